"""Many texts against many phrases (F9, F12): which texts hold which phrases, without pairing them first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import values

#: Phrases that one automaton holds at most, on average, and texts of a group that one share holds, likewise.
SLICE, SHARE = 2000, 20_000


def holds(texts: DataFrame, phrases: DataFrame, slice_size: int = SLICE, share_size: int = SHARE) -> DataFrame:
    """grp, key, phrase: every text that holds a phrase of its group, each once.  texts: grp, key, text; phrases: grp, phrase (not empty; null
    ones match nothing), all strings.

    Phrases of a group are dealt by hash into slices of about ``slice_size``.  A slice is one automaton (Aho-Corasick) that reads each
    text of the group once, whatever the number of phrases.  Texts of a group are dealt into shares of about ``share_size``, so that a large
    group fills many tasks and a small one's phrases go to one place; a task gets a slice's phrases first and then streams the texts by.
    """
    phrases = phrases.where("phrase <> ''").select("grp", "phrase").distinct()
    slices = phrases.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / slice_size), F.lit(1)).cast("int").alias("slices"))
    texts = texts.where("text IS NOT NULL")
    slices = slices.join(texts.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / share_size), F.lit(1)).cast("int").alias("shares")), "grp")
    dealt = phrases.join(slices, "grp").select("grp", F.pmod(F.xxhash64("phrase"), F.col("slices")).cast("int").alias("slice"), "shares", "phrase")
    sliced = dealt.groupBy("grp", "slice", "shares").agg(F.collect_list("phrase").alias("phrases"))
    everywhere = sliced.select("grp", "slice", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), "phrases")
    read = texts.join(slices, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "key", "text", F.lit(None).cast("array<string>").alias("phrases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, at = None, None
        for batch in batches:
            found: list[tuple[str, str, str]] = []
            for grp, part, share, kind, key, text, words in zip(*map(values, batch.columns), strict=True):
                if kind == 0:
                    at, automaton = (grp, part, share), ahocorasick.Automaton()
                    for w in words:
                        automaton.add_word(w, w)
                    automaton.make_automaton()
                elif at == (grp, part, share):  # else the slice is empty
                    found += [(grp, key, w) for w in {w for _, w in automaton.iter(text)}]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["grp", "key", "phrase"])

    rows = everywhere.unionByName(read).repartition("grp", "slice", "share").sortWithinPartitions("grp", "slice", "share", "kind")
    return rows.select("grp", "slice", "share", "kind", "key", "text", "phrases").mapInArrow(run, "grp string, key string, phrase string")


def held_of(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """texts with an array of the phrases that a text holds, in place of the text; rows without any are left out.  texts: text comes last.  For phrases that are few
    (counted first): they go to all tasks as one automaton, and no text is shuffled."""
    phrases = sorted({p for p in phrases if p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in phrases:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({p for _, p in automaton.iter(t)}) if t and phrases else [] for t in values(batch.columns[-1])]
            kept = pa.array([bool(f) for f in found], pa.bool_())
            columns = [*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "phrases"]).filter(kept)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema][:-1]
    return texts.mapInArrow(run, ", ".join([*kinds, "phrases array<string>"]))


#: Titles that are looked for one by one; more become an automaton.
FEW = 8


def places(n: int, m: int, own: Column, other: Column, slice_size: int = SLICE, share_size: int = SHARE) -> Column:
    """Where ``titles_met`` needs an article (article_id, title, content) of side n of a pair of sides, which have ``own`` and ``other`` articles: an array of
    structs.  Its content meets every slice of the other side's titles, its title every share of the other side's contents."""
    parts = lambda count, size: F.greatest(F.ceil(count / size), F.lit(1)).cast("int")
    dealt = lambda count, size: F.pmod(F.xxhash64("article_id"), parts(count, size)).cast("int")
    place = lambda side, part, share, reads, text: F.struct(F.lit(side).alias("side"), part.alias("slice"), share.alias("share"), F.lit(reads).alias("reads"), text.alias("text"))
    as_text = F.transform(F.sequence(F.lit(0), parts(other, slice_size) - 1), lambda i: place(n, i, dealt(own, share_size), True, F.col("content")))
    as_title = F.transform(F.sequence(F.lit(0), parts(other, share_size) - 1), lambda i: place(m, dealt(own, slice_size), i, False, F.col("title")))
    return F.filter(F.concat(as_text, as_title), lambda p: p["text"] != "")


def titles_met(rows: DataFrame) -> DataFrame:
    """grp, article_id1, article_id2: of two sides of a group the articles of which one's content holds the other's title, if one of the two is ``about`` the topic.
    rows: grp, article_id, about, and the columns of ``places``.

    Titles and contents of a group, slice and share come to one task, titles first, and go by there: nothing is joined back.  A pair that is met
    both ways comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, titles, automaton = None, {}, None
        for batch in batches:
            found: list[tuple[int, str, str]] = []
            for grp, side, part, share, reads, key, text, about in zip(*map(values, batch.columns), strict=True):
                if at != (grp, side, part, share):
                    at, titles, automaton = (grp, side, part, share), {}, None
                if not reads:
                    titles.setdefault(text, []).append((key, about))
                    continue
                if len(titles) <= FEW:
                    hits = [t for t in titles if t in text]
                else:
                    if automaton is None:
                        automaton = ahocorasick.Automaton()
                        for t in titles:
                            automaton.add_word(t, t)
                        automaton.make_automaton()
                    hits = {t for _, t in automaton.iter(text)}
                for t in hits:
                    found += [(grp, key, other) if side == 1 else (grp, other, key) for other, too in titles[t] if about or too]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["grp", "article_id1", "article_id2"])

    order = ["grp", "side", "slice", "share"]
    rows = rows.repartition(*order).sortWithinPartitions(*order, "reads")
    return rows.select(*order, "reads", "article_id", "text", "about").mapInArrow(run, "grp long, article_id1 string, article_id2 string")
