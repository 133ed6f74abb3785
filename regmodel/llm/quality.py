"""Operator 7: quality rules by a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets.  Two multinomials over the buckets are counted:
one over the trusted target (documents labelled as good), one over the raw corpus (all documents).  A document's score
is the mean over its n-grams of the logarithm of the ratio of their probabilities, so that length cancels out; every
document is judged against one fixed cut.  Rules on length and repetition come first.

All of it is DataFrame expressions.  Counting aggregates before it shuffles, to one row a bucket and task at most; scoring
looks a bucket up in an array of ``BUCKETS`` numbers and doesn't shuffle at all.  All trusted rows count, whatever their number: their
documents are found by a join on the id.

Defined cases: a null text has no words and fails the rules; labels that are null don't count; without trusted rows
the ratio is that of a uniform target; equal rows are judged alike, null and repeated ids stay; empty tables give empty
results; extra columns are ignored (``judge``) or kept (``keep_good``); a very long text is one row of hashes, judged whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
#: log2 of the most bits of the map of trusted ids: 512 KB.
MAP_BITS = 22
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
CUT = -0.15

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def _bucket(*h: Column) -> Column:
    return F.pmod(h[0] if len(h) == 1 else F.xxhash64(*h), F.lit(BUCKETS)).cast("int")


def _buckets(h: Column) -> Column:
    """Buckets of words, then of pairs."""
    one = F.transform(h, lambda x: _bucket(x))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: _bucket(F.get(h, i), x))
    return F.concat(one, two)


def trusted(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").cast("long").alias("trusted_id")).where(F.col("trusted_id").isNotNull()).distinct()


def _maybe_in(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for all ids and for few others, by a map of at most 2**MAP_BITS bits: it thins out the rows that are shuffled to an
    exact join.  A full map thins out nothing, and the join is as exact."""
    bits = min(max(math.ceil(math.log2(max(ids.count(), 1))) + 4, 10), MAP_BITS)
    slot = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    words = [0] * (1 << (bits - 6))
    at = slot(F.col("trusted_id"))
    for r in ids.groupBy(F.shiftright(at, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(xxhash64(trusted_id) & {(1 << bits) - 1} & 63 AS INT))")).alias("v")).collect():
        words[r["k"]] = r["v"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda c: F.getbit(F.get(table, F.shiftright(slot(c), 6).cast("int")), slot(c).bitwiseAND(63).cast("int")) == 1


def _counts(texts: DataFrame) -> dict[int, int]:
    """How often each bucket comes: BUCKETS rows at most."""
    rows = texts.select(F.explode(bind(word_hashes(F.col("text")), _buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def ratios(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """By bucket, the logarithm of its probability in the target over that in the raw corpus, each count plus one.
    target: trusted_id of all trusted rows; the join to them shuffles little more than those rows.  The result has BUCKETS numbers."""
    rows, target = common.pick(docs, id_col, text_col), common.materialize(target, "trusted")
    raw = _counts(rows)
    good = _counts(rows.where(_maybe_in(target)(F.col("doc_id"))).join(target, F.col("doc_id") == F.col("trusted_id"), "left_semi"))
    all_raw, all_good = sum(raw.values()) + BUCKETS, sum(good.values()) + BUCKETS
    return [math.log((good.get(b, 0) + 1) / all_good) - math.log((raw.get(b, 0) + 1) / all_raw) for b in range(BUCKETS)]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(h: Column) -> Column:
    """Words within windows of WINDOW words that the text holds twice or more."""
    n = F.size(h) - F.lit(WINDOW) + 1
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(pairs: Column) -> Column:
        same = lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
        places = F.sort_array(F.transform(F.filter(pairs, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def repeats(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(bind(pairs, covered))

    return F.when(n < 2, 0).otherwise(bind(windows, repeats)).cast("long")


def _score(h: Column, table: list[float]) -> Column:
    lam = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    n = F.size(h)
    pair = lambda i: F.when(i + 1 < n, F.get(lam, _bucket(F.get(h, i), F.get(h, i + 1)))).otherwise(0.0)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.get(lam, _bucket(F.get(h, i))) + pair(i))
    return F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)


def verdict(text: Column, table: list[float], cut: float = CUT) -> Column:
    """n_words, n_repeat_words, llr, base_failed and kept of a text, as one struct."""

    def measures(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words"), _score(h, table).alias("llr"))

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in ("n_words", "n_repeat_words", "llr")], failed.alias("base_failed"), (~failed & (m["llr"] >= cut)).alias("kept"))

    return bind(bind(word_hashes(F.coalesce(text, F.lit(""))), measures), judged)


def judge(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept of every document."""
    table = ratios(docs, trusted(labels, id_col=id_col), id_col, text_col)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gap = lambda drop: F.translate(text, drop, "")
    out = common.pick(docs, id_col, text_col).select(
        "doc_id",
        verdict(text, table, cut).alias("v"),
        F.length(gap(SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(gap(SYMBOLS))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.select("doc_id", "v.n_words", "word_chars", "n_symbols", "n_dup_lines", "v.n_repeat_words", "v.llr", "v.base_failed", "v.kept")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, as they are."""
    table = ratios(docs, trusted(labels, id_col=id_col), id_col, text_col)
    return docs.where(verdict(F.col(f"`{text_col}`"), table, cut)["kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
