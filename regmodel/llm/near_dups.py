"""Operator 6: near duplicates by ProbMinHash, banding and verification.

A document is its set of five-word shingles, each weighted by ``weights`` of its occurrences.  ProbMinHash: every shingle has
arrivals of a Poisson process whose rate is its weight, each arrival falls into one of ``REGISTERS`` registers, and a
register keeps the shingle that arrived first; a shingle is given up as soon as its next arrival is later than all kept
ones.  Two documents agree in a register with the probability Jaccard similarity of their weighted shingles.

Equal texts are one node from the start.  Nodes that agree in all registers of a band are candidates.  First every bucket
is compared with one of its nodes only, the one with most bucket mates, which makes most classes whole.  What then still
lies in one bucket without being connected may pair up too, but most of it can be ruled out exactly: a text shares at
most those shingles that any other open text has, which for the usual edited copy is too few for the threshold.  Only pairs
that this bound leaves are compared, each in its first common bucket; no class is expanded into pairs, and no candidate
that could be a link is left out.  Candidates are verified exactly: Jaccard similarity of their shingle sets of ``THRESHOLD`` or more makes a link.  Classes
are the connected components of links, found by spreading the smallest label along links until nothing changes.

Defined cases: a null text counts as empty; texts without words are near duplicates only of equal texts; a text of one to four words is one shingle; rows with
equal texts have one class whatever their ids; class_id is the smallest doc_id of the class (null if all are null);
an empty table gives an empty result; extra columns are ignored (``classes``) or kept (``keep_one``); a very long text is
hashed and its arrivals drawn in parts, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: How much weight repetition can add to a shingle.
SPREAD = 0.1
#: Shingles, and texts, whose arrivals are drawn together.
PART, PART_TEXTS = 1 << 15, 1 << 12
_SEED = np.uint64(0x5851F42D4C957F2D)


def shingles(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice, their text's index and occurrences; sorted by text."""
    g, d, _ = words.grams(h, counts, SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.array([words.mix(np.array([hash_all(h[begin[i] : begin[i] + counts[i]])], np.uint64))[0] for i in short], np.uint64)
        g, d = np.concatenate([g, extra]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])) if len(g) else np.zeros(0, np.int64)
    return g[first], d[first], np.diff(np.append(first, len(g)))


def hash_all(h: np.ndarray) -> np.uint64:
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * np.uint64(0xD6E8FEB86659FD93) + x
    return out


def prob_min_hash(g: np.ndarray, d: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n, m) of n texts: the shingle of the first arrival in each register.  Texts without shingles: zeros."""
    first, sig = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    for at in range(0, len(g), PART):
        part = slice(at, at + PART)
        _arrive(g[part], d[part], 1.0 / weight[part], first, sig, n, m)
    return sig.reshape(n, m)


def _arrive(g: np.ndarray, d: np.ndarray, rate: np.ndarray, first: np.ndarray, sig: np.ndarray, n: int, m: int) -> None:
    """The arrivals of some shingles, as long as they may still be the first somewhere."""
    at, done, many = np.zeros(len(g)), 0, 1
    while len(g):
        # the next `many` arrivals of each shingle: exponential gaps, registers drawn by the same hash
        k = np.arange(done + 1, done + many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = words.mix((g[:, None] ^ _SEED) + k[None, :])
        t = at[:, None] + np.cumsum(-np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52), axis=1) * rate[:, None]
        slot = (d[:, None] * m + ((r & np.uint64(0xFFF)) * np.uint64(m) >> np.uint64(12)).astype(np.int64)).ravel()
        flat, owner = t.ravel(), np.repeat(g, many)
        better = flat < first[slot]
        slot, flat, owner = slot[better], flat[better], owner[better]
        np.minimum.at(first, slot, flat)
        won = flat == first[slot]
        sig[slot[won]] = owner[won]
        latest = first.reshape(n, m).max(axis=1)
        live = t[:, -1] < latest[d]
        at, g, d, rate = t[live, -1], g[live], d[live], rate[live]
        done += many
        many = min(16, many * 2)


def weights(occurrences: np.ndarray) -> np.ndarray:
    """1 for a shingle that stands once, towards 1 + SPREAD for one that stands often: whatever repeats, the similarity of weighted shingles
    is at least that of the sets over 1 + SPREAD."""
    return 1 + SPREAD * (1 - 1 / occurrences)


def groups(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts first to end (exclusive) of about PART shingles together, and of at most PART_TEXTS; a larger text is alone."""
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        j = int(np.searchsorted(ends, ends[i] - counts[i] + PART, side="right"))
        j = min(max(j, i + 1), i + PART_TEXTS, len(counts))
        yield i, j
        i = j


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (16 bytes: a digest of the text), bands (a hash of each; none for a text without words).  docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, h in words.hashed(batch.column(1)):
                ends = np.cumsum(counts)
                for i, j in groups(counts):
                    mine, n = counts[i:j], j - i
                    g, d, c = shingles(h[ends[i] - counts[i] : ends[j - 1]], mine)
                    sig = prob_min_hash(g, d, weights(c), n)
                    bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _SEED, n, axis=0)
                    for k in range(ROWS):
                        bands = words.mix(bands + sig[:, k::ROWS][:, :BANDS])
                    some = mine > 0
                    offsets = pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * BANDS)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + i, n), batch.column(2).slice(first + i, n), pa.ListArray.from_arrays(offsets, pa.array(bands[some].ravel().view(np.int64)))], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", "text", _node(F.col("text")).alias("node")).mapInArrow(run, "doc_id long, node binary, bands array<long>")


def _node(text):
    return F.unhex(F.md5(text.cast("binary")))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, s: sorted distinct shingles (64-bit hashes), as bytes.  texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, h in words.hashed(batch.column(1)):
                g, d, _ = shingles(h, counts)
                g = g.astype("<u8")
                ends = np.cumsum(np.bincount(d, minlength=len(counts)))
                sets = [g[lo:hi].tobytes() for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(sets, pa.binary())], names=["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node binary, s binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s, t = (batch.column(k) for k in range(4))
            keep = []
            for x, y in zip(s, t, strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                n, m = len(x), len(y)
                if min(n, m) < threshold * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common_ = int((both[1:] == both[:-1]).sum())
                keep.append(common_ >= threshold * (n + m - common_) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes of links (a, b)."""
    both = common.materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = common.materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        step = common.materialize(labels.join(near, "node").select("node", F.least("label", "l").alias("next"), "label"), "steps")
        # a label's own label is smaller still: jumping there makes the number of rounds logarithmic in long chains
        jump = common.materialize(step.groupBy("label").agg(F.min("next").alias("to")), "jumps")
        new = common.materialize(step.join(jump, "label").select("node", F.least("next", "to").alias("label"), (F.least("next", "to") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def unshared(sets: DataFrame) -> DataFrame:
    """node, n, k: the size of each shingle set, and how many of its shingles another set of the table has too."""
    schema = pa.schema([("x", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8").reshape(-1, 2).astype(np.int64)
            parts = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
            row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            x = np.concatenate([*parts, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(nodes[row, 0]), pa.array(nodes[row, 1])], schema=schema)

    halves = [F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("long").alias(name) for at, name in ((1, "hi"), (9, "lo"))]
    single = sets.select("node", "s").mapInArrow(spread, "x long, hi long, lo long").groupBy("x").agg(F.count("*").alias("c"), F.min("hi").alias("hi"), F.min("lo").alias("lo")).where("c = 1")
    own = single.groupBy("hi", "lo").agg(F.count("*").alias("u"))
    sized = sets.select("node", F.floor(F.octet_length("s") / 8).alias("n"), *halves)
    return sized.join(own, ["hi", "lo"], "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("k"))


def still_open(rows: DataFrame, sets: DataFrame, threshold: float, rounds: int = 2) -> DataFrame:
    """Of rows (band, h, node, label) those that could link to another class of their bucket, with n and k.  A link needs a common part of
    threshold / (1 + threshold) of both sizes together, and k bounds it from above; each round counts k among what is left."""
    share = threshold / (1 + threshold)
    for _ in range(rounds):
        size = unshared(of_nodes(sets, rows))
        sized = common.materialize(rows.select("band", "h", "node", "label").join(size, "node"), "sized-rows")
        rows = in_mixed(sized, F.min("n").alias("least")).where(F.col("k") + 1e-9 >= share * (F.col("n") + F.greatest(F.col("least").cast("double"), threshold * F.col("n")))).drop("least")
        rows = common.materialize(rows, "open-rows")
    return common.materialize(in_mixed(rows), "open-rows")


def of_nodes(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a table by node whose node is one of rows."""
    nodes = common.materialize(rows.select("node").distinct(), "some-nodes")
    return table.where(common.maybe_in(nodes, "node")(F.col("node"))).join(nodes, "node", "left_semi")


def in_mixed(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows (band, h, label, ...) of a stored table whose bucket holds two labels or more, with further aggregates of the bucket.  Aggregates
    are stored first: a join of two tables as they are is one that Spark splits where a bucket is large."""
    mixed = rows.groupBy("band", "h").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), *more).where("l0 <> l1").drop("l0", "l1")
    return rows.join(common.materialize(mixed, "mixed-buckets"), ["band", "h"])


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node of every row; node, label of the nodes with links).  docs: doc_id, text."""
    sig = common.materialize(signatures(docs), "signatures")
    nodes = sig.groupBy("node").agg(F.first("bands").alias("bands"))
    entries = common.materialize(nodes.select("node", F.posexplode("bands").alias("band", "h")), "band-entries")
    shared = common.materialize(entries.groupBy("band", "h").agg(F.count("*").alias("size")).where("size > 1"), "shared-buckets")
    buckets = common.materialize(entries.where(common.maybe_in(shared, "h")(F.col("h"))).join(shared, ["band", "h"]), "buckets")
    mates = buckets.groupBy("node").agg(F.sum("size").alias("mates"))
    known = common.materialize(buckets.select("band", "h", "node").join(mates, "node"), "bucket-mates")
    centres = known.groupBy("band", "h").agg(F.max(F.struct("mates", "node")).alias("c")).select("band", "h", F.col("c.node").alias("centre"))
    star = known.join(common.materialize(centres, "centres"), ["band", "h"]).where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    star = common.materialize(star.distinct(), "pairs")
    wanted = common.materialize(known.select("node").distinct(), "wanted-nodes")
    texts = docs.select(_node(F.col("text")).alias("node"), "text").where(common.maybe_in(wanted, "node")(F.col("node")))
    texts = texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi")  # copies go before anything is shuffled
    sets = common.materialize(shingle_sets(texts), "shingle-sets")
    links = common.materialize(verified(star, sets, threshold), "links")
    first = components(links)

    # what shares a bucket and is not connected yet
    own = buckets.select("band", "h", "node").join(first, "node", "left").select("band", "h", "node", F.coalesce("label", "node").alias("label"))
    rows = common.materialize(in_mixed(common.materialize(own, "bucket-labels")), "mixed-rows")
    rows = still_open(rows, sets, threshold)
    rows = rows.join(of_nodes(sig.select("node", "bands"), rows).groupBy("node").agg(F.first("bands").alias("bands")), "node")
    rows = common.materialize(rows, "open-buckets")
    parts = rows.groupBy("band", "h", "label").agg(F.count("*").alias("size"))
    major = parts.groupBy("band", "h").agg(F.max(F.struct("size", "label")).alias("top")).select("band", "h", F.col("top.label").alias("major"))
    rows = common.materialize(rows.join(common.materialize(major, "major-labels"), ["band", "h"]), "major-rows")
    side = lambda p, df: df.select("band", "h", *["major"] * (p == "b"), *[F.col(c).alias(f"{p}_{c}") for c in ("node", "label", "n", "k", "bands")])
    minor, other = side("a", rows.where("label <> major")), side("b", rows)
    c = F.col
    earlier = F.exists(F.zip_with(F.slice("a_bands", 1, c("band")), F.slice("b_bands", 1, c("band")), lambda x, y: x == y), lambda x: x)
    fits = (F.least("a_n", "b_n") + 1e-9 >= threshold * F.greatest("a_n", "b_n")) & (F.least("a_k", "b_k") + 1e-9 >= threshold / (1 + threshold) * (c("a_n") + c("b_n")))
    once = (c("b_label") == c("major")) | (c("a_node") < c("b_node"))
    pairs = minor.join(other, ["band", "h"]).where((c("a_label") != c("b_label")) & fits & once & ~earlier)
    pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), F.least("a_label", "b_label").alias("la"), F.greatest("a_label", "b_label").alias("lb"))
    pairs = common.materialize(pairs.dropDuplicates(["a", "b"]).join(star, ["a", "b"], "left_anti"), "cross-pairs")
    open_sets = of_nodes(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    more = common.materialize(verified(pairs.select("a", "b"), common.materialize(open_sets, "open-sets"), threshold).join(pairs, ["a", "b"]).select("la", "lb").distinct().toDF("a", "b"), "class-links")
    if not more.limit(1).count():
        return sig.select("doc_id", "node"), first
    joined = components(more).toDF("label", "joined")
    alone = joined.select(F.col("label").alias("node"), "label").join(first.select("node"), "node", "left_anti")  # texts that are linked only now
    both = first.unionByName(alone.select("node", "label")).join(joined, "label", "left")
    return sig.select("doc_id", "node"), both.select("node", F.coalesce("joined", "label").alias("label"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of the class), class_size (rows), kept (this row is the one that stays:
    of the smallest doc_id and, of its texts, the one of the smallest digest)."""
    rows, labels = labelled(common.pick(docs, id_col, text_col), threshold)
    rows = rows.join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    rows = common.materialize(rows, "labelled")
    found = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))
    return rows.join(common.materialize(found, "groups"), "label").select("doc_id", "class_id", "class_size", kept.alias("kept"), "node")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs from each class, as it is; of rows equal in id and text one stays.  Rows that are alone in their class go
    straight through; only the others are shuffled."""
    rows = classes(docs, threshold, id_col, text_col).where("class_size > 1")
    rows = common.materialize(rows.select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"), "kept").distinct(), "shared-classes")
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row_"), F.col(f"`{id_col}`").cast("long").alias("kept_id"), _node(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("kept_node"))
    keyed = keyed.withColumn("shared_", common.maybe_in(rows, "kept_node")(F.col("kept_node")))
    same = F.col("x.kept_id").eqNullSafe(F.col("y.kept_id")) & (F.col("x.kept_node") == F.col("y.kept_node"))
    some = keyed.where("shared_").alias("x").join(rows.alias("y"), same, "left").select("x.row_", "x.kept_node", "y.kept")
    one = some.where("kept").dropDuplicates(["kept_node"]).select("row_")
    every = keyed.where("NOT shared_").select("row_").union(some.where("kept IS NULL").select("row_")).union(one)
    return every.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).drop("node")
