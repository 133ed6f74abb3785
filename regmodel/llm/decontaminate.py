"""Operator 3: benchmark decontamination by greedy string tiling.

Seeds are windows of ``MIN_TILE`` words shared by a document and a benchmark item.  A bit map of bounded size over the
hashes of the items' windows goes to all tasks; documents are read once, and only the regions around possible seeds
leave a task: they are joined to the items' windows by hash.  For each document and item that share a seed, greedy
string tiling marks the longest match that overlaps no earlier one, again and again, found by running Karp-Rabin over
the words not yet marked, down to tiles of ``MIN_TILE`` words.  The share of the item's words under tiles is its coverage;
passages in another order are still covered.  From ``THRESHOLD`` on a document is contaminated.

Words are compared lower-cased, by 64-bit hashes.

Defined cases: a null text counts as empty; items of fewer words than ``MIN_TILE`` match nothing; documents are told
apart by id and text, so that repeated and null ids are judged each by its own text; without benchmark rows nothing is
contaminated; equal coverages name the smallest item_id; empty tables give empty results; extra columns are ignored
(``find``) or kept (``keep_clean``); a very long text is read whole, and only stretches around possible seeds leave its task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

MIN_TILE = 5
THRESHOLD = 0.5
#: Tasks that a seed is dealt to.
SALT = 16
_ROLL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# --- tiling ---------------------------------------------------------------------------------------------------------
def _runs(marked: list[bool], bounds: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of at least size unmarked words within regions; bounds: where regions start, and the end."""
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        start = lo
        for i in range(lo, hi + 1):
            if i == hi or marked[i]:
                if i - start >= size:
                    yield start, i
                start = i + 1


def _rolling(values: list[int], start: int, end: int, size: int, drop: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each window of size words, each from the one before."""
    h = 0
    for i in range(start, start + size):
        h = (h * _ROLL + values[i]) & _MASK
    yield start, h
    for i in range(start + 1, end - size + 1):
        h = ((h - values[i - 1] * drop) * _ROLL + values[i + size - 1]) & _MASK
        yield i, h


def tiles(item: list[int], text: list[int], bounds: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, words) of the tiles, none of which overlap.

    One pass looks for matches of at least ``size`` words; only such are kept whose words before differ (or are marked, or lie in
    another region), so that there is one for each stretch that agrees, however often a word repeats.  A longer match than twice the size
    starts the pass again at its length; matches are marked from the longest on, then the size is halved.  Of equally long
    matches the first in the item and then in the text is taken.  What earlier tiles leave of a match waits until its own length is due.
    """
    in_item, in_text = [False] * len(item), [False] * len(text)
    found: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        drop = pow(_ROLL, size - 1, 1 << 64)
        table: dict[int, list[int]] = {}
        runs = list(_runs(in_text, bounds, size))
        for s, e in runs:
            for place, h in _rolling(text, s, e, size, drop):
                table.setdefault(h, []).append(place)
        ends, starts = {}, set()
        for s, e in runs:
            ends.update(dict.fromkeys(range(s, e), e))
            starts.add(s)
        matches, longest = [], 0
        for s, e in _runs(in_item, [0, len(item)], size):
            for a, h in _rolling(item, s, e, size, drop):
                before = item[a - 1] if a > s else None
                for b in table.get(h, ()):
                    if before is not None and text[b - 1] == before and b not in starts:
                        continue  # part of the match that begins a word earlier
                    k, most = 0, min(e - a, ends[b] - b)
                    while k < most and item[a + k] == text[b + k]:
                        k += 1
                    if k >= size:
                        matches.append((-k, a, b))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(matches)
        while matches:
            k, a, b = heapq.heappop(matches)
            free = [i for i in range(-k) if not (in_item[a + i] or in_text[b + i])]
            if len(free) == -k:
                in_item[a : a - k] = [True] * -k
                in_text[b : b - k] = [True] * -k
                found.append((a, b, -k))
                continue
            at = 0
            while at < len(free):  # stretches that no earlier tile took
                to = at
                while to + 1 < len(free) and free[to + 1] == free[to] + 1:
                    to += 1
                if to + 1 - at >= size:
                    heapq.heappush(matches, (at - to - 1, a + free[at], b + free[at]))
                at = to + 1
        if size == least:
            return found
        size = max(least, size // 2)


# --- the join -------------------------------------------------------------------------------------------------------
def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, ws: hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, h in words.hashed(batch.column(1)):
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.ListArray.from_arrays(offsets, pa.array(_signed(h)))], names=["item_id", "ws"])

    return common.pick(benchmark, id_col, text_col).mapInArrow(run, "item_id long, ws array<long>")


def item_seeds(items: DataFrame, least: int = MIN_TILE) -> DataFrame:
    """item_id, seed: hashes of the windows of least words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([len(x) for x in lists], np.int64)
            g, d, _ = words.grams(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), counts, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(_signed(g))], names=["item_id", "seed"])

    return items.mapInArrow(run, "item_id long, seed long").distinct()


def seed_map(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A map of the seeds, and the log2 of its bits."""
    bits = common.map_bits(seeds.count())
    return common.bit_map(seeds, "seed", bits), bits


def regions(docs: DataFrame, marks: tuple[np.ndarray, int], least: int = MIN_TILE) -> DataFrame:
    """doc_id, text_key, ws, bounds, seeds for the documents that may share a seed: the words of the stretches that
    possible seeds cover, where each stretch starts, and the possible seeds."""
    bits, packed = marks[1], docs.sparkSession.sparkContext.broadcast(marks[0])
    schema = "doc_id long, text_key binary, ws array<long>, bounds array<int>, seeds array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        live, mask = packed.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            rows: list[tuple] = []
            for first, counts, h in words.hashed(batch.column(1)):
                g, d, place = words.grams(h, counts, least)
                at = (g & mask).astype(np.int64)
                hit = np.flatnonzero(live[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                begin = np.cumsum(counts) - counts
                for part in np.split(hit, np.flatnonzero(np.diff(d[hit])) + 1) if len(hit) else ():
                    doc = int(d[part[0]])
                    at = place[part]
                    cover = np.unique((at[:, None] + np.arange(least)).ravel())
                    starts = np.flatnonzero(np.diff(cover, prepend=-9) > 1)
                    text = batch.column(1)[first + doc].as_py().encode()
                    rows.append((batch.column(0)[first + doc].as_py(), hashlib.md5(text).digest(), _signed(h[begin[doc] + cover]), starts.astype(np.int32), _signed(np.unique(g[part]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "text_key", "ws", "bounds", "seeds"])

    return docs.mapInArrow(run, schema)


def coverages(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE) -> DataFrame:
    """doc_id, text_key, item_id, coverage for every document and item that share a seed.  docs: doc_id, text."""
    items = common.materialize(item_words(benchmark), "items")
    seeds = common.materialize(item_seeds(items, least), "item-seeds")
    found = common.materialize(regions(docs, seed_map(seeds), least), "regions")
    # a seed may stand in very many documents: it is dealt to SALT tasks by the document, and the benchmark's side goes to all of them
    left = found.select("doc_id", "text_key", F.pmod(F.xxhash64("text_key"), F.lit(SALT)).cast("int").alias("salt"), F.explode("seeds").alias("seed"))
    right = seeds.select("item_id", "seed", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = left.join(right, ["seed", "salt"]).select("doc_id", "text_key", "item_id").distinct()
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    once = found.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "ws", "bounds")
    full = pairs.alias("a").join(once.alias("b"), same).select("a.doc_id", "a.text_key", "a.item_id", "ws", "bounds").join(items.withColumnRenamed("ws", "item_ws"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, bounds, item in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                # of the regions, only words that the item has too can lie in a tile
                shared = set(item)
                bound = set(bounds)
                kept, cuts, inside = [], [], False
                for i, w in enumerate(text):
                    if w in shared:
                        if not inside or i in bound:
                            cuts.append(len(kept))
                        kept.append(w)
                        inside = True
                    else:
                        inside = False
                cuts.append(len(kept))
                got.append(sum(k for *_, k in tiles(item, kept, cuts, least)) / len(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.float64())], names=["doc_id", "text_key", "item_id", "coverage"])

    return full.select("doc_id", "text_key", "item_id", "ws", "bounds", "item_ws").mapInArrow(run, "doc_id long, text_key binary, item_id long, coverage double")


def _verdicts(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int) -> DataFrame:
    best = F.struct((-F.col("coverage")).alias("c"), F.col("item_id").alias("i"))
    return coverages(docs, benchmark, least).groupBy("doc_id", "text_key").agg(F.min(best).alias("best"), F.sum((F.col("coverage") >= threshold).cast("long")).alias("n"))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, contaminated, n_items (covered from the threshold on), item_id and coverage of the one with
    the largest coverage (null and 0 where no seed is shared)."""
    docs = common.pick(docs, id_col, text_col)
    keyed = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    got = _verdicts(docs, benchmark, threshold, least)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return keyed.alias("a").join(got.alias("b"), same, "left").select(F.col("a.doc_id").alias("doc_id"), (n > 0).alias("contaminated"), n.alias("n_items"), F.col("best.i").alias("item_id"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, as they are.  A bit map of the contaminated rows' keys lets the others pass where they lie:
    only rows that may be among them are shuffled, to an exact join."""
    bad_id, bad_key = common.fresh(docs, "bad_id"), common.fresh(docs, "bad_key")
    bad = _verdicts(common.pick(docs, id_col, text_col), benchmark, threshold, least).where("n > 0").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key))
    bad = common.materialize(bad, "contaminated")
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    maybe = common.maybe_in(bad, bad_key)(key)
    exact = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(bad_id)) & (key == F.col(bad_key))
    return docs.where(~maybe).unionAll(docs.where(maybe).join(bad, exact, "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
