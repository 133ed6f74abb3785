"""Operator 11: periodic runs of words by multi-scale minimizers.

A run is a longest stretch of words that repeats with a smallest period q, of at least ``LEAST`` words and ``TIMES`` periods.
Periods up to ``DIRECT`` are too short for minimizers: for each of them the whole text is compared with itself that many
words on.  Longer periods are dealt to scales.  A scale with periods over ``low`` and up to ``high`` looks at stretches of
``high`` words, of which no two within a period are equal, so that inside a run a stretch comes again after exactly q
words and not before.  Window minima of the stretches' hashes (minimizers) fall on the same places of each period, and the
window is short enough for at least one minimum and the same one a period later to lie in the shortest run of the scale.
So neighbouring equal minimizers at a distance within the scale are seeds for all runs; each is extended word by word in
both directions, and the period is proved to be the smallest one.  A text without equal minimizers at a scale has no run
at this and all larger scales and is left behind: what ordinary text costs is the first scale.

A word is dropped if a run contains it after that run's first q words; the others, joined by one space, are the collapsed text.

A text is the work of one task, and nothing is shuffled.  Memory follows a slice of about ``SLICE`` bytes or, if larger, the longest text.

Defined cases: a null text counts as empty, has no runs and collapses to the empty text; a null doc_id stays null and is
never planted; repeated rows give one row each; an empty table gives an empty result; extra columns are ignored; a very
long text is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

LEAST, TIMES = 24, 3
DIRECT = 8
SLICE = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUNS = "array<struct<start:long,length:long,period:long>>"


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, window) for all periods over DIRECT that a text of so many words has room for.  In a run of TIMES periods of low + 1
    words or more, a window of stretches and the same window a period later both fit."""
    low = DIRECT
    while TIMES * (low + 1) <= longest:
        high = low + low // 2
        yield low, high, (TIMES - 1) * (low + 1) - high + 1
        low = high


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window of so many places."""
    done = 1
    while done < width and len(x):
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places that are the minimum of at least one window, ties included: where the largest of the minima of a place's windows is its own value."""
    low = _slide(h, width, np.minimum)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many places of two views agree from the first on."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(done + step, n)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, step = end, min(2 * step, 1 << 16)
    return n


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _smallest(x: np.ndarray, start: int, period: int) -> bool:
    """Whether no part of the period repeats through it.  A stretch of two periods or more has no other smaller period than a divisor."""
    return not any((x[start : start + period] == x[start + d : start + d + period]).all() for d in (period // p for p in _primes(period)))


def find_runs(ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of texts that lie one after the other: numbers of words (not negative), words of each text."""
    n = len(counts)
    own = np.repeat(np.arange(n), counts + 1)
    place = np.arange(len(own)) - np.repeat(np.cumsum(counts + 1) - counts - 1, counts + 1)
    ends = np.cumsum(counts + 1) - 1
    x = np.empty(len(own), np.int64)
    inside = np.ones(len(own), bool)
    inside[ends] = False
    x[inside] = ids
    x[ends] = -1 - np.arange(n)  # a word that comes once ends each text: nothing repeats across it
    found: list[tuple[int, int, int, int]] = []

    def keep(start: int, length: int, period: int) -> None:
        if length >= max(LEAST, TIMES * period) and _smallest(x, start, period):
            found.append((int(own[start]), int(place[start]), length, period))

    for q in range(1, DIRECT + 1):
        same = np.zeros(max(len(x) - q, 0) + 2, np.int8)
        same[1:-1] = x[q:] == x[: max(len(x) - q, 0)]
        edges = np.flatnonzero(np.diff(same))
        for a, b in edges.reshape(-1, 2)[(edges[1::2] - edges[::2] + q) >= max(LEAST, TIMES * q)].tolist():
            keep(a, b - a + q, q)

    live = np.ones(n, bool)
    h, span = words.mix(x.view(np.uint64) + np.uint64(1 << 32)), 1  # hashes of the span words from each place on
    for low, high, width in scales(int(counts.max(initial=0))):
        stay = live & (counts >= TIMES * (low + 1))
        if not stay.any():
            break
        if stay.sum() < live.sum():
            mask = stay[own]
            x, own, place, h = x[mask], own[mask], place[mask], h[mask[: len(h)]]
        live = stay
        while 2 * span <= high:
            h = words.mix(h[:-span] * _STEP + h[span:])
            span *= 2
        rest = high - span
        g = words.mix(h[: len(h) - rest] * _STEP + h[rest:] + np.uint64(high))
        at = minimizers(g, width)
        at = at[np.argsort(g[at], kind="stable")]
        twin = (g[at[1:]] == g[at[:-1]]) & (own[at[1:]] == own[at[:-1]])
        live = live & np.isin(np.arange(n), own[at[:-1][twin]])
        gap = at[1:] - at[:-1]
        seed = np.flatnonzero(twin & (gap > low) & (gap <= high))
        seed = seed[np.lexsort((at[seed], gap[seed]))]
        period, end = 0, 0
        for p, d in zip(at[seed].tolist(), gap[seed].tolist(), strict=True):
            if d == period and p < end:
                continue  # in the stretch that the last seed was extended to
            left, right = _agree(x[:p][::-1], x[: p + d][::-1]), _agree(x[p:], x[p + d :])
            period, end = d, p + right
            keep(p - left, left + right + d, d)
    return found


def _texts(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Slices of a column: (index of its first text, the words of each of its texts)."""
    raw, offsets = words.buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1, i + 1), n)
        yield i, [raw[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)]
        i = j


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, runs (start, length and period in words, by start and period), collapsed (text)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                counts = np.array([len(t) for t in texts], np.int64)
                ids = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs: list[list[dict]] = [[] for _ in texts]
                for text, start, length, period in sorted(find_runs(ids, counts), key=lambda r: (r[0], r[1], r[3])):
                    runs[text].append({"start": start, "length": length, "period": period})
                for text, mine in enumerate(runs):
                    if mine:
                        keep = np.ones(len(texts[text]), bool)
                        for r in mine:
                            keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                        texts[text] = [texts[text][k] for k in np.flatnonzero(keep)]
                collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(runs, kind), collapsed], names=["doc_id", "runs", "collapsed"])

    return common.pick(docs, id_col, text_col).mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every document whose crc32(doc_id) is divisible by 10 repeats p of its words from word a on (both from the same checksum)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = common.pick(docs, "doc_id", "text").withColumn("h", h)
    rows = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.coalesce(F.size("ws"), F.lit(0)).cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.slice("ws", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.expr("CAST((n - a + p - 1) div p AS INT)")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    text = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run with the largest length / period (compared as fractions), the first by start and period of equal ones; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        out = F.when(x > y, -1).when(x < y, 1)
        for name in ("start", "period"):
            out = out.when(a[name] < b[name], -1).when(a[name] > b[name], 1)
        return out.otherwise(0)

    return F.get(F.array_sort(runs, order), F.lit(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic(planted(common.table(spark, sf_dir, "documents"))).withColumn("top", greatest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
