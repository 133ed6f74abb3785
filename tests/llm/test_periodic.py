"""Periodic runs against a scan of all lags."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from regmodel.llm import periodic


def all_runs(ws):
    """(start, length, period), by comparing each text with itself at every lag."""
    code = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    x, out, n = np.array([code[w] for w in ws], np.int64), [], len(ws)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], x[q:] == x[: n - q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            length = b - a + q
            if length >= max(24, 3 * q) and not any((x[a : a + length - d] == x[a + d : a + length]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]


def wanted(doc_id, text):
    ws = plant(doc_id, split(text))
    runs = all_runs(ws)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def found(texts):
    counts = np.array([len(t) for t in texts], np.int64)
    code = {}
    ids = np.array([code.setdefault(w, len(code)) for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for t, s, n, q in periodic.find_runs(ids, counts):
        out[t].append((s, n, q))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 70), st.integers(1, 300)), max_size=4), min_size=1, max_size=4))
def test_runs_of_repeated_blocks(plan):
    """Texts made of blocks of few words, each repeated to some length, so that runs touch and overlap and periods have small alphabets."""
    texts = []
    for t, parts in enumerate(plan):
        text = []
        for seed, period, length in parts:
            rng = np.random.default_rng(seed * 1000 + period)
            block = rng.integers(0, 2 + seed * 3, period).tolist()
            text += (block * (length // period + 1))[:length]
        texts.append(text)
    assert found(texts) == [all_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.integers(9, 400), st.integers(0, 50), st.integers(0, 50), st.integers(3, 5), st.integers(0, 6))
def test_every_period_at_its_shortest(period, before, after, times, extra):
    rng = np.random.default_rng(period)
    block = rng.integers(10, 10 + max(2, period // 3), period).tolist()
    text = rng.integers(1000, 2000, before).tolist() + (block * (times + 1))[: times * period + extra] + rng.integers(2000, 3000, after).tolist()
    assert found([text]) == [all_runs(text)] and found([text])[0]


def test_thue_morse_and_fibonacci():
    """Words with many squares and few or no cubes, and many runs of one text."""
    morse = [bin(i).count("1") % 2 for i in range(2000)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert found([morse, b, [1] * 500, list(range(300)) * 4]) == [all_runs(t) for t in (morse, b, [1] * 500, list(range(300)) * 4)]


def test_defined_cases(spark):
    long = "z " * 10 + " ".join(f"w{i % 701}" for i in range(40_000)) + " end"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 23), (5, "a " * 24), (None, "x y " * 20), (6, "  b\x0bc\fd " * 12), (6, "  b\x0bc\fd " * 12), (7, long)]
    docs = spark.createDataFrame([(*r, 0, "s", "r") for r in rows], "doc_id long, text string, n int, runs string, collapsed string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.periodic(docs).collect()}
    for i, text in rows:
        ws = split(text)
        gone = {k for s, n, q in all_runs(ws[:8000]) for k in range(s + q, s + n)} if i != 7 else set(range(10 + 701, 40_010))
        key = (i, " ".join(w for k, w in enumerate(ws) if k not in gone))
        assert got[key] == (all_runs(ws) if i != 7 else [(10, 40_000, 701)])
    assert periodic.periodic(docs).count() == len(rows) and periodic.periodic(docs.limit(0)).count() == 0


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = sorted(tuple(r) for r in periodic.query(spark, data).collect())
    assert got == sorted(wanted(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5
