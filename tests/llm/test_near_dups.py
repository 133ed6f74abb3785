import numpy as np
import pytest

from regmodel.llm import near_dups, words


def text(start, n, skip=()):
    return " ".join(f"word{start + i}" if i not in skip else f"changed{start + i}" for i in range(n))


def test_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    g = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    wa[:60] = 1e-9
    m = 4096
    sig = near_dups.prob_min_hash(np.concatenate([g, g]), np.repeat([0, 1], 300), np.concatenate([wa, wb]), 2, m)
    pa, pb = wa / wa.sum(), wb / wb.sum()
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(300))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03 and abs(pa.sum() - pb.sum()) < 1e-9


def test_early_end_changes_nothing():
    g = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = near_dups.prob_min_hash(g, np.zeros(399, np.int64), np.ones(399), 1)
    both = near_dups.prob_min_hash(np.concatenate([g, g[:50]]), np.repeat([0, 1], [399, 50]), np.ones(449), 2)
    assert (one[0] == both[0]).all()


def test_parts_change_nothing(monkeypatch):
    """Arrivals of a long text that are drawn in parts, and of texts that are drawn together."""
    rng = np.random.default_rng(6)
    g = rng.integers(1, 2**63, 900).astype(np.uint64)
    d, w = np.repeat([0, 1, 2], [700, 0, 200]), rng.uniform(1, 1.1, 900)
    whole = near_dups.prob_min_hash(g, d, w, 3)
    monkeypatch.setattr(near_dups, "PART", 64)
    assert (near_dups.prob_min_hash(g, d, w, 3) == whole).all()
    assert list(near_dups.groups(np.array([10, 50, 5, 500, 0, 0, 64, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, text(0, 200)), (2, text(0, 200)), (3, text(0, 200, {100})), (4, text(0, 200, {50, 150})), (5, text(1000, 200)), (6, None), (7, ""), (8, "one two"), (9, "one two"), (10, "One TWO"), (None, text(5000, 100)), (11, text(5000, 100)), (12, text(0, 100) + " " + text(7000, 100)), (13, text(0, 200).upper())]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, label int")


def test_classes(frame):
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dups.classes(frame).collect() if r.doc_id}
    assert got == {1: (1, 5), 2: (1, 5), 3: (1, 5), 4: (1, 5), 13: (1, 5), 5: (5, 1), 6: (6, 2), 7: (6, 2), 8: (8, 3), 9: (8, 3), 10: (8, 3), 11: (11, 2), 12: (12, 1)}


def test_keep_one(frame):
    kept = near_dups.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 8, 11, 12]
    twice = frame.union(frame)
    assert sorted(r.doc_id for r in near_dups.keep_one(twice).collect()) == [1, 5, 6, 8, 11, 12]


def test_large_group(spark):
    """Copies that are each near the first, not all near each other, are one class; an unrelated one stays out."""
    rows = [(i, text(0, 300, {(7 * i) % 300, (7 * i + 150) % 300, (11 * i) % 300} if i else ())) for i in range(120)] + [(1000, text(9000, 300))]
    got = near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0} and {r.class_id for r in got if r.doc_id == 1000} == {1000}


def test_unshared(spark):
    """What a text shares with no other is counted for the text that has it."""
    rows = [(bytes([255] * 8 + [i] * 8), np.array([1, 2, 3, 2**40 * i], "<u8").tobytes()) for i in range(1, 4)] + [(bytes(16), b"")]
    got = {r.node: (r.n, r.k) for r in near_dups.unshared(spark.createDataFrame(rows, "node binary, s binary")).collect()}
    assert sorted(got.values()) == [(0, 0), (4, 3), (4, 3), (4, 3)]


def test_wordless(spark):
    rows = [(i, "!" * (i % 3)) for i in range(9)]
    assert {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i % 3 for i in range(9)}


def test_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    sets = {}
    for r in docs.collect():
        h = words.hash_words([r.text])
        g, _, _ = near_dups.shingles(h, np.array([len(h)]))
        sets[r.doc_id] = (r.text, frozenset(g.tolist()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                a, b = sets[i][1], sets[j][1]
                if sets[i][0] == sets[j][0] or (a or b) and len(a & b) >= 0.8 * len(a | b):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets}


def test_empty(spark):
    assert near_dups.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
