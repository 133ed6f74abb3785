import random

import pytest

from regmodel.llm import decontaminate


def brute(item, text, bounds, least):
    """Greedy string tiling by trying all pairs of places."""
    a, b, found = [False] * len(item), [False] * len(text), []
    ends = {}
    for lo, hi in zip(bounds, bounds[1:]):
        ends.update({i: hi for i in range(lo, hi)})
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < ends[j] and not a[i + k] and not b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return found
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k
        found.append((i, j, k))


@pytest.mark.parametrize("seed", range(120))
def test_tiles(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 3 + seed // 8) for _ in range(rng.randrange(3, 40))]
    text = [rng.randrange(1, 3 + seed // 8) for _ in range(rng.randrange(0, 60))]
    for _ in range(2):
        s = rng.randrange(len(item))
        text[len(text) // 2 : len(text) // 2] = item[s : s + rng.randrange(3, 15)]
    cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(seed % 3))})
    got, want = decontaminate.tiles(item, text, cuts, 3), brute(item, text, cuts, 3)
    assert sorted(got) == sorted(want)


WORDS = [f"w{i}" for i in range(400)]
ITEM = " ".join(WORDS[:40])


@pytest.fixture(scope="module")
def results(spark):
    reordered = " ".join([*WORDS[20:40], "filler", *WORDS[:20]])
    docs = [(1, f"before {ITEM} after"), (2, reordered), (3, " ".join(WORDS[:15]) + " other words"), (4, None), (5, ""), (6, " ".join(WORDS[200:300])), (7, ITEM.upper()), (1, "another text of the same id"), (None, ITEM), (8, "x " * 50000 + ITEM)]
    frame = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id long, text string")
    return frame, items


def test_find(results):
    got = {(r.doc_id, r.contaminated, r.item_id, round(r.coverage, 3)) for r in decontaminate.find(*results).collect()}
    assert got == {(1, True, 10, 1.0), (2, True, 10, 1.0), (3, False, 10, 0.375), (4, False, None, 0.0), (5, False, None, 0.0), (6, False, None, 0.0), (7, True, 10, 1.0), (1, False, None, 0.0), (None, True, 10, 1.0), (8, True, 10, 1.0)}


def test_keep_clean(results):
    kept = decontaminate.keep_clean(*results)
    assert kept.columns == results[0].columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6"]


def test_keep_clean_with_clashing_names(spark, results):
    frame = results[0].selectExpr("doc_id", "text", "1 AS bad_id", "2 AS bad_key", "3 AS seed", "4 AS salt")
    kept = decontaminate.keep_clean(frame, results[1])
    assert kept.columns == frame.columns and kept.count() == 5


def test_all_documents_by_brute_force(spark, data):
    """Verdicts of the query: every document against every item, tiles by trying all places."""
    import re

    words = lambda x: re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+", x or "")
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    items = {r.item_id: [low(w) for w in words(r.text)] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    docs = {r.doc_id: [low(w) for w in words(r.text)] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in decontaminate.query(spark, data).collect()}
    assert set(got) == set(docs)
    seeds = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    for d, text in docs.items():
        own = {}
        for k in range(len(text) - 4):
            own.setdefault(tuple(text[k : k + 5]), []).append(k)
        best = (0.0, None)
        for i, item in items.items():
            if shared := seeds[i] & own.keys():
                cover = sorted({k + x for s in shared for k in own[s] for x in range(5)})
                stretch = [text[k] for k in cover]
                cuts = [0, *(n for n in range(1, len(cover)) if cover[n] != cover[n - 1] + 1), len(cover)]
                share = sum(k for *_, k in brute(item, stretch, cuts, 5)) / len(item)
                best = max(best, (share, -i))
        assert (got[d].contaminated, got[d].coverage) == (best[0] >= 0.5, pytest.approx(best[0])), d
        assert got[d].item_id == (None if best[1] is None else -best[1])


def test_empty(results):
    frame, items = results
    assert decontaminate.find(frame.limit(0), items).count() == 0
    assert decontaminate.find(frame, items.limit(0)).where("contaminated").count() == 0


def test_one_word_over_and_over():
    """One match is kept and extended a diagonal, not one a pair of places, and the tiles are the same."""
    assert decontaminate.tiles([7] * 200, [7] * 8000, [0, 8000]) == [(0, 0, 200)]
    item, text = [7] * 30 + [8] + [7] * 20, [7] * 25 + [9] + [7] * 60
    assert sorted(decontaminate.tiles(item, text, [0, 86], 5)) == sorted(brute(item, text, [0, 86], 5))
