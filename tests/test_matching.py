"""Phrases in texts, references between standards, and upserts, against plain Python."""

import random

import pytest

from regmodel.operators import kgraph, matching, vectors


@pytest.mark.parametrize("size", [1, 3, 2000])
def test_holds(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 5)))
    texts = [(g, f"{g}{i}", "".join(word() for _ in range(rng.randint(0, 9)))) for g in ("x", "y", "z") for i in range(30)] + [("x", "none", None)]
    phrases = [(g, word()) for g in ("x", "y", "w") for _ in range(12)] + [("x", ""), ("x", None), ("y", "a"), ("y", "a")]
    got = matching.holds(spark.createDataFrame(texts, "grp string, key string, text string"), spark.createDataFrame(phrases, "grp string, phrase string"), size).collect()
    want = {(g, k, p) for g, k, t in texts for h, p in phrases if g == h and t is not None and p and p in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("topic", [None, "cửa"])
def test_cross_reference(spark, topic):
    rng = random.Random(4)
    articles = [(s, f"{s}{i}", rng.choice(["Lối đi", "Cửa đi", "", None]), f"Xem {rng.choice(['Lối đi', 'Cửa đi', 'thang'])} và {rng.choice(['cửa', 'sàn'])}") for s in "ABCD" for i in range(12)]
    types = [(a, rng.choice("PQR")) for _, a, *_ in articles if rng.random() < 0.3] * 2
    pairs = [("A", "B"), ("B", "A"), ("C", "D"), ("C", "C"), ("A", "Z"), ("A", "B")]
    got = kgraph.cross_reference(spark.createDataFrame(articles, "standard_code string, article_id string, title string, content string"), spark.createDataFrame(types, "article_id string, building_type string"), spark.createDataFrame(pairs, "code1 string, code2 string"), topic, 5).collect()
    kinds = {}
    for a, t in types:
        kinds.setdefault(a, set()).add(t)
    want = set()
    for c1, c2 in set(pairs):
        met = sorted((a, b) for s, a, t, x in articles for r, b, u, y in articles if (s, r) == (c1, c2) and (bool(u) and u in x or bool(t) and t in y or kinds.get(a, set()) & kinds.get(b, set())) and (topic is None or topic in x or topic in y))
        want |= {(c1, c2, a, b) for a, b in met[:5]}
    assert {(r.code1, r.code2, r.article1, r.article2) for r in got} == want and len(got) == len(want) > 12
    assert all(len(r.content1) <= 300 for r in got)


def test_the_last_point_of_an_id_stays(spark):
    index = spark.createDataFrame([("a", None, 1), ("c", "s", 1)], "id string, source_id string, v int")
    new = spark.createDataFrame([("b", None, 2, 1), ("b", None, 3, 3), ("b", None, 4, 2), ("a", None, 5, 1), ("d", "s", 6, 1), ("d", "s", 6, 1)], "id string, source_id string, v int, came int")
    rows = lambda replace: sorted((r.id, r.v) for r in vectors.upsert_by_source(index, new, replace, order="came").collect())
    assert rows(True) == [("a", 5), ("b", 3), ("d", 6)] and rows(False) == [("a", 5), ("b", 3), ("c", 1), ("d", 6)]
    once = vectors.upsert_by_source(index, new, order="came")
    assert sorted(map(tuple, vectors.upsert_by_source(once, new, order="came").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_shares_follow_the_texts(spark):
    """A group's phrases go to as many places as its texts need, not to a fixed number; small shares give the same rows."""
    texts = spark.createDataFrame([("x", f"x{i}", "abc") for i in range(40)] + [("y", "y0", "b")], "grp string, key string, text string")
    phrases = spark.createDataFrame([("x", "b"), ("y", "b"), ("y", "c"), ("w", "b")], "grp string, phrase string")
    every = {("x", f"x{i}", "b") for i in range(40)} | {("y", "y0", "b")}
    for size in (1, 7, 1000):
        got = matching.holds(texts, phrases, share_size=size).collect()
        assert len(got) == len(every) and {tuple(r) for r in got} == every
