"""Search by cells against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmodel.operators import cells, vectors

SCHEMA = "id long, kind string, embedding array<float>"


def clusters(n: int = 1200, dim: int = 8) -> list[tuple]:
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(20, dim)) * 3
    x = (centres[draw.integers(0, 20, n)] + draw.normal(size=(n, dim)) * 0.2).astype(np.float32)
    x[300:700] = x[7]  # a third are copies
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    odd = [[0.0] * dim, None, [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    return rows + [(n + i, "ab"[i % 2], v) for i, v in enumerate(odd)]


def all_pairs(points: list[tuple], queries: list[tuple], k: int) -> dict:
    def cosine(a, b):
        if any(v is None or len(v) != 8 or None in v or not any(v) or np.isnan(v).any() for v in (a, b)):
            return 0.0
        a, b = np.array(a, float), np.array(b, float)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    return {q: sorted(((round(-cosine(v, e), 9), i) for i, _, e in points))[:k] for q, v in queries}


@pytest.mark.parametrize("kind", [None, "b"])
def test_equals_all_pairs(spark, kind):
    rows = clusters()
    queries = [(i, e) for i, _, e in rows if i % 50 == 0 or e is None] + [(-1, [0.0] * 8)]
    index = cells.build(spark.createDataFrame(rows, SCHEMA), block=64)
    assert index.points.groupBy("cell_", "block_").count().agg(F.max("count")).first()[0] < 150
    got = {}
    for r in vectors.search(index, spark.createDataFrame(queries, "query_id long, embedding array<float>"), 5, None if kind is None else F.col("kind") == kind).collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9) + 0.0, r.id))
    want = all_pairs([r for r in rows if kind in (None, r[1])], queries, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        assert np.allclose(sorted(s for s, _ in found), [s for s, _ in want[q]], atol=1e-7)
        assert sorted(i for _, i in found) == sorted(i for _, i in want[q])


def test_reads_few_cells(spark):
    rows = clusters()
    index = cells.build(spark.createDataFrame(rows, SCHEMA))
    queries = spark.createDataFrame([(i, e) for i, _, e in rows if i < 1200 and i % 50 == 0], "query_id long, embedding array<float>")
    p = cells.probes(index, queries, 5)
    least = vectors.search(index, queries, 5).groupBy("query_id").agg(F.min("score").alias("least"))
    read = F.size(F.filter("probes_", lambda x: x["first"] | (x["best"] >= F.col("least")))) / F.size("probes_")
    assert p.join(least, "query_id").agg(F.avg(read)).first()[0] < 0.5


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert vectors.search(none, queries).count() == 0
    two = spark.createDataFrame([(5, "a", [0.0, 1.0]), (4, "a", [1.0, 1.0])], SCHEMA)
    assert [(r.id, r["rank"]) for r in vectors.search(two, queries).orderBy("rank").collect()] == [(4, 1), (5, 2)]
    assert vectors.search(two, queries.where("false")).count() == 0


def test_embedding_counts_words(spark):
    rows = {r.i: r.embedding for r in vectors.embed(spark.createDataFrame([(1, "Cửa cửa, sổ"), (2, ""), (3, None), (4, "sổ cửa CỬA")], "i int, t string"), "t", dim=64).collect()}
    assert rows[1] == rows[4] and len(rows[1]) == 64 and abs(sum(x * x for x in rows[1]) - 1) < 1e-6
    assert sorted(rows[1])[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not any(rows[2]) and not any(rows[3])
