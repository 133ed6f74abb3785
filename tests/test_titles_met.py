"""contents meet titles in one shuffle, which nothing is joined back to."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from regmodel.operators import kgraph, matching


@pytest.mark.parametrize("slice_size, share_size", [(1, 1), (3, 2), (2000, 20_000)])
def test_titles_met(spark, slice_size, share_size):
    """Whatever the slices and shares, and with titles that many articles have."""
    rng = random.Random(slice_size)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    sides = {(g, n): [(f"{g}{n}-{i}", rng.choice([text(rng.randint(1, 3)), "", None]), rng.choice([text(9), None]), rng.random() < 0.5) for i in range(rng.choice([3, 30]))] for g in range(4) for n in (1, 2)}
    rows = [(g, n, len(own), len(sides[g, 3 - n]), *a) for (g, n), own in sides.items() for a in own]
    rows = spark.createDataFrame(rows, "grp long, n int, own int, other int, article_id string, title string, content string, about boolean")
    one = lambda n: rows.where(F.col("n") == n).select("grp", "article_id", "about", F.explode(matching.places(n, 3 - n, F.col("own"), F.col("other"), slice_size, share_size)).alias("p"))
    got = matching.titles_met(one(1).unionByName(one(2)).select("grp", "article_id", "about", "p.*")).distinct().collect()
    want = {(g, a, b) for g in range(4) for a, t, x, p in sides[g, 1] for b, u, y, q in sides[g, 2] if (p or q) and (u and x and u in x or t and y and t in y)}
    assert len(got) == len(want) > 5 and set(map(tuple, got)) == want


def test_moves(spark):
    """A side's articles are shuffled for the titles and contents once, not for each of what meets them."""
    articles = spark.createDataFrame([("A", "A1", "Lối đi", "x"), ("B", "B1", "Cửa", "Xem Lối đi")], "standard_code string, article_id string, title string, content string")
    got = kgraph.article_pairs(articles, spark.createDataFrame([("A1", "P")], "article_id string, building_type string"), spark.createDataFrame([("A", "B")], "code1 string, code2 string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(grp#\d+L, side#", plan)) == 1 and "phrase" not in plan
    assert [tuple(r) for r in got.collect()] == [("A", "B", "A1", "B1")]
