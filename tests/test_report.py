"""The check report holds all checks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from regmodel.operators import models
from regmodel.plans import buildings, registry


def test_report_has_every_check(spark, data):
    own = {"openings": "h2_check_openings", "walls": "h3_check_wall_connections", "columns": "h4_check_columns_on_grid", "spaces": "h5_check_spaces", "clashes": "h7_check_clashes"}
    want = {c: Counter(r.model for r in registry.QUERIES[q](spark, data).select("model").collect()) for c, q in own.items()}
    report = registry.QUERIES["h9_check_report"](spark, data).collect()
    for check, n in want.items():
        assert sum(n.values()) and {r.model: r[check] for r in report} == {r.model: n[r.model] for r in report}


def test_regressions_of_every_check(spark, data):
    n = buildings.stored(buildings._issues(spark, data).groupBy("model", "check").agg(F.count("*").alias("n")), "issues")
    worse = models.compare_baseline(n, n.withColumn("n", F.col("n") - 1))
    assert {r.check for r in worse.select("check").distinct().collect()} == set(models.CHECKS)
