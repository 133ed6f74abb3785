"""All line items are checked against the grid."""

from __future__ import annotations

import math

from regmodel.plans import base, registry


def test_every_column(spark, data):
    axes = base.fixture(spark, data, "fx_axes").collect()
    grid = {}
    for m in {a.model for a in axes}:
        us, vs = ({a[f] for a in axes if a.model == m and a.axis == k} for k, f in (("U", "ax0"), ("V", "ay0")))
        grid[m] = [(x, y) for x in us for y in vs]
    near, models = {}, set()
    for r in base.table(spark, data, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        m = f"M{r.l_orderkey % 60}"
        models.add(m)
        if grid.get(m):
            d = min(math.hypot(r.l_partkey % 30 - x, r.l_suppkey % 20 - y) for x, y in grid[m])
            near[m, str(r.l_partkey)] = min(d, near.get((m, str(r.l_partkey)), math.inf))
    want = [k for k, d in near.items() if d * 1000 > 10] + [(m, None) for m in models if not grid.get(m)]
    got = [(r.model, r.element) for r in registry.QUERIES["h4_check_columns_on_grid"](spark, data).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
