"""Clashes that are counted against the rows of those that are made."""

from __future__ import annotations

import random
from collections import Counter

from regmodel.operators import models

SCHEMA = "model string, global_id string, ifc_type string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def test_counts_are_those_of_the_pairs(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        at = [draw.choice([draw.uniform(-5, 5), draw.randint(-5, 5) + draw.choice([0, 0.002, -0.002, 0.001])]) for _ in "xyz"]
        size = [draw.choice([0.001, 0.002, 0.5, 2.0, 4.0, 9.0, -1.0, draw.uniform(0, 9), draw.uniform(0, 9)]) for _ in "xyz"]
        box = [float(v) for v in at] + [float(a + s) for a, s in zip(at, size, strict=True)]
        copies = draw.choice([1, 1, 2])
        rows += [(f"m{i % 3}", f"e{i if draw.random() < 0.9 else i % 7}" if i % 40 else None, "IfcOpeningElement" if i % 31 == 0 else "IfcWall", *box) for _ in range(copies)]
    rows.append(("m0", "nowhere", "IfcWall", None, 0.0, 0.0, 1.0, 1.0, 1.0))
    boxes = spark.createDataFrame(rows, SCHEMA)
    ids = [r[1] for r in rows if r[1]]
    hosts = spark.createDataFrame([("m1", draw.choice(ids), draw.choice(ids)) for _ in range(3000)], "model string, element string, wall string")
    connects = hosts.limit(500).selectExpr("model", "wall AS a", "element AS b")
    for known in ((None, None), (hosts, None), (hosts, connects)):
        want = Counter(r.model for r in models.check_clashes(boxes, *known).collect())
        assert sum(want.values()) > 300 and dict(want) == {r.model: r.n for r in models.count_clashes(boxes, *known).collect()}
    assert models.count_clashes(boxes.limit(0)).count() == 0
