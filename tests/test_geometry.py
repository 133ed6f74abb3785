"""Placements against products of matrices in a loop; columns against all crossings."""

from __future__ import annotations

import math
import random

import numpy as np

from regmodel.operators import models

SCHEMA = "model string, id long, parent long, x double, y double, z double, axis array<double>, ref array<double>"


def matrix(row) -> np.ndarray:
    z = np.array(row[6] or [0, 0, 1], float)
    z = z / np.linalg.norm(z) if np.linalg.norm(z) else np.array([0.0, 0, 1])
    for ref in (row[7], [1, 0, 0], [0, 1, 0]):
        if ref is not None and np.linalg.norm(ref):
            x = np.array(ref, float) - np.dot(ref, z) * z
            if np.linalg.norm(x) > 1e-9:
                break
    x /= np.linalg.norm(x)
    return np.array([[*c, p] for c, p in zip(np.array([x, np.cross(z, x), z]).T, row[3:6])] + [[0, 0, 0, 1.0]])


def test_chain_of_turns(spark):
    draw = random.Random(3)
    turn = lambda: draw.choice([None, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [draw.uniform(-1, 1) for _ in range(3)]])
    rows = [("a", i, i - 1 if i else None, *[draw.uniform(-5, 5) for _ in range(3)], turn(), turn()) for i in range(21)]
    want, m = {}, np.eye(4)
    for r in rows:
        m = m @ matrix(r)
        want[r[1]] = m[:3].ravel()
    got = models.resolve_placements(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 21 and {r.status for r in got} == {"ok"}
    for r in got:
        assert np.allclose(r.matrix, want[r.id]) and np.allclose([r.x, r.y, r.z], want[r.id].reshape(3, 4)[:, 3])


def test_cycles_and_missing_parents(spark):
    at = (1.0, 2.0, 3.0, None, None)
    rows = [("a", 1, 2, *at), ("a", 2, 3, *at), ("a", 3, 1, *at), ("a", 4, 3, *at), ("a", 5, None, *at), ("a", 6, 5, *at), ("a", 7, 99, *at), ("a", 8, 7, *at), ("a", 9, 9, *at), ("b", 1, 5, *at)]
    got = {(r.model, r.id): (r.status, r.x) for r in models.resolve_placements(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if v == ("cycle", None)} == {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 9)}
    assert {k for k, v in got.items() if v == ("missing", None)} == {("a", 7), ("a", 8), ("b", 1)}
    assert got["a", 5] == ("ok", 1.0) and got["a", 6] == ("ok", 2.0)
    assert models.resolve_placements(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turned_grids(spark):
    draw = random.Random(5)
    axes, columns = [], []
    for m in range(6):
        lean = draw.uniform(0.3, 2.8)
        for axis, turn, n in (("U", m * 0.4, 5), ("V", m * 0.4 + lean, 4)):
            for i in range(n if m else 0):
                d = np.array([math.cos(turn), math.sin(turn)]) * draw.uniform(0.5, 20)
                p = np.array([draw.uniform(-20, 20), draw.uniform(-20, 20)])
                axes.append((f"m{m}", axis, *map(float, p), *map(float, p + d)))
        columns += [(f"m{m}", f"c{i % 25}", draw.uniform(-30, 30), draw.uniform(-30, 30)) for i in range(40)]
    axes += [("p", "U", 0.0, 0.0, 1.0, 0.0), ("p", "V", 0.0, 5.0, 2.0, 5.0), ("q", "U", 0.0, 0.0, 1.0, 0.0), ("q", "V", 0.0, 5.0, 2.0, 5.0), ("q", "V", 100.0, 0.0, 100.0, 1.0), ("m1", "U", 1.0, 1.0, 1.0, 1.0)]
    columns += [("p", "c", 0.0, 0.0), ("q", "c", 0.0, 0.0), ("q", "on", 100.0, 0.005)]
    want = set()
    for m in {c[0] for c in columns}:
        us, vs = ([(np.array(a[2:4]), np.array(a[4:6]) - a[2:4]) for a in axes if a[0] == m and a[1] == k] for k in "UV")
        at = []
        for p, d in us:
            for o, e in vs:
                det = d[0] * e[1] - d[1] * e[0]
                if abs(det) > 1e-9:
                    at.append(p + ((o[0] - p[0]) * e[1] - (o[1] - p[1]) * e[0]) / det * d)
        if not at:
            want.add((m, None, "no grid"))
            continue
        for e in {c[1] for c in columns if c[0] == m}:
            d = min(math.hypot(*(g - c[2:])) for c in columns if c[:2] == (m, e) for g in at)
            if d * 1000 > 10:
                want.add((m, e, f"off grid by {round(d * 1000)} mm"))
    a = spark.createDataFrame(axes, "model string, axis string, ax0 double, ay0 double, ax1 double, ay1 double")
    got = models.check_columns_on_grid(spark.createDataFrame(columns, "model string, element string, x double, y double"), a).collect()
    assert {(r.model, r.element, r.message) for r in got} == want and len(got) == len(want)
