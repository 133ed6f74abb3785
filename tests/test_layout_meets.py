"""What is placed meets what is wanted once."""

from __future__ import annotations

from regmodel.operators import layouts
from regmodel.plans import layouts as plans


def test_missing_and_unknown(spark):
    """rooms that are not placed, places that nothing wants, a stair that is wanted on each floor and placed on one."""
    rects = spark.createDataFrame([(1, 0, "a", 0, 0, 2000, 2000), (1, 0, "x", 2000, 0, 2000, 2000), (1, 1, "stair", 0, 0, 1000, 1000), (2, 0, "a", 0, 0, 2000, 2000)], "program int, floor_idx int, room_id string, x_mm int, y_mm int, w_mm int, d_mm int")
    rooms = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "a"), (2, 0, "stair")], "program int, floor_idx int, room_id string").selectExpr("*", "'ngu' AS kind", "1.0D AS min_width_m", "1.0D AS min_area_m2", "9.0D AS max_aspect", "false AS needs_daylight", "false AS entrance", "false AS projecting", "CAST(array() AS array<string>) AS adjacent_to")
    lots = spark.createDataFrame([(1, 0, 0, 4000, 2000, 1000, 1500, 1000, 1000)], "program int, x0_mm int, y0_mm int, x1_mm int, y1_mm int, projection_mm int, min_shared_mm int, stair_w_mm int, stair_d_mm int")
    got = layouts.layout_violations(rects, rooms, lots, plans.kinds(spark))
    rows = sorted((r.program, r.floor_idx, r.rule, r.room_a or "") for r in got.collect())
    assert rows == [(1, 0, "missing", "b"), (1, 0, "missing", "stair"), (1, 0, "unknown", "x"), (1, 1, "cover", ""), (1, 1, "missing", "c"), (2, 0, "missing", "stair")]


def test_fixture_runs_once(spark, data):
    """Rectangles, rooms and lots come from rows that are stored."""
    for rows in plans._placed(spark, data):
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
