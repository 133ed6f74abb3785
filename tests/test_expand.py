"""Elements of a small building, laid out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from regmodel.operators import specs

SPEC = {
    "spec_id": 1, "num_storeys": 2, "storey_height": 3000.0, "footprint_length": 9000.0, "footprint_width": 5000.0, "slab_thickness": 100.0,
    "column_size": 300.0, "column_spacing_x": 4000.0, "column_spacing_y": 6000.0, "num_staircases": 2, "doors_per_storey": 2,
}


def test_expand_building(spark):
    got = specs.expand_building(spark.createDataFrame([SPEC])).collect()
    at = {(r.name, r.storey): (r.x, r.y, r.z, r.dx, r.dy, r.dz) for r in got}
    assert len(at) == len(got)
    # Lines at x = 0, 4000, 8000 and y = 0, 5000: the second bay of y ends at the edge.
    beams = sorted(n for n, s in at if n.startswith("Dầm") and s == 1)
    assert beams == ["Dầm BX1 T1", "Dầm BX2 T1", "Dầm BX3 T1", "Dầm BX4 T1", "Dầm BY5 T1", "Dầm BY6 T1", "Dầm BY7 T1"]
    assert at["Dầm BX4 T2", 2] == (4000, 5000, 5600, 4000, 200, 400)
    assert at["Dầm BY7 T1", 1] == (8000, 0, 2600, 200, 5000, 400)
    assert not [n for n, _ in at if n.startswith("Cột")]  # all stand in walls
    assert at["Móng M6", 1] == (8000, 5000, -500, 750, 750, 500)
    assert at["Tường Đông T2", 2] == (8800, 200, 3100, 200, 4600, 2900)
    assert at["Cửa D2 T1", 1] == (5550, 0, 100, 900, 200, 2100)
    assert at["Thang CT2 T1", 1] == (400, 1500, 0, 2200, 1000, 3000)
    assert at["Mái", 2] == (-300, -300, 6000, 9600, 5600, 250)


def test_nothing_to_expand(spark):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in SPEC.items())
    rows = [{**SPEC, "num_storeys": 0}, {**SPEC, "footprint_length": None}]
    assert specs.expand_building(spark.createDataFrame(rows, schema)).isEmpty()
    assert specs.expand_building(spark.createDataFrame([], schema)).isEmpty()


def test_expand_bridge(spark):
    """F32: families are exploded index ranges; no arrays of structs, which are not compiled, hold a bridge's elements."""
    one = {"spec_id": 1, "bridge_function": "Đường bộ", "total_length": 40000.0, "num_spans": 2, "deck_width": 9000.0, "num_lanes": 2, "lane_width": 3500.0, "girder_height": 1200.0, "num_girders": 3, "clearance_height": 4500.0, "barrier_post_spacing": 2000.0, "num_piles_per_pier": 3, "pier_width": 1500.0}
    got = specs.expand_bridge(spark.createDataFrame([one]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "flatten(" not in plan
    rows = got.collect()
    counts = {p: sum(r.part == p for r in rows) for p in {r.part for r in rows}}
    assert counts == {"abutment": 2, "pier": 1, "girder": 6, "deck": 2, "post": 42, "bearing": 9, "pile": 9}
    assert {(r.x, r.y) for r in rows if r.part == "pier"} == {(20000.0, 4500.0)}


def test_specs_are_dealt_over_tasks(spark):
    """specifications that lie in one partition are expanded by several tasks, and read from where they are stored."""
    rows = spark.createDataFrame([{**SPEC, "spec_id": i} for i in range(2_000)]).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        got = specs.expand_building(rows).where("ifc_type = 'IfcStair'").select(F.spark_partition_id().alias("p")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) > 1
