"""A small valid layout, and one broken rule at a time."""

import random

from pyspark.sql import functions as F

from regmodel.operators import layouts

KINDS = [("yard", True, False), ("living", False, False), ("bed", False, False), ("well", False, True), ("balcony", True, False)]
#: Ground floor: yard at the street, living room, stair and well behind; upper floor: bedroom over yard and living room, and a balcony over the street.
RECTS = {
    (0, "yard"): (0, 0, 4000, 2000), (0, "living"): (0, 2000, 4000, 4000), (0, "stair"): (0, 6000, 2500, 3000), (0, "well"): (2500, 6000, 1500, 3000),
    (1, "bed"): (0, 0, 4000, 6000), (1, "stair"): (0, 6000, 2500, 3000), (1, "well"): (2500, 6000, 1500, 3000), (1, "balcony"): (500, -1000, 3000, 1000),
}
ROOMS = {
    (0, "yard"): ("yard", 2.0, 4.0, 4.0, False, True, False, ["living"]), (0, "living"): ("living", 3.0, 12.0, 2.0, True, False, False, ["stair", "well"]), (0, "well"): ("well", 1.0, 2.0, 3.0, False, False, False, []),
    (1, "bed"): ("bed", 3.0, 9.0, 2.0, True, False, False, ["stair", "balcony"]), (1, "well"): ("well", 1.0, 2.0, 3.0, False, False, False, ["stair"]), (1, "balcony"): ("balcony", 0.8, 1.0, 5.0, False, False, True, []),
}
LOT = dict(x0_mm=0, y0_mm=0, x1_mm=4000, y1_mm=9000, projection_mm=1000, min_shared_mm=800, stair_w_mm=2500, stair_d_mm=3000)
WALLS = [(0, "living", "yard", 0, 2000, 4000, 2000), (0, "living", "stair", 0, 6000, 2500, 6000), (0, "living", "well", 2500, 6000, 4000, 6000), (1, "bed", "stair", 0, 6000, 2500, 6000), (1, "balcony", "bed", 500, 0, 3500, 0), (1, "stair", "well", 2500, 6000, 2500, 9000)]


def found(spark, changes):
    """The rules that each change of the layout breaks: all in one job, a program each."""
    rects, rooms, lots, conn = [], [], [], []
    for p, change in enumerate(changes):
        rects += [(p, f, i, *v) for (f, i), v in change.get("rects", RECTS).items()]
        rooms += [(p, f, i, *v) for (f, i), v in change.get("rooms", ROOMS).items()]
        lots.append((p, *change.get("lot", LOT).values()))
        conn += [(p, *w) for w in change.get("walls", WALLS)]
    r = spark.createDataFrame(rects, "program int, floor_idx int, room_id string, x_mm int, y_mm int, w_mm int, d_mm int")
    q = spark.createDataFrame(rooms, "program int, floor_idx int, room_id string, kind string, min_width_m double, min_area_m2 double, max_aspect double, needs_daylight boolean, entrance boolean, projecting boolean, adjacent_to array<string>")
    t = spark.createDataFrame(lots, "program int, " + ", ".join(f"{k} int" for k in LOT))
    kinds = spark.createDataFrame(KINDS, "kind string, outdoor boolean, light_well boolean")
    out = [set() for _ in changes]
    for x in layouts.layout_violations(r, q, t, kinds, spark.createDataFrame(conn, "program int, floor_idx int, a string, b string, x0_mm int, y0_mm int, x1_mm int, y1_mm int")).collect():
        out[x.program].add(x.rule)
    return out


ROOM = ["kind", "min_width_m", "min_area_m2", "max_aspect", "needs_daylight", "entrance", "projecting", "adjacent_to"]


def room(key, **new):
    return {"rooms": {**ROOMS, key: tuple(new.get(n, v) for n, v in zip(ROOM, ROOMS[key], strict=True))}}


def rect(key, *box):
    return {"rects": {**RECTS, key: box}}


CASES = [
    ({}, set()),
    (rect((0, "yard"), 0, 0, 3900, 2000), {"cover", "connection_wall"}),
    (rect((0, "yard"), 0, 0, 3950, 2000), {"grid", "cover", "connection_wall"}),
    (rect((0, "yard"), 0, -100, 4000, 2100), {"bounds", "cover", "outdoor", "entrance"}),
    (rect((1, "balcony"), 500, -900, 3000, 900), {"projection"}),
    (rect((1, "balcony"), 500, -1000, 700, 1000), {"width", "area", "shared", "connection_wall"}),
    (rect((1, "well"), 2500, 6000, 1500, 2900), {"cover", "well_aligned", "connection_wall"}),
    (rect((1, "stair"), 0, 6000, 2500, 2900), {"cover", "stair_size", "stair_aligned", "connection_wall"}),
    (room((0, "living"), min_width_m=4.1), {"width"}),
    (room((0, "living"), max_aspect=0.9), {"aspect"}),
    (room((0, "living"), entrance=True), {"entrance"}),
    (room((0, "living"), adjacent_to=["stair"], kind="yard"), {"outdoor", "connection_extra"}),
    (room((0, "living"), adjacent_to=["stair"]), {"connection_extra"}),
    ({"rooms": {**ROOMS, (0, "living"): (*ROOMS[0, "living"][:-1], ["stair"]), (0, "yard"): (*ROOMS[0, "yard"][:-1], [])}}, {"daylight", "connection_extra"}),
    (room((0, "yard"), adjacent_to=["living", "stair"]), {"shared", "connection_missing"}),
    ({"rects": {k: v for k, v in RECTS.items() if k != (1, "well")}}, {"missing", "cover"}),
    ({"rooms": {k: v for k, v in ROOMS.items() if k != (1, "well")}}, {"unknown", "well_floors", "connection_extra"}),
    ({"walls": [*WALLS[1:], (0, "living", "yard", 0, 2000, 3900, 2000)]}, {"connection_wall"}),
    ({"lot": {**LOT, "stair_w_mm": 2400}}, {"stair_size"}),
    (rect((0, "stair"), 0, 5000, 2500, 4000), {"overlap", "cover", "stair_size", "stair_aligned", "shared"}),
]


def test_broken_rules(spark):
    for (change, rules), got in zip(CASES, found(spark, [c for c, _ in CASES]), strict=True):
        assert got == rules, change


def test_area_by_floor(spark):
    rooms = spark.createDataFrame([(1, 0, 10.0, False), (1, 0, 8.0, False), (1, 1, 30.0, True), (1, 1, 19.0, False), (2, 0, 1.0, False), (3, 0, 1.0, False)], "program int, floor_idx int, min_area_m2 double, projecting boolean")
    lots = spark.createDataFrame([(1, 4.0, 7.0, 1.0, 0.5, 2.0, 2.0), (2, 4.0, 3.0, 2.5, 0.5, None, None), (3, 2.0, 9.0, 0.0, 0.0, 2.1, 4.0)], "program int, width_m double, depth_m double, front_setback_m double, back_setback_m double, stair_width_m double, stair_length_m double")
    got = {(r.program, r.floor_idx, r.rule) for r in layouts.area_feasibility(rooms, lots).collect()}
    assert got == {(1, 1, "area"), (2, None, "lot"), (3, None, "stair")}  # 18 + 4 of 22 m² fit, 19 + 4 don't


def test_connectivity(spark):
    rooms = spark.createDataFrame([(1, 0, f"r{i}", i, [f"r{i + 1}"] if i < 40 else []) for i in range(41)] + [(1, 0, "x", 50, ["stair"]), (1, 1, "a", 2, []), (1, 1, "b", 1, [])], "program int, floor_idx int, room_id string, position int, adjacent_to array<string>")
    floors = spark.createDataFrame([(1, 0, True), (1, 1, False)], "program int, floor_idx int, has_stair boolean")
    assert {(r.floor_idx, r.room_id) for r in layouts.floor_connectivity(rooms, floors).collect()} == {(0, "x"), (0, "stair"), (1, "a")}


def test_facade(spark):
    """No wall at the street before a yard; a window moves beside a door, or goes if the wall is too short."""
    rects = spark.createDataFrame([(1, 0, "yard", 0, 0, 4000, 2000, "yard", True, False), (1, 0, "hall", 0, 2000, 4000, 4000, "living", False, False), (1, 1, "bed", 0, 0, 4000, 6000, "bed", False, False)], "program int, floor_idx int, room_id string, x_mm int, y_mm int, w_mm int, d_mm int, kind string, outdoor boolean, light_well boolean")
    lots = spark.createDataFrame([(1, 0, 0, 4000, 6000)], "program int, x0_mm int, y0_mm int, x1_mm int, y1_mm int")
    axes = spark.createDataFrame([(1, 3000)], "program int, pos_mm int")
    segments = layouts.wall_segments(rects, lots, axes)
    ground = {(r.orient, r.c, r.a, r.b, r.is_ext) for r in segments.where("floor_idx = 0").collect()}
    assert ground == {("h", 2000, 0, 4000, False), ("h", 6000, 0, 4000, True), *{("v", x, a, b, True) for x in (0, 4000) for a, b in ((0, 2000), (2000, 3000), (3000, 6000))}}
    pairs, alone = layouts.wall_joints(segments.where("floor_idx = 0"))
    assert alone.count() == 0 and ("h:2000:0:4000", "v:0:0:2000", "ATSTART", "ATEND") in {tuple(r)[2:] for r in pairs.collect()}
    doors = spark.createDataFrame([(1, 1, 0, 0, 900), (1, 1, 6000, 1500, 2500)], "program int, floor_idx int, c int, lo int, hi int")
    got = {(r.floor_idx, r.room_id, r.c, r.mid, r.width, r.a) for r in layouts.facade_windows(rects, lots, segments, doors).collect()}
    assert got == {(0, "hall", 6000, 2000.0, 2400.0, 0), (1, "bed", 0, 2450.0, 2400.0, 0)}  # the door in the middle of the back leaves 1.5 m on either side
    assert segments.where(F.col("is_ext") != (F.col("thick") == 200)).count() == 0


def test_equal_intervals_stay_together(spark):
    """Equal intervals that begin a union are one with it, however often they come."""
    rows = [("g", lo, hi) for lo, hi in [(0, 2), (5, 9), (5, 9), (9, 10), (12, 13)] for _ in range(20)]
    got = layouts.merge_intervals(spark.createDataFrame(rows, "k string, lo int, hi int").repartition(7), ["k"]).collect()
    assert sorted((r.lo, r.hi) for r in got) == [(0, 2), (5, 10), (12, 13)]


def test_small_floors_need_no_rounds(spark, monkeypatch):
    """floors of a few rooms are a row each; only large ones are labelled in rounds, which store a table each.  Both ways agree."""
    rng = random.Random(3)
    rows = []
    for program in range(60):
        n = rng.randint(1, 9)
        rows += [(program, program % 2, f"r{i}", rng.randint(0, 99) * 10 + i, [rng.choice([f"r{rng.randrange(12)}", "stair", None]) for _ in range(rng.randint(0, 2))]) for i in range(n)]
    rows += [(70, 0, "a", 1, None), (70, 0, "a", 2, ["b"]), (70, 0, "b", 3, []), (70, 0, "c", 4, ["none"]), (70, 0, "d", 5, ["none"])]
    rooms = spark.createDataFrame(rows, "program int, floor_idx int, room_id string, position int, adjacent_to array<string>")
    floors = spark.createDataFrame([(p, p % 2, p % 3 > 0) for p in range(65)], "program int, floor_idx int, has_stair boolean")
    names = []
    monkeypatch.setattr(layouts, "stored", lambda df, name, f=layouts.stored: names.append(name) or f(df, name))
    got = sorted(map(tuple, layouts.floor_connectivity(rooms, floors).collect()))
    assert len(names) == 2 and got and {x for x in got if x[0] == 70} == {(70, 0, "c"), (70, 0, "d")}
    assert got == sorted(map(tuple, layouts.floor_connectivity(rooms, floors, 5).collect()))
