"""Room programs and layouts (J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

# Storey heights in m (the last repeats), the least height, and allowed balcony depth from a street width on.
STOREY_HEIGHTS = [3.9, 3.6, 3.3]
MIN_HEIGHT = 3.0
BALCONY = [(0.0, 0.0), (7.0, 1.2)]


def on_grid(v: Column) -> Column:
    """Whole multiples of 0.1 m."""
    return F.abs(v * 10 - F.round(v * 10)) < 1e-6


def apply_room_defaults(rooms: DataFrame, rules: DataFrame) -> DataFrame:
    """Missing width, area, aspect and daylight of a room from its kind, the target area from the least area.  rules: kind and
    the same columns; a table of kinds, tens of rows."""
    names = ["min_width_m", "min_area_m2", "max_aspect", "needs_daylight"]
    j = rooms.join(rules.select("kind", *[F.col(n).alias(f"rule_{n}") for n in names]), "kind", "left")
    filled = j.withColumns({n: F.coalesce(n, f"rule_{n}") if n in rooms.columns else F.col(f"rule_{n}") for n in names})
    target = F.coalesce("target_area_m2", "min_area_m2") if "target_area_m2" in rooms.columns else F.col("min_area_m2")
    return filled.withColumn("target_area_m2", target).drop(*[f"rule_{n}" for n in names])


def storey_height(floor_idx: Column, given: Column | None = None, heights: list[float] = STOREY_HEIGHTS) -> Column:
    """The given height, else that of the list."""
    usual = F.element_at(F.array(*map(F.lit, heights)), F.least(floor_idx, F.lit(len(heights) - 1)) + 1)
    return usual if given is None else F.coalesce(given, usual)


def balcony_projection(lots: DataFrame, table: list[tuple[float, float]] = BALCONY) -> DataFrame:
    """The value of the largest threshold not above the street width; 0 without a width or a threshold."""
    best = F.lit(0.0)
    for least, value in sorted(table):
        best = F.when(F.col("street_width_m") >= least, F.lit(value)).otherwise(best)
    return lots.withColumn("max_projection_m", best)


def validate_program(rooms: DataFrame, floors: DataFrame, lots: DataFrame, kinds: DataFrame) -> DataFrame:
    """Program, floor_idx, room_id, rule of each broken rule.  rooms: program, floor_idx, room_id, kind, entrance, projecting,
    adjacent_to (array); floors: program, floor_idx, height_m, has_stair; lots: program, width_m, depth_m, street_width_m;
    kinds: kind, outdoor."""
    none = F.lit(None).cast("string")

    def broken(df: DataFrame, rule: str, floor: Column | None = None, room: Column = none) -> DataFrame:
        return df.select("program", (F.lit(None).cast("int") if floor is None else floor.cast("int")).alias("floor_idx"), room.cast("string").alias("room_id"), F.lit(rule).alias("rule"))

    f, r = F.col("floor_idx"), F.col("room_id")
    known = rooms.join(kinds, "kind", "left")
    reach = balcony_projection(lots).select("program", "max_projection_m")
    ends = rooms.select("program", "floor_idx", "room_id", F.explode("adjacent_to").alias("target"))
    there = rooms.select("program", "floor_idx", F.col("room_id").alias("target")).union(floors.where("has_stair").select("program", "floor_idx", F.lit("stair")))
    entrances = rooms.groupBy("program", "floor_idx").agg(F.count_if("entrance").alias("n"))
    rows = [
        broken(lots.where(~on_grid(F.col("width_m")) | ~on_grid(F.col("depth_m"))), "lot_grid"),
        broken(floors.where((F.col("height_m") < MIN_HEIGHT - 1e-9)), "height", f),
        broken(floors.where(~on_grid(F.col("height_m"))), "height_grid", f),
        broken(floors.groupBy("program").agg(F.count("*").alias("n"), F.bool_or("has_stair").alias("s")).where("n >= 2 AND NOT s"), "stair"),
        broken(rooms.where("room_id = 'stair'"), "reserved_id", f, r),
        broken(rooms.groupBy("program", "floor_idx", "room_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id", f, r),
        broken(known.where("outdoor IS NULL"), "unknown_kind", f, r),
        broken(known.where("projecting AND NOT outdoor"), "projecting_indoor", f, r),
        broken(rooms.where("projecting AND floor_idx < 1"), "projecting_ground", f, r),
        broken(rooms.where("projecting").join(reach, "program").where("max_projection_m <= 0"), "projecting_street", f, r),
        broken(entrances.where("floor_idx = 0 AND n <> 1"), "entrance", f),
        broken(entrances.where("floor_idx > 0 AND n > 0"), "entrance_above", f),
        broken(ends.where("target = room_id"), "self_adjacent", f, r),
        broken(ends.where("target <> room_id").join(there, ["program", "floor_idx", "target"], "left_anti"), "unknown_adjacent", f, r),
    ]
    return reduce(DataFrame.unionByName, rows)


#: Rooms and adjacencies of a floor that is one row; larger ones are labelled round by round.
SMALL_FLOOR = 32


def floor_connectivity(rooms: DataFrame, floors: DataFrame | None = None, small: int = SMALL_FLOOR) -> DataFrame:
    """Program, floor_idx, room_id of what the first room of its floor (by position) can't reach over adjacency, in either direction.
    rooms: program, floor_idx, room_id, position, adjacent_to (array); floors: program, floor_idx, has_stair: a stair is a room
    "stair".  Floors are counted first: those of at most ``small`` rooms and adjacencies become one row each, the others are labelled in rounds."""
    c, key = F.col, ["program", "floor_idx"]
    rows = rooms.select(*key, "room_id", "position", c("adjacent_to").cast("array<string>").alias("adjacent_to"), F.lit(True).alias("own"))
    if floors is not None:
        rows = rows.unionByName(floors.where("has_stair").select(*key, F.lit("stair").alias("room_id"), F.lit(False).alias("own")), allowMissingColumns=True)
    rows = stored(rows.where("program IS NOT NULL AND floor_idx IS NOT NULL"), "floor-rows")
    size = F.sum(F.greatest(F.size("adjacent_to"), F.lit(0)) + 1)
    large = stored(rows.groupBy(*key).agg(size.alias("n")).where(c("n") > small).select(*key), "large-floors")
    if large.isEmpty():
        return _small_floors(rows)
    return _small_floors(rows.join(large, key, "left_anti")).unionByName(_large_floors(rows.join(large, key, "left_semi")))


def _small_floors(rows: DataFrame) -> DataFrame:
    """J3 by floors, a row each: what is reached grows by one adjacency a step, as often as there are further rooms."""
    c, key = F.col, ["program", "floor_idx"]
    ends = F.transform("adjacent_to", lambda b: F.struct(c("room_id").alias("a"), b.alias("b")))
    one = rows.groupBy(*key).agg(F.min_by("room_id", "position").alias("first"), F.bool_or("own").alias("own"), F.collect_set("room_id").alias("ids"), F.flatten(F.collect_list(ends)).alias("ends"))
    known = F.filter("ends", lambda e: F.array_contains("ids", e["a"]) & F.array_contains("ids", e["b"]))
    one = one.where("own").select(*key, "first", "ids", known.alias("ends"))

    def further(found: Column, _: Column) -> Column:
        to = lambda x, y: F.transform(F.filter("ends", lambda e: F.array_contains(found, e[x])), lambda e: e[y])
        return F.array_union(found, F.array_union(to("a", "b"), to("b", "a")))

    steps = F.when(F.size("ends") > 0, F.slice("ids", 2, F.size("ids"))).otherwise(F.slice("ids", 1, 0))
    found = F.aggregate(steps, F.array("first"), further)
    return one.select(*key, F.explode(F.array_except("ids", found)).alias("room_id"))


def _large_floors(rows: DataFrame) -> DataFrame:
    """J3 for floors of any size.  Labels spread to the smaller one and jump to the label's label until nothing moves, which the write itself counts."""
    c, key = F.col, ["program", "floor_idx"]
    rows = stored(rows, "large-floor-rows")
    first = rows.where("own").groupBy(*key).agg(F.min_by("room_id", "position").alias("first"))
    ids = rows.select(*key, "room_id").distinct()
    one = rows.select(*key, c("room_id").alias("a"), F.explode("adjacent_to").alias("b"))
    edges = stored(one.union(one.select(*key, "b", "a")).distinct(), "adjacency")
    labels = stored(ids.join(first, key).select(*key, "room_id", F.when(c("room_id") == c("first"), "").otherwise(c("room_id")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(*key, c("room_id").alias("b"), c("label").alias("l")), [*key, "b"]).groupBy(*key, c("a").alias("room_id")).agg(F.min("l").alias("l"))
        step = labels.join(near, [*key, "room_id"], "left").select(*key, "room_id", "label", F.least("label", "l").alias("next"))
        jump = step.groupBy(*key, "label").agg(F.min("next").alias("to"))
        moved = Observation()
        new = step.join(jump, [*key, "label"]).select(*key, "room_id", F.least("next", "to").alias("new_"), "label")
        labels = stored(new.observe(moved, F.count_if(c("new_") != c("label")).alias("n")).select(*key, "room_id", c("new_").alias("label")), "labels")
        if not moved.get["n"]:
            return labels.where("label <> ''").select(*key, "room_id")


def light_well_continuity(rooms: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors between its first and the top one that a light well misses.  rooms: program, floor_idx, room_id of the wells."""
    top = floors.groupBy("program").agg(F.max("floor_idx").alias("top"))
    span = rooms.groupBy("program", "room_id").agg(F.min("floor_idx").alias("low")).join(top, "program")
    wanted = span.select("program", "room_id", F.explode(F.sequence("low", "top")).alias("floor_idx"))
    return wanted.join(rooms.select("program", "room_id", "floor_idx"), ["program", "room_id", "floor_idx"], "left_anti")


def typical_floors(rooms: DataFrame, columns: list[str]) -> DataFrame:
    """Program, floor_idx, same_as: the first floor whose whole list of rooms is the same."""
    signed = rooms.groupBy("program", "floor_idx").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256).alias("sign"))
    return signed.withColumn("same_as", F.min("floor_idx").over(Window.partitionBy("program", "sign"))).drop("sign")


_RECT = ("room_id", "x_mm", "y_mm", "w_mm", "d_mm")


def _pairs(rects: DataFrame) -> DataFrame:
    a, b = (rects.select("program", "floor_idx", *[F.col(c).alias(f"{p}_{c}") for c in _RECT]) for p in "ab")
    return a.join(b, ["program", "floor_idx"]).where("a_room_id < b_room_id")


def shared_segment() -> Column:
    """The wall that rectangles a and b (columns a_x_mm and so on) share: orient, c, lo, hi; an upright one first, positive lengths only, else null."""
    lo = lambda n: F.greatest(f"a_{n}", f"b_{n}")
    hi = lambda n, s: F.least(F.col(f"a_{n}") + F.col(f"a_{s}"), F.col(f"b_{n}") + F.col(f"b_{s}"))
    meet = lambda n, s: F.when(F.col(f"a_{n}") + F.col(f"a_{s}") == F.col(f"b_{n}"), F.col(f"b_{n}")).when(F.col(f"b_{n}") + F.col(f"b_{s}") == F.col(f"a_{n}"), F.col(f"a_{n}"))
    wall = lambda o, n, s, m, t: F.when(meet(n, s).isNotNull() & (lo(m) < hi(m, t)), F.struct(F.lit(o).alias("orient"), meet(n, s).alias("c"), lo(m).alias("lo"), hi(m, t).alias("hi")))
    return F.coalesce(wall("v", "x_mm", "w_mm", "y_mm", "d_mm"), wall("h", "y_mm", "d_mm", "x_mm", "w_mm"))


def shared_segments(rects: DataFrame) -> DataFrame:
    """The wall that two rectangles of a floor share."""
    return _pairs(rects).withColumn("s", shared_segment()).where("s IS NOT NULL").select("program", "floor_idx", F.col("a_room_id").alias("room_a"), F.col("b_room_id").alias("room_b"), "s.*")


def adjacency(rooms: DataFrame) -> DataFrame:
    """program, floor_idx, a, b of the rooms that must share a wall, each pair once with a < b.  rooms: adjacent_to (array)."""
    one = rooms.select("program", "floor_idx", "room_id", F.explode("adjacent_to").alias("o"))
    return one.select("program", "floor_idx", F.least("room_id", "o").alias("a"), F.greatest("room_id", "o").alias("b")).distinct()


def layout_violations(rects: DataFrame, rooms: DataFrame, lots: DataFrame, kinds: DataFrame, connections: DataFrame | None = None, grid_mm: int = 100) -> DataFrame:
    """Program, floor_idx (null: several floors), rule, room_a, room_b of everything that a layout breaks.

    rects: program, floor_idx, room_id ("stair" for the stair), x_mm, y_mm, w_mm, d_mm; rooms, the program: program, floor_idx, room_id,
    kind, min_width_m, min_area_m2, max_aspect, needs_daylight, entrance, projecting, adjacent_to (a null limit is none); lots: program,
    x0_mm, y0_mm, x1_mm, y1_mm (what may be built on; y0 is the street's side), projection_mm, min_shared_mm, stair_w_mm, stair_d_mm
    (null: no stair); kinds: kind, outdoor, light_well, tens of rows; connections: program, floor_idx, a, b, x0_mm, y0_mm, x1_mm, y1_mm.
    """
    c, key = F.col, ["program", "floor_idx"]
    none = F.lit(None).cast("string")
    row = lambda df, rule, a=none, b=none, floor=c("floor_idx"): df.select("program", floor.cast("int").alias("floor_idx"), F.lit(rule).alias("rule"), a.alias("room_a"), b.alias("room_b"))
    rid, many = c("room_id"), F.lit(None)
    rects, rooms, lots = (stored(df, name) for df, name in ((rects, "rects"), (rooms, "rooms"), (lots, "lots")))  # read many times below
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    known = rooms.join(kinds.select("kind", "outdoor", "light_well"), "kind", "left")
    floors = rooms.select(*key).distinct()
    stairs = rooms.groupBy(*key).agg(F.bool_or(rid == "stair").alias("named_")).where("NOT named_").join(lots.where("stair_w_mm IS NOT NULL").select("program"), "program").select(*key, F.lit("stair").alias("room_id"))
    wanted = known.unionByName(stairs, allowMissingColumns=True).withColumn("wanted_", F.lit(True))
    pairs = adjacency(rooms)
    # a room is lit by a neighbour in the open or over a light well
    open_ = known.where(yes("outdoor") | yes("light_well")).select(*key, rid.alias("n_"))
    ways = pairs.select(*key, c("a").alias("room_id"), c("b").alias("n_")).union(pairs.select(*key, "b", "a"))
    lit = ways.join(open_, [*key, "n_"]).select(*key, "room_id").distinct().withColumn("lit", F.lit(True))
    # what is placed meets what is wanted once: where one is missing that is a rule of its own
    at = rects.select(*key, *_RECT, F.lit(True).alias("placed_")).join(wanted, [*key, "room_id"], "full").join(lit, [*key, "room_id"], "left").join(lots.withColumn("lot_", F.lit(True)), "program", "left")
    at = stored(at.drop("adjacent_to"), "at")
    front, back, out = c("y_mm") == c("y0_mm"), c("y_mm") + c("d_mm") == c("y1_mm"), yes("projecting")
    short, long = F.least("w_mm", "d_mm"), F.greatest("w_mm", "d_mm")
    broken = {
        "grid": reduce(Column.__or__, [c(n) % grid_mm != 0 for n in ("x_mm", "y_mm", "w_mm", "d_mm")]),
        "bounds": ~out & ((c("w_mm") <= 0) | (c("d_mm") <= 0) | (c("x_mm") < c("x0_mm")) | (c("y_mm") < c("y0_mm")) | (c("x_mm") + c("w_mm") > c("x1_mm")) | (c("y_mm") + c("d_mm") > c("y1_mm"))),
        "projection": out & ((c("w_mm") <= 0) | (c("x_mm") < c("x0_mm")) | (c("x_mm") + c("w_mm") > c("x1_mm")) | (c("y_mm") != c("y0_mm") - c("projection_mm")) | (c("d_mm") != c("projection_mm"))),
        "width": short < F.bround(c("min_width_m") * 1000),
        "area": c("w_mm").cast("double") * c("d_mm") < c("min_area_m2") * 1e6 - 1,
        "aspect": long > c("max_aspect") * short + 1e-6,
        "outdoor": yes("outdoor") & ~(front | back | out),
        "entrance": yes("entrance") & ~front,
        "daylight": yes("needs_daylight") & ~yes("outdoor") & ~(yes("lit") | front | back),
        "stair_size": (rid == "stair") & ((c("w_mm") != c("stair_w_mm")) | (c("d_mm") != c("stair_d_mm"))),
    }
    here = c("placed_") & c("lot_")
    broken = {name: here & test for name, test in broken.items()} | {"missing": c("placed_").isNull(), "unknown": c("wanted_").isNull()}
    rules = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]))
    own = at.select("program", c("floor_idx").cast("int").alias("floor_idx"), F.explode(rules).alias("rule"), rid.alias("room_a"), none.alias("room_b"))
    place = F.struct("x_mm", "y_mm", "w_mm", "d_mm")
    moved = rects.where("room_id = 'stair'").groupBy("program").agg(F.count_distinct(place).alias("n")).where("n > 1")
    wells = at.where(c("placed_") & yes("light_well"))
    crooked = wells.groupBy("program", "room_id").agg(F.count_distinct(place).alias("n")).where("n > 1")
    over = _pairs(rects).where("a_x_mm < b_x_mm + b_w_mm AND b_x_mm < a_x_mm + a_w_mm AND a_y_mm < b_y_mm + b_d_mm AND b_y_mm < a_y_mm + a_d_mm")
    size = F.when(~out, c("w_mm").cast("long") * c("d_mm"))
    bare = at.where(here).groupBy(*key).agg(F.coalesce(F.sum(size), F.lit(0)).alias("have"), F.first((c("x1_mm") - c("x0_mm")).cast("long") * (c("y1_mm") - c("y0_mm"))).alias("need")).where("have <> need")
    side = lambda p, n: rects.select(*key, *[c(x).alias(f"{p}_{x}") for x in _RECT]).withColumnRenamed(f"{p}_room_id", n)
    walls = pairs.join(side("a", "a"), [*key, "a"]).join(side("b", "b"), [*key, "b"]).withColumn("s", shared_segment()).join(lots.select("program", "min_shared_mm"), "program")
    parts = [
        own,
        row(over, "overlap", c("a_room_id"), c("b_room_id")),
        row(bare, "cover"),
        row(moved, "stair_aligned", floor=many),
        row(crooked, "well_aligned", rid, floor=many),
        row(light_well_continuity(known.where(yes("light_well")), floors), "well_floors", rid),
        row(walls.where(F.coalesce(c("s.hi") - c("s.lo"), F.lit(0)) < c("min_shared_mm")), "shared", c("a"), c("b")),
    ]
    if connections is not None:
        parts.append(row(pairs.join(connections, [*key, "a", "b"], "left_anti"), "connection_missing", c("a"), c("b")))
        parts.append(row(connections.join(pairs, [*key, "a", "b"], "left_anti"), "connection_extra", c("a"), c("b")))
        upright = c("s.orient") == "v"
        told = F.struct("x0_mm", "y0_mm", "x1_mm", "y1_mm")
        real = F.struct(F.when(upright, c("s.c")).otherwise(c("s.lo")).alias("x0_mm"), F.when(upright, c("s.lo")).otherwise(c("s.c")).alias("y0_mm"), F.when(upright, c("s.c")).otherwise(c("s.hi")).alias("x1_mm"), F.when(upright, c("s.hi")).otherwise(c("s.c")).alias("y1_mm"))
        parts.append(row(walls.join(connections, [*key, "a", "b"]).where(c("s").isNotNull() & (told != real)), "connection_wall", c("a"), c("b")))
    return reduce(DataFrame.unionByName, parts)


def area_feasibility(rooms: DataFrame, lots: DataFrame) -> DataFrame:
    """Floors that can't hold their rooms' least areas and the stair, in m² or in whole cells of 0.1 m (rule "area"), lots without ground to
    build on ("lot") and stairs larger than it ("stair"): program, floor_idx (null for a lot's rule), rule, need_m2, have_m2.
    rooms: program, floor_idx, min_area_m2, projecting (such a room takes no ground); lots: program, width_m, depth_m, front_setback_m,
    back_setback_m, stair_width_m, stair_length_m (null: no stair)."""
    c, g = F.col, lambda x: F.bround(x * 10).cast("long")
    wide, deep = g(c("width_m")), g(c("depth_m") - c("back_setback_m")) - g(c("front_setback_m"))
    stair_w, stair_d = (F.coalesce(g(c(n)), F.lit(0)) for n in ("stair_width_m", "stair_length_m"))
    lots = lots.select("program", wide.alias("wide"), deep.alias("deep"), stair_w.alias("sw"), stair_d.alias("sd"), F.coalesce(c("stair_width_m") * c("stair_length_m"), F.lit(0.0)).alias("stair_m2")).withColumn("cells", c("wide") * c("deep"))
    area = F.when(~F.coalesce(c("projecting"), F.lit(False)), F.coalesce("min_area_m2", F.lit(0.0)))
    need = rooms.groupBy("program", "floor_idx").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("m2"), F.coalesce(F.sum(F.ceil(area * 100 - 1e-9)), F.lit(0)).alias("n"))
    at = need.join(lots, "program").withColumns({"need_m2": c("m2") + c("stair_m2"), "have_m2": c("cells") / 100})
    small = at.where((c("cells") > 0) & ((c("need_m2") > c("have_m2") + 1e-9) | (c("n") + c("sw") * c("sd") > c("cells"))))
    whole = lots.withColumns({"need_m2": c("stair_m2"), "have_m2": c("cells") / 100})
    row = lambda df, rule, floor: df.select("program", floor.cast("int").alias("floor_idx"), F.lit(rule).alias("rule"), "need_m2", "have_m2")
    none = (c("wide") <= 0) | (c("deep") <= 0)
    return row(small, "area", c("floor_idx")).unionByName(row(whole.where(none), "lot", F.lit(None))).unionByName(row(whole.where(~none & ((c("sw") > c("wide")) | (c("sd") > c("deep")))), "stair", F.lit(None)))


def merge_intervals(df: DataFrame, group: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Unions of intervals of a group that overlap or touch."""
    by = Window.partitionBy(*group).orderBy(lo, hi)
    before = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new_", F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0))
    islands = marked.withColumn("island_", F.sum("new_").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "island_").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island_")


def axis_positions(spans: DataFrame, bay_mm: int = 5000, snap_mm: int = 100) -> DataFrame:
    """Equal bays of at most 5 m; inner axes are rounded to 100 mm, half to even.  spans: span_id, length_mm."""
    n = F.greatest(F.ceil(F.col("length_mm") / bay_mm), F.lit(1)).cast("int")
    at = spans.select("span_id", "length_mm", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    inner = F.bround(F.col("length_mm") * F.col("i") / F.col("n") / snap_mm) * snap_mm
    return at.select("span_id", "i", F.when(F.col("i") == F.col("n"), F.col("length_mm").cast("double")).otherwise(inner).alias("pos_mm"))


def area_deviation(rects: DataFrame, targets: DataFrame) -> DataFrame:
    """By program, the sum of |area - target| over its rooms, in m²."""
    area = F.col("w_mm").cast("double") * F.col("d_mm") / 1e6
    return rects.join(targets.select("program", "room_id", "target_area_m2"), ["program", "room_id"]).groupBy("program").agg(F.round(F.sum(F.abs(area - F.col("target_area_m2"))), 6).alias("deviation"))


def wall_segments(rects: DataFrame, lots: DataFrame, axes: DataFrame | None = None, outer: int = 200, inner: int = 100) -> DataFrame:
    """Program, floor_idx, orient, c, a, b, is_ext, thick: room edges merged along each line and cut where lines across it reach or
    cross it, on the outer walls along the depth at the column axes too.  A room in the open has no wall on the front or back edge
    of what is built on, and one that projects over the street only its back wall.  rects: also outdoor (null: no); lots: program, x0_mm, y0_mm,
    x1_mm, y1_mm; axes: program, pos_mm along the depth."""
    c, key = F.col, ["program", "floor_idx"]
    box = ["x0_mm", "y0_mm", "x1_mm", "y1_mm"]
    lots = lots.select("program", *box)
    if axes is None:
        lots = lots.withColumn("axes_", F.array().cast("array<int>"))
    else:
        lots = lots.join(axes.groupBy("program").agg(F.collect_set(c("pos_mm").cast("int")).alias("axes_")), "program", "left")
    rows = rects.repartition("program").join(lots, "program")  # dealt by program, edges need no further shuffle to become lines
    open_ = F.coalesce(c("outdoor"), F.lit(False)) if "outdoor" in rects.columns else F.lit(False)
    ahead = c("y_mm") < c("y0_mm")
    x, y, xe, ye = c("x_mm"), c("y_mm"), c("x_mm") + c("w_mm"), c("y_mm") + c("d_mm")
    edge = lambda o, at, lo, hi, there, axes=F.lit(None).cast("array<int>"): F.when(there, F.struct(F.lit(o).alias("orient"), at.alias("c"), lo.alias("lo"), hi.alias("hi"), axes.alias("axes_")))
    outer_axes = lambda at: F.when(at.isin(c("x0_mm"), c("x1_mm")), c("axes_"))
    edges = F.array(
        edge("h", y, x, xe, ~ahead & ~(open_ & (y == c("y0_mm")))), edge("h", ye, x, xe, ahead | ~(open_ & (ye == c("y1_mm")))),
        edge("v", x, y, ye, ~ahead, outer_axes(x)), edge("v", xe, y, ye, ~ahead, outer_axes(xe)),
    )
    raw = rows.select(*key, *box, F.explode(F.array_compact(edges)).alias("e")).select(*key, *box, "e.*")
    lines = stored(merge_intervals(raw, [*key, *box, "axes_", "orient", "c"]), "wall-lines")  # read twice
    across = lines.select(c("program").alias("p_"), c("floor_idx").alias("f_"), F.when(c("orient") == "v", "h").otherwise("v").alias("o_"), c("c").alias("cut"), c("lo").alias("clo"), c("hi").alias("chi")).hint("merge")
    meets = (c("program") == c("p_")) & (c("floor_idx") == c("f_")) & (c("orient") == c("o_")) & c("cut").between(c("lo"), c("hi")) & c("c").between(c("clo"), c("chi"))
    # a line's cuts come together where it has met the lines across it
    cuts = F.concat(F.collect_list("cut"), F.array("lo", "hi"), F.coalesce(F.filter("axes_", lambda p: p.between(c("lo"), c("hi"))), F.array().cast("array<int>")))
    cut = lines.join(across, meets, "left").groupBy(*lines.columns).agg(F.array_sort(F.array_distinct(cuts)).alias("cuts_"))
    parts = F.arrays_zip(F.slice("cuts_", F.lit(1), F.size("cuts_") - 1).alias("a"), F.slice("cuts_", F.lit(2), F.size("cuts_")).alias("b"))
    out = F.when(c("orient") == "v", c("c").isin(c("x0_mm"), c("x1_mm"))).otherwise(c("c").isin(c("y0_mm"), c("y1_mm")))
    cut = cut.select(*key, "orient", "c", F.explode(parts).alias("s"), out.alias("is_ext")).select(*key, "orient", "c", c("s")["a"].alias("a"), c("s")["b"].alias("b"), "is_ext")
    return cut.where("b IS NOT NULL").withColumn("thick", F.when(c("is_ext"), outer).otherwise(inner))


def wall_joints(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of segments that meet at a point, each once, with the end of either that meets, ATSTART or ATEND; segments that meet none)."""
    key = ["program", "floor_idx"]
    seg = segments.withColumn("sid", F.concat_ws(":", "orient", "c", "a", "b"))
    point = lambda e: F.when(F.col("orient") == "v", F.struct(F.col("c").alias("px"), F.col(e).alias("py"))).otherwise(F.struct(F.col(e).alias("px"), F.col("c").alias("py")))
    ends = seg.select(*key, "sid", point("a").alias("p"), F.lit("ATSTART").alias("type")).union(seg.select(*key, "sid", point("b"), F.lit("ATEND")))
    a, b = (ends.select(*key, "p", F.col("sid").alias(f"seg_{n}"), F.col("type").alias(f"type_{n}")) for n in "ab")
    pairs = a.join(b, [*key, "p"]).where("seg_a < seg_b").groupBy(*key, "seg_a", "seg_b").agg(F.min(F.struct("p", "type_a", "type_b")).alias("x"))
    pairs = pairs.select(*key, "seg_a", "seg_b", "x.type_a", "x.type_b")
    met = pairs.select(*key, F.col("seg_a").alias("sid")).union(pairs.select(*key, "seg_b"))
    return pairs, seg.select(*key, "sid").join(met, [*key, "sid"], "left_anti")


def _hosted(df: DataFrame, segments: DataFrame, ident: list[str]) -> DataFrame:
    """df (program, floor_idx, orient, c, mid) with a and b of the first segment of its line that holds the middle."""
    found = df.join(segments.select("program", "floor_idx", "orient", "c", "a", "b"), ["program", "floor_idx", "orient", "c"], "left").withColumn("in_", F.coalesce(F.col("mid").between(F.col("a"), F.col("b")), F.lit(False)))
    best = found.groupBy(*ident).agg(F.min(F.when(F.col("in_"), F.struct("a", "b"))).alias("s_"))
    return df.join(best, ident).select(*df.columns, "s_.a", "s_.b")


def openings(connections: DataFrame, kinds: DataFrame, segments: DataFrame) -> DataFrame:
    """Connections (program, floor_idx, room_a, room_b, orient, c, lo, hi) as light-well windows (an upper floor, a well on either side)
    or doors, with the first segment of the line that holds their middle.  kinds: program, room_id, light_well."""
    side = lambda n: kinds.select("program", F.col("room_id").alias(f"room_{n}"), F.col("light_well").alias(f"well_{n}"))
    j = connections.join(side("a"), ["program", "room_a"], "left").join(side("b"), ["program", "room_b"], "left").withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    well = F.coalesce("well_a", F.lit(False)) | F.coalesce("well_b", F.lit(False))
    j = j.select("program", "floor_idx", "room_a", "room_b", F.when((F.col("floor_idx") > 0) & well, "window").otherwise("door").alias("kind"), "orient", "c", "mid")
    return _hosted(j, segments, ["program", "floor_idx", "room_a", "room_b"])


# Fixed values, in mm: the width of a window, in small rooms and others; what a room's wall and a door beside it must leave.
SMALL_KINDS, SMALL_WINDOW, WINDOW = ["wc", "kho"], 600.0, 2400.0
WALL_LEAVES, LEAST_SPAN, SPAN_LEAVES = 600, 1200.0, 400.0


def facade_windows(rects: DataFrame, lots: DataFrame, segments: DataFrame, doors: DataFrame | None = None) -> DataFrame:
    """A window for each edge that an indoor room has on the front or back of what is built on: program, floor_idx, room_id, c, mid, width
    and the segment (a, b) that holds it.  Beside doors of that edge a window goes to the wider span of the room, if that is wide
    enough, else there is none.  rects: also kind, outdoor, light_well (the stair has no kind); doors: program, floor_idx, c, lo, hi."""
    c, key = F.col, ["program", "floor_idx", "room_id", "c"]
    inside = rects.where("kind IS NOT NULL AND NOT coalesce(outdoor, false) AND NOT coalesce(light_well, false)").join(lots.select("program", "y0_mm", "y1_mm"), "program")
    edge = inside.withColumn("c", F.explode(F.array_compact(F.array(*[F.when((c("y_mm") == c(y)) | (c("y_mm") + c("d_mm") == c(y)), c(y)) for y in ("y0_mm", "y1_mm")]))))
    width = F.least(F.when(c("kind").isin(SMALL_KINDS), SMALL_WINDOW).otherwise(WINDOW), (c("w_mm") - WALL_LEAVES).cast("double"))
    rows = edge.select(*key, c("x_mm").cast("double").alias("r0"), (c("x_mm") + c("w_mm")).cast("double").alias("r1"), width.alias("width"))
    if doors is None:
        rows = rows.withColumns({"d0": F.lit(None).cast("double"), "d1": F.lit(None).cast("double")})
    else:
        taken = rows.join(doors.select("program", "floor_idx", "c", c("lo").alias("lo_"), c("hi").alias("hi_")), ["program", "floor_idx", "c"]).where(F.greatest("r0", "lo_") < F.least("r1", "hi_"))
        rows = rows.join(taken.groupBy(*key).agg(F.min("lo_").cast("double").alias("d0"), F.max("hi_").cast("double").alias("d1")), key, "left")
    left, right, least = c("d0") - c("r0"), c("r1") - c("d1"), F.greatest(F.lit(LEAST_SPAN), c("width") + SPAN_LEAVES)
    mid = F.when(c("d0").isNull(), (c("r0") + c("r1")) / 2).when((left >= right) & (left >= least), (c("r0") + c("d0")) / 2).when(right >= least, (c("d1") + c("r1")) / 2)
    placed = rows.withColumn("mid", mid).where("mid IS NOT NULL").select(*key, F.lit("h").alias("orient"), "mid", "width")
    return _hosted(placed, segments, key).drop("orient")
