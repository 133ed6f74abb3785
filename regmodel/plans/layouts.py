"""Queries of room programs and layouts (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import layouts
from .base import fixture, query

_KINDS = [("san", 1.5, 4.0, 5.0, False, True, False), ("bep", 1.8, 6.0, 3.0, True, False, False), ("ngu", 2.4, 9.0, 2.5, True, False, False), ("wc", 1.2, 2.5, 3.0, False, False, True)]
_KINDS_SQL = ", ".join(f"('{k}', {w}, {a}, {r}, {str(dl).lower()}, {str(o).lower()}, {str(lw).lower()})" for k, w, a, r, dl, o, lw in _KINDS)
_KINDS_SQL = f"(VALUES {_KINDS_SQL}) k(kind, min_width_m, min_area_m2, max_aspect, needs_daylight, outdoor, light_well)"


def kinds(spark):
    return spark.createDataFrame(_KINDS, "kind string, min_width_m double, min_area_m2 double, max_aspect double, needs_daylight boolean, outdoor boolean, light_well boolean")


def _rooms(spark, d):
    return fixture(spark, d, "fx_rooms").withColumn("floor_idx", (F.substring("room_id", 2, 9).cast("int") % 3))


@query("j1_apply_room_defaults", f"SELECT program, room_id, min_width_m, min_area_m2, max_aspect, needs_daylight, target_area_m2, CASE CAST(substr(room_id, 2) AS INT) % 5 WHEN 0 THEN 3.9 WHEN 1 THEN 3.6 ELSE 3.3 END AS height_m FROM fx_rooms JOIN {_KINDS_SQL} USING (kind)")
def j1(spark, d):
    r = layouts.apply_room_defaults(fixture(spark, d, "fx_rooms"), kinds(spark))
    return r.withColumn("height_m", layouts.storey_height(F.substring("room_id", 2, 9).cast("int") % 5)).select("program", "room_id", "min_width_m", "min_area_m2", "max_aspect", "needs_daylight", "target_area_m2", "height_m")


_PROG = f"""WITH r AS (SELECT *, CAST(substr(room_id, 2) AS INT) % 3 AS floor_idx, CAST(substr(room_id, 2) AS INT) % 4 = 0 AS entrance, CAST(substr(room_id, 2) AS INT) % 5 = 0 AS projecting, CASE WHEN program % 7 = 0 AND room_id = 'r1' THEN 'attic' ELSE kind END AS k2 FROM fx_rooms),
fl AS (SELECT DISTINCT program, floor_idx, CASE WHEN program % 5 = 0 THEN 2.9 WHEN program % 5 = 1 THEN 3.35 ELSE 3.3 END AS height_m, program % 2 = 0 AS has_stair FROM r),
lt AS (SELECT DISTINCT program, CASE WHEN program % 4 = 0 THEN 4.05 ELSE 4.0 END AS width_m, CAST(program % 14 AS DOUBLE) AS street_width_m FROM r),
j AS (SELECT r.*, k.outdoor FROM r LEFT JOIN {_KINDS_SQL} ON r.k2 = k.kind), en AS (SELECT program, floor_idx, count(*) FILTER (entrance) AS n FROM r GROUP BY ALL)
"""


@query("j2_validate_program", _PROG + """SELECT program, NULL::INT AS floor_idx, NULL::VARCHAR AS room_id, 'lot_grid' AS rule FROM lt WHERE width_m = 4.05
UNION ALL SELECT program, floor_idx, NULL, 'height' FROM fl WHERE height_m < 3 UNION ALL SELECT program, floor_idx, NULL, 'height_grid' FROM fl WHERE height_m = 3.35
UNION ALL SELECT program, NULL, NULL, 'stair' FROM fl GROUP BY program HAVING count(*) >= 2 AND NOT bool_or(has_stair)
UNION ALL SELECT program, floor_idx, room_id, 'unknown_kind' FROM j WHERE outdoor IS NULL UNION ALL SELECT program, floor_idx, room_id, 'projecting_indoor' FROM j WHERE projecting AND NOT outdoor
UNION ALL SELECT program, floor_idx, room_id, 'projecting_ground' FROM r WHERE projecting AND floor_idx < 1 UNION ALL SELECT program, floor_idx, room_id, 'projecting_street' FROM r JOIN lt USING (program) WHERE projecting AND street_width_m < 7
UNION ALL SELECT program, floor_idx, NULL, 'entrance' FROM en WHERE floor_idx = 0 AND n <> 1 UNION ALL SELECT program, floor_idx, NULL, 'entrance_above' FROM en WHERE floor_idx > 0 AND n > 0
UNION ALL SELECT program, floor_idx, room_id, 'unknown_adjacent' FROM r WHERE adjacent_to IS NOT NULL""")
def j2(spark, d):
    n = F.substring("room_id", 2, 9).cast("int")
    r = fixture(spark, d, "fx_rooms").withColumns({
        "floor_idx": n % 3, "entrance": n % 4 == 0, "projecting": n % 5 == 0, "kind": F.when((F.col("program") % 7 == 0) & (F.col("room_id") == "r1"), "attic").otherwise(F.col("kind")),
        "adjacent_to": F.when(F.col("adjacent_to").isNotNull(), F.array("adjacent_to")).otherwise(F.array().cast("array<string>")),
    })
    p = F.col("program")
    fl = r.select("program", "floor_idx").distinct().withColumns({"height_m": F.when(p % 5 == 0, 2.9).when(p % 5 == 1, 3.35).otherwise(3.3), "has_stair": p % 2 == 0})
    lt = r.select("program").distinct().withColumns({"width_m": F.when(p % 4 == 0, 4.05).otherwise(4.0), "depth_m": F.lit(12.0), "street_width_m": (p % 14).cast("double")})
    return layouts.validate_program(r, fl, lt, kinds(spark).select("kind", "outdoor"))


_FLOORED = """fr AS (SELECT program, room_id, kind, target_area_m2, CAST(substr(room_id, 2) AS INT) AS n, CAST((CAST(substr(room_id, 2) AS INT) - 1 - (CAST(substr(room_id, 2) AS INT) - 1) % 3) / 3 AS INT) AS floor_idx,
CASE WHEN CAST(substr(room_id, 2) AS INT) % 3 <> 1 THEN adjacent_to WHEN program % 3 = 0 THEN 'stair' END AS o FROM fx_rooms)"""


def _floored(spark, d):
    """Three rooms a floor; the first one is at the stair, where there is one."""
    n = F.substring("room_id", 2, 9).cast("int")
    r = fixture(spark, d, "fx_rooms").withColumns({"position": n, "floor_idx": F.floor((n - 1) / 3).cast("int"), "o": F.when(n % 3 != 1, F.col("adjacent_to")).when(F.col("program") % 3 == 0, "stair")})
    return r.withColumn("adjacent_to", F.when(F.col("o").isNotNull(), F.array("o")).otherwise(F.array().cast("array<string>")))


@query("j3_floor_connectivity", f"""WITH RECURSIVE {_FLOORED}, e AS (SELECT program, floor_idx, room_id AS a, o AS b FROM fr WHERE o IS NOT NULL UNION SELECT program, floor_idx, o, room_id FROM fr WHERE o IS NOT NULL),
i AS (SELECT program, floor_idx, room_id FROM fr UNION SELECT program, floor_idx, 'stair' FROM fr WHERE program % 3 < 2),
s(program, floor_idx, room_id) AS (SELECT program, floor_idx, arg_min(room_id, n) FROM fr GROUP BY program, floor_idx UNION SELECT e.program, e.floor_idx, e.b FROM s JOIN e ON s.program = e.program AND s.floor_idx = e.floor_idx AND s.room_id = e.a)
SELECT * FROM i EXCEPT SELECT * FROM s""")
def j3(spark, d):
    r = _floored(spark, d)
    return layouts.floor_connectivity(r, r.select("program", "floor_idx").distinct().withColumn("has_stair", F.col("program") % 3 < 2))


@query("j4_light_well_continuity", """WITH w AS (SELECT program, kind AS room_id, CAST(substr(room_id, 2) AS INT) % 4 AS floor_idx FROM fx_rooms), t AS (SELECT program, max(floor_idx) AS top FROM w GROUP BY program), l AS (SELECT program, room_id, min(floor_idx) AS low FROM w WHERE room_id = 'wc' GROUP BY ALL)
SELECT program, room_id, CAST(f AS INT) AS floor_idx FROM l JOIN t USING (program), range(0, 4) g(f) WHERE f BETWEEN low AND top EXCEPT SELECT program, room_id, CAST(floor_idx AS INT) FROM w""")
def j4(spark, d):
    w = fixture(spark, d, "fx_rooms").select("program", F.col("kind").alias("room_id"), (F.substring("room_id", 2, 9).cast("int") % 4).alias("floor_idx"))
    return layouts.light_well_continuity(w.where("room_id = 'wc'").distinct(), w)


@query("j5_balcony_projection", "SELECT lot_id, CASE WHEN street_width_m >= 7 THEN 1.2 ELSE 0.0 END AS max_projection_m FROM fx_lots")
def j5(spark, d):
    return layouts.balcony_projection(fixture(spark, d, "fx_lots")).select("lot_id", "max_projection_m")


@query("j6_typical_floors", """WITH s AS (SELECT program, CAST(substr(room_id, 2) AS INT) % 3 AS floor_idx, string_agg(kind, ',' ORDER BY kind) AS sign FROM fx_rooms GROUP BY ALL) SELECT program, floor_idx, min(floor_idx) OVER (PARTITION BY program, sign) AS same_as FROM s""")
def j6(spark, d):
    return layouts.typical_floors(_rooms(spark, d), ["kind"])


_PAIRS = "fx_rects a JOIN fx_rects b ON a.program = b.program AND a.floor_idx = b.floor_idx AND a.room_id < b.room_id"
_SHARED = f"""SELECT a.program, a.floor_idx, a.room_id AS room_a, b.room_id AS room_b,
 CASE WHEN a.x_mm + a.w_mm = b.x_mm AND greatest(a.y_mm, b.y_mm) < least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) THEN b.x_mm WHEN a.x_mm + a.w_mm <> b.x_mm AND b.x_mm + b.w_mm = a.x_mm AND greatest(a.y_mm, b.y_mm) < least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) THEN a.x_mm END AS v,
 CASE WHEN a.y_mm + a.d_mm = b.y_mm AND greatest(a.x_mm, b.x_mm) < least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) THEN b.y_mm WHEN a.y_mm + a.d_mm <> b.y_mm AND b.y_mm + b.d_mm = a.y_mm AND greatest(a.x_mm, b.x_mm) < least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) THEN a.y_mm END AS h,
 greatest(a.y_mm, b.y_mm) AS vlo, least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) AS vhi, greatest(a.x_mm, b.x_mm) AS hlo, least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) AS hhi FROM {_PAIRS}"""


@query("j7_shared_segments", f"SELECT program, floor_idx, room_a, room_b, CASE WHEN v IS NOT NULL THEN 'v' ELSE 'h' END AS orient, coalesce(v, h) AS c, CASE WHEN v IS NOT NULL THEN vlo ELSE hlo END AS lo, CASE WHEN v IS NOT NULL THEN vhi ELSE hhi END AS hi FROM ({_SHARED}) t WHERE v IS NOT NULL OR h IS NOT NULL")
def j7(spark, d):
    return layouts.shared_segments(fixture(spark, d, "fx_rects"))


#: Rectangles with the rooms of their programs; r2 of every third program is the stair, on one floor.
_PLACED = f"""q AS (SELECT f.program, f.floor_idx, CASE WHEN f.program % 3 = 0 AND f.room_id = 'r2' THEN 'stair' ELSE f.room_id END AS room_id, f.x_mm, f.y_mm, f.w_mm, f.d_mm, r.kind AS k0, CASE WHEN f.program % 3 = 0 AND r.adjacent_to = 'r2' THEN 'stair' ELSE r.adjacent_to END AS o FROM fx_rects f JOIN fx_rooms r ON f.program = r.program AND f.room_id = r.room_id),
pr AS (SELECT q.program, q.floor_idx, q.room_id, kind, min_width_m, min_area_m2, max_aspect, needs_daylight, outdoor, light_well, q.room_id = 'r1' AS entrance, kind = 'san' AND q.floor_idx > 0 AND q.program % 4 = 0 AS projecting,
  CASE WHEN EXISTS (SELECT 1 FROM q z WHERE z.program = q.program AND z.floor_idx = q.floor_idx AND z.room_id = q.o) THEN q.o END AS o FROM q JOIN {_KINDS_SQL} ON k.kind = q.k0 WHERE q.room_id <> 'stair'),
lo AS (SELECT DISTINCT program, 0 AS x0, 1000 * (program % 2) AS y0, 7000 AS x1, 6000 AS y1 FROM q), pa AS (SELECT DISTINCT program, floor_idx, least(room_id, o) AS a, greatest(room_id, o) AS b FROM pr WHERE o IS NOT NULL),
wy AS (SELECT program, floor_idx, a AS room_id, b AS n FROM pa UNION ALL SELECT program, floor_idx, b, a FROM pa), li AS (SELECT DISTINCT wy.program, wy.floor_idx, wy.room_id FROM wy JOIN pr ON pr.program = wy.program AND pr.floor_idx = wy.floor_idx AND pr.room_id = wy.n WHERE outdoor OR light_well),
p AS (SELECT q.*, kind, min_width_m, min_area_m2, max_aspect, coalesce(needs_daylight, false) AS dl, coalesce(outdoor, false) AS od, coalesce(light_well, false) AS lw, coalesce(entrance, false) AS en, coalesce(projecting, false) AS pj, x0, y0, x1, y1, y_mm = y0 AS fr, y_mm + d_mm = y1 AS bk,
  EXISTS (SELECT 1 FROM li WHERE li.program = q.program AND li.floor_idx = q.floor_idx AND li.room_id = q.room_id) AS lit FROM q LEFT JOIN pr USING (program, floor_idx, room_id) JOIN lo USING (program))"""


def _placed(spark, d):
    """rects, rooms and lots of the fixture."""
    q = fixture(spark, d, "fx_rects").join(fixture(spark, d, "fx_rooms").select("program", "room_id", "kind", "adjacent_to"), ["program", "room_id"])
    stair = lambda c: F.when((F.col("program") % 3 == 0) & (F.col(c) == "r2"), "stair").otherwise(F.col(c))
    q = stored(q.withColumns({"room_id": stair("room_id"), "o": stair("adjacent_to")}), "placed")  # all that is returned reads it
    rects = q.select("program", "floor_idx", "room_id", "x_mm", "y_mm", "w_mm", "d_mm", F.when(F.col("room_id") != "stair", F.col("kind")).alias("kind"))
    there = q.select("program", "floor_idx", F.col("room_id").alias("o"), F.array("room_id").alias("adjacent")).distinct()
    rooms = q.where("room_id <> 'stair'").join(there, ["program", "floor_idx", "o"], "left").join(kinds(spark).drop("outdoor", "light_well"), "kind")
    rooms = rooms.select("program", "floor_idx", "room_id", "kind", "min_width_m", "min_area_m2", "max_aspect", "needs_daylight", (F.col("room_id") == "r1").alias("entrance"), ((F.col("kind") == "san") & (F.col("floor_idx") > 0) & (F.col("program") % 4 == 0)).alias("projecting"), F.coalesce("adjacent", F.array().cast("array<string>")).alias("adjacent_to"))
    return rects, rooms, _lots(q)


def _lots(rows):
    size = F.when(F.col("program") % 3 == 0, 2000)
    return rows.select("program").distinct().withColumns({"x0_mm": F.lit(0), "y0_mm": (1000 * (F.col("program") % 2)).cast("int"), "x1_mm": F.lit(7000), "y1_mm": F.lit(6000), "projection_mm": F.lit(1000), "min_shared_mm": F.lit(1500), "stair_w_mm": size, "stair_d_mm": size})


_OWN = {
    "bounds": "NOT pj AND (x_mm < x0 OR y_mm < y0 OR x_mm + w_mm > x1 OR y_mm + d_mm > y1)", "projection": "pj AND (x_mm < x0 OR x_mm + w_mm > x1 OR y_mm <> y0 - 1000 OR d_mm <> 1000)", "width": "least(w_mm, d_mm) < min_width_m * 1000",
    "area": "w_mm * d_mm < min_area_m2 * 1e6 - 1", "aspect": "greatest(w_mm, d_mm) > max_aspect * least(w_mm, d_mm) + 1e-6", "outdoor": "od AND NOT (fr OR bk OR pj)", "entrance": "en AND NOT fr", "daylight": "dl AND NOT od AND NOT (lit OR fr OR bk)",
    "stair_size": "room_id = 'stair' AND (w_mm <> 2000 OR d_mm <> 2000)",
}
_BOXES = "q a JOIN q b ON a.program = b.program AND a.floor_idx = b.floor_idx AND a.room_id < b.room_id"
_WALL = "CASE WHEN (a.x_mm + a.w_mm = b.x_mm OR b.x_mm + b.w_mm = a.x_mm) AND least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) > greatest(a.y_mm, b.y_mm) THEN least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) - greatest(a.y_mm, b.y_mm) WHEN (a.y_mm + a.d_mm = b.y_mm OR b.y_mm + b.d_mm = a.y_mm) AND least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) > greatest(a.x_mm, b.x_mm) THEN least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) - greatest(a.x_mm, b.x_mm) ELSE 0 END"
_WELLS = "w AS (SELECT program, room_id, floor_idx, x_mm, y_mm, w_mm, d_mm FROM p WHERE lw), wf AS (SELECT program, room_id, min(floor_idx) AS f0 FROM w GROUP BY ALL), tp AS (SELECT program, max(floor_idx) AS top FROM pr GROUP BY program)"


@query("j8_layout_violations", f"WITH {_PLACED}, {_WELLS} " + " UNION ALL ".join([f"SELECT program, floor_idx, '{rule}' AS rule, room_id AS room_a, NULL::VARCHAR AS room_b FROM p WHERE {test}" for rule, test in _OWN.items()]) + f"""
UNION ALL SELECT program, floor_idx, 'missing', 'stair', NULL FROM (SELECT DISTINCT program, floor_idx FROM pr WHERE program % 3 = 0) f WHERE (program, floor_idx) NOT IN (SELECT (program, floor_idx) FROM q WHERE room_id = 'stair')
UNION ALL SELECT program, floor_idx, 'unknown', room_id, NULL FROM q WHERE room_id = 'stair' AND (program, floor_idx) NOT IN (SELECT (program, floor_idx) FROM pr)
UNION ALL SELECT a.program, a.floor_idx, 'overlap', a.room_id, b.room_id FROM {_BOXES} AND a.x_mm < b.x_mm + b.w_mm AND b.x_mm < a.x_mm + a.w_mm AND a.y_mm < b.y_mm + b.d_mm AND b.y_mm < a.y_mm + a.d_mm
UNION ALL SELECT program, floor_idx, 'cover', NULL, NULL FROM p GROUP BY program, floor_idx, x0, y0, x1, y1 HAVING coalesce(sum(w_mm * d_mm) FILTER (NOT pj), 0) <> (x1 - x0) * (y1 - y0)
UNION ALL SELECT program, NULL, 'well_aligned', room_id, NULL FROM w GROUP BY program, room_id HAVING count(DISTINCT (x_mm, y_mm, w_mm, d_mm)) > 1
UNION ALL SELECT program, CAST(f AS INT), 'well_floors', room_id, NULL FROM wf JOIN tp USING (program), range(0, 3) g(f) WHERE f BETWEEN f0 AND top AND (program, room_id, f) NOT IN (SELECT (program, room_id, floor_idx) FROM w)
UNION ALL SELECT a.program, a.floor_idx, 'shared', a.room_id, b.room_id FROM {_BOXES} JOIN pa ON pa.program = a.program AND pa.floor_idx = a.floor_idx AND pa.a = a.room_id AND pa.b = b.room_id WHERE {_WALL} < 1500""")
def j8(spark, d):
    return layouts.layout_violations(*_placed(spark, d), kinds(spark))


@query("j9_area_feasibility", f"""WITH {_FLOORED}, n AS (SELECT program, floor_idx, coalesce(sum(target_area_m2 / 4) FILTER (NOT (kind = 'san' AND floor_idx > 0)), 0) + CASE WHEN program % 3 = 0 THEN 8.4 ELSE 0 END AS m2, coalesce(sum(ceil(target_area_m2 / 4 * 100 - 1e-9)) FILTER (NOT (kind = 'san' AND floor_idx > 0)), 0) + CASE WHEN program % 3 = 0 THEN 840 ELSE 0 END AS cells, (40 + program % 3 * 5) * (55 - 20 * (program % 4)) AS have FROM fr GROUP BY program, floor_idx)
SELECT program, floor_idx, 'area' AS rule, round(m2, 6) AS need_m2, have / 100 AS have_m2 FROM n WHERE have > 0 AND (m2 > have / 100 + 1e-9 OR cells > have)
UNION ALL SELECT DISTINCT program, NULL, 'lot', CASE WHEN program % 3 = 0 THEN 8.4 ELSE 0 END, have / 100 FROM n WHERE have <= 0 UNION ALL SELECT DISTINCT program, NULL, 'stair', 8.4, have / 100 FROM n WHERE have > 0 AND program % 3 = 0 AND 55 - 20 * (program % 4) < 40""")
def j9(spark, d):
    p = F.col("program")
    r = _floored(spark, d).withColumns({"min_area_m2": F.col("target_area_m2") / 4, "projecting": (F.col("kind") == "san") & (F.col("floor_idx") > 0)})
    lots = r.select("program").distinct().withColumns({"width_m": 4 + (p % 3) * 0.5, "depth_m": F.lit(7.0), "front_setback_m": F.lit(1.0) + 2.0 * (p % 4), "back_setback_m": F.lit(0.5), "stair_width_m": F.when(p % 3 == 0, 2.1), "stair_length_m": F.when(p % 3 == 0, 4.0)})
    return layouts.area_feasibility(r, lots).withColumn("need_m2", F.round("need_m2", 6))


_MERGED = """m AS (SELECT *, max(hi) OVER (PARTITION BY program, floor_idx, orient, c ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM iv),
isl AS (SELECT *, sum(CASE WHEN mx IS NULL OR lo > mx THEN 1 ELSE 0 END) OVER (PARTITION BY program, floor_idx, orient, c ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m), ln AS (SELECT program, floor_idx, orient, c, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY program, floor_idx, orient, c, k)"""


@query("j10_merge_intervals", f"WITH iv AS (SELECT program, floor_idx, 'h' AS orient, y_mm AS c, x_mm AS lo, x_mm + w_mm AS hi FROM fx_rects), {_MERGED} SELECT program, floor_idx, c, lo, hi FROM ln")
def j10(spark, d):
    r = fixture(spark, d, "fx_rects").select("program", "floor_idx", F.col("y_mm").alias("c"), F.col("x_mm").alias("lo"), (F.col("x_mm") + F.col("w_mm")).alias("hi"))
    return layouts.merge_intervals(r, ["program", "floor_idx", "c"])


@query("j11_axis_positions", "SELECT spec_id AS span_id, CAST(i AS INT) AS i, CASE WHEN i = n THEN footprint_length ELSE round_even(footprint_length * i / n / 100, 0) * 100 END AS pos_mm FROM (SELECT *, greatest(CAST(ceil(footprint_length / 5000) AS INT), 1) AS n FROM fx_buildings) t, range(0, 40) r(i) WHERE i <= n")
def j11(spark, d):
    return layouts.axis_positions(fixture(spark, d, "fx_buildings").select(F.col("spec_id").alias("span_id"), F.col("footprint_length").alias("length_mm")))


@query("j12_area_deviation", "SELECT program, round(sum(abs(CAST(w_mm AS DOUBLE) * d_mm / 1e6 - target_area_m2)), 6) AS deviation FROM fx_rects JOIN fx_rooms USING (program, room_id) GROUP BY program")
def j12(spark, d):
    return layouts.area_deviation(fixture(spark, d, "fx_rects"), fixture(spark, d, "fx_rooms"))


#: Walls of the placed rooms: outdoor rooms (not the stair) on the front or back edge, rooms that project, and column axes on the side walls.
_SEGMENTS = f"""{_PLACED}, ax AS (SELECT * FROM (VALUES (2500), (4100)) v(pos)), iv AS (SELECT program, floor_idx, 'h' AS orient, y_mm AS c, x_mm AS lo, x_mm + w_mm AS hi, y0 FROM p WHERE y_mm >= y0 AND NOT (od AND y_mm = y0) UNION ALL SELECT program, floor_idx, 'h', y_mm + d_mm, x_mm, x_mm + w_mm, y0 FROM p WHERE y_mm < y0 OR NOT (od AND y_mm + d_mm = y1)
UNION ALL SELECT program, floor_idx, 'v', x_mm, y_mm, y_mm + d_mm, y0 FROM p WHERE y_mm >= y0 UNION ALL SELECT program, floor_idx, 'v', x_mm + w_mm, y_mm, y_mm + d_mm, y0 FROM p WHERE y_mm >= y0), {_MERGED},
ct AS (SELECT l.*, o.c AS cut FROM ln l JOIN ln o ON l.program = o.program AND l.floor_idx = o.floor_idx AND l.orient <> o.orient AND o.c BETWEEN l.lo AND l.hi AND l.c BETWEEN o.lo AND o.hi UNION SELECT *, lo FROM ln UNION SELECT *, hi FROM ln UNION SELECT ln.*, pos FROM ln, ax WHERE orient = 'v' AND c IN (0, 7000) AND pos BETWEEN lo AND hi),
sg AS (SELECT program, floor_idx, orient, c, cut AS a, lead(cut) OVER (PARTITION BY program, floor_idx, orient, c, lo, hi ORDER BY cut) AS b, CASE WHEN orient = 'v' THEN c IN (0, 7000) ELSE c = 1000 * (program % 2) OR c = 6000 END AS is_ext FROM ct), s AS (SELECT *, concat_ws(':', orient, c, a, b) AS sid FROM sg WHERE b IS NOT NULL)"""


def _walls(spark, d):
    """(rects with kinds, lots, segments)."""
    rects = _placed(spark, d)[0].join(F.broadcast(kinds(spark).select("kind", "outdoor", "light_well")), "kind", "left")
    lots = stored(_lots(rects), "lots")
    axes = lots.select("program", F.explode(F.array(F.lit(2500), F.lit(4100))).alias("pos_mm"))
    return rects, lots, layouts.wall_segments(rects, lots, axes)


@query("j13_wall_segments", f"WITH {_SEGMENTS} SELECT program, floor_idx, orient, c, a, b, is_ext, CASE WHEN is_ext THEN 200 ELSE 100 END AS thick FROM s")
def j13(spark, d):
    return _walls(spark, d)[2]


@query("j14_wall_joints", f"""WITH {_SEGMENTS}, e AS (SELECT program, floor_idx, sid, CASE WHEN orient = 'v' THEN c ELSE a END AS px, CASE WHEN orient = 'v' THEN a ELSE c END AS py, 'ATSTART' AS t FROM s UNION ALL SELECT program, floor_idx, sid, CASE WHEN orient = 'v' THEN c ELSE b END, CASE WHEN orient = 'v' THEN b ELSE c END, 'ATEND' FROM s)
SELECT x.program, x.floor_idx, x.sid AS seg_a, y.sid AS seg_b, min(x.t) AS type_a, min(y.t) AS type_b FROM e x JOIN e y ON x.program = y.program AND x.floor_idx = y.floor_idx AND x.px = y.px AND x.py = y.py AND x.sid < y.sid GROUP BY ALL""")
def j14(spark, d):
    return layouts.wall_joints(_walls(spark, d)[2])[0]


_HOST = "LEFT JOIN s ON k.program = s.program AND k.floor_idx = s.floor_idx AND k.orient = s.orient AND k.c = s.c AND mid BETWEEN s.a AND s.b GROUP BY ALL"
_MET = "SELECT a.program, a.floor_idx, a.room_id AS room_a, b.room_id AS room_b, a.lw OR b.lw AS well, CASE WHEN a.x_mm + a.w_mm = b.x_mm THEN b.x_mm WHEN b.x_mm + b.w_mm = a.x_mm THEN a.x_mm END AS v0, CASE WHEN a.y_mm + a.d_mm = b.y_mm THEN b.y_mm WHEN b.y_mm + b.d_mm = a.y_mm THEN a.y_mm END AS h0, greatest(a.y_mm, b.y_mm) AS vlo, least(a.y_mm + a.d_mm, b.y_mm + b.d_mm) AS vhi, greatest(a.x_mm, b.x_mm) AS hlo, least(a.x_mm + a.w_mm, b.x_mm + b.w_mm) AS hhi FROM p a JOIN p b ON a.program = b.program AND a.floor_idx = b.floor_idx AND a.room_id < b.room_id"


@query("j15_openings", f"""WITH {_SEGMENTS}, mt AS (SELECT *, v0 IS NOT NULL AND vlo < vhi AS up FROM ({_MET}) t WHERE v0 IS NOT NULL AND vlo < vhi OR h0 IS NOT NULL AND hlo < hhi),
k AS (SELECT program, floor_idx, room_a, room_b, CASE WHEN floor_idx > 0 AND well THEN 'window' ELSE 'door' END AS kind, CASE WHEN up THEN 'v' ELSE 'h' END AS orient, CASE WHEN up THEN v0 ELSE h0 END AS c, CASE WHEN up THEN (vlo + vhi) / 2 ELSE (hlo + hhi) / 2 END AS mid FROM mt)
SELECT k.program, k.floor_idx, room_a, room_b, kind, k.orient, k.c, mid, min(s.a) AS a FROM k {_HOST}""")
def j15(spark, d):
    rects, _, segments = _walls(spark, d)
    wells = rects.select("program", "room_id", F.coalesce("light_well", F.lit(False)).alias("light_well")).groupBy("program", "room_id").agg(F.bool_or("light_well").alias("light_well"))
    return layouts.openings(layouts.shared_segments(rects), wells, segments).drop("b")


@query("j15_facade_windows", f"""WITH {_SEGMENTS}, dr AS (SELECT program, floor_idx, y0 AS c, x_mm + 200 AS lo, x_mm + 1100 AS hi FROM p WHERE en AND fr), ed AS (SELECT program, floor_idx, room_id, x_mm, w_mm, kind, unnest(list_filter([CASE WHEN y_mm = y0 OR y_mm + d_mm = y0 THEN y0 END, CASE WHEN y_mm = y1 OR y_mm + d_mm = y1 THEN y1 END], lambda z: z IS NOT NULL)) AS c FROM p WHERE kind IS NOT NULL AND NOT od AND NOT lw),
f AS (SELECT program, floor_idx, room_id, ed.c, x_mm AS r0, x_mm + w_mm AS r1, least(CASE WHEN kind IN ('wc', 'kho') THEN 600 ELSE 2400 END, w_mm - 600) AS width, min(lo) AS d0, max(hi) AS d1 FROM ed LEFT JOIN dr USING (program, floor_idx, c) WHERE TRUE GROUP BY ALL),
g AS (SELECT f.program, f.floor_idx, f.room_id, f.c, r0, r1, width, CASE WHEN greatest(r0, d0) < least(r1, d1) THEN d0 END AS d0, CASE WHEN greatest(r0, d0) < least(r1, d1) THEN d1 END AS d1 FROM f),
k AS (SELECT *, 'h' AS orient, CASE WHEN d0 IS NULL THEN (r0 + r1) / 2 WHEN d0 - r0 >= r1 - d1 AND d0 - r0 >= greatest(1200, width + 400) THEN (r0 + d0) / 2 WHEN r1 - d1 >= greatest(1200, width + 400) THEN (d1 + r1) / 2 END AS mid FROM g)
SELECT k.program, k.floor_idx, room_id, k.c, mid, CAST(width AS DOUBLE) AS width, min(s.a) AS a FROM k {_HOST.replace("GROUP BY", "WHERE mid IS NOT NULL GROUP BY")}""")
def j15b(spark, d):
    """A door beside the front wall's left end in the entrance room."""
    rects, lots, segments = _walls(spark, d)
    doors = rects.where("room_id = 'r1'").join(lots, "program").where("y_mm = y0_mm").select("program", "floor_idx", F.col("y0_mm").alias("c"), (F.col("x_mm") + 200).alias("lo"), (F.col("x_mm") + 1100).alias("hi"))
    return layouts.facade_windows(rects, lots, segments, doors).drop("b")
