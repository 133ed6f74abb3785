"""Design parameters: bounds, compliance findings and quantity expansion (I).

Rules are data: each is a condition and the fields of its finding; all are evaluated in one pass over a specification.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

# The least and largest allowed value of each parameter, in mm where it is a length.
BOUNDS = {
    "building": {
        "num_storeys": (1.0, 40.0),
        "storey_height": (2400.0, 6000.0),
        "footprint_length": (3000.0, 150000.0),
        "footprint_width": (3000.0, 150000.0),
        "wall_thickness": (100.0, 600.0),
        "column_size": (200.0, 1500.0),
        "slab_thickness": (80.0, 500.0),
        "beam_height": (200.0, 1500.0),
        "beam_width": (150.0, 800.0),
        "num_interior_walls_x": (0.0, 20.0),
        "num_interior_walls_y": (0.0, 20.0),
        "doors_per_storey": (0.0, 50.0),
        "windows_per_storey": (0.0, 100.0),
        "num_staircases": (0.0, 10.0),
        "column_spacing_x": (2000.0, 15000.0),
        "column_spacing_y": (2000.0, 15000.0),
        "corridor_width": (900.0, 6000.0),
        "footing_depth": (300.0, 5000.0),
        "railing_height": (900.0, 1500.0),
        "riser_height": (100.0, 200.0),
        "tread_depth": (220.0, 400.0),
        "window_sill_height": (0.0, 1500.0),
    },
    "bridge": {
        "total_length": (6000.0, 500000.0),
        "deck_width": (4000.0, 40000.0),
        "num_spans": (1.0, 20.0),
        "span_length": (6000.0, 60000.0),
        "num_lanes": (1.0, 8.0),
        "lane_width": (2750.0, 4500.0),
        "sidewalk_width": (0.0, 5000.0),
        "num_piers": (0.0, 19.0),
        "pier_height": (1000.0, 40000.0),
        "pier_width": (500.0, 5000.0),
        "pier_depth": (500.0, 8000.0),
        "abutment_height": (1000.0, 20000.0),
        "abutment_width": (4000.0, 40000.0),
        "abutment_depth": (1000.0, 10000.0),
        "deck_thickness": (150.0, 600.0),
        "girder_height": (400.0, 3500.0),
        "girder_width": (200.0, 1500.0),
        "girder_web_thickness": (100.0, 600.0),
        "girder_flange_thickness": (80.0, 500.0),
        "num_girders": (2.0, 20.0),
        "barrier_height": (800.0, 1500.0),
        "barrier_post_spacing": (1000.0, 5000.0),
        "bearing_length": (200.0, 1000.0),
        "bearing_width": (150.0, 1000.0),
        "bearing_height": (30.0, 300.0),
        "pile_diameter": (300.0, 3000.0),
        "pile_depth": (3000.0, 80000.0),
        "num_piles_per_pier": (1.0, 40.0),
        "pile_cap_thickness": (500.0, 4000.0),
        "clearance_height": (0.0, 20000.0),
    },
}
COUNTS = {c for table in BOUNDS.values() for c in table if c.startswith("num_") or c.endswith("_per_storey")}


def validate_bounds(specs: DataFrame, kind: str, key: str = "spec_id", fields: list[str] | None = None) -> DataFrame:
    """Key, field, value and reason (missing, fraction, range, no bound) of each violation.  fields: default, the columns
    that have a bound."""
    table = BOUNDS[kind]
    fields = fields or [c for c in specs.columns if c in table]

    def check(c: str) -> Column:
        v = F.col(c).cast("double")
        if c not in table:
            return F.struct(F.lit(c).alias("field"), v.alias("value"), F.lit("no bound").alias("reason"))
        lo, hi = table[c]
        reason = F.when(v.isNull() | F.isnan(v), "missing").when(F.lit(c in COUNTS) & (v != F.floor(v)), "fraction").when((v < lo) | (v > hi), "range")
        return F.when(reason.isNotNull(), F.struct(F.lit(c).alias("field"), v.alias("value"), reason.alias("reason")))

    return specs.select(key, F.explode(F.array_compact(F.array(*map(check, fields)))).alias("x")).select(key, "x.*")


def derive_bridge(specs: DataFrame) -> DataFrame:
    """Number of piers, span length, abutment width and name, where they don't fit; rows that break a precondition have
    problem set instead of failing the job."""
    c = lambda name, value: F.col(name) if name in specs.columns else F.lit(value)
    span, total, n = c("span_length", 0.0), F.col("total_length"), F.col("num_spans")
    problem = F.when(n < 1, "num_spans").when(total <= 0, "total_length").when(F.col("deck_width") <= 0, "deck_width").when(F.col("girder_height") <= 0, "girder_height")
    width, name = c("abutment_width", 12000.0), c("structure_name", "")
    return specs.withColumns({
        "num_piers": (n - 1).cast("int"),
        "span_length": F.when(span * n != total, total / n).otherwise(span),
        "abutment_width": F.when((width == 12000.0) & (F.col("deck_width") != 12000.0), F.col("deck_width")).otherwise(width),
        "structure_name": F.when(F.coalesce(name, F.lit("")).isin("", "Công trình"), c("bridge_name", "")).otherwise(name),
        "problem": problem,
    })


def _findings(specs: DataFrame, key: str, rules: list[tuple[str, Column, str, Column, str]]) -> DataFrame:
    rows = [F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule"), F.lit(level).alias("severity"), value.cast("double").alias("value"))) for code, cond, rule, value, level in rules]
    return specs.select(key, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(key, "x.*")


def check_building(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """Findings on a building: code, rule, severity (error, warning, info, pass) and the value that was judged."""
    c = F.col
    storeys, height = c("num_storeys"), c("num_storeys") * c("storey_height") / 1000
    storey = c("storey_height") / 1000
    home = F.lower("building_function").contains("ở") | F.lower("building_function").contains("chung cư")
    area = c("footprint_length") / 1000 * (c("footprint_width") / 1000)
    slab, span = c("slab_thickness"), F.greatest("column_spacing_x", "column_spacing_y")
    least = F.when(area < 50, 100).otherwise(150)
    ratio = F.when(c("footprint_width") > 0, c("footprint_length") / c("footprint_width")).otherwise(999.0)
    return _findings(specs, key, [
        ("stairs", (storeys > 3) & (c("num_staircases") < 2), "QCVN 06:2022, Điều 3.4.2", c("num_staircases"), "error"),
        ("exits", (c("doors_per_storey") < 2) & (storeys > 2), "QCVN 06:2022, Điều 3.4.5", c("doors_per_storey"), "error"),
        ("escape", c("footprint_length") / 1000 > 40, "QCVN 06:2022, Điều 3.4.7", c("footprint_length") / 1000, "warning"),
        ("high_rise", height > 28, "QCVN 06:2022, Điều 7.1", height, "warning"),
        ("fire_rating", F.upper("building_type").isin("F1", "F2", "F3") & (storeys > 5), "QCVN 06:2022, Bảng 4", storeys, "info"),
        ("storey_home", home & (storey < 2.7), "QCVN 04:2021, Điều 2.3.1", storey, "error"),
        ("storey_other", ~home & (storey < 3.0), "QCVN 04:2021, Điều 2.3.2", storey, "warning"),
        ("floor_area", area < 20, "QCVN 04:2021", area, "warning"),
        ("slab", slab < least, "TCVN 2737:1995", slab, "warning"),
        ("slab_span", slab < span / 30, "TCVN 5574:2018, Bảng 12", slab, "warning"),
        ("span", span > 8000, "TCVN 5574:2018", span / 1000, "warning"),
        ("column_5", (storeys > 5) & (c("column_size") < 500), "TCVN 5574:2018", c("column_size"), "warning"),
        ("column_10", (storeys > 10) & (c("column_size") < 600), "TCVN 5574:2018", c("column_size"), "error"),
        ("aspect", ratio > 5, "Thiết kế kiến trúc", ratio, "warning"),
        ("super_high", height > 75, "QCVN 06:2022", height, "error"),
        ("stairs_ok", (c("num_staircases") >= 2) & (storeys > 3), "QCVN 06:2022, Điều 3.4.2", c("num_staircases"), "pass"),
        ("storey_ok", storey >= 3.0, "QCVN 04:2021", storey, "pass"),
    ])


#: What a bridge has where its specification says nothing.
BRIDGE_DEFAULTS = {"has_sidewalk": True, "sidewalk_width": 1500.0, "girder_web_thickness": 200.0, "barrier_height": 1100.0, "barrier_post_spacing": 2000.0, "pile_diameter": 1000.0, "pile_depth": 15000.0, "num_piles_per_pier": 4, "deck_thickness": 250.0, "bridge_type": "beam", "pier_width": 1500.0, "pier_depth": 2000.0}


def check_bridge(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """I4: findings on a bridge, as ``check_building``; columns that are missing take the usual values."""
    full = specs.withColumns({k: F.lit(v) for k, v in BRIDGE_DEFAULTS.items() if k not in specs.columns})
    if "span_length" not in full.columns:
        full = full.withColumn("span_length", F.col("total_length") / F.col("num_spans"))
    c = F.col
    needed = c("num_lanes") * c("lane_width") + F.when(c("has_sidewalk"), 2 * c("sidewalk_width")).otherwise(0.0)
    slender = F.when(c("girder_height") > 0, c("span_length") / c("girder_height")).otherwise(999.0)
    girders = F.greatest(F.lit(2), F.floor(c("deck_width") / 3000))
    mean = F.when(c("num_spans") > 0, c("total_length") / c("num_spans")).otherwise(0.0)
    road, rail, clear = c("bridge_function") == "Đường bộ", c("bridge_function") == "Đường sắt", c("clearance_height")
    low_road, low_rail = road & (clear < 4500), rail & (clear < 5500)
    return _findings(full, key, [
        ("lane", c("lane_width") < 3500, "TCVN 11823:2017, §2.5.2", c("lane_width"), "error"),
        ("lane_ok", c("lane_width") >= 3500, "TCVN 11823:2017, §2.5.2", c("lane_width"), "pass"),
        ("sidewalk", c("has_sidewalk") & (c("sidewalk_width") < 1000), "TCVN 11823:2017, §2.5.3", c("sidewalk_width"), "warning"),
        ("deck_width", c("deck_width") < needed, "TCVN 11823:2017, §2.5", c("deck_width"), "error"),
        ("span", c("span_length") > 40000, "22TCN 272-05", c("span_length") / 1000, "warning"),
        ("slender", slender > 20, "TCVN 11823:2017, §5.14", slender, "error"),
        ("slender_high", (slender > 16) & (slender <= 20), "TCVN 11823:2017, §5.14", slender, "warning"),
        ("slender_ok", slender <= 16, "TCVN 11823:2017, §5.14", slender, "pass"),
        ("girders", c("num_girders") < girders, "22TCN 272-05", c("num_girders"), "warning"),
        ("web", c("girder_web_thickness") < 150, "TCVN 11823:2017", c("girder_web_thickness"), "warning"),
        ("barrier", c("barrier_height") < 1100, "TCVN 11823:2017, §13.8.1", c("barrier_height"), "error"),
        ("barrier_ok", c("barrier_height") >= 1100, "TCVN 11823:2017, §13.8.1", c("barrier_height"), "pass"),
        ("posts", c("barrier_post_spacing") > 2500, "TCVN 11823:2017, §13.8.2", c("barrier_post_spacing"), "warning"),
        ("clearance_road", low_road, "TCVN 11823:2017, §2.3.3.2", clear, "error"),
        ("clearance_rail", low_rail, "TCVN 11823:2017", clear, "error"),
        ("clearance_ok", ~low_road & ~low_rail, "TCVN 11823:2017, §2.3.3.2", clear, "pass"),
        ("pile_diameter", c("pile_diameter") < 400, "22TCN 272-05", c("pile_diameter"), "warning"),
        ("pile_depth", c("pile_depth") < 10000, "22TCN 272-05", c("pile_depth"), "warning"),
        ("piles", c("num_piles_per_pier") < 4, "22TCN 272-05", c("num_piles_per_pier"), "warning"),
        ("deck", c("deck_thickness") < 200, "TCVN 11823:2017, §9.7", c("deck_thickness"), "error"),
        ("mean_span", (mean > 35000) & (c("bridge_type") == "beam"), "Thiết kế cầu", mean, "info"),
        ("load", F.lit(True), "TCVN 11823:2017, §3.6", F.lit(None), "pass"),
    ])


#: What a building has where its specification says nothing.
BUILDING_DEFAULTS = {"wall_thickness": 200.0, "windows_per_storey": 3, "window_sill_height": 900.0, "beam_height": 400.0, "beam_width": 200.0, "has_foundation": True, "footing_depth": 500.0}


def expand_building(specs: DataFrame) -> DataFrame:
    """The elements of a building: spec_id, ifc_type, storey (from 1), name, x, y, z and dimensions dx, dy, dz in mm.  Every
    family explodes its own index ranges and computes its coordinates after that, as plain arithmetic.  The families are a union that
    reads the narrow specifications once for each, so these are dealt over all tasks and stored first: a few bytes of a
    specification become hundreds of elements, and tasks cut by its bytes would be few and long.  Grid lines stand at every whole spacing within the
    footprint, two at least; beams run from line to line.  A building without storeys, or whose footprint or column spacing is null,
    has no elements."""
    full = specs.withColumns({k: F.lit(v) for k, v in BUILDING_DEFAULTS.items() if k not in specs.columns})
    full = full.where("num_storeys >= 1").dropna(subset=["footprint_length", "footprint_width", "column_spacing_x", "column_spacing_y"])
    full = stored(full.repartition("spec_id"), "building-specs")
    bays = {a: F.greatest(F.floor(F.col(length) / F.col(gap)).cast("int"), F.lit(1)) for a, length, gap in (("x", "footprint_length", "column_spacing_x"), ("y", "footprint_width", "column_spacing_y"))}
    per = full.withColumn("s", F.explode(F.sequence(F.lit(1), "num_storeys"))).withColumn("elev", (F.col("s") - 1) * F.col("storey_height"))
    c, s = F.col, F.col("s").cast("string")
    length, width, wall, slab, size = c("footprint_length"), c("footprint_width"), c("wall_thickness"), c("slab_thickness"), c("column_size")
    wall_z, wall_h = c("elev") + slab, c("storey_height") - slab
    line = {"x": lambda i: F.least(i * c("column_spacing_x"), length), "y": lambda i: F.least(i * c("column_spacing_y"), width)}
    title = lambda text, i=None: F.concat(F.lit(text), *([i.cast("string")] if i is not None else []), F.lit(" T"), s)

    def span(rows: DataFrame, name: str, first: int, upto: Column) -> DataFrame:
        return rows.where(upto >= first).withColumn(name, F.explode(F.sequence(F.lit(first), upto)))

    def items(rows: DataFrame, kind: str, name: Column, x, y, z, dx, dy, dz) -> DataFrame:
        sizes = [(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(("x", "y", "z", "dx", "dy", "dz"), (x, y, z, dx, dy, dz), strict=True)]
        return rows.select("spec_id", F.lit(kind).alias("ifc_type"), c("s").alias("storey"), name.alias("name"), *sizes)

    def grid(rows: DataFrame) -> DataFrame:
        points = span(span(rows, "i", 0, bays["x"]), "j", 0, bays["y"])
        return points.select("*", line["x"](c("i")).alias("gx"), line["y"](c("j")).alias("gy"), (c("i") * (bays["y"] + 1) + c("j") + 1).alias("n"))

    def beams(along: str, across: str) -> DataFrame:
        # All bays of a direction are equally long, so either all of them get a beam or none.  Numbers go on from X to Y.
        begin, row = line[along](c("i") - 1), line[across](c("j"))
        rows = span(span(per, "i", 1, bays[along]).withColumn("free", line[along](c("i")) - begin).where("free > 500"), "j", 0, bays[across])
        earlier = F.lit(0) if along == "x" else F.when(line["x"](F.lit(1)) > 500, bays["x"] * (bays["y"] + 1)).otherwise(0)
        name = title(f"Dầm B{along.upper()}", earlier + c("j") * bays[along] + c("i"))
        at, dims = ((begin, row), (c("free"), c("beam_width"))) if along == "x" else ((row, begin), (c("beam_width"), c("free")))
        return items(rows, "IfcBeam", name, *at, c("elev") + c("storey_height") - c("beam_height"), *dims, c("beam_height"))

    def even(n: str, cut: int) -> Column:
        return length / (c(n) + 1) * c("i") - cut

    inside = (c("gx") >= wall + 1) & (c("gx") <= length - wall - 1) & (c("gy") >= wall + 1) & (c("gy") <= width - wall - 1)
    doors, windows, stairs = (span(per, "i", 1, c(n)) for n in ("doors_per_storey", "windows_per_storey", "num_staircases"))
    families = [
        items(per, "IfcSlab", title("Sàn"), 0, 0, c("elev"), length, width, slab),
        items(per, "IfcWall", title("Tường Bắc"), 0, 0, wall_z, length, wall, wall_h),
        items(per, "IfcWall", title("Tường Nam"), 0, width - wall, wall_z, length, wall, wall_h),
        items(per, "IfcWall", title("Tường Tây"), 0, wall, wall_z, wall, width - 2 * wall, wall_h),
        items(per, "IfcWall", title("Tường Đông"), length - wall, wall, wall_z, wall, width - 2 * wall, wall_h),
        items(grid(per).where(inside), "IfcColumn", title("Cột C", c("n")), c("gx"), c("gy"), c("elev"), size, size, c("storey_height")),
        beams("x", "y"),
        beams("y", "x"),
        items(doors, "IfcDoor", title("Cửa D", c("i")), even("doors_per_storey", 450), 0, wall_z, 900, wall, 2100),
        items(windows, "IfcWindow", title("Cửa sổ W", c("i")), even("windows_per_storey", 600), width - wall, wall_z + c("window_sill_height"), 1200, wall, 1500),
        items(stairs, "IfcStair", title("Thang CT", c("i")), F.when(c("i") == 1, length - wall - 2600).otherwise(wall + 200), width / 2 - 1000, c("elev"), 2200, 1000, c("storey_height")),
        items(grid(full.where("has_foundation").withColumn("s", F.lit(1))), "IfcFooting", F.concat(F.lit("Móng M"), c("n").cast("string")), c("gx"), c("gy"), -c("footing_depth"), size * 2.5, size * 2.5, c("footing_depth")),
        items(full.withColumn("s", c("num_storeys")), "IfcSlab", F.lit("Mái"), -300, -300, c("num_storeys") * c("storey_height"), length + 600, width + 600, 250),
    ]
    return functools.reduce(DataFrame.unionAll, families)


def _bridges(specs: DataFrame) -> DataFrame:
    """Derived specifications that break no precondition; columns that are missing take the usual values."""
    full = derive_bridge(specs).where("problem IS NULL")
    return full.withColumns({k: F.lit(v) for k, v in BRIDGE_DEFAULTS.items() if k not in full.columns})


def expand_bridge(specs: DataFrame) -> DataFrame:
    """Counts as elements: abutments, piers, girders and decks by span, barrier posts on both sides, bearings for each support and
    girder, piles under each support: spec_id, ifc_type, part, span, x, y in mm.  As in I5 each family explodes index ranges and computes
    places after that, as arrays of structs are not compiled; nothing is shuffled."""
    full = _bridges(specs)
    c = F.col
    full = full.dropna(subset=["num_spans", "num_girders", "total_length", "barrier_post_spacing"])  # without these a bridge has no elements
    support, middle, gap = F.sequence(F.lit(0), "num_spans"), c("deck_width") / 2, c("deck_width") / (c("num_girders") + 1)
    upto = lambda n: F.sequence(F.lit(1), n)

    def each(rows: DataFrame, name: str, numbers: Column) -> DataFrame:
        return rows.select("*", F.explode(numbers).alias(name))

    def items(rows: DataFrame, kind: str, part: str, span, x, y) -> DataFrame:
        col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return rows.select("spec_id", F.lit(kind).alias("ifc_type"), F.lit(part).alias("part"), col(span).cast("int").alias("span"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))

    spans, supports, girders = each(full, "i", upto("num_spans")), each(full, "i", support), upto("num_girders")
    last = F.floor(c("total_length") / c("barrier_post_spacing")).cast("int")
    piles = each(supports.where("num_piles_per_pier > 0"), "k", F.sequence(F.lit(0), c("num_piles_per_pier") - 1))
    at = _pile(c("i"), c("k"))
    families = [
        items(full, "IfcFooting", "abutment", 0, 0, middle),
        items(full, "IfcFooting", "abutment", c("num_spans"), c("total_length"), middle),
        items(each(full.where("num_piers > 0"), "i", upto("num_piers")), "IfcColumn", "pier", c("i"), c("i") * c("span_length"), middle),
        items(each(spans, "g", girders), "IfcBeam", "girder", c("i"), (c("i") - 1) * c("span_length"), c("g") * gap),
        items(spans, "IfcSlab", "deck", c("i"), (c("i") - 1) * c("span_length"), 0),
        items(each(each(full, "side", F.array(F.lit(0.0), c("deck_width"))), "k", F.sequence(F.lit(0), last)), "IfcRailing", "post", 0, c("k") * c("barrier_post_spacing"), c("side")),
        items(each(supports, "g", girders), "IfcPlate", "bearing", c("i"), c("i") * c("span_length"), c("g") * gap),
        items(piles, "IfcPile", "pile", c("i"), at["x"], at["y"]),
    ]
    return functools.reduce(DataFrame.unionAll, families)


def _pile(support: Column, i: Column) -> Column:
    """Where pile i (from 0) of a support stands: two columns along the bridge, rows across its middle."""
    c = F.col
    n, cols = c("num_piles_per_pier"), F.least(c("num_piles_per_pier"), F.lit(2))
    x = support * c("span_length") + (i % cols - (cols - 1) / 2) * c("pier_width") * 2
    y = c("deck_width") / 2 + (F.floor(i / cols) - (F.ceil(n / cols) - 1) / 2) * c("pier_depth") * 2
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _piles(support: Column) -> Column:
    """The piles of a support; none where the specification counts none."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.col("num_piles_per_pier"), F.lit(1)) - 1), lambda i: _pile(support, i))
    return F.when(F.col("num_piles_per_pier") > 0, every).otherwise(F.slice(every, 1, 0))


def foundation_supports(specs: DataFrame) -> DataFrame:
    """A nested record for each support of a bridge: two abutments and the piers, each with its piles in two columns."""
    full = _bridges(specs)
    supports = F.sequence(F.lit(0), "num_spans")
    one = lambda i: F.struct(F.when((i == 0) | (i == F.col("num_spans")), "abutment").otherwise("pier").alias("kind"), (i * F.col("span_length")).cast("double").alias("x"), _piles(i).alias("piles"))
    return full.select("spec_id", F.transform(supports, one).alias("supports"))


def extract_spec(df: DataFrame, col: str) -> DataFrame:
    """Parameters named in a text, with defaults: length 30 m, 3 spans, 2 lanes; 3 storeys, 96 m², 1 staircase."""
    number = lambda pattern, default: F.coalesce(F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).cast("int"), F.lit(default))
    side = F.floor(F.sqrt(number(r"(\d+)\s*m[²2]", 96)) * 1000).cast("int")
    return df.withColumns({
        "total_length": number(r"(\d+)\s*m(?:\s|,|$)", 30) * 1000, "num_spans": number(r"(\d+)\s*nhịp", 3), "num_lanes": number(r"(\d+)\s*làn", 2),
        "num_storeys": number(r"(\d+)\s*tầng", 3), "footprint_length": side, "footprint_width": side, "num_staircases": number(r"(\d+)\s*cầu thang", 1),
    })


# Class, material, rgb, transparency, category.
MATERIALS = {
    "IfcColumn": ("Bê tông cốt thép", (0.70, 0.70, 0.68), 0.0, "concrete"),
    "IfcBeam": ("Bê tông cốt thép", (0.70, 0.70, 0.68), 0.0, "concrete"),
    "IfcFooting": ("Bê tông cốt thép", (0.70, 0.70, 0.68), 0.0, "concrete"),
    "IfcStair": ("Bê tông cốt thép", (0.70, 0.70, 0.68), 0.0, "concrete"),
    "IfcSlab": ("Sàn bê tông lát gạch men", (0.87, 0.83, 0.76), 0.0, "concrete"),
    "IfcRoof": ("Mái bê tông chống thấm", (0.55, 0.57, 0.60), 0.0, "concrete"),
    "IfcDoor": ("Gỗ", (0.52, 0.34, 0.20), 0.0, "wood"),
    "IfcWindow": ("Kính", (0.55, 0.75, 0.88), 0.5, "glass"),
    "IfcRailing": ("Thép sơn", (0.22, 0.24, 0.27), 0.0, "steel"),
    "IfcPlate": ("Kính", (0.55, 0.75, 0.88), 0.5, "glass"),
}
WALLS = {True: ("Tường gạch sơn ngoài", (0.96, 0.94, 0.89), 0.0, "brick"), False: ("Tường gạch sơn trong", (0.99, 0.98, 0.96), 0.0, "brick")}


def material_for_element(elements: DataFrame) -> DataFrame:
    """I8: elements and material_name, r, g, b, transparency, category by class; walls by is_external.  Null for other classes."""
    def entry(v) -> Column:
        name, rgb, clear, kind = v
        return F.struct(F.lit(name).alias("material_name"), *[F.lit(x).alias(n) for n, x in zip("rgb", rgb, strict=True)], F.lit(clear).alias("transparency"), F.lit(kind).alias("category"))

    table = F.create_map(*[x for k, v in MATERIALS.items() for x in (F.lit(k), entry(v))])
    wall = F.when(F.coalesce("is_external", F.lit(False)), entry(WALLS[True])).otherwise(entry(WALLS[False]))
    return elements.withColumn("m_", F.when(F.col("ifc_type") == "IfcWall", wall).otherwise(table[F.col("ifc_type")])).select(*elements.columns, "m_.*")
