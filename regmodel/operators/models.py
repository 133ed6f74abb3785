"""Building-model tables (G) and quality checks (H).

A check gives rows (model, check, message, element, other).  All models are checked in one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..sources.step import named, references_of, text_of, value_of

# The classes that a complete model holds, in order.
REQUIRED_CLASSES = ["IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace", "IfcWall", "IfcSlab", "IfcColumn", "IfcBeam", "IfcDoor", "IfcWindow", "IfcStair"]
PROPERTY_KEYS = ["Width", "Height", "Length", "Thickness", "Area", "Volume", "FireRating", "IsExternal", "LoadBearing", "Reference"]
ELEMENT_TYPES = {
    "IfcWall": "Tường", "IfcWallStandardCase": "Tường", "IfcColumn": "Cột", "IfcBeam": "Dầm", "IfcSlab": "Sàn", "IfcDoor": "Cửa đi", "IfcWindow": "Cửa sổ", "IfcStair": "Cầu thang",
    "IfcRailing": "Lan can", "IfcRoof": "Mái", "IfcCovering": "Lớp phủ", "IfcCurtainWall": "Tường rèm", "IfcPlate": "Bản thép", "IfcMember": "Thanh", "IfcFooting": "Móng", "IfcPile": "Cọc",
}
LABELS = {
    "IfcWall": "Wall", "IfcWallStandardCase": "Wall", "IfcColumn": "Column", "IfcBeam": "Beam", "IfcSlab": "Slab", "IfcDoor": "Door", "IfcWindow": "Window",
    "IfcStair": "Stair", "IfcRoof": "Roof", "IfcFooting": "Footing", "IfcRailing": "Railing", "IfcCurtainWall": "CurtainWall", "IfcPlate": "Plate", "IfcMember": "Member",
}


# --- G --------------------------------------------------------------------------------------------------------------
def explode_models(models: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G1: storeys, elements and spaces of parsed models, by file name."""
    one = lambda name: models.select("filename", F.explode(name).alias("x")).select("filename", "x.*")
    return one("storeys"), one("elements"), one("spaces")


def element_counts(elements: DataFrame) -> DataFrame:
    """Model, ifc_type, n."""
    return elements.groupBy("model", "ifc_type").agg(F.count("*").alias("n"))


def materials(elements: DataFrame) -> DataFrame:
    """Model and its sorted distinct materials that are not empty."""
    used = F.array_sort(F.collect_set(F.when(F.col("material") != "", F.col("material"))))
    return elements.groupBy("model").agg(used.alias("materials"))


def step_elements(step: DataFrame) -> DataFrame:
    """file, id, global_id, ifc_type and name (else type and id) of the element classes.  A class counts with its standard and elemented
    cases; standard-case walls are listed as such too."""
    kinds = {k: [k] for k in ELEMENT_TYPES}
    for k in ELEMENT_TYPES:
        for case in ("StandardCase", "ElementedCase"):
            if not k.endswith(case):
                kinds.setdefault(k + case, []).append(k)
    lookup = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k.upper()), F.array(*map(F.lit, v)))])
    rows = step.where(F.col("class").isin([k.upper() for k in kinds])).select("file", "id", F.explode(F.element_at(lookup, F.col("class"))).alias("ifc_type"), *[F.get("attributes", F.lit(p)).alias(n) for n, p in (("g", 0), ("n", 2))])
    rows = rows.withColumns({"g": text_of(F.col("g")), "n": text_of(F.col("n"))})
    return rows.select("file", "id", F.coalesce("g", F.lit("")).alias("global_id"), "ifc_type", F.coalesce(F.nullif("n", F.lit("")), F.concat("ifc_type", F.lit("_"), F.col("id").cast("string"))).alias("name"))


def _relation(step: DataFrame, kind: str, one: str, many: str) -> DataFrame:
    """file, rel, one, id: a relation's single end, and a row for each reference in its list."""
    return named(step, kind, one, many).select("file", F.col("id").alias("rel"), F.get(references_of(F.col(one)), F.lit(0)).alias("one"), F.explode(references_of(F.col(many))).alias("id"))


def _listed(step: DataFrame, kind: str, attribute: str, name: str) -> DataFrame:
    """file, (name) id, pos, ref: the references in an attribute, in order."""
    return named(step, kind, attribute).select("file", F.col("id").alias(name), F.posexplode(references_of(F.col(attribute))).alias("pos", "ref"))


def element_storey(step: DataFrame, elements: DataFrame) -> DataFrame:
    """File, id, storey of each element: of its containments by id, the first in a storey or in a part of one; else ""."""
    contained = _relation(step, "IFCRELCONTAINEDINSPATIALSTRUCTURE", "RelatingStructure", "RelatedElements").withColumnRenamed("one", "place")
    parents = _relation(step, "IFCRELAGGREGATES", "RelatingObject", "RelatedObjects").select("file", F.col("id").alias("place"), F.col("one").alias("parent"), F.col("rel").alias("up"))
    name = named(step, "IFCBUILDINGSTOREY", "Name").withColumn("Name", text_of(F.col("Name")))
    storeys = name.select("file", "id", F.coalesce(F.nullif("Name", F.lit("")), F.concat(F.lit("Storey_"), F.col("id").cast("string"))).alias("name"))
    own = storeys.select("file", F.col("id").alias("place"), F.col("name").alias("sname"))
    # a part of a storey, by the first storey that it is part of
    part = parents.join(storeys.withColumnRenamed("id", "parent"), ["file", "parent"]).groupBy("file", "place").agg(F.min_by("name", "up").alias("pname"))
    places = contained.select("file", "place").distinct().join(own, ["file", "place"], "left").join(part, ["file", "place"], "left").select("file", "place", F.coalesce("sname", "pname").alias("storey")).where("storey IS NOT NULL")
    found = contained.join(places, ["file", "place"]).groupBy("file", "id").agg(F.min_by("storey", "rel").alias("storey"))
    return elements.select("file", "id").join(found, ["file", "id"], "left").withColumn("storey", F.coalesce("storey", F.lit("")))


def element_material(step: DataFrame, elements: DataFrame) -> DataFrame:
    """File, id, material by an element's first association with a material, layer set (or its use) or list: the name, or the names
    joined by " + ", in order; nameless parts are left out."""
    assoc = _relation(step, "IFCRELASSOCIATESMATERIAL", "RelatingMaterial", "RelatedObjects").withColumnRenamed("one", "m")
    use = _listed(step, "IFCMATERIALLAYERSETUSAGE", "ForLayerSet", "m").select("file", "m", F.col("ref").alias("set"))
    top = assoc.join(use, ["file", "m"], "left").withColumn("m", F.coalesce("set", "m")).drop("set")
    single = named(step, "IFCMATERIAL", "Name").select("file", F.col("id").alias("mat"), text_of(F.col("Name")).alias("name"))
    layer = _listed(step, "IFCMATERIALLAYER", "Material", "layer").select("file", "layer", F.col("ref").alias("mat"))
    in_set = _listed(step, "IFCMATERIALLAYERSET", "MaterialLayers", "m").withColumnRenamed("ref", "layer").join(layer, ["file", "layer"], "left").select("file", "m", "pos", "mat")
    in_list = _listed(step, "IFCMATERIALLIST", "Materials", "m").select("file", "m", "pos", F.col("ref").alias("mat"))
    parts = in_set.unionByName(in_list).unionByName(single.select("file", F.col("mat").alias("m"), F.lit(0).alias("pos"), "mat"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("name") != "", F.struct("pos", "name"))))
    names = parts.join(single, ["file", "mat"], "left").groupBy("file", "m").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " + ").alias("material"))
    first = top.join(names, ["file", "m"]).groupBy("file", "id").agg(F.min_by("material", "rel").alias("material"))
    return elements.select("file", "id").join(first, ["file", "id"], "left").withColumn("material", F.coalesce("material", F.lit("")))


def element_properties(step: DataFrame, elements: DataFrame, keys: list[str] = PROPERTY_KEYS) -> DataFrame:
    """File, id, properties: those of the named keys over all property sets, the later one wins, in the order of the keys."""
    defines = _relation(step, "IFCRELDEFINESBYPROPERTIES", "RelatingPropertyDefinition", "RelatedObjects").withColumnRenamed("one", "pset")
    has = _listed(step, "IFCPROPERTYSET", "HasProperties", "pset").withColumnRenamed("ref", "prop")
    props = named(step, "IFCPROPERTYSINGLEVALUE", "Name", "NominalValue").select("file", F.col("id").alias("prop"), text_of(F.col("Name")).alias("k"), "NominalValue")
    props = props.where(F.col("k").isin(keys)).select("file", "prop", "k", value_of(F.col("NominalValue")).alias("v")).where("v IS NOT NULL")
    # dealt by what the next step joins by, so that rows are shuffled once for both
    sets = has.join(props, ["file", "prop"]).repartition("file", "pset").groupBy("file", "pset", "k").agg(F.max_by("v", "pos").alias("v"))
    rows = defines.join(sets, ["file", "pset"]).repartition("file", "id").groupBy("file", "id", "k").agg(F.max_by("v", "rel").alias("v"))
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("k"))
    maps = rows.groupBy("file", "id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "k", "v"))), lambda x: F.struct(x["k"], x["v"]))).alias("properties"))
    return elements.select("file", "id").join(maps, ["file", "id"], "left").withColumn("properties", F.coalesce("properties", F.expr("map()").cast("map<string,string>")))


def space_areas(step: DataFrame) -> DataFrame:
    """File, id, area of each space: the last area quantity that is not zero, else 0."""
    spaces = step.where(F.col("class") == "IFCSPACE").select("file", "id")
    defines = _relation(step, "IFCRELDEFINESBYPROPERTIES", "RelatingPropertyDefinition", "RelatedObjects").withColumnRenamed("one", "q")
    has = _listed(step, "IFCELEMENTQUANTITY", "Quantities", "q").withColumnRenamed("ref", "a")
    area = named(step, "IFCQUANTITYAREA", "AreaValue").select("file", F.col("id").alias("a"), F.expr("try_cast(AreaValue AS DOUBLE)").alias("area")).where("area <> 0")
    sums = has.join(area, ["file", "a"]).groupBy("file", "q").agg(F.max_by("area", "pos").alias("area"))
    last = spaces.join(defines, ["file", "id"]).join(sums, ["file", "q"]).groupBy("file", "id").agg(F.max_by("area", "rel").alias("area"))
    return spaces.join(last, ["file", "id"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def model_elements(step: DataFrame) -> DataFrame:
    """file, id, global_id, ifc_type, name, storey, material, properties of all elements of model files."""
    out = step_elements(step)
    ids = out.select("file", "id").distinct()
    for part in (element_storey(step, ids), element_material(step, ids), element_properties(step, ids)):
        out = out.join(part, ["file", "id"])
    return out


def label_of(ifc_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[ifc_type], F.lit("BIMElement"))


def build_bim_graph(elements: DataFrame, spaces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, key) and edges (src, rel, dst): building, storey, material, typed elements and spaces (model, global_id,
    storey), each once; an edge needs both its ends, so elements without storey or material have none, nor have spaces on a storey
    that no element names."""
    storey = F.concat("model", F.lit("::"), F.col("storey"))
    nodes = [
        elements.select(F.lit("Building").alias("label"), F.col("model").alias("key")),
        elements.where("storey <> ''").select(F.lit("Storey"), storey),
        elements.where("material <> ''").select(F.lit("Material"), F.col("material")),
        elements.select(label_of(F.col("ifc_type")), F.col("global_id")),
    ]
    edges = [
        elements.where("storey <> ''").select(F.col("model").alias("src"), F.lit("HAS_STOREY").alias("rel"), storey.alias("dst")),
        elements.where("storey <> ''").select(storey, F.lit("CONTAINS"), F.col("global_id")),
        elements.where("material <> ''").select(F.col("global_id"), F.lit("MADE_OF"), F.col("material")),
    ]
    if spaces is not None:
        nodes.append(spaces.select(F.lit("Space"), F.col("global_id")))
        storeys = elements.where("storey <> ''").select("model", "storey").distinct()
        edges.append(spaces.join(storeys, ["model", "storey"], "left_semi").select(storey, F.lit("CONTAINS"), F.col("global_id")))
    return reduce(DataFrame.union, nodes).distinct(), reduce(DataFrame.union, edges).distinct()


def building_summary(elements: DataFrame) -> DataFrame:
    """By model, its sorted storeys and materials and how many elements each label has."""
    count = elements.groupBy("model", label_of(F.col("ifc_type")).alias("label")).agg(F.count("*").alias("n"))
    counts = count.groupBy("model").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x: F.concat(x["label"], F.lit("="), (-x["m"]).cast("string"))), ",")
    own = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(f"{c}s")
    return elements.groupBy("model").agg(own("storey"), own("material")).join(counts.select("model", listed.alias("counts")), "model")


def elements_on_storey(elements: DataFrame, name: str) -> DataFrame:
    """Elements of the storeys of a name, ordered by type and id."""
    return elements.where(F.col("storey") == name).select("model", "ifc_type", "global_id", "storey").orderBy("ifc_type", "global_id")


def material_usage(elements: DataFrame, text: str) -> DataFrame:
    """Elements whose material holds the text, ordered by storey and type."""
    return elements.where(F.lower("material").contains(text.lower())).select("model", "global_id", "ifc_type", "storey", "material").orderBy("storey", "ifc_type", "global_id")


def mesh_bounds(meshes: DataFrame, skip: tuple[str, ...] = ("IfcSpace", "IfcOpeningElement")) -> DataFrame:
    """Bounding box of each mesh: v holds x, y, z in turn, f the corners of faces; spaces, openings and meshes of fewer than
    nine numbers or three corners are left out."""
    rows = meshes.where(~F.col("ifc_type").isin(*skip) & (F.size("v") >= 9) & (F.size("f") >= 3))
    axis = lambda k: F.filter("v", lambda _, i: i % 3 == k)
    return rows.select("model", "global_id", "ifc_type", *[f(axis(k)).alias(f"{n}{e}") for e, f in (("0", F.array_min), ("1", F.array_max)) for k, n in enumerate("xyz")])


def model_bounds(meshes: DataFrame) -> DataFrame:
    """By model, the box around its meshes to two decimals, their number and how many each class has (a map, "Ifc" left away)."""
    box = [f(f"{n}{e}").alias(f"{n}{e}") for e, f in (("0", F.min), ("1", F.max)) for n in "xyz"]
    classes = mesh_bounds(meshes).groupBy("model", F.regexp_replace("ifc_type", "^Ifc", "").alias("class")).agg(F.count("*").alias("n"), *box)
    round_box = [F.round(f(f"{n}{e}"), 2).alias(f"{n}{e}") for e, f in (("0", F.min), ("1", F.max)) for n in "xyz"]
    return classes.groupBy("model").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("counts"), *round_box)


# Default colour (red, green, blue) and opacity by class.
COLORS = {
    "IfcWall": (0.91, 0.88, 0.83), "IfcColumn": (0.69, 0.69, 0.69), "IfcBeam": (0.63, 0.63, 0.63), "IfcSlab": (0.78, 0.75, 0.71), "IfcDoor": (0.43, 0.30, 0.25),
    "IfcWindow": (0.50, 0.85, 1.00), "IfcStair": (0.74, 0.67, 0.64), "IfcRailing": (0.38, 0.49, 0.55), "IfcFooting": (0.55, 0.43, 0.39), "IfcRoof": (0.47, 0.56, 0.61),
    "IfcCovering": (0.85, 0.82, 0.78), "IfcSpace": (0.60, 0.80, 0.60), "IfcPile": (0.50, 0.40, 0.30), "IfcCivilElement": (0.60, 0.60, 0.65), "IfcBuildingElementProxy": (0.35, 0.65, 0.65),
}
OTHER_COLOR = (0.7, 0.7, 0.7)
OPACITY = {"IfcWindow": 0.3, "IfcSpace": 0.15, "IfcCovering": 0.6}


def mesh_style(df: DataFrame) -> DataFrame:
    """Color (three decimals) and opacity (two) of each row: a style's own (columns color, transparency, where df has them and they are
    set), else the class's."""
    rgb = lambda c: F.array(*[F.lit(x) for x in c])
    kinds = F.create_map(*[x for k, c in COLORS.items() for x in (F.lit(k), rgb(c))])
    clear = F.create_map(*[F.lit(x) for kv in OPACITY.items() for x in kv])
    color, opacity = F.coalesce(kinds[F.col("ifc_type")], rgb(OTHER_COLOR)), F.coalesce(clear[F.col("ifc_type")], F.lit(1.0))
    if "color" in df.columns:
        color = F.coalesce("color", color)
    if "transparency" in df.columns:
        own = F.col("transparency").cast("double")
        finite = own.isNotNull() & ~F.isnan(own) & (F.abs(own) != float("inf"))
        opacity = F.when(finite, 1 - own).otherwise(opacity)
    return df.withColumns({"color": F.transform(color, lambda x: F.round(x, 3)), "opacity": F.round(opacity, 2)})


def quantity_takeoff(elements: DataFrame) -> DataFrame:
    """By model and class: count, volume, footprint area and the rounded percent share of the count."""
    dx, dy, dz = (F.col(f"{n}1") - F.col(f"{n}0") for n in "xyz")
    sums = elements.groupBy("model", "ifc_type").agg(F.count("*").alias("n"), F.round(F.sum(dx * dy * dz), 6).alias("volume"), F.round(F.sum(dx * dy), 6).alias("area"))
    return sums.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("model"))).cast("int"))


# --- H --------------------------------------------------------------------------------------------------------------
def issue(check: str, df: DataFrame, message: Column, element: Column, other: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("model", F.lit(check).alias("check"), message.alias("message"), element.cast("string").alias("element"), (none if other is None else other.cast("string")).alias("other"))


def check_required_classes(elements: DataFrame, required: list[str] = REQUIRED_CLASSES) -> DataFrame:
    """H1: a row for each model and required class without an instance."""
    wanted = elements.select("model").distinct().withColumn("ifc_type", F.explode(F.array(*map(F.lit, required))))
    missing = wanted.join(elements.select("model", "ifc_type").distinct(), ["model", "ifc_type"], "left_anti")
    return issue("classes", missing, F.concat(F.lit("missing class "), F.col("ifc_type")), F.col("ifc_type"))


def check_openings(doors: DataFrame, fills: DataFrame, voids: DataFrame, walls: DataFrame) -> DataFrame:
    """H2: doors and windows (model, element) that no wall hosts.  fills: model, element, opening; voids: model, opening, wall."""
    hosted = fills.join(voids, ["model", "opening"]).join(walls.select("model", F.col("element").alias("wall")), ["model", "wall"]).select("model", "element")
    return issue("openings", doors.join(hosted, ["model", "element"], "left_anti"), F.lit("no host wall"), F.col("element"))


def check_wall_connections(walls: DataFrame, connects: DataFrame) -> DataFrame:
    """H3: walls of models with two or more that no connection names on either side.  connects: model, a, b."""
    ends = connects.select("model", F.col("a").alias("element")).union(connects.select("model", "b")).distinct()
    many = walls.withColumn("n_", F.count("*").over(Window.partitionBy("model"))).where("n_ >= 2")
    return issue("walls", many.join(ends, ["model", "element"], "left_anti"), F.lit("wall is not connected"), F.col("element"))


def check_columns_on_grid(columns: DataFrame, axes: DataFrame, tol_mm: float = 10) -> DataFrame:
    """H4: columns (model, element, x, y in m) further than the tolerance from all crossings of a U and a V axis (lines without end,
    parallel ones skipped); a single row for a model without a crossing.  A crossing within some distance of a place lies on two lines
    within that distance.  So a place meets lines, not crossings: where the nearest line of each direction cross bounds the distance, and
    only lines within this bound are crossed."""
    c = F.col
    dx, dy = c("ax1") - c("ax0"), c("ay1") - c("ay0")
    lines = axes.where(c("axis").isin("U", "V") & (F.hypot(dx, dy) > 0)).select("model", "axis", "ax0", "ay0", dx.alias("dx"), dy.alias("dy")).distinct()
    spots = columns.select("model", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    spot = ["model", "x", "y"]
    away = F.abs((c("x") - c("ax0")) * c("dy") - (c("y") - c("ay0")) * c("dx")) / F.hypot("dx", "dy")
    near = spots.join(lines, "model").withColumn("away", away)

    def nearest_crossing(of: DataFrame) -> DataFrame:
        u, v = (of.where(c("axis") == k).select(*spot, *[c(n).alias(f"{k}_{n}") for n in ("ax0", "ay0", "dx", "dy")]) for k in "UV")
        det = c("U_dx") * c("V_dy") - c("U_dy") * c("V_dx")
        t = ((c("V_ax0") - c("U_ax0")) * c("V_dy") - (c("V_ay0") - c("U_ay0")) * c("V_dx")) / det
        d = F.hypot(c("x") - (c("U_ax0") + t * c("U_dx")), c("y") - (c("U_ay0") + t * c("U_dy")))
        return u.join(v, spot).where(F.abs(det) > 1e-9).groupBy(*spot).agg(F.min(d).alias("d"))

    line = F.struct("ax0", "ay0", "dx", "dy")
    direction = F.round(F.pmod(F.atan2("dy", "dx"), F.lit(math.pi)), 6)
    first = near.groupBy(*spot, "axis", direction.alias("direction")).agg(F.min_by(line, "away").alias("l")).select(*spot, "axis", "l.*")
    bound = nearest_crossing(first).withColumnRenamed("d", "bound")
    within = near.join(bound, spot, "left").where(c("bound").isNull() | (c("away") <= c("bound") * (1 + 1e-9) + 1e-6))
    found = stored(nearest_crossing(within), "grid-distances")
    off = columns.join(found, spot).groupBy("model", "element").agg(F.min("d").alias("d")).where(c("d") * 1000 > tol_mm)
    off = issue("columns", off, F.concat(F.lit("off grid by "), F.round(c("d") * 1000, 0).cast("long").cast("string"), F.lit(" mm")), c("element"))
    bare = columns.select("model").distinct().join(found.select("model").distinct(), "model", "left_anti")
    return off.unionByName(issue("columns", bare, F.lit("no grid"), F.lit(None)))


def check_spaces(storeys: DataFrame, aggregates: DataFrame) -> DataFrame:
    """H5: storeys (model, element) that hold no space.  aggregates: model, storey, space."""
    return issue("spaces", storeys.join(aggregates.select("model", F.col("storey").alias("element")).distinct(), ["model", "element"], "left_anti"), F.lit("storey without space"), F.col("element"))


def check_extent(placements: DataFrame, max_m: float = 1000) -> DataFrame:
    """H6: products further than max_m from the origin.  placements: model, element, x, y, z, unit_scale."""
    far = F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) * F.col("unit_scale")
    return issue("extent", placements.where(far > max_m), F.lit("far from the origin"), F.col("element"))


def check_clashes(boxes: DataFrame, hosts: DataFrame | None = None, connects: DataFrame | None = None, tol: float = 0.002, cell: float = 4.0) -> DataFrame:
    """H7: pairs of boxes of a model that overlap deeper than the tolerance, each once.  Boxes are copied to the grid cells that
    they touch and joined within a cell; a pair counts only in the cell of its common corner, so nothing is made twice.
    hosts: model, element, wall and connects: model, a, b are left out."""
    cells = lambda n: F.sequence(F.floor(F.col(f"{n}0") / cell), F.floor(F.col(f"{n}1") / cell))
    own = boxes.where(F.col("ifc_type") != "IfcOpeningElement").select("model", "global_id", *[f"{n}{e}" for n in "xyz" for e in "01"])
    spread = own.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y"))).withColumn("cz", F.explode(cells("z")))
    a, b = (spread.select("model", "cx", "cy", "cz", *[F.col(c).alias(f"{p}_{c}") for c in own.columns if c != "model"]) for p in "ab")
    corner = lambda n: F.floor(F.greatest(f"a_{n}0", f"b_{n}0") / cell) == F.col(f"c{n}")
    depth = lambda n: F.least(f"a_{n}1", f"b_{n}1") - F.greatest(f"a_{n}0", f"b_{n}0") > tol
    pairs = a.join(b, ["model", "cx", "cy", "cz"]).where((F.col("a_global_id") < F.col("b_global_id")) & reduce(Column.__and__, [f(n) for n in "xyz" for f in (corner, depth)]))
    pairs = pairs.select("model", F.col("a_global_id").alias("element"), F.col("b_global_id").alias("other"))
    for known, x, y in ((hosts, "element", "wall"), (connects, "a", "b")):
        if known is not None:
            ends = known.select("model", F.least(x, y).alias("element"), F.greatest(x, y).alias("other"))
            pairs = pairs.join(ends, ["model", "element", "other"], "left_anti")
    return issue("clashes", pairs, F.lit("boxes overlap"), F.col("element"), F.col("other"))


def _overlaps(boxes: DataFrame, group: list[str], tol: float, cell: float) -> DataFrame:
    """group, n: how many pairs of a group's boxes overlap deeper than the tolerance, without making them.  Every box is deeper than that itself.

    Boxes of one extent in y and z lie in one lane, cut into cells along x; only lanes are paired.  Of two lanes, or a lane and itself, in a
    cell, all pairs with a box that starts there are taken, less those where one box ends before the other starts: a running sum of
    ends, met by starts.  Ends and starts are counted by place first, so that equal boxes cost one row."""
    c = F.col
    lane, shape = [*group, "cx"], ["y0", "y1", "z0", "z1"]
    cells = lambda n: F.sequence(F.floor(c(f"{n}0") / cell), F.floor(c(f"{n}1") / cell))
    spread = boxes.select(*group, "x0", "x1", *shape, F.explode(cells("x")).alias("cx")).withColumn("here", (F.floor(c("x0") / cell) == c("cx")).cast("long"))
    # a1 - b0 <= tol is a1 <= b0 + tol, where the sum is rounded down: what rounding added tells on which side of an equal end a start stands
    sum_ = c("x0") + F.lit(tol)
    back = sum_ - c("x0")
    lost = (c("x0") - (sum_ - back)) + (F.lit(tol) - back)
    ends = F.array(F.struct(c("x1").alias("at"), F.lit(0).alias("side")), F.struct(sum_.alias("at"), F.when(lost < 0, -1).otherwise(1).alias("side")))
    events = spread.select(*lane, *shape, "here", F.explode(ends).alias("e")).groupBy(*lane, *shape, "e.at", "e.side").agg(F.count("*").alias("n"), F.sum("here").alias("here"))
    events = stored(events, "clash-events")
    lanes = events.where("side <> 0").groupBy(*lane, *shape).agg(F.sum("n").alias("n"), F.sum("here").alias("here"))
    filed = stored(lanes, "clash-lanes").withColumn("cy", F.explode(cells("y"))).withColumn("cz", F.explode(cells("z")))
    a, b = (filed.select(*lane, "cy", "cz", *[c(k).alias(f"{p}_{k}") for k in (*shape, "n", "here")]) for p in "ab")
    corner = [F.floor(F.greatest(f"a_{k}0", f"b_{k}0") / cell) == c(f"c{k}") for k in "yz"]
    depth = [F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0") > tol for k in "yz"]
    pairs = stored(a.join(b, [*lane, "cy", "cz"]).where(reduce(Column.__and__, [*corner, *depth])).drop("cy", "cz"), "clash-pairs")  # either way round, and a lane with itself
    own = reduce(Column.__and__, [c(f"a_{k}") == c(f"b_{k}") for k in shape])
    twice = c("a_n") * c("b_n") - (c("a_n") - c("a_here")) * (c("b_n") - c("b_here")) - F.when(own, c("a_here")).otherwise(0)
    side = lambda p, kind: events.where(f"side {kind} 0").select(*lane, *[c(k).alias(f"{p}_{k}") for k in shape], "at", "side", "n", "here")
    names = [*lane, *[f"{p}_{k}" for p in "ab" for k in shape]]
    keys = pairs.select(*names)
    met = keys.join(side("a", "="), [*lane, *[f"a_{k}" for k in shape]]).unionByName(keys.join(side("b", "<>"), [*lane, *[f"b_{k}" for k in shape]]))
    before = Window.partitionBy(*names).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = lambda k: F.sum(F.when(c("side") == 0, c(k)).otherwise(0)).over(before)
    apart = met.withColumns({"ended": gone("n"), "ended_here": gone("here")}).where("side <> 0").select(*group, (-2 * (c("here") * c("ended") + (c("n") - c("here")) * c("ended_here"))).alias("m"))
    return pairs.select(*group, twice.alias("m")).unionByName(apart).groupBy(*group).agg(F.expr("sum(m) DIV 2").alias("n"))


def count_clashes(boxes: DataFrame, hosts: DataFrame | None = None, connects: DataFrame | None = None, tol: float = 0.002, cell: float = 4.0) -> DataFrame:
    """H7 counted: model, n, the number of rows that ``check_clashes`` gives by model, where there are any.  Rows of one id are no pair."""
    c = F.col
    deep = reduce(Column.__and__, [c(f"{n}1") - c(f"{n}0") > tol for n in "xyz"])
    own = boxes.where((c("ifc_type") != "IfcOpeningElement") & c("model").isNotNull() & c("global_id").isNotNull() & deep).select("model", "global_id", *[c(f"{n}{e}").cast("double").alias(f"{n}{e}") for n in "xyz" for e in "01"])
    parts = [_overlaps(own, ["model"], tol, cell)]
    again = stored(own.groupBy("model", "global_id").agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_"), "repeated-ids")
    if not again.isEmpty():
        same = _overlaps(own.join(again, ["model", "global_id"]), ["model", "global_id"], tol, cell)
        parts.append(same.select("model", (-c("n")).alias("n")))
    known = [df.select("model", F.least(x, y).alias("element"), F.greatest(x, y).alias("other")) for df, x, y in ((hosts, "element", "wall"), (connects, "a", "b")) if df is not None]
    if known:
        ends = reduce(DataFrame.union, known).where("element < other").distinct()
        side = lambda p, name: own.select("model", c("global_id").alias(name), *[c(f"{n}{e}").alias(f"{p}_{n}{e}") for n in "xyz" for e in "01"])
        depth = [F.least(f"a_{n}1", f"b_{n}1") - F.greatest(f"a_{n}0", f"b_{n}0") > tol for n in "xyz"]
        left_out = ends.join(side("a", "element"), ["model", "element"]).join(side("b", "other"), ["model", "other"]).where(reduce(Column.__and__, depth))
        parts.append(left_out.groupBy("model").agg((-F.count("*")).alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("model").agg(F.sum("n").alias("n")).where("n > 0")


def placement_matrix(place: list[Column], axis: Column | None = None, ref: Column | None = None) -> Column:
    """The rows of the 3x4 matrix of a placement, as an array of 12: z along axis, x along what of ref stands square on it, y = z x x.
    Missing or zero directions are (0, 0, 1) and (1, 0, 0); a ref along the axis gives way to the y axis, or z if that is the axis too."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    vector = lambda *v: F.array(*[F.lit(float(x)) if isinstance(x, (int, float)) else x for x in v])
    none = F.lit(None).cast("array<double>")

    def unit(v: Column) -> Column:
        n = F.sqrt(dot(v, v))
        return F.when(n > 1e-12, F.transform(v, lambda x: x / n))

    def square(v: Column, z: Column) -> Column:
        k = dot(v, z)
        out = vector(*[v[i] - k * z[i] for i in range(3)])
        return F.when(dot(out, out) > 1e-18, unit(out))

    z = F.coalesce(unit(none if axis is None else axis), vector(0, 0, 1))
    x = F.coalesce(square(none if ref is None else ref, z), square(vector(1, 0, 0), z), square(vector(0, 1, 0), z))
    # the array is bound to a name of its own, so that each direction is computed once
    return F.transform(F.array(F.struct(z.alias("z"), x.alias("x"))), lambda d: vector(
        d["x"][0], d["z"][1] * d["x"][2] - d["z"][2] * d["x"][1], d["z"][0], place[0],
        d["x"][1], d["z"][2] * d["x"][0] - d["z"][0] * d["x"][2], d["z"][1], place[1],
        d["x"][2], d["z"][0] * d["x"][1] - d["z"][1] * d["x"][0], d["z"][2], place[2],
    ))[0]


def compose(a: Column, b: Column) -> Column:
    """The product of two 3x4 matrices: b first, then a."""
    cell = lambda r, k: sum((a[4 * r + j] * b[4 * j + k] for j in range(1, 3)), a[4 * r] * b[k])
    return F.array(*[cell(r, k) + a[4 * r + 3] if k == 3 else cell(r, k) for r in range(3) for k in range(4)])


def resolve_placements(placements: DataFrame) -> DataFrame:
    """H8: world position of nested placements.  placements: model, id, parent (null at the top), x, y, z, and either axis and ref
    (arrays of three, null where not given) or the angle about z in radians; neither is no rotation.  Returns model, id, x, y, z, matrix
    (12 numbers, the rows of a 3x4 matrix) and status: ok, missing (a parent on the way up is no row) or cycle, the last two without a
    position.  Each round folds a placement's parent into it and moves on to the parent's parent, so that depth d takes log2 d rounds.
    A round closes a placement wherever one without a cycle is open; the first that closes none leaves only cycles."""
    c = F.col
    place = [c(n).cast("double") for n in "xyz"]
    if "angle" in placements.columns:
        sin, cos = F.sin("angle"), F.cos("angle")
        own = F.array(cos, -sin, F.lit(0.0), place[0], sin, cos, F.lit(0.0), place[1], F.lit(0.0), F.lit(0.0), F.lit(1.0), place[2])
    else:
        own = placement_matrix(place, *[c(n) if n in placements.columns else None for n in ("axis", "ref")])
    rows = stored(placements.select("model", "id", "parent", own.alias("m"), F.lit("ok").alias("status")), "placements")
    still, before = rows.where("parent IS NOT NULL").count(), None
    while still and still != before:
        up = rows.select("model", c("id").alias("parent"), c("parent").alias("next"), c("m").alias("above"), c("status").alias("up_status"))
        j = rows.join(up, ["model", "parent"], "left")
        open_, has = c("parent").isNotNull(), c("above").isNotNull()
        status = F.when(open_ & ~has, "missing").when(open_, c("up_status")).otherwise(c("status"))
        rows = stored(j.select("model", "id", c("next").alias("parent"), F.when(has, compose(c("above"), c("m"))).otherwise(c("m")).alias("m"), status.alias("status")), "placements")
        still, before = rows.where("parent IS NOT NULL").count(), still
    status = F.when(c("parent").isNotNull(), "cycle").otherwise(c("status"))
    known = rows.select("model", "id", status.alias("status"), F.when(status == "ok", c("m")).alias("matrix"))
    return known.select("model", "id", *[c("matrix")[k].alias(n) for n, k in (("x", 3), ("y", 7), ("z", 11))], "matrix", "status")


CHECKS = ["classes", "openings", "walls", "columns", "spaces", "extent", "clashes"]


def count_issues(issues: DataFrame, *counted: DataFrame) -> DataFrame:
    """model, check, n of issue rows, with checks that were counted without their rows (also model, check, n)."""
    return reduce(DataFrame.unionByName, counted, issues.groupBy("model", "check").agg(F.count("*").alias("n")))


def report_of(counts: DataFrame, models: DataFrame, checks: list[str] = CHECKS) -> DataFrame:
    """H9: a row a model with the number of issues by check, zeros included, checks in a fixed order.  counts: model, check, n."""
    wide = counts.groupBy("model").pivot("check", checks).agg(F.sum("n"))
    return models.select("model").distinct().join(wide, "model", "left").na.fill(0, checks).select("model", *checks)


def check_report(issues: DataFrame, models: DataFrame, checks: list[str] = CHECKS) -> DataFrame:
    """H9 of issue rows."""
    return report_of(count_issues(issues), models, checks)


def compare_baseline(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Regressions only.  Both: model, check, n.  More than the baseline, a check that it lacks, or a model that it lacks (one
    row with a null check)."""
    known = baseline.select("model").distinct()
    joined = report.join(baseline.select("model", "check", F.col("n").alias("old")), ["model", "check"], "left").join(known.withColumn("known", F.lit(True)), "model", "left")
    new = joined.where("known IS NULL").select("model").distinct().select("model", F.lit(None).cast("string").alias("check"), F.lit(None).cast("long").alias("old"), F.lit(None).cast("long").alias("n"))
    worse = joined.where("known AND (old IS NULL OR n > old)").select("model", "check", "old", "n")
    return worse.unionByName(new)


def run_checks(checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All issues of a set of checks, by name; any function that gives issue rows can be added."""
    return reduce(DataFrame.unionByName, [f() for f in checks.values()])
