"""Queries of building models, checks and specifications (G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_path, stored
from ..operators import models, specs
from ..sources import readers
from ..sources.step import read_step
from .base import fixture, query, sql, table


# --- G --------------------------------------------------------------------------------------------------------------
@query("g1_explode_models", "SELECT model AS filename, global_id, ifc_type, storey FROM fx_elements")
def g1(spark, d):
    """A model comes in one file for each order, so that a row stays small however many elements the model has."""
    e = fixture(spark, d, "fx_elements")
    row = F.struct("global_id", "ifc_type", F.col("global_id").alias("name"), "storey", "material")
    nested = e.groupBy(F.col("model").alias("filename"), F.substring_index("global_id", "-", 1).alias("file")).agg(F.collect_list(row).alias("elements"), F.collect_list(F.struct(F.col("storey").alias("name"), F.col("z0").alias("elevation"))).alias("storeys"), F.collect_list(F.struct("global_id", F.lit(0.0).alias("area"))).alias("spaces"))
    return models.explode_models(nested)[1].select("filename", "global_id", "ifc_type", "storey")


@query("g2_element_counts", "SELECT model, ifc_type, count(*) AS n FROM fx_elements GROUP BY ALL")
def g2(spark, d):
    return models.element_counts(fixture(spark, d, "fx_elements"))


@query("g2_materials", "SELECT model, string_agg(DISTINCT material, ',' ORDER BY material) AS materials FROM fx_elements WHERE material <> '' GROUP BY model")
def g2b(spark, d):
    return models.materials(fixture(spark, d, "fx_elements")).select("model", F.array_join("materials", ",").alias("materials"))


_ITEMS = "(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_orderkey * 1000 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) t"
#: Statements of a storey with a space for each order, and of an element with its properties for each of its items: source, class, number
#: within the order's, attributes, condition.  Half of the orders name an owner, the others don't.
_STATEMENTS = [
    ("orders", "IFCOWNERHISTORY", 0, '"#1"', "b % 2000 = 0"),
    ("orders", "IFCBUILDINGSTOREY", 1, r'''concat("'g',", own, ",", CASE WHEN o_custkey % 5 = 0 THEN "$" ELSE concat(r"'T\X2\1EA7\X0\ng ", CAST(o_custkey % 5 AS STRING), "'") END, ",$,$,$,$,$,.ELEMENT.,0.")''', None),
    ("orders", "IFCSPACE", 2, '''concat("'s;(''#9,',", own, ",'R, 1',$,$,$,$,$,.ELEMENT.,.INTERNAL.,$")''', None),
    ("orders", "IFCRELAGGREGATES", 3, '''concat("'r',", own, ",$,$,#", b + 1, ",(#", b + 2, ")")''', None),
    ("orders", "IFCMATERIAL", 20, '''concat("'M", CAST(o_custkey % 3 AS STRING), "',$,$")''', None),
    ("orders", "IFCMATERIAL", 21, r'''r"'V\X2\1EEF\X0\a',$,$"''', None),
    ("orders", "IFCMATERIALLAYER", 22, '''concat("#", b + 20, ",15.,$,$,$,$,$")''', None),
    ("orders", "IFCMATERIALLAYER", 23, '''concat("#", b + 21, ",170.,$,$,$,$,$")''', None),
    ("orders", "IFCMATERIALLAYERSET", 24, '''concat("(#", b + 22, ",#", b + 23, "),'W',$")''', None),
    ("orders", "IFCMATERIALLAYERSETUSAGE", 25, '''concat("#", b + 24, ",.AXIS2.,.POSITIVE.,0.,$")''', None),
    ("orders", "IFCMATERIALLIST", 26, '''concat("(#", b + 21, ",#", b + 20, ")")''', None),
    ("orders", "IFCQUANTITYAREA", 80, '''concat("'NetFloorArea',$,$,", CAST(o_custkey % 50 AS STRING), ".5,$")''', None),
    ("orders", "IFCELEMENTQUANTITY", 81, '''concat("'q',", own, ",'Qto',$,$,(#", b + 80, ")")''', None),
    ("orders", "IFCRELDEFINESBYPROPERTIES", 82, '''concat("'r',", own, ",$,$,(#", b + 2, "),#", b + 81)''', "o_custkey % 4 > 0"),
    ("items", "IFCWALL", 100, '''concat("'w',", own, ",$,$,$,$,$,$,$")''', "x.l_partkey % 2 = 0"),
    ("items", "IFCDOOR", 100, '''concat("'d',", own, ",'Door',$,$,$,$,$,2.1,0.9,$,$,$")''', "x.l_partkey % 2 = 1"),
    ("items", "IFCPROPERTYSET", 200, '''concat("'p',", own, ",'Pset',$,(#", b + 300 + x.k, ",#", b + 400 + x.k, ")")''', None),
    ("items", "IFCPROPERTYSINGLEVALUE", 300, '''concat("'Height',$,IFCREAL(", CAST(CAST(x.l_quantity AS INT) AS STRING), ".),$")''', None),
    ("items", "IFCPROPERTYSINGLEVALUE", 400, '''CASE WHEN x.l_suppkey % 2 = 0 THEN "'IsExternal',$,IFCBOOLEAN(.T.),$" ELSE "'FireRating',$,IFCLABEL('REI (60), #1'),$" END''', None),
    ("items", "IFCRELDEFINESBYPROPERTIES", 500, '''concat("'r',", own, ",$,$,(#", b + 100 + x.k, "),#", b + 200 + x.k)''', None),
]
#: Relations with a list of elements: number, class, the single end, and which elements.
_LISTS = [
    (4, "IFCRELCONTAINEDINSPATIALSTRUCTURE", 1, "x.l_suppkey % 3 = 0"), (5, "IFCRELCONTAINEDINSPATIALSTRUCTURE", 2, "x.l_suppkey % 3 = 1"),
    (30, "IFCRELASSOCIATESMATERIAL", 25, "x.l_partkey % 4 = 0"), (31, "IFCRELASSOCIATESMATERIAL", 26, "x.l_partkey % 4 = 1"), (32, "IFCRELASSOCIATESMATERIAL", 20, "x.l_partkey % 4 = 2"),
]


#: Items that one model file holds, on average.
FILE_ITEMS = 60_000


def _step(spark, d, classes, *columns):
    """Model files made of orders and their items, written to the shared folder and read as such: the statements of some classes, with
    some columns.  An order's items are brought to it once, so that its statements lie in one file; a file is known by its number.  Files are
    compressed, each is read by one task, and there are the more of them the more items there are."""
    item = "struct(l_linenumber, l_partkey, l_suppkey, l_quantity)"
    rows = sql(spark, d, f"SELECT o_orderkey AS b, struct(o_custkey) AS o, CAST(NULL AS STRUCT<l_linenumber: INT, l_partkey: BIGINT, l_suppkey: BIGINT, l_quantity: DOUBLE>) AS x FROM orders UNION ALL SELECT l_orderkey, NULL, {item} FROM lineitem")
    files = max(1, -(-table(spark, d, "lineitem").count() // FILE_ITEMS))
    rows = rows.withColumn("b", F.expr("b * 1000")).repartition(files, "b").groupBy("b").agg(F.collect_list("o").alias("os"), F.sort_array(F.collect_list("x")).alias("xs"))
    rows = rows.select("b", F.expr('CASE WHEN b % 2000 = 0 THEN concat("#", b) ELSE "$" END').alias("own"), "os", F.expr("transform(xs, (x, i) -> named_struct('k', i + 1, 'l_partkey', x.l_partkey, 'l_suppkey', x.l_suppkey, 'l_quantity', x.l_quantity))").alias("xs"))
    texts = {"orders": [], "items": []}
    for source, kind, n, args, cond in _STATEMENTS:
        text = f'concat("#", b + {n}{" + x.k" if source == "items" else ""}, "= {kind}(", {args}, ");")'
        texts[source].append(f"CASE WHEN {cond} THEN {text} END" if cond else text)
    lists = []
    for n, kind, end, cond in _LISTS:
        ids = f'transform(filter(xs, x -> {cond}), x -> concat("#", b + 100 + x.k))'
        lists.append(f'CASE WHEN exists(xs, x -> {cond}) THEN concat("#", b + {n}, "={kind}(\'r\',", own, ",$,$,(", array_join(array_sort({ids}), ", "), "),\\n#", b + {end}, ");") END')
    of_orders = ", ".join(t.replace("o_custkey", "o.o_custkey") for t in texts["orders"])
    every = f"concat(flatten(transform(os, o -> array({of_orders}))), flatten(transform(xs, x -> array({', '.join(texts['items'])}))), array({', '.join(lists)}))"
    path = new_path(spark, "step-files")
    rows.select(F.explode(F.expr(every)).alias("value")).where("value IS NOT NULL").write.option("compression", "gzip").text(path)
    step = read_step(spark, path, classes)
    return step.withColumn("file", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")).select("file", "id", "class", *columns)


def _relations(spark, d, *classes):
    """Statements of elements and of some classes, stored, as several relations read them."""
    return stored(_step(spark, d, ("IFCWALL", "IFCDOOR", *classes), "attributes"), "statements")


def _elements(step):
    return step.where(F.col("class").isin("IFCWALL", "IFCDOOR"))


_PLACED = "string_agg(CAST(b + 100 + k AS STRING), ',' ORDER BY CAST(b + 100 + k AS STRING))"


@query("a4_read_step", f"""SELECT o_orderkey * 1000 + 1 AS id, 'IFCBUILDINGSTOREY' AS class, 10 AS n, '' AS refs FROM orders UNION ALL SELECT o_orderkey * 1000 + 2, 'IFCSPACE', 11, '' FROM orders
UNION ALL SELECT o_orderkey * 1000 + 3, 'IFCRELAGGREGATES', 6, concat(o_orderkey * 1000 + 1, ',', o_orderkey * 1000 + 2) FROM orders
UNION ALL SELECT b + 4, 'IFCRELCONTAINEDINSPATIALSTRUCTURE', 6, concat({_PLACED}, ',', b + 1) FROM {_ITEMS} WHERE l_suppkey % 3 = 0 GROUP BY b
UNION ALL SELECT b + 5, 'IFCRELCONTAINEDINSPATIALSTRUCTURE', 6, concat({_PLACED}, ',', b + 2) FROM {_ITEMS} WHERE l_suppkey % 3 = 1 GROUP BY b""")
def a4(spark, d):
    """Statements of places and of what is placed, with the number of attributes; references without the owner's."""
    step = _step(spark, d, ("IFCBUILDINGSTOREY", "IFCSPACE", "IFCRELAGGREGATES", "IFCRELCONTAINEDINSPATIALSTRUCTURE"), "attributes", "refs")
    owner = F.get("attributes", F.lit(1)).startswith("#").cast("int")
    return step.select("id", "class", F.size("attributes").alias("n"), F.array_join(F.slice("refs", owner + 1, F.lit(1 << 30)), ",").alias("refs"))


@query("g3_element_storey", f"SELECT b + 100 + k AS id, CASE WHEN l_suppkey % 3 = 2 THEN '' WHEN o_custkey % 5 = 0 THEN concat('Storey_', CAST(b + 1 AS STRING)) ELSE concat('Tầng ', CAST(o_custkey % 5 AS STRING)) END AS storey FROM {_ITEMS} JOIN orders ON o_orderkey = l_orderkey")
def g3(spark, d):
    step = _relations(spark, d, "IFCBUILDINGSTOREY", "IFCRELAGGREGATES", "IFCRELCONTAINEDINSPATIALSTRUCTURE")
    return models.element_storey(step, _elements(step)).select("id", "storey")


@query("g4_element_material", f"SELECT b + 100 + k AS id, CASE l_partkey % 4 WHEN 3 THEN '' WHEN 2 THEN concat('M', CAST(o_custkey % 3 AS STRING)) WHEN 1 THEN concat('Vữa + M', CAST(o_custkey % 3 AS STRING)) ELSE concat('M', CAST(o_custkey % 3 AS STRING), ' + Vữa') END AS material FROM {_ITEMS} JOIN orders ON o_orderkey = l_orderkey")
def g4(spark, d):
    step = _relations(spark, d, "IFCRELASSOCIATESMATERIAL", "IFCMATERIAL", "IFCMATERIALLAYER", "IFCMATERIALLAYERSET", "IFCMATERIALLAYERSETUSAGE", "IFCMATERIALLIST")
    return models.element_material(step, _elements(step)).select("id", "material")


@query("g5_element_properties", f"SELECT b + 100 + k AS id, concat('Height=', CAST(CAST(floor(l_quantity) AS INT) AS STRING), '.0,', CASE WHEN l_suppkey % 2 = 0 THEN 'IsExternal=true' ELSE 'FireRating=REI (60), #1' END) AS properties FROM {_ITEMS}")
def g5(spark, d):
    step = _relations(spark, d, "IFCRELDEFINESBYPROPERTIES", "IFCPROPERTYSET", "IFCPROPERTYSINGLEVALUE")
    pairs = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return models.element_properties(step, _elements(step)).select("id", F.array_join(pairs, ",").alias("properties"))


@query("g6_space_areas", "SELECT o_orderkey * 1000 + 2 AS id, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_custkey % 50 + 0.5 END AS area FROM orders")
def g6(spark, d):
    classes = ("IFCSPACE", "IFCRELDEFINESBYPROPERTIES", "IFCELEMENTQUANTITY", "IFCQUANTITYAREA")
    return models.space_areas(stored(_step(spark, d, classes, "attributes"), "statements")).select("id", "area")


def _with_spaces(spark, d):
    """The elements, and a space above each slab, some of them on storeys without a name."""
    e = fixture(spark, d, "fx_elements")
    return e, e.where("ifc_type = 'IfcSlab'").select("model", F.concat(F.lit("P"), F.col("global_id")).alias("global_id"), "storey")


@query("g7_build_bim_graph", """SELECT DISTINCT model AS src, 'HAS_STOREY' AS rel, concat(model, '::', storey) AS dst FROM fx_elements WHERE storey <> ''
UNION ALL SELECT concat(model, '::', storey), 'CONTAINS', global_id FROM fx_elements WHERE storey <> '' UNION ALL SELECT global_id, 'MADE_OF', material FROM fx_elements WHERE material <> ''
UNION ALL SELECT concat(model, '::', storey), 'CONTAINS', concat('P', global_id) FROM fx_elements WHERE ifc_type = 'IfcSlab' AND (model, storey) IN (SELECT (model, storey) FROM fx_elements WHERE storey <> '')""")
def g7(spark, d):
    return models.build_bim_graph(*_with_spaces(spark, d))[1]


@query("g7_graph_nodes", """SELECT DISTINCT 'Building' AS label, model AS key FROM fx_elements UNION ALL SELECT DISTINCT 'Storey', concat(model, '::', storey) FROM fx_elements WHERE storey <> ''
UNION ALL SELECT DISTINCT 'Material', material FROM fx_elements WHERE material <> '' UNION ALL SELECT substr(ifc_type, 4), global_id FROM fx_elements UNION ALL SELECT 'Space', concat('P', global_id) FROM fx_elements WHERE ifc_type = 'IfcSlab'""")
def g7b(spark, d):
    return models.build_bim_graph(*_with_spaces(spark, d))[0]


@query("g8_building_summary", """WITH c AS (SELECT model, substr(ifc_type, 4) AS label, count(*) AS n FROM fx_elements GROUP BY ALL)
SELECT model, storeys, materials, counts FROM (SELECT model, coalesce(string_agg(DISTINCT storey, ',' ORDER BY storey) FILTER (storey <> ''), '') AS storeys, coalesce(string_agg(DISTINCT material, ',' ORDER BY material) FILTER (material <> ''), '') AS materials FROM fx_elements GROUP BY model) a
JOIN (SELECT model, string_agg(concat(label, '=', CAST(n AS STRING)), ',' ORDER BY n DESC, label) AS counts FROM c GROUP BY model) b USING (model)""")
def g8(spark, d):
    return models.building_summary(fixture(spark, d, "fx_elements"))


@query("g9_elements_on_storey", "SELECT model, ifc_type, global_id, storey FROM fx_elements WHERE storey = 'Tầng 3'")
def g9(spark, d):
    return models.elements_on_storey(fixture(spark, d, "fx_elements"), "Tầng 3")


@query("g10_material_usage", "SELECT model, global_id, ifc_type, storey, material FROM fx_elements WHERE contains(lower(material), 'liệu 2')")
def g10(spark, d):
    return models.material_usage(fixture(spark, d, "fx_elements"), "liệu 2")


def _meshes(spark, d):
    v = F.array("x0", "y0", "z0", "x1", "y0", "z1", "x0", "y1", "z0")
    return fixture(spark, d, "fx_elements").select("model", "global_id", "ifc_type", v.alias("v"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("f"))


@query("g11_mesh_bounds", "SELECT model, global_id, ifc_type, x0, y0, z0, x1, y1, z1 FROM fx_elements")
def g11(spark, d):
    return models.mesh_bounds(_meshes(spark, d))


@query("g11_model_bounds", """WITH c AS (SELECT model, replace(ifc_type, 'Ifc', '') AS class, count(*) AS n FROM fx_elements GROUP BY ALL), l AS (SELECT model, string_agg(concat(class, '=', CAST(n AS STRING)), ',' ORDER BY class) AS counts FROM c GROUP BY model)
SELECT model, counts, count(*) AS n, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(min(z0), 2) AS z0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1, round(max(z1), 2) AS z1 FROM l JOIN fx_elements USING (model) GROUP BY model, counts""")
def g11b(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return models.model_bounds(_meshes(spark, d)).withColumn("counts", listed)


@query("g11_mesh_style", """SELECT global_id, coalesce(r, 0.7) AS red, CASE WHEN CAST(x0 AS INT) % 4 = 0 THEN 0.75 WHEN ifc_type = 'IfcWindow' THEN 0.3 ELSE 1.0 END AS opacity FROM fx_elements
LEFT JOIN (VALUES ('IfcWall', 0.91), ('IfcColumn', 0.69), ('IfcBeam', 0.63), ('IfcSlab', 0.78), ('IfcDoor', 0.43), ('IfcWindow', 0.5), ('IfcStair', 0.74), ('IfcFooting', 0.55)) v(t, r) ON t = ifc_type""")
def g11c(spark, d):
    e = fixture(spark, d, "fx_elements").withColumn("transparency", F.when(F.col("x0").cast("int") % 4 == 0, 0.25))
    return models.mesh_style(e).select("global_id", F.col("color")[0].alias("red"), "opacity")


@query("g12_quantity_takeoff", "SELECT model, ifc_type, n, volume, area, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY model)) AS INT) AS share FROM (SELECT model, ifc_type, count(*) AS n, round(sum((x1 - x0) * (y1 - y0) * (z1 - z0)), 6) AS volume, round(sum((x1 - x0) * (y1 - y0)), 6) AS area FROM fx_elements GROUP BY ALL) t")
def g12(spark, d):
    return models.quantity_takeoff(fixture(spark, d, "fx_elements"))


# --- H --------------------------------------------------------------------------------------------------------------
_WANTED = ", ".join(f"('{c}')" for c in models.REQUIRED_CLASSES)
_H1 = f"SELECT model, 'classes' AS \"check\", c AS element FROM (SELECT DISTINCT model FROM fx_elements) m, (VALUES {_WANTED}) v(c) WHERE NOT EXISTS (SELECT 1 FROM fx_elements e WHERE e.model = m.model AND e.ifc_type = c)"


@query("h1_check_required_classes", _H1)
def h1(spark, d):
    return models.check_required_classes(fixture(spark, d, "fx_elements")).select("model", "check", "element")


def _parts(spark, d):
    """Doors, fills, voids, walls and wall connections that miss some, by the element's number."""
    e = fixture(spark, d, "fx_elements").select("model", F.col("global_id").alias("element"), "ifc_type", F.crc32(F.col("global_id").cast("binary")).alias("h"))
    doors = e.where("ifc_type IN ('IfcDoor', 'IfcWindow')")
    opening = F.concat(F.lit("O"), F.col("element"))
    wall = F.concat(F.lit("W"), F.col("element"))
    fills = doors.where("substring(element, -1) <> '3'").select("model", "element", opening.alias("opening"))
    voids = fills.where("substring(element, -1) <> '2'").select("model", "opening", wall.alias("wall")).withColumn("wall", F.concat(F.lit("W"), F.substring("opening", 2, 99)))
    walls = doors.select("model", wall.alias("element"))
    return e, doors, fills, voids, walls


_H2 = "SELECT model, global_id AS element FROM fx_elements WHERE ifc_type IN ('IfcDoor', 'IfcWindow') AND right(global_id, 1) IN ('2', '3')"


@query("h2_check_openings", _H2)
def h2(spark, d):
    _, doors, fills, voids, walls = _parts(spark, d)
    return models.check_openings(doors, fills, voids, walls).select("model", "element")


def _walls(spark, d):
    """Walls, and connections that name those whose number ends in 1 or 2."""
    walls = fixture(spark, d, "fx_elements").where("ifc_type = 'IfcWall'").select("model", F.col("global_id").alias("element"))
    one = walls.where("substring(element, -1) = '1'").select("model", F.col("element").alias("a"), F.lit("x").alias("b"))
    two = walls.where("substring(element, -1) = '2'").select("model", F.lit("y").alias("a"), F.col("element").alias("b"))
    return walls, one.unionByName(two)


_H3 = "SELECT model, global_id AS element FROM (SELECT *, count(*) OVER (PARTITION BY model) AS n FROM fx_elements WHERE ifc_type = 'IfcWall') t WHERE n >= 2 AND right(global_id, 1) NOT IN ('1', '2')"


@query("h3_check_wall_connections", _H3)
def h3(spark, d):
    return models.check_wall_connections(*_walls(spark, d)).select("model", "element")


def _columns(spark, d):
    """Columns, and the axes of their grid."""
    li = table(spark, d, "lineitem")
    cols = li.select(F.concat(F.lit("M"), (F.col("l_orderkey") % 60).cast("string")).alias("model"), F.col("l_partkey").alias("element"), (F.col("l_partkey") % 30).cast("double").alias("x"), (F.col("l_suppkey") % 20).cast("double").alias("y"))
    return cols, fixture(spark, d, "fx_axes")


_H4 = """WITH c AS (SELECT concat('M', CAST(l_orderkey % 60 AS STRING)) AS model, l_partkey AS element, CAST(l_partkey % 30 AS DOUBLE) AS x, CAST(l_suppkey % 20 AS DOUBLE) AS y FROM lineitem),
g AS (SELECT u.model, u.ax0 AS gx, v.ay0 AS gy FROM fx_axes u JOIN fx_axes v ON u.model = v.model AND u.axis = 'U' AND v.axis = 'V'),
n AS (SELECT c.model, c.element, min(sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy))) AS d FROM c JOIN g USING (model) GROUP BY ALL)
SELECT model, CAST(element AS STRING) AS element FROM n WHERE d * 1000 > 10 UNION ALL SELECT DISTINCT model, NULL FROM c WHERE model NOT IN (SELECT model FROM g)"""


@query("h4_check_columns_on_grid", _H4)
def h4(spark, d):
    return models.check_columns_on_grid(*_columns(spark, d)).select("model", "element")


def _storeys(spark, d):
    """Storeys, and the spaces that two of them hold."""
    s = fixture(spark, d, "fx_elements").where("storey <> ''").select("model", F.col("storey").alias("element")).distinct()
    return s, s.where("element IN ('Tầng 2', 'Tầng 5')").select("model", F.col("element").alias("storey"))


_H5 = "SELECT DISTINCT model, storey AS element FROM fx_elements WHERE storey NOT IN ('', 'Tầng 2', 'Tầng 5')"


@query("h5_check_spaces", _H5)
def h5(spark, d):
    return models.check_spaces(*_storeys(spark, d)).select("model", "element")


@query("h6_check_extent", "SELECT model, global_id AS element FROM fx_elements WHERE greatest(abs(x1), abs(y1), abs(z1)) * 30 > 1000")
def h6(spark, d):
    e = fixture(spark, d, "fx_elements").select("model", F.col("global_id").alias("element"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"), F.lit(30).alias("unit_scale"))
    return models.check_extent(e).select("model", "element")


_H7 = """SELECT a.model, a.global_id AS element, b.global_id AS other FROM fx_elements a JOIN fx_elements b ON a.model = b.model AND a.global_id < b.global_id
 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.002 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.002 AND least(a.z1, b.z1) - greatest(a.z0, b.z0) > 0.002"""


@query("h7_check_clashes", _H7)
def h7(spark, d):
    return models.check_clashes(fixture(spark, d, "fx_elements")).select("model", "element", "other")


@query("h8_resolve_placements", "SELECT concat('o', CAST(o_custkey AS STRING)) AS model, o_orderkey AS id, CAST(sum(1 + o_orderkey % 7) OVER w AS DOUBLE) AS x, CAST(row_number() OVER w AS DOUBLE) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def h8(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = o.select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("model"), F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(by).alias("parent"), (1.0 + F.col("o_orderkey") % 7).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), F.lit(0.0).alias("angle"))
    return models.resolve_placements(p).select("model", "id", "x", "z")


def _issues(spark, d, clashes=True):
    """The issues of all checks, each with the inputs of its own query (H6 with another unit)."""
    e = fixture(spark, d, "fx_elements")
    far = e.select("model", F.col("global_id").alias("element"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"), F.lit(25).alias("unit_scale"))
    checks = {
        "classes": lambda: models.check_required_classes(e), "openings": lambda: models.check_openings(*_parts(spark, d)[1:]), "walls": lambda: models.check_wall_connections(*_walls(spark, d)),
        "columns": lambda: models.check_columns_on_grid(*_columns(spark, d)), "spaces": lambda: models.check_spaces(*_storeys(spark, d)), "extent": lambda: models.check_extent(far), "clashes": lambda: models.check_clashes(e),
    }
    return models.run_checks({name: f for name, f in checks.items() if clashes or name != "clashes"})


def _counts(spark, d):
    """How many issues each check has by model; clashes are counted without their pairs."""
    clashes = models.count_clashes(fixture(spark, d, "fx_elements")).select("model", F.lit("clashes").alias("check"), "n")
    return models.count_issues(_issues(spark, d, clashes=False), clashes)


_OTHERS = " ".join(f"UNION ALL SELECT model, '{c}', element FROM ({q}) q_{c}" for c, q in (("openings", _H2), ("walls", _H3), ("columns", _H4), ("spaces", _H5), ("clashes", _H7)))
_REPORT = f"""WITH i AS ({_H1} {_OTHERS} UNION ALL SELECT model, 'extent', global_id FROM fx_elements WHERE greatest(abs(x1), abs(y1), abs(z1)) * 25 > 1000), m AS (SELECT DISTINCT model FROM fx_elements)"""


@query("h9_check_report", f"{_REPORT} SELECT m.model, {', '.join(f'count(*) FILTER (i.\"check\" = {c!r}) AS {c}' for c in models.CHECKS)} FROM m LEFT JOIN i USING (model) GROUP BY m.model")
def h9(spark, d):
    return models.report_of(_counts(spark, d), fixture(spark, d, "fx_elements"))


@query("h10_compare_baseline", f"""{_REPORT}, n AS (SELECT model, "check", count(*) AS n FROM i GROUP BY ALL), b AS (SELECT model, "check", CASE WHEN "check" = 'extent' THEN n - 1 ELSE n END AS old FROM n WHERE right(model, 1) <> '3' AND NOT ("check" = 'classes' AND right(model, 1) = '4'))
SELECT n.model, n."check", b.old, n.n FROM n LEFT JOIN b USING (model, "check") WHERE n.model IN (SELECT model FROM b) AND (b.old IS NULL OR n.n > b.old) UNION ALL SELECT DISTINCT model, NULL, NULL, NULL FROM n WHERE model NOT IN (SELECT model FROM b)""")
def h10(spark, d):
    n = stored(_counts(spark, d), "issues")
    last = F.substring("model", -1, 1)
    base = n.where((last != "3") & ~((F.col("check") == "classes") & (last == "4"))).withColumn("n", F.col("n") - (F.col("check") == "extent").cast("int"))
    return models.compare_baseline(n, base)


# --- I --------------------------------------------------------------------------------------------------------------
def _bounds_sql(kind: str, fields: list[str], view: str) -> str:
    rows = []
    for f in fields:
        lo, hi = specs.BOUNDS[kind][f]
        rows.append(f"SELECT spec_id, '{f}' AS field, CAST({f} AS DOUBLE) AS value FROM {view} WHERE {f} < {lo} OR {f} > {hi}")
    return " UNION ALL ".join(rows)


_BUILDING = ["num_storeys", "storey_height", "footprint_length", "footprint_width", "slab_thickness", "column_size", "column_spacing_x", "column_spacing_y", "num_staircases", "doors_per_storey"]
_BRIDGE = ["total_length", "num_spans", "deck_width", "num_lanes", "lane_width", "girder_height", "num_girders", "clearance_height"]


#: What is moved out of bounds, on some rows.
_OFF = {"buildings": {"num_storeys": "num_storeys + 100 * (spec_id % 3)", "storey_height": "storey_height - 900 * (spec_id % 4)", "num_staircases": "num_staircases + 4 * (spec_id % 5)"}, "bridges": {"total_length": "total_length * (1 + spec_id % 7)", "num_lanes": "num_lanes + spec_id % 6"}}
_OFF_SQL = {k: f"(SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in v.items())}) FROM fx_{k})" for k, v in _OFF.items()}


@query("i1_validate_bounds", f"SELECT 'building' AS kind, * FROM ({_bounds_sql('building', _BUILDING, _OFF_SQL['buildings'])}) a UNION ALL SELECT 'bridge', * FROM ({_bounds_sql('bridge', _BRIDGE, _OFF_SQL['bridges'])}) b")
def i1(spark, d):
    off = lambda k: fixture(spark, d, f"fx_{k}").withColumns({c: F.expr(e) for c, e in _OFF[k].items()})
    a, b = (specs.validate_bounds(off(f"{k}s"), k).select(F.lit(k).alias("kind"), "spec_id", "field", "value") for k in ("building", "bridge"))
    return a.unionByName(b)


@query("i2_derive_bridge", "SELECT spec_id, num_spans - 1 AS num_piers, total_length / num_spans AS span_length, CASE WHEN deck_width <> 12000 THEN deck_width ELSE 12000 END AS abutment_width FROM fx_bridges")
def i2(spark, d):
    return specs.derive_bridge(fixture(spark, d, "fx_bridges")).select("spec_id", "num_piers", "span_length", "abutment_width")


_I3 = [
    ("stairs", "num_storeys > 3 AND num_staircases < 2"), ("exits", "doors_per_storey < 2 AND num_storeys > 2"), ("escape", "footprint_length > 40000"), ("high_rise", "num_storeys * storey_height / 1000 > 28"),
    ("fire_rating", "building_type IN ('F1', 'F2', 'F3') AND num_storeys > 5"), ("storey_home", "building_function = 'Nhà ở' AND storey_height < 2700"), ("storey_other", "building_function <> 'Nhà ở' AND storey_height < 3000"),
    ("floor_area", "footprint_length / 1000 * (footprint_width / 1000) < 20"), ("slab", "slab_thickness < CASE WHEN footprint_length / 1000 * (footprint_width / 1000) < 50 THEN 100 ELSE 150 END"),
    ("slab_span", "slab_thickness < greatest(column_spacing_x, column_spacing_y) / 30"), ("span", "greatest(column_spacing_x, column_spacing_y) > 8000"), ("column_5", "num_storeys > 5 AND column_size < 500"), ("column_10", "num_storeys > 10 AND column_size < 600"),
    ("aspect", "footprint_length / footprint_width > 5"), ("super_high", "num_storeys * storey_height / 1000 > 75"), ("stairs_ok", "num_staircases >= 2 AND num_storeys > 3"), ("storey_ok", "storey_height >= 3000"),
]


@query("i3_check_building", " UNION ALL ".join(f"SELECT spec_id, '{c}' AS code FROM fx_buildings WHERE {w}" for c, w in _I3))
def i3(spark, d):
    return specs.check_building(fixture(spark, d, "fx_buildings")).select("spec_id", "code")


_I4 = [
    ("lane", "lane_width < 3500"), ("lane_ok", "lane_width >= 3500"), ("deck_width", "deck_width < num_lanes * lane_width + 3000"), ("span", "total_length / num_spans > 40000"),
    ("slender", "total_length / num_spans / girder_height > 20"), ("slender_high", "total_length / num_spans / girder_height > 16 AND total_length / num_spans / girder_height <= 20"), ("slender_ok", "total_length / num_spans / girder_height <= 16"),
    ("girders", "num_girders < greatest(2, floor(deck_width / 3000))"), ("barrier_ok", "TRUE"), ("clearance_road", "bridge_function = 'Đường bộ' AND clearance_height < 4500"), ("clearance_rail", "bridge_function = 'Đường sắt' AND clearance_height < 5500"),
    ("clearance_ok", "NOT (bridge_function = 'Đường bộ' AND clearance_height < 4500) AND NOT (bridge_function = 'Đường sắt' AND clearance_height < 5500)"), ("mean_span", "total_length / num_spans > 35000"), ("load", "TRUE"),
]


@query("i4_check_bridge", " UNION ALL ".join(f"SELECT spec_id, '{c}' AS code FROM fx_bridges WHERE {w}" for c, w in _I4))
def i4(spark, d):
    return specs.check_bridge(fixture(spark, d, "fx_bridges")).select("spec_id", "code")


@query("i5_expand_building", """WITH b AS (SELECT *, greatest(2, CAST(floor(footprint_length / column_spacing_x) AS INT) + 1) AS nx, greatest(2, CAST(floor(footprint_width / column_spacing_y) AS INT) + 1) AS ny FROM fx_buildings),
st AS (SELECT b.*, s, (s - 1) * storey_height AS e, (s - 1) * storey_height + slab_thickness AS wz, storey_height - slab_thickness AS wh FROM b, range(1, 26) r(s) WHERE s <= num_storeys),
gx AS (SELECT spec_id, i, least(i * column_spacing_x, footprint_length) AS x, least((i + 1) * column_spacing_x, footprint_length) AS x2 FROM b, range(0, 100) r(i) WHERE i < nx),
gy AS (SELECT spec_id, j, least(j * column_spacing_y, footprint_width) AS y, least((j + 1) * column_spacing_y, footprint_width) AS y2 FROM b, range(0, 100) r(j) WHERE j < ny),
g AS (SELECT * FROM gx JOIN gy USING (spec_id)),
e AS (SELECT spec_id, 'IfcSlab' AS ifc_type, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, e AS z, footprint_length AS dx, footprint_width AS dy, slab_thickness AS dz FROM st
 UNION ALL SELECT spec_id, 'IfcSlab', -300, -300, num_storeys * storey_height, footprint_length + 600, footprint_width + 600, 250 FROM b
 UNION ALL SELECT spec_id, 'IfcWall', 0, 0, wz, footprint_length, 200, wh FROM st UNION ALL SELECT spec_id, 'IfcWall', 0, footprint_width - 200, wz, footprint_length, 200, wh FROM st
 UNION ALL SELECT spec_id, 'IfcWall', 0, 200, wz, 200, footprint_width - 400, wh FROM st UNION ALL SELECT spec_id, 'IfcWall', footprint_length - 200, 200, wz, 200, footprint_width - 400, wh FROM st
 UNION ALL SELECT spec_id, 'IfcColumn', x, y, e, column_size, column_size, storey_height FROM st JOIN g USING (spec_id) WHERE NOT (x < 201 OR x > footprint_length - 201 OR y < 201 OR y > footprint_width - 201)
 UNION ALL SELECT spec_id, 'IfcBeam', x, y, e + storey_height - 400, x2 - x, 200, 400 FROM st JOIN g USING (spec_id) WHERE i < nx - 1 AND x2 - x > 500
 UNION ALL SELECT spec_id, 'IfcBeam', x, y, e + storey_height - 400, 200, y2 - y, 400 FROM st JOIN g USING (spec_id) WHERE j < ny - 1 AND y2 - y > 500
 UNION ALL SELECT spec_id, 'IfcDoor', footprint_length / (doors_per_storey + 1) * i - 450, 0, wz, 900, 200, 2100 FROM st, range(1, 4) r(i) WHERE i <= doors_per_storey
 UNION ALL SELECT spec_id, 'IfcWindow', footprint_length / 4 * i - 600, footprint_width - 200, wz + 900, 1200, 200, 1500 FROM st, range(1, 4) r(i)
 UNION ALL SELECT spec_id, 'IfcStair', CASE WHEN i = 1 THEN footprint_length - 2800 ELSE 400 END, footprint_width / 2 - 1000, e, 2200, 1000, storey_height FROM st, range(1, 4) r(i) WHERE i <= num_staircases
 UNION ALL SELECT spec_id, 'IfcFooting', x, y, -500, column_size * 2.5, column_size * 2.5, 500 FROM g JOIN b USING (spec_id))
SELECT spec_id, ifc_type, count(*) AS n, CAST(round(sum(x)) AS BIGINT) AS x, CAST(round(sum(y)) AS BIGINT) AS y, CAST(round(sum(z)) AS BIGINT) AS z, CAST(round(sum(dx)) AS BIGINT) AS dx, CAST(round(sum(dy)) AS BIGINT) AS dy, CAST(round(sum(dz)) AS BIGINT) AS dz FROM e GROUP BY ALL""")
def i5(spark, d):
    sums = [F.round(F.sum(c)).cast("long").alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")]
    return specs.expand_building(fixture(spark, d, "fx_buildings")).groupBy("spec_id", "ifc_type").agg(F.count("*").alias("n"), *sums)


def _bridges(spark, d):
    """The bridges, with posts 1.5 to 3 m apart and up to seven piles a support."""
    return fixture(spark, d, "fx_bridges").withColumns({"barrier_post_spacing": 1500.0 + F.col("spec_id") % 4 * 500, "num_piles_per_pier": (1 + F.col("spec_id") % 7).cast("int"), "pier_width": 1000.0 + F.col("num_lanes") * 250})


_BRIDGES = """b AS (SELECT *, total_length / num_spans AS span, 1500 + spec_id % 4 * 500 AS gap, 1 + spec_id % 7 AS np, 1000 + num_lanes * 250 AS pw FROM fx_bridges),
sup AS (SELECT b.*, i, i * span AS sx FROM b, range(0, 7) r(i) WHERE i <= num_spans),
piles AS (SELECT spec_id, i, k, sx + (k % least(np, 2) - (least(np, 2) - 1) / 2) * pw * 2 AS x, deck_width / 2 + (floor(k / least(np, 2)) - (ceil(np / least(np, 2)) - 1) / 2) * 4000 AS y FROM sup, range(0, 7) q(k) WHERE k < np)"""


@query("i6_expand_bridge", f"""WITH {_BRIDGES},
e AS (SELECT spec_id, 'abutment' AS part, CAST(i AS DOUBLE) * span AS x, deck_width / 2 AS y FROM sup WHERE i IN (0, num_spans)
 UNION ALL SELECT spec_id, 'pier', sx, deck_width / 2 FROM sup WHERE i > 0 AND i < num_spans
 UNION ALL SELECT spec_id, 'girder', sx, g * deck_width / (num_girders + 1) FROM sup, range(1, 10) h(g) WHERE g <= num_girders AND i < num_spans
 UNION ALL SELECT spec_id, 'deck', sx, 0 FROM sup WHERE i < num_spans
 UNION ALL SELECT spec_id, 'post', p * gap, y.y * deck_width FROM b, range(0, 200) h(p), (VALUES (0), (1)) y(y) WHERE p * gap <= total_length
 UNION ALL SELECT spec_id, 'bearing', sx, g * deck_width / (num_girders + 1) FROM sup, range(1, 10) h(g) WHERE g <= num_girders
 UNION ALL SELECT spec_id, 'pile', x, y FROM piles)
SELECT spec_id, part, count(*) AS n, round(sum(x), 1) AS x, round(sum(y), 1) AS y FROM e GROUP BY ALL""")
def i6(spark, d):
    return specs.expand_bridge(_bridges(spark, d)).groupBy("spec_id", "part").agg(F.count("*").alias("n"), F.round(F.sum("x"), 1).alias("x"), F.round(F.sum("y"), 1).alias("y"))


_FOUNDATION = f"""WITH {_BRIDGES}
SELECT s.spec_id, s.i AS support, CASE WHEN s.i = 0 OR s.i = num_spans THEN 'abutment' ELSE 'pier' END AS kind, sx AS x, CAST(np AS INT) AS piles, round(min(p.x), 1) AS x0, round(max(p.x), 1) AS x1, round(min(p.y), 1) AS y0, round(max(p.y), 1) AS y1
FROM sup s JOIN piles p ON s.spec_id = p.spec_id AND s.i = p.i GROUP BY s.spec_id, s.i, num_spans, sx, np"""


def _supports(records):
    own = records.select("spec_id", F.posexplode("supports").alias("support", "s"))
    ends = [F.round(f(F.col("s.piles")[c]), 1).alias(f"{c}{k}") for c in ("x", "y") for k, f in enumerate((F.array_min, F.array_max))]
    return own.select("spec_id", "support", "s.kind", "s.x", F.size("s.piles").alias("piles"), *ends)


@query("i6_foundation_supports", _FOUNDATION)
def i6b(spark, d):
    return _supports(specs.foundation_supports(_bridges(spark, d)))


@query("a8_write_foundation_json", _FOUNDATION)
def a8(spark, d):
    """The records as they are read back from the files."""
    records = specs.foundation_supports(_bridges(spark, d))
    path = new_path(spark, "foundations")
    readers.write_foundation_json(records, path)
    return _supports(spark.read.schema(records.schema).json(path))


def _stated(pattern: str, default: int) -> str:
    return f"coalesce(CAST(nullif(regexp_extract(question, '{pattern}', 1), '') AS INT), {default})"


@query("i7_extract_spec", f"""SELECT conv_id, turn, {_stated("(\\d+)\\s*m(?:\\s|,|$)", 30)} * 1000 AS total_length, {_stated("(\\d+)\\s*nhịp", 3)} AS num_spans, {_stated("(\\d+)\\s*làn", 2)} AS num_lanes, {_stated("(\\d+)\\s*tầng", 3)} AS num_storeys,
CAST(floor(sqrt({_stated("(\\d+)\\s*m[²2]", 96)}) * 1000) AS INT) AS footprint_length, {_stated("(\\d+)\\s*cầu thang", 1)} AS num_staircases FROM fx_questions""")
def i7(spark, d):
    return specs.extract_spec(fixture(spark, d, "fx_questions"), "question").select("conv_id", "turn", "total_length", "num_spans", "num_lanes", "num_storeys", "footprint_length", "num_staircases")


@query("i8_material_for_element", "SELECT global_id, CASE ifc_type WHEN 'IfcWall' THEN CASE WHEN x0 = 0 THEN 'Tường gạch sơn ngoài' ELSE 'Tường gạch sơn trong' END WHEN 'IfcSlab' THEN 'Sàn bê tông lát gạch men' WHEN 'IfcDoor' THEN 'Gỗ' WHEN 'IfcWindow' THEN 'Kính' ELSE 'Bê tông cốt thép' END AS material_name, CASE ifc_type WHEN 'IfcWall' THEN 'brick' WHEN 'IfcDoor' THEN 'wood' WHEN 'IfcWindow' THEN 'glass' ELSE 'concrete' END AS category, CASE ifc_type WHEN 'IfcWindow' THEN 0.5 ELSE 0.0 END AS transparency FROM fx_elements")
def i8(spark, d):
    return specs.material_for_element(fixture(spark, d, "fx_elements").withColumn("is_external", F.col("x0") == 0)).select("global_id", "material_name", "category", "transparency")
