"""Registration of queries, and the fixture views that they read.

A fixture is one SQL text over the given tables.  Spark runs it as a query, the SQL of an oracle gets it as a common table
expression, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ORDERED_ITEMS = """row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ordinal FROM lineitem"""

FIXTURES: dict[str, str] = {
    "fx_standards": """SELECT o_orderkey AS std_id, concat('QCVN ', CAST(o_orderkey AS STRING), ':', CAST(year(o_orderdate) AS STRING), '/BXD') AS standard_code,
  concat('Standard ', o_orderpriority) AS standard_name, CAST(year(o_orderdate) AS INT) AS year,
  CASE o_orderstatus WHEN 'F' THEN 'Hết hiệu lực toàn bộ' WHEN 'O' THEN 'Còn hiệu lực' ELSE 'Hết hiệu lực một phần' END AS eff_status,
  o_custkey AS family FROM orders""",
    "fx_articles": f"""SELECT std_id, ordinal, chapter_number, section_number, concat(section_number, '.', CAST(ordinal AS STRING)) AS article_number,
  concat('Lối đi ', CAST(ordinal AS STRING)) AS title,
  concat(section_number, '.', CAST(ordinal AS STRING), ' Chiều rộng không nhỏ hơn ', CAST(CAST(l_quantity AS INT) AS STRING), ' mm; chiều cao không quá ', CAST(1 + l_suppkey % 9 AS STRING), ',5 m.') AS content,
  CAST(l_quantity AS INT) AS q
FROM (SELECT l_orderkey AS std_id, l_suppkey, l_quantity, CAST(1 + l_suppkey % 5 AS STRING) AS chapter_number,
  concat(CAST(1 + l_suppkey % 5 AS STRING), '.', CAST(1 + l_partkey % 4 AS STRING)) AS section_number, {_ORDERED_ITEMS}) t""",
    "fx_refs": """SELECT std_id, prev AS supersedes_id FROM (SELECT o_orderkey AS std_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) t WHERE prev IS NOT NULL""",
    "fx_elements": f"""SELECT concat('M', CAST(l_orderkey % 50 AS STRING)) AS model, concat(CAST(l_orderkey AS STRING), '-', CAST(ordinal AS STRING)) AS global_id,
  CASE l_partkey % 8 WHEN 0 THEN 'IfcWall' WHEN 1 THEN 'IfcColumn' WHEN 2 THEN 'IfcBeam' WHEN 3 THEN 'IfcSlab' WHEN 4 THEN 'IfcDoor' WHEN 5 THEN 'IfcWindow' WHEN 6 THEN 'IfcStair' ELSE 'IfcFooting' END AS ifc_type,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('Tầng ', CAST(1 + l_suppkey % 7 AS STRING)) END AS storey,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('Vật liệu ', CAST(l_partkey % 5 AS STRING)) END AS material,
  CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 30 AS DOUBLE) AS y0, CAST(3 * (l_suppkey % 7) AS DOUBLE) AS z0,
  CAST(l_partkey % 40 AS DOUBLE) + l_quantity * 0.125 AS x1, CAST(l_suppkey % 30 AS DOUBLE) + 0.5 AS y1, CAST(3 * (l_suppkey % 7) AS DOUBLE) + 2.5 AS z1
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, {_ORDERED_ITEMS}) t""",
    "fx_buildings": """SELECT o_orderkey AS spec_id, CASE o_orderkey % 3 WHEN 0 THEN 'F1' WHEN 1 THEN 'F2' ELSE 'F5' END AS building_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'Nhà ở' ELSE 'Văn phòng' END AS building_function, CAST(1 + o_orderkey % 25 AS INT) AS num_storeys,
  CAST(2400 + 100 * (o_orderkey % 15) AS DOUBLE) AS storey_height, CAST(3000 + 1000 * (o_custkey % 60) AS DOUBLE) AS footprint_length,
  CAST(3000 + 500 * (o_orderkey % 20) AS DOUBLE) AS footprint_width, CAST(80 + 10 * (o_orderkey % 20) AS DOUBLE) AS slab_thickness,
  CAST(200 + 50 * (o_custkey % 12) AS DOUBLE) AS column_size, CAST(3000 + 500 * (o_orderkey % 14) AS DOUBLE) AS column_spacing_x,
  CAST(3000 + 500 * (o_custkey % 14) AS DOUBLE) AS column_spacing_y, CAST(o_orderkey % 4 AS INT) AS num_staircases, CAST(o_custkey % 4 AS INT) AS doors_per_storey FROM orders""",
    "fx_bridges": """SELECT p_partkey AS spec_id, CASE p_partkey % 3 WHEN 0 THEN 'Đường bộ' WHEN 1 THEN 'Đường sắt' ELSE 'Bộ hành' END AS bridge_function,
  CAST(20000 + 5000 * (p_partkey % 30) AS DOUBLE) AS total_length, CAST(1 + p_partkey % 6 AS INT) AS num_spans, CAST(4000 + 500 * p_size AS DOUBLE) AS deck_width,
  CAST(1 + p_size % 6 AS INT) AS num_lanes, CAST(3000 + 250 * (p_partkey % 5) AS DOUBLE) AS lane_width, CAST(600 + 100 * (p_size % 20) AS DOUBLE) AS girder_height,
  CAST(2 + p_partkey % 8 AS INT) AS num_girders, CAST(4000 + 250 * (p_size % 9) AS DOUBLE) AS clearance_height FROM part""",
    "fx_rects": f"""SELECT l_orderkey AS program, CAST(l_suppkey % 3 AS INT) AS floor_idx, concat('r', CAST(ordinal AS STRING)) AS room_id,
  CAST(1000 * (l_partkey % 6) AS INT) AS x_mm, CAST(1000 * (l_suppkey % 6) AS INT) AS y_mm, CAST(1000 * (1 + l_partkey % 3) AS INT) AS w_mm, CAST(1000 * (1 + l_suppkey % 3) AS INT) AS d_mm
FROM (SELECT l_orderkey, l_partkey, l_suppkey, {_ORDERED_ITEMS}) t""",
    "fx_hits": "SELECT event_id, concat('chat:', CAST(user_id AS STRING)) AS k, ts FROM events",
    "fx_feedback": "SELECT event_id, user_id AS message_id, ts, CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END AS feedback FROM events WHERE event_type IN ('click', 'error')",
    "fx_questions": """SELECT conv_id, turn, concat(CASE conv_id % 5 WHEN 0 THEN 'Thiết kế cầu dầm 30m, 3 nhịp, 2 làn xe. ' WHEN 1 THEN 'Thiết kế nhà 5 tầng 200m2, 2 cầu thang. '
  WHEN 2 THEN 'So sánh QCVN 06 và TCVN 2737. ' WHEN 3 THEN 'Tầng 1 có bao nhiêu cột? ' ELSE 'Xin chào. ' END, text) AS question FROM conversations WHERE role = 'user'""",
    "fx_files": "SELECT page_id AS file_id, page_id % 20 AS doc_id, concat('f', CAST(page_id AS STRING), CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.html' END) AS file_name, length(html) AS n_chars, html FROM pages",
    "fx_classifies": "SELECT DISTINCT l_orderkey AS std_id, l_linenumber AS req_no, concat('F', CAST(1 + l_partkey % 5 AS STRING)) AS building_type FROM lineitem WHERE l_suppkey % 3 = 0",
    "fx_materials": "SELECT p_partkey AS req_id, p_type AS material, p_retailprice AS unit_weight, 'kg/m³' AS unit, p_partkey % 50 AS std_id FROM part",
    "fx_axes": """SELECT concat('M', CAST(o_orderkey AS STRING)) AS model, CASE n_nationkey % 2 WHEN 0 THEN 'U' ELSE 'V' END AS axis,
  CASE n_nationkey % 2 WHEN 0 THEN CAST(n_nationkey * 3 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS ax0, CASE n_nationkey % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(n_nationkey * 2 AS DOUBLE) END AS ay0,
  CASE n_nationkey % 2 WHEN 0 THEN CAST(n_nationkey * 3 AS DOUBLE) ELSE CAST(41 AS DOUBLE) END AS ax1, CASE n_nationkey % 2 WHEN 0 THEN CAST(41 AS DOUBLE) ELSE CAST(n_nationkey * 2 AS DOUBLE) END AS ay1
FROM orders CROSS JOIN nation WHERE o_orderkey < 50""",
    "fx_lots": "SELECT c_custkey AS lot_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 14 AS DOUBLE) END AS street_width_m, CAST(4 + c_custkey % 5 AS DOUBLE) AS width_m, CAST(12 + c_custkey % 10 AS DOUBLE) AS depth_m FROM customer",
    "fx_rooms": f"""SELECT l_orderkey AS program, concat('r', CAST(ordinal AS STRING)) AS room_id, CASE WHEN ordinal > 1 AND l_partkey % 4 <> 0 THEN concat('r', CAST(ordinal - 1 AS STRING)) END AS adjacent_to,
  CASE l_partkey % 4 WHEN 0 THEN 'san' WHEN 1 THEN 'bep' WHEN 2 THEN 'ngu' ELSE 'wc' END AS kind, CAST(4 + l_quantity AS DOUBLE) AS target_area_m2
FROM (SELECT l_orderkey, l_partkey, l_quantity, {_ORDERED_ITEMS}) t""",
    "fx_catalog": """SELECT o_orderkey AS id, concat(CAST(o_orderkey % 40 AS STRING), '/', CAST(year(o_orderdate) AS STRING), '/TT-BXD') AS doc_num,
  CASE o_orderkey % 5 WHEN 0 THEN concat('Thông tư ban hành QCVN 0', CAST(1 + o_orderkey % 9 AS STRING), ':', CAST(year(o_orderdate) AS STRING), '/BXD về nhà ở')
    WHEN 1 THEN 'Quy chuẩn kỹ thuật quốc gia về công trình' WHEN 2 THEN 'Sửa đổi 1:2021 QCXDVN 05:2008/BXD và QCVN 06:2022/BXD, QCXDVN 05:2008/BXD'
    WHEN 3 THEN 'Tiêu chuẩn TCVN 2737' ELSE 'Nghị định về xây dựng' END AS title,
  CASE WHEN o_custkey % 7 = 0 THEN 'Bản dịch' WHEN o_custkey % 7 = 1 THEN 'Văn bản hợp nhất' ELSE 'Thông tư' END AS doc_type, CAST(o_orderdate AS STRING) AS issue_date,
  CASE o_orderkey % 7 WHEN 0 THEN 'Còn hiệu lực' WHEN 1 THEN 'Hết hiệu lực toàn bộ' WHEN 2 THEN 'hết hiệu lực một phần' WHEN 3 THEN 'Chưa có hiệu lực' WHEN 4 THEN 'Ngưng hiệu lực' WHEN 5 THEN 'khác' ELSE NULL END AS eff_status,
  CAST(floor(o_totalprice) AS BIGINT) % 20000 AS html_chars, CAST(o_custkey % 15000 AS BIGINT) AS text_chars, CASE o_custkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'pdf' ELSE 'docx' END AS kind, o_custkey % 5 = 0 AS scanned,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('QCVN_07-', CAST(1 + o_orderkey % 9 AS STRING), '.docx') ELSE 'van_ban.docx' END AS file_name FROM orders""",
    "fx_clauses": """SELECT std_id AS doc_id, CAST(ordinal * 2 AS BIGINT) AS line_no, concat(article_number, ' Quy định về lối đi số ', CAST(q AS STRING), CASE WHEN q % 2 = 0 THEN '.' ELSE '' END) AS line FROM fx_articles
UNION ALL SELECT std_id AS doc_id, CAST(ordinal * 2 + 1 AS BIGINT) AS line_no, CASE q % 5 WHEN 0 THEN concat('Điều ', CAST(q AS STRING), '. Phạm vi') WHEN 1 THEN concat(CAST(q AS STRING), '.5 m chiều cao') WHEN 2 THEN 'a) mục nhỏ' WHEN 3 THEN 'phần tiếp theo của câu' ELSE 'PHỤ LỤC A' END AS line FROM fx_articles""",
    "fx_tree": f"""WITH k AS (SELECT std_id, n, q, p, CAST(1 + (n - 1) % 2 AS STRING) AS j, CAST((n + 1 - (n - 1) % 2) / 2 AS INT) AS c, count(*) OVER (PARTITION BY std_id) AS items FROM (SELECT l_orderkey AS std_id, CAST(l_quantity AS INT) AS q, l_partkey AS p, CAST(ordinal AS INT) AS n FROM (SELECT l_orderkey, l_quantity, l_partkey, {_ORDERED_ITEMS}) x) y)
SELECT std_id, n, q, p, j, c, items, concat(CAST(c AS STRING), '.', j) AS s FROM k""",
    "fx_tree_lines": """SELECT std_id AS doc_id, CAST(1 AS BIGINT) AS line_no, concat('Quyết định số ', CAST(std_id AS STRING)) AS line FROM fx_tree WHERE n = 1
UNION ALL SELECT std_id, CAST(n * 20 AS BIGINT), concat('Chương ', CAST(c AS STRING), CASE WHEN c % 2 = 0 THEN '. YÊU CẦU ' ELSE ' QUY ĐỊNH ' END, CAST(c AS STRING)) FROM fx_tree WHERE j = '1' AND c % 3 > 0
UNION ALL SELECT std_id, CAST(n * 20 + 1 AS BIGINT), '(quy định)' FROM fx_tree WHERE j = '1' AND c % 3 = 1
UNION ALL SELECT std_id, CAST(n * 20 + 2 AS BIGINT), concat('Thân chương ', CAST(q AS STRING), '.') FROM fx_tree WHERE j = '1' AND c % 3 > 0
UNION ALL SELECT std_id, CAST(n * 20 + 3 AS BIGINT), concat(s, ' Tiêu đề mục ', CAST(q AS STRING)) FROM fx_tree
UNION ALL SELECT std_id, CAST(n * 20 + 4 AS BIGINT), concat(s, '.1 Nội dung ', CAST(p AS STRING), '.') FROM fx_tree
UNION ALL SELECT std_id, CAST(n * 20 + 5 AS BIGINT), 'câu sau nối' FROM fx_tree
UNION ALL SELECT std_id, CAST(n * 20 + 6 AS BIGINT), 'dòng này.' FROM fx_tree
UNION ALL SELECT std_id, CAST(n * 20 + 7 AS BIGINT), concat(s, '.1.1 Chi tiết ', CAST(q AS STRING), '.') FROM fx_tree WHERE p % 2 = 0
UNION ALL SELECT std_id, CAST(n * 20 + 8 AS BIGINT), concat(s, '.2 Mục hai ', CAST(q AS STRING), '.') FROM fx_tree WHERE p % 3 = 0
UNION ALL SELECT std_id, CAST(n * 20 + 10 AS BIGINT), 'PHỤ LỤC C (tham khảo)' FROM fx_tree WHERE n = items AND p % 5 > 0
UNION ALL SELECT std_id, CAST(n * 20 + 11 AS BIGINT), 'CÁC HÌNH MINH HỌA' FROM fx_tree WHERE n = items AND p % 5 > 0
UNION ALL SELECT std_id, CAST(n * 20 + 12 AS BIGINT), concat('Hình ', CAST(p AS STRING), '.') FROM fx_tree WHERE n = items AND p % 5 > 0""",
}

#: This fixture needs a form of its own for each engine.
LINES_SPARK = r"SELECT doc_id, CAST(pos DIV 20 AS INT) AS page, CAST(pos AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line"
LINES_ORACLE = "SELECT doc_id, CAST((i - 1) // 20 AS INT) AS page, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d, generate_series(1, len(lines)) g(i)"

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL text over the given tables."""
    for name in _TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a fixture.  Of another one that its text names several times the columns that it names are stored, so that its windows run once."""
    text = LINES_SPARK if name == "fx_lines" else FIXTURES[name]
    for other in FIXTURES:
        uses = len(re.findall(rf"\b{other}\b", text))
        if uses:
            rows = fixture(spark, sf_dir, other)
            if uses > 1:
                rows = stored(rows.select(*[c for c in rows.columns if re.search(rf"\b{c}\b", text)]), other)
            rows.createOrReplaceTempView(other)
    return sql(spark, sf_dir, text)


def oracle(text: str) -> str:
    """The SQL text with the fixtures that it names in front."""
    used = text + "".join(FIXTURES[n] for n in ("fx_clauses", "fx_tree_lines") if n in text)
    names = [n for n in (*FIXTURES, "fx_lines") if re.search(rf"\b{n}\b", used)]
    views = [f"{n} AS ({LINES_ORACLE if n == 'fx_lines' else FIXTURES[n]})" for n in names]
    text = text.strip()
    if not views:
        return text
    found = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.IGNORECASE)
    if not found:
        return f"WITH {', '.join(views)} {text}"
    return f"WITH {found[1] or ''}{', '.join(views)}, {text[found.end() :]}"


def query(name: str, expected: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that gives its rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if expected:
            ORACLES[name] = oracle(expected)
        return f

    return register
