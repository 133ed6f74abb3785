"""Queries of vector and graph tables (E, F)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import clauses, kgraph, vectors
from .base import fixture, query, table


# --- E --------------------------------------------------------------------------------------------------------------
def _points(spark, d):
    return table(spark, d, "embeddings")


@query("e1_embed")
def e1(spark, d):
    rows = vectors.embed(table(spark, d, "documents").select("doc_id", "text"), "text", dim=64)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm2"))


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CASE WHEN std_id % 5 > 0 THEN concat('qcvn|', CAST(std_id AS STRING), '|', CAST(ordinal AS STRING)) ELSE content END))"


@query("e2_point_id", f"""SELECT source_id, source_index, text, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END, h[18:20], '-', h[21:32]) AS id
FROM (SELECT CASE WHEN std_id % 5 > 0 THEN CAST(std_id AS STRING) END AS source_id, ordinal AS source_index, content AS text, {_SHA} AS h FROM fx_articles) t""")
def e2(spark, d):
    a = fixture(spark, d, "fx_articles").select(F.when(F.col("std_id") % 5 > 0, F.col("std_id").cast("string")).alias("source_id"), F.col("ordinal").alias("source_index"), F.col("content").alias("text"))
    return vectors.point_id(a, "qcvn")


@query("e3_source_index", "SELECT std_id, ordinal, row_number() OVER (PARTITION BY std_id ORDER BY ordinal) - 1 AS source_index FROM fx_articles")
def e3(spark, d):
    return vectors.source_index(fixture(spark, d, "fx_articles"), "std_id").select("std_id", "ordinal", "source_index")


_INDEX = "SELECT concat(CAST(std_id AS STRING), '-', CAST(ordinal AS STRING)) AS id, CASE WHEN std_id % 10 > 0 THEN CAST(std_id AS STRING) END AS source_id, q AS v FROM fx_articles"


def _index(spark, d):
    return fixture(spark, d, "fx_articles").select(F.concat(F.col("std_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string")).alias("id"), F.when(F.col("std_id") % 10 > 0, F.col("std_id").cast("string")).alias("source_id"), F.col("q").alias("v"))


@query("e4_upsert_by_source", f"""WITH i AS ({_INDEX}), n AS (SELECT id, source_id, v + 1000 + 500 * CAST(v % 8 = 0 AS INT) AS v FROM i WHERE v % 4 = 0)
SELECT id, source_id, v FROM n UNION ALL SELECT id, source_id, v FROM i WHERE (source_id IS NULL OR source_id NOT IN (SELECT source_id FROM n WHERE source_id IS NOT NULL)) AND id NOT IN (SELECT id FROM n)""")
def e4(spark, d):
    i = _index(spark, d)
    new = i.where("v % 4 = 0").withColumn("ordinal", F.lit(1))
    again = new.where("v % 8 = 0").withColumns({"v": F.col("v") + 500, "ordinal": F.lit(2)})  # some points come twice, the later one counts
    return vectors.upsert_by_source(i, again.unionByName(new).withColumn("v", F.col("v") + 1000), order="ordinal")


@query("e5_prune_sources", f"WITH i AS ({_INDEX}) SELECT * FROM i WHERE source_id IN (SELECT CAST(std_id AS STRING) FROM fx_standards WHERE family % 3 = 0)")
def e5(spark, d):
    keep = fixture(spark, d, "fx_standards").where("family % 3 = 0").select(F.col("std_id").cast("string").alias("k"))
    return vectors.prune_sources(_index(spark, d), keep)


@query("e7_index_info", "SELECT count(*) AS points, count(embedding) AS vectors, count(DISTINCT label) AS sources, 'ok' AS status FROM embeddings")
def e7(spark, d):
    return vectors.index_info(_points(spark, d), "label")


# --- F --------------------------------------------------------------------------------------------------------------
def _flat(spark, d):
    a = fixture(spark, d, "fx_articles").join(fixture(spark, d, "fx_standards").select("std_id", "standard_code"), "std_id")
    return clauses.flatten_standards(a)


_EDGES = """SELECT DISTINCT 'Standard' AS src_label, standard_code AS src, 'CONTAINS' AS rel, 'Chapter' AS dst_label, concat(standard_code, '_ch', chapter_number) AS dst FROM fx_articles JOIN fx_standards USING (std_id)
UNION ALL SELECT DISTINCT 'Chapter', concat(standard_code, '_ch', substr(section_number, 1, 1)), 'HAS_SECTION', 'Section', concat(standard_code, '_sec', section_number) FROM fx_articles JOIN fx_standards USING (std_id)
UNION ALL SELECT DISTINCT 'Section', concat(standard_code, '_sec', section_number), 'HAS_ARTICLE', 'Article', concat(standard_code, '_art', article_number) FROM fx_articles JOIN fx_standards USING (std_id)
UNION ALL SELECT DISTINCT 'Article', concat(standard_code, '_art', article_number), 'SPECIFIES', 'Requirement', concat(standard_code, '_art', article_number, '_req', CAST(i AS STRING)) FROM fx_articles JOIN fx_standards USING (std_id), (VALUES (0), (1)) v(i)"""


@query("f1_build_nodes_edges", _EDGES)
def f1(spark, d):
    return kgraph.build_edges(*_flat(spark, d))


@query("f1_node_tables", f"""SELECT 'Standard' AS label, standard_code AS key, standard_name AS value FROM fx_standards
UNION ALL SELECT DISTINCT 'Chapter', concat(standard_code, '_ch', chapter_number), chapter_number FROM fx_articles JOIN fx_standards USING (std_id)
UNION ALL SELECT 'Section', concat(standard_code, '_sec', section_number), max(concat(standard_code, '_ch', chapter_number)) FROM fx_articles JOIN fx_standards USING (std_id) GROUP BY standard_code, section_number
UNION ALL SELECT 'Article', concat(standard_code, '_art', article_number), max(content) FROM fx_articles JOIN fx_standards USING (std_id) GROUP BY standard_code, article_number
UNION ALL SELECT 'Requirement', dst, src FROM ({_EDGES}) e WHERE rel = 'SPECIFIES'""")
def f1b(spark, d):
    standards, chapters, sections, articles, reqs = fixture(spark, d, "fx_standards"), *_flat(spark, d)
    # of the largest row of a key, what stands before a column decides its value, not what comes after it: that needn't be shuffled
    nodes = kgraph.build_nodes(standards.select("std_id", "standard_code", "standard_name"), chapters, sections.select("chapter_id", "section_id"), articles, reqs.select("article_id", "req_id"))
    shown = {"Standard": ("standard_code", "standard_name"), "Chapter": ("chapter_id", "chapter_number"), "Section": ("section_id", "chapter_id"), "Article": ("article_id", "content"), "Requirement": ("req_id", "article_id")}
    return functools.reduce(DataFrame.unionAll, [nodes[label].select(F.lit(label).alias("label"), F.col(key).alias("key"), F.col(value).alias("value")) for label, (key, value) in shown.items()])


@query("f2_domain_nodes", "SELECT material, arg_max(unit_weight, req_id) AS unit_weight, 'kg/m³' AS unit FROM fx_materials GROUP BY material")
def f2(spark, d):
    c = fixture(spark, d, "fx_classifies").withColumn("req_id", F.concat_ws("_", "std_id", "req_no"))
    return kgraph.domain_nodes(c, fixture(spark, d, "fx_materials"))[0]


_REFS = "SELECT std_id, supersedes_id AS target, CASE WHEN std_id % 2 = 0 THEN 'SUPERSEDES' ELSE 'RELATED_TO' END AS rel FROM fx_refs"


def _refs(spark, d):
    return fixture(spark, d, "fx_refs").select("std_id", F.col("supersedes_id").alias("target"), F.when(F.col("std_id") % 2 == 0, "SUPERSEDES").otherwise("RELATED_TO").alias("rel"))


@query("f3_reference_edges", f"WITH r AS ({_REFS}) SELECT target, CASE WHEN bool_or(rel = 'SUPERSEDES') THEN 'superseded' END AS status FROM r WHERE target NOT IN (SELECT std_id FROM fx_standards WHERE std_id % 3 > 0) GROUP BY target")
def f3(spark, d):
    return kgraph.reference_edges(fixture(spark, d, "fx_standards").where("std_id % 3 > 0"), _refs(spark, d))[0]


@query("f4_rebuild_standards", "SELECT std_id, ordinal, q FROM fx_articles WHERE std_id % 4 > 0 UNION ALL SELECT std_id, ordinal, q + 100 FROM fx_articles WHERE std_id % 4 = 0 AND ordinal = 1")
def f4(spark, d):
    a = fixture(spark, d, "fx_articles").select("std_id", "ordinal", "q")
    return kgraph.rebuild_standards(a, a.where("std_id % 4 = 0 AND ordinal = 1").withColumn("q", F.col("q") + 100), "std_id")


@query("f5_prune_standards", "SELECT std_id FROM fx_standards WHERE family % 2 = 0 OR std_id NOT IN (SELECT std_id FROM fx_articles)")
def f5(spark, d):
    s = fixture(spark, d, "fx_standards")
    return kgraph.prune_standards(s, fixture(spark, d, "fx_articles"), s.where("family % 2 = 0"), "std_id").select("std_id")


@query("f5_prune_content", f"""WITH e AS ({_EDGES}), gone AS (SELECT DISTINCT standard_code FROM fx_standards JOIN fx_articles USING (std_id) WHERE family % 2 <> 0),
lost AS (SELECT DISTINCT e.dst_label AS label, e.dst AS key FROM e JOIN gone ON split_part(e.dst, '_', 1) = gone.standard_code)
SELECT 'Standard' AS label, standard_code AS key FROM fx_standards WHERE standard_code NOT IN (SELECT standard_code FROM gone)
UNION ALL SELECT label, key FROM (SELECT DISTINCT dst_label AS label, dst AS key FROM e EXCEPT SELECT label, key FROM lost) t""")
def f5b(spark, d):
    s = fixture(spark, d, "fx_standards")
    left = kgraph.prune_content(s, *_flat(spark, d), s.where("family % 2 = 0"))
    keys = (("Standard", "standard_code"), ("Chapter", "chapter_id"), ("Section", "section_id"), ("Article", "article_id"), ("Requirement", "req_id"))
    return functools.reduce(DataFrame.unionAll, [df.select(F.lit(label).alias("label"), F.col(key).alias("key")).distinct() for df, (label, key) in zip(left, keys, strict=True)])


@query("f6_graph_stats", f"""WITH e AS ({_EDGES}) SELECT rel AS name, count(*) AS n, 'relationship' AS kind FROM e GROUP BY rel
UNION ALL SELECT l, count(*), 'label' FROM (SELECT src_label AS l, src AS k FROM e UNION SELECT dst_label, dst FROM e) t GROUP BY l""")
def f6(spark, d):
    return kgraph.graph_stats(kgraph.build_edges(*_flat(spark, d)))


@query("f7_keyword_search", """WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')) AS terms FROM benchmark),
w AS (SELECT query_id, unnest(terms) AS term FROM q), s AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '') AS ts FROM documents),
g AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM s), h AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM s),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM h WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT query_id, doc_id AS key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM tf JOIN df USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT query_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM r) t WHERE rank <= 10""")
def f7(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return kgraph.keyword_search(table(spark, d, "documents"), q).select("query_id", "key", "rank")


_TYPED = "SELECT DISTINCT concat(standard_code, '_art', article_number) AS article_id, concat(standard_code, '_art', article_number, '_req0') AS req_id, building_type FROM fx_articles JOIN fx_standards USING (std_id) JOIN fx_classifies c ON c.std_id = fx_articles.std_id AND c.req_no = fx_articles.ordinal"


def _typed(spark, d):
    a = fixture(spark, d, "fx_articles").join(fixture(spark, d, "fx_standards").select("std_id", "standard_code"), "std_id")
    c = fixture(spark, d, "fx_classifies").withColumnRenamed("req_no", "ordinal")
    return a.join(c, ["std_id", "ordinal"]).select(F.concat("standard_code", F.lit("_art"), F.col("article_number")).alias("article_id"), F.concat("standard_code", F.lit("_art"), F.col("article_number"), F.lit("_req0")).alias("req_id"), "building_type").distinct()


@query("f8_requirements_for_building_type", f"WITH t AS ({_TYPED}) SELECT building_type, standard_code, article_id, req_id FROM t JOIN (SELECT DISTINCT standard_code, concat(standard_code, '_art', article_number) AS article_id FROM fx_articles JOIN fx_standards USING (std_id)) a USING (article_id) WHERE building_type IN ('F1', 'F3')")
def f8(spark, d):
    edges = kgraph.build_edges(*_flat(spark, d)).unionByName(kgraph.edges_of(_typed(spark, d), "Requirement", "req_id", "CLASSIFIES", "BuildingType", "building_type"))
    return kgraph.requirements_for_building_type(edges, ["F1", "F3"]).select("building_type", "standard_code", "article_id", "req_id")


def _named(spark, d):
    return fixture(spark, d, "fx_articles").join(fixture(spark, d, "fx_standards").select("std_id", "standard_code", "family"), "std_id").withColumn("article_id", F.concat("standard_code", F.lit("_art"), F.col("article_number")))


@query("f9_requirements_for_topic", "SELECT a.standard_code, a.article_id, t.i AS req_no FROM (SELECT standard_code, concat(standard_code, '_art', article_number) AS article_id, content, title FROM fx_articles JOIN fx_standards USING (std_id)) a, (VALUES (0), (1)) t(i) WHERE contains(lower(title), 'lối đi 3') OR contains(lower(content), 'lối đi 3')")
def f9(spark, d):
    rows = _named(spark, d)
    reqs = clauses.extract_requirements(rows.select("article_id", "article_number", "content")).select("article_id", "req_no")
    return kgraph.requirements_for_topic(rows, reqs, "Lối đi 3").select("standard_code", "article_id", "req_no")


@query("f10_related_standards", f"""WITH r AS ({_REFS}), c AS (SELECT DISTINCT CAST(std_id AS STRING) AS std_id FROM fx_standards)
SELECT c.std_id, coalesce(string_agg(DISTINCT CAST(target AS STRING), ',' ORDER BY CAST(target AS STRING)) FILTER (rel = 'RELATED_TO'), '') AS related, coalesce(string_agg(DISTINCT CAST(target AS STRING), ',' ORDER BY CAST(target AS STRING)) FILTER (rel = 'SUPERSEDES'), '') AS superseded FROM c LEFT JOIN r ON CAST(r.std_id AS STRING) = c.std_id GROUP BY c.std_id""")
def f10(spark, d):
    codes = fixture(spark, d, "fx_standards").select(F.col("std_id").cast("string").alias("std_id"))
    refs = _refs(spark, d).select(F.col("std_id").cast("string").alias("std_id"), "rel", F.col("target").cast("string").alias("target"))
    return kgraph.related_standards(refs, codes).select("std_id", F.array_join("related", ",").alias("related"), F.array_join("superseded", ",").alias("superseded"))


@query("f11_material_properties", """SELECT m.material, m.unit_weight, CAST(e.req_id AS STRING) AS req_id, CASE WHEN e.req_id % 2 = 0 THEN concat('a', CAST(e.std_id AS STRING)) END AS article_id, CASE WHEN e.req_id % 2 = 0 AND e.std_id % 3 > 0 THEN CAST(e.std_id AS STRING) END AS standard_code
FROM (SELECT material, arg_max(unit_weight, req_id) AS unit_weight FROM fx_materials GROUP BY material) m JOIN fx_materials e ON m.material = e.material WHERE contains(lower(m.material), 'economy')""")
def f11(spark, d):
    m = fixture(spark, d, "fx_materials")
    c = fixture(spark, d, "fx_classifies").withColumn("req_id", F.concat_ws("_", "std_id", "req_no"))
    nodes, edges = kgraph.domain_nodes(c, m)
    ids = m.select("req_id", F.col("std_id").cast("string").alias("std"), *[F.concat(F.lit(k), F.col("std_id").cast("string")).alias(k) for k in "asc"])
    reached = ids.where("CAST(std AS INT) % 3 > 0")  # the articles of the others hang in the air
    own = [
        kgraph.edges_of(ids.where("req_id % 2 = 0"), "Article", "a", "SPECIFIES", "Requirement", "req_id"),
        kgraph.edges_of(ids, "Section", "s", "HAS_ARTICLE", "Article", "a"),
        kgraph.edges_of(ids, "Chapter", "c", "HAS_SECTION", "Section", "s"),
        kgraph.edges_of(reached, "Standard", "std", "CONTAINS", "Chapter", "c"),
    ]
    return kgraph.material_properties(nodes, functools.reduce(DataFrame.unionByName, own, edges), "economy").select("material", "unit_weight", "req_id", "article_id", "standard_code")


_SEE = "concat(content, ' Xem Lối đi ', CAST(q % 9 AS STRING), '.')"


@query("f12_cross_reference", f"""WITH p AS (SELECT x.standard_code AS code1, y.standard_code AS code2 FROM fx_refs JOIN fx_standards x USING (std_id) JOIN fx_standards y ON y.std_id = supersedes_id),
a AS (SELECT standard_code, concat(standard_code, '_art', article_number) AS article_id, title, {_SEE} AS content FROM fx_articles JOIN fx_standards USING (std_id)), t AS ({_TYPED}),
m AS (SELECT code1, code2, x.article_id AS article1, y.article_id AS article2 FROM p JOIN a x ON x.standard_code = code1 JOIN a y ON y.standard_code = code2 WHERE contains(x.content, y.title) OR contains(y.content, x.title)
UNION SELECT code1, code2, x.article_id, y.article_id FROM p JOIN a x ON x.standard_code = code1 JOIN a y ON y.standard_code = code2 JOIN t t1 ON t1.article_id = x.article_id JOIN t t2 ON t2.article_id = y.article_id AND t1.building_type = t2.building_type)
SELECT code1, code2, article1, article2 FROM (SELECT *, row_number() OVER (PARTITION BY code1, code2 ORDER BY article1, article2) AS k FROM m) r WHERE k <= 15""")
def f12(spark, d):
    """Every standard with the one that it supersedes; each article names another one by its title."""
    codes = fixture(spark, d, "fx_standards").select("std_id", "standard_code")
    pairs = fixture(spark, d, "fx_refs").join(codes.withColumnRenamed("standard_code", "code1"), "std_id").join(codes.select(F.col("std_id").alias("supersedes_id"), F.col("standard_code").alias("code2")), "supersedes_id")
    content = F.concat("content", F.lit(" Xem Lối đi "), (F.col("q") % 9).cast("string"), F.lit("."))
    rows = stored(_named(spark, d).select("std_id", "ordinal", "standard_code", "article_id", "title", content.alias("content")), "named-articles")
    types = rows.join(fixture(spark, d, "fx_classifies").withColumnRenamed("req_no", "ordinal"), ["std_id", "ordinal"]).select("article_id", "building_type")
    return kgraph.article_pairs(rows, types, pairs)


@query("f9_requirements_for_topics", "WITH a AS (SELECT standard_code, concat(standard_code, '_art', article_number) AS article_id, content, title FROM fx_articles JOIN fx_standards USING (std_id)), p AS (SELECT DISTINCT title AS topic FROM fx_articles) SELECT topic, standard_code, article_id, i AS req_no FROM p JOIN a ON contains(lower(title), lower(topic)) OR contains(lower(content), lower(topic)), (VALUES (0), (1)) t(i)")
def f9b(spark, d):
    """Each title as a topic."""
    rows = stored(_named(spark, d).select("standard_code", "article_id", "article_number", "title", "content"), "named-articles")  # read three times
    reqs = clauses.extract_requirements(rows.select("article_id", "article_number", "content")).select("article_id", "req_no")
    return kgraph.requirements_for_topics(rows, reqs, rows.select(F.col("title").alias("topic")).distinct()).select("topic", "standard_code", "article_id", "req_no")


@query("f13_check_unique_keys", "SELECT 'Item' AS label, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'Standard', standard_code, count(*) FROM fx_standards GROUP BY ALL HAVING count(*) > 1")
def f13(spark, d):
    items = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return kgraph.check_unique_keys({"Item": (items, "key"), "Standard": (fixture(spark, d, "fx_standards"), "standard_code")})


_CYPHER = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'MATCH (n) RETURN n' WHEN 1 THEN 'match (n) delete n return n' WHEN 2 THEN '' WHEN 3 THEN 'MATCH (n) RETURN n; MATCH (m) RETURN m'
 WHEN 4 THEN 'RETURN 1' WHEN 5 THEN 'MATCH (n:Offset) WHERE n.created = 1' WHEN 6 THEN concat('MATCH (n) RETURN ', repeat('n', 2100)) ELSE 'WITH 1 AS x SET x = 2 RETURN x' END AS q FROM events"""


@query("f14_audit_generated_queries", f"SELECT event_id, event_id % 8 = 0 AS ok, CASE event_id % 8 WHEN 1 THEN 'keyword' WHEN 2 THEN 'empty' WHEN 3 THEN 'multiple' WHEN 4 THEN 'start' WHEN 5 THEN 'no_return' WHEN 6 THEN 'too_long' WHEN 7 THEN 'keyword' END AS reason FROM ({_CYPHER}) t")
def f14(spark, d):
    from .base import sql

    return kgraph.audit_generated_queries(sql(spark, d, _CYPHER), "q").select("event_id", "ok", "reason")


@query("f15_rows_to_context", "SELECT std_id, string_agg(concat('article_number: ', article_number, chr(10), 'title: ', title), chr(10) || chr(10) ORDER BY ordinal) AS context FROM fx_articles WHERE ordinal <= 2 GROUP BY std_id")
def f15(spark, d):
    a = fixture(spark, d, "fx_articles").withColumn("note", F.lit(""))
    return kgraph.rows_to_context(a, "std_id", "ordinal", ["article_number", "note", "title"], 2)


@query("f16_citation_graph", "SELECT answer_id, src, dst FROM (SELECT std_id AS answer_id, concat('S', chapter_number) AS src, concat('art_', CAST(ordinal AS STRING)) AS dst FROM fx_articles UNION ALL SELECT a.std_id, building_type, concat('art_', CAST(ordinal AS STRING)) FROM fx_articles a JOIN (SELECT DISTINCT std_id, building_type FROM fx_classifies) c ON a.std_id = c.std_id) t")
def f16(spark, d):
    c = fixture(spark, d, "fx_articles").select(F.col("std_id").alias("answer_id"), F.col("ordinal").alias("idx"), F.concat(F.lit("S"), F.col("chapter_number")).alias("standard_code"), "article_number")
    t = fixture(spark, d, "fx_classifies").select(F.col("std_id").alias("answer_id"), "building_type")
    return kgraph.citation_graph(c, t)[1]


@query("e6_search", """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS query_id, v AS qv FROM e WHERE id % 50 = 0)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) DESC, id) AS rank FROM e, q) t WHERE rank <= 10""")
def e6(spark, d):
    p = _points(spark, d)
    key = p.columns[0]
    rows = p.select(F.col(key).alias("id"), "embedding")
    return vectors.search(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")).select("query_id", "id", "rank")
