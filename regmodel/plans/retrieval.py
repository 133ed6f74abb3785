"""Queries of routing and evidence assembly (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import models, retrieval
from .base import fixture, query, table


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_PLAIN = reduce(lambda t, w: f"replace({t}, '{w}', '')", retrieval.STAIR_WORDS, "lower(question)")
_DESIGN = f"{_any('lower(question)', retrieval.DESIGN_WORDS)} AND ({_any('lower(question)', retrieval.SPEC_WORDS)} OR {_any(_PLAIN, retrieval.BRIDGE_WORDS)})"
_ROUTED = f"SELECT conv_id, turn, question, CASE conv_id % 9 WHEN 7 THEN 'ifc_query' WHEN 8 THEN 'design_building' ELSE CASE WHEN {_DESIGN} THEN 'design_building' ELSE 'qcvn_search' END END AS tool, {_any(_PLAIN, retrieval.BRIDGE_WORDS)} AS is_bridge FROM fx_questions"


def _routed(spark, d):
    q = fixture(spark, d, "fx_questions")
    mode = F.when(q["conv_id"] % 9 == 7, "analyze").when(q["conv_id"] % 9 == 8, "design")
    return retrieval.route_questions(q.withColumn("mode", mode), "question", "mode")


@query("k1_route_questions", f"SELECT conv_id, turn, tool, is_bridge FROM ({_ROUTED}) t")
def k1(spark, d):
    return _routed(spark, d).select("conv_id", "turn", "tool", "is_bridge")


_CX, _CM = _any("lower(question)", retrieval.COMPLEX_WORDS), _any("lower(question)", retrieval.COMPLIANCE_WORDS)


@query("k2_tool_plan", f"""WITH r AS ({_ROUTED}) SELECT conv_id, turn, tool AS step FROM r UNION ALL SELECT conv_id, turn, 'graph_reasoning' FROM r WHERE tool = 'qcvn_search' AND {_CX}
UNION ALL SELECT conv_id, turn, 'cross_reference' FROM r WHERE tool = 'qcvn_search' AND {_CX} AND len(regexp_extract_all(lower(question), 'qcvn\\s*\\d+|tcvn\\s*\\d+')) >= 2 UNION ALL SELECT conv_id, turn, 'qcvn_search' FROM r WHERE tool = 'ifc_query' AND {_CM}""")
def k2(spark, d):
    return retrieval.tool_plan(_routed(spark, d), "question").select("conv_id", "turn", "step")


_HITS = """SELECT query_id, source, ordinal, text, score FROM (
 SELECT conv_id AS query_id, 'topic' AS source, turn AS ordinal, text, 0.85 AS score FROM conversations WHERE turn % 3 = 0
 UNION ALL SELECT conv_id, 'building_type', turn, text, 0.9 FROM conversations WHERE turn % 3 = 1
 UNION ALL SELECT conv_id, 'vector', turn, text, CAST(length(text) % 97 AS DOUBLE) / 100 FROM conversations) t"""


def _hits(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ordinal"), "text", ((F.length("text") % 97).cast("double") / 100).alias("score"))
    return retrieval.candidates({"topic": c.where("ordinal % 3 = 0"), "building_type": c.where("ordinal % 3 = 1"), "vector": c})


@query("k3_candidates", f"SELECT query_id, source, ordinal, score FROM ({_HITS}) h")
def k3(spark, d):
    return _hits(spark, d).drop("text")


@query("k3_hit_texts", """SELECT 'article' AS kind, concat(CAST(a.std_id AS STRING), '-', CAST(ordinal AS STRING)) AS key, concat('[', standard_code, '] Điều ', article_number, ': ', title, chr(10), content, CASE WHEN q % 2 = 0 THEN concat(chr(10), chr(10), 'Yêu cầu: ', CAST(q AS STRING), ' mm') ELSE '' END) AS text FROM fx_articles a JOIN fx_standards USING (std_id)
UNION ALL SELECT 'material', CAST(req_id AS STRING), concat('[', CAST(std_id AS STRING), '] Vật liệu: ', material, chr(10), 'Trọng lượng riêng: ', CAST(unit_weight AS STRING), ' ', unit, CASE WHEN req_id % 2 = 0 THEN concat(chr(10), 'r', CAST(req_id AS STRING)) ELSE '' END) FROM fx_materials WHERE std_id % 3 > 0
UNION ALL SELECT 'summary', model, concat('Tổng quan công trình: ', model, chr(10), 'Dự án: ', chr(10), string_agg(concat('  - ', ifc_type, ': ', CAST(n AS STRING), chr(10)), '' ORDER BY ifc_type)) FROM (SELECT model, ifc_type, count(*) AS n FROM fx_elements GROUP BY ALL) c GROUP BY model""")
def k3b(spark, d):
    """Texts of articles with and without a requirement, of materials with a standard, and of buildings."""
    text = lambda c: F.col(c).cast("string")
    a = fixture(spark, d, "fx_articles").join(fixture(spark, d, "fx_standards").select("std_id", "standard_code"), "std_id")
    a = a.withColumn("requirement", F.when(F.col("q") % 2 == 0, F.concat(text("q"), F.lit(" mm")))).select(F.lit("article").alias("kind"), F.concat_ws("-", "std_id", "ordinal").alias("key"), retrieval.article_text("requirement").alias("text"))
    m = fixture(spark, d, "fx_materials").withColumns({"standard_code": F.when(F.col("std_id") % 3 > 0, text("std_id")), "requirement": F.when(F.col("req_id") % 2 == 0, F.concat(F.lit("r"), text("req_id")))})
    m = m.select(F.lit("material").alias("kind"), text("req_id").alias("key"), retrieval.material_text().alias("text")).where("text IS NOT NULL")
    b = models.element_counts(fixture(spark, d, "fx_elements")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct(F.col("ifc_type").alias("class"), "n"))).alias("counts"))
    b = b.withColumns({"building": F.col("model"), "project": F.lit("")}).select(F.lit("summary").alias("kind"), F.col("model").alias("key"), retrieval.summary_text().alias("text"))
    return a.unionByName(m).unionByName(b)


@query("k3_keyword_hits", """WITH k AS (SELECT query_id, pos, keyword FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM (SELECT conv_id AS query_id, CAST(i - 1 AS INT) AS pos, ts[i] AS keyword FROM (SELECT conv_id, string_split_regex(lower(text), '[^\\pL\\pN]+') AS ts FROM conversations WHERE turn = 0) c, generate_series(1, len(ts)) g(i)) x WHERE length(keyword) >= 6) y WHERE r <= 3),
w AS (SELECT DISTINCT keyword AS term FROM k), s AS (SELECT doc_id, source, lang, text, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '') AS ts FROM documents),
g AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM s), h AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM s),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM h WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT term, doc_id AS key, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM tf JOIN df USING (term), g),
f AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, key) AS rank FROM r)
SELECT query_id, pos, key, rank, md5(concat('[', source, '] Điều ', CAST(key AS STRING), ': ', lang, chr(10), text)) AS text_md5 FROM k JOIN f ON term = keyword JOIN s ON doc_id = key WHERE rank <= 3""")
def k3c(spark, d):
    """Three hits for each of the first three long words of each conversation."""
    words = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("pos", "keyword"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("standard_code"), F.col("doc_id").alias("article_number"), F.col("lang").alias("title"), F.col("text").alias("content"))
    hits = retrieval.keyword_hits(docs, words.where(F.length("keyword") >= 6))
    return hits.select("query_id", "pos", "key", "rank", F.md5("text").alias("text_md5"))


_MERGED = f"SELECT *, CASE WHEN source = 'vector' THEN 1 ELSE 0 END AS p FROM ({_HITS}) h QUALIFY row_number() OVER (PARTITION BY query_id, left(text, 200) ORDER BY CASE WHEN source = 'vector' THEN 1 ELSE 0 END, ordinal) = 1"


def _merged(spark, d):
    return retrieval.merge_candidates(_hits(spark, d).withColumn("priority", (F.col("source") == "vector").cast("int")))


@query("k4_merge_candidates", f"SELECT query_id, source, ordinal, score FROM ({_MERGED}) m")
def k4(spark, d):
    return _merged(spark, d).select("query_id", "source", "ordinal", "score")


_RANKED = f"SELECT * FROM (SELECT query_id, source, ordinal, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM ({_MERGED}) m) r WHERE rank <= 20"


def _ranked(spark, d):
    return retrieval.rank_candidates(_merged(spark, d))


@query("k5_rank_candidates", f"SELECT query_id, ordinal, score, rank FROM ({_RANKED}) t")
def k5(spark, d):
    return _ranked(spark, d).select("query_id", "ordinal", "score", "rank")


@query("k6_apply_rerank", f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({_RANKED}) t), o AS (SELECT *, CASE WHEN n <= 2 THEN rank WHEN query_id % 3 = 0 THEN CASE rank WHEN 2 THEN 1 WHEN 1 THEN 2 END ELSE rank END AS k FROM r)
SELECT query_id, ordinal, rank, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, rank) AS new_rank FROM o WHERE k IS NOT NULL) t WHERE n <= 2 OR new_rank <= 2""")
def k6(spark, d):
    r = _ranked(spark, d)
    lists = r.select("query_id").distinct().withColumn("ranking", F.when(F.col("query_id") % 3 == 0, "1, 0, 1, 99, x").otherwise("none"))
    return retrieval.apply_rerank(r, lists, 2).select("query_id", "ordinal", "rank", "new_rank")


@query("k7_build_context", f"SELECT query_id, string_agg(concat('[', rank, '] (', source, ', ', ordinal, ') ', left(text, 100)), chr(10) || chr(10) ORDER BY rank) AS context FROM ({_RANKED}) t GROUP BY query_id")
def k7(spark, d):
    r = _ranked(spark, d).withColumns({"standard_code": F.col("source"), "article_number": F.col("ordinal").cast("string")})
    return retrieval.build_context(r, 100)


@query("k8_citations", f"SELECT query_id, count(*) AS n, string_agg(concat(rank, ':', left(text, 200)), '|' ORDER BY rank) AS previews FROM ({_RANKED}) t WHERE rank <= 5 GROUP BY query_id")
def k8(spark, d):
    r = _ranked(spark, d).withColumns({"standard_code": F.lit(None).cast("string"), "article_number": F.lit(None).cast("string")})
    c = retrieval.citations(r)
    return c.select("query_id", F.size("citations").cast("long").alias("n"), F.array_join(F.transform("citations", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["text_preview"])), "|").alias("previews"))


@query("k9_parse_model_json", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE event_type END AS intent, CASE event_id % 3 WHEN 2 THEN NULL ELSE user_id END AS user_id FROM events")
def k9(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit('{"intent":"'), F.col("event_type"), F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, body).otherwise(F.concat(F.lit("xin lỗi "), body))
    return retrieval.parse_model_json(e.withColumn("raw", text), "raw", "intent string, user_id long").select("event_id", "parsed.intent", "parsed.user_id")


@query("k10_score_confidence", """WITH s AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN (event_id % 11) / 11 END AS a, (event_id % 13) / 13 AS b, (event_id % 7) / 7 AS c, (user_id % 9) / 9 AS e FROM events),
t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.85 WHEN event_id % 10 = 1 THEN 0.7 ELSE round_even(least(greatest(coalesce(a, 0.5) * 0.35::DOUBLE + b * 0.2::DOUBLE + c * 0.25::DOUBLE + e * 0.2::DOUBLE, 0), 1), 2) END AS confidence, round_even(least(greatest(coalesce(a, 0.5) * 0.35::DOUBLE + b * 0.2::DOUBLE + c * 0.25::DOUBLE + e * 0.2::DOUBLE, 0), 1), 2) < 0.4 AND event_id % 10 > 1 AS should_retry FROM s)
SELECT event_id, confidence, should_retry, CASE WHEN confidence >= 0.85 THEN 'Rất tin cậy' WHEN confidence >= 0.7 THEN 'Tin cậy' WHEN confidence >= 0.5 THEN 'Trung bình' WHEN confidence >= 0.3 THEN 'Cần xem xét' ELSE 'Độ tin cậy thấp' END AS label FROM t""")
def k10(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(i % 7 > 0, (i % 11) / 11).alias("relevance"), ((i % 13) / 13).alias("citations"), ((i % 7) / 7).alias("completeness"), ((F.col("user_id") % 9) / 9).alias("accuracy"),
        F.when(i % 10 == 0, "general_chat").otherwise("qcvn").alias("intent"), F.lit("x" * 60).alias("response"), (i % 10 == 1).alias("bad"),
    )
    return retrieval.score_confidence(e, "bad").select("event_id", "confidence", "should_retry", "label")
