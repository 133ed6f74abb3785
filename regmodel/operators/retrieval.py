"""Question routing, evidence assembly and answer scores over batches of questions (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kgraph import keyword_search

# The words that route a question.
DESIGN_WORDS = [
    "thiết kế", "tạo mô hình", "xây dựng mô hình", "tạo tòa nhà",
    "thiết kế tòa nhà", "thiết kế nhà", "tạo nhà", "xây nhà",
    "thiết kế cầu", "thiet ke cau", "tạo cầu",
    "design", "generate building", "generate bridge",
]
SPEC_WORDS = [
    "tầng", "m²", "m2", "diện tích", "btct", "bê tông",
    "văn phòng", "nhà ở", "chung cư", "trường học",
    "nhịp", "làn xe", "lan xe", "dầm", "dam",
    "trụ cầu", "mố cầu", "cầu dầm", "cau dam",
]
BRIDGE_WORDS = [" cầu ", " cau ", "bridge"]
STAIR_WORDS = ["cầu thang", "cau thang"]
COMPLEX_WORDS = ["so sánh", "khác nhau", "liên quan", "mối liên hệ", "tất cả", "toàn bộ", "giữa", "cùng"]
COMPLIANCE_WORDS = ["tuân thủ", "vi phạm", "quy chuẩn", "đạt", "yêu cầu"]
MODES = {"design": "design_building", "analyze": "ifc_query"}
SPECIALISTS = {"qcvn_search": "qcvn", "graph_reasoning": "qcvn", "material_check": "qcvn", "ifc_query": "bim", "design_building": "design"}
SOURCE_SCORES = {"building_type": 0.9, "topic": 0.85, "material": 0.8}
WEIGHTS = {"relevance": 0.35, "citations": 0.2, "completeness": 0.25, "accuracy": 0.2}
CONFIDENCE = [(0.85, "Rất tin cậy"), (0.7, "Tin cậy"), (0.5, "Trung bình"), (0.3, "Cần xem xét"), (None, "Độ tin cậy thấp")]


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def route_questions(df: DataFrame, col: str, mode: str | None = None, default: str = "qcvn_search") -> DataFrame:
    """K1: tool and is_bridge.  A mode decides by itself; else design words with a specification or bridge word."""
    q = F.lower(col)
    plain = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), STAIR_WORDS, q)
    bridge = has_any(plain, BRIDGE_WORDS)
    design = has_any(q, DESIGN_WORDS) & (has_any(q, SPEC_WORDS) | bridge)
    tool = F.when(design, "design_building").otherwise(default)
    if mode:
        given = reduce(lambda c, kv: F.when(F.col(mode) == kv[0], kv[1]).otherwise(c), MODES.items(), F.lit(None).cast("string"))
        tool = F.coalesce(given, tool)
    return df.withColumn("tool", tool).withColumn("is_bridge", bridge)


def tool_plan(df: DataFrame, col: str, tool: str = "tool") -> DataFrame:
    """K2: a row for each step of a question: the specialist's own step, graph reasoning for complex questions, a cross reference from two
    codes on, regulations for compliance questions to the model specialist; each step once."""
    q, t = F.lower(col), F.col(tool)
    who = F.create_map(*[F.lit(x) for p in SPECIALISTS.items() for x in p])[t]
    codes = F.size(F.regexp_extract_all(q, F.lit(r"(qcvn\s*\d+|tcvn\s*\d+)"), 1))
    steps = F.array_compact(F.array(
        t, F.when((who == "qcvn") & (t != "qcvn_search"), "qcvn_search"), F.when((who == "qcvn") & has_any(q, COMPLEX_WORDS), "graph_reasoning"),
        F.when((who == "qcvn") & has_any(q, COMPLEX_WORDS) & (codes >= 2), "cross_reference"), F.when((who == "bim") & has_any(q, COMPLIANCE_WORDS), "qcvn_search"),
    ))
    return df.select("*", who.alias("specialist"), F.posexplode(F.array_distinct(steps)).alias("step_no", "step"))


def candidates(hits: dict[str, DataFrame], scores: dict[str, float] = SOURCE_SCORES) -> DataFrame:
    """K3: hits of all sources (query_id, ordinal, text; their own score where the source has no fixed one) in one table."""
    one = lambda name, df: df.select("query_id", F.lit(name).alias("source"), "ordinal", "text", (F.lit(scores[name]) if name in scores else F.col("score")).cast("double").alias("score"))
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in hits.items()])


def _said(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# Fixed formats: the texts of hits in the graph.
def article_text(requirement: str | None = None) -> Column:
    """K3: the text of an article (standard_code, article_number, title, content), with a requirement where that is set."""
    text = F.concat(F.lit("["), _said("standard_code"), F.lit("] Điều "), _said("article_number"), F.lit(": "), _said("title"), F.lit("\n"), _said("content"))
    return text if requirement is None else F.concat(text, F.when(_said(requirement) != "", F.concat(F.lit("\n\nYêu cầu: "), _said(requirement))).otherwise(""))


def material_text(requirement: str = "requirement") -> Column:
    """K3: the text of a material (standard_code, material, unit_weight, unit), with a requirement where that is set; null without a standard."""
    text = F.concat(F.lit("["), _said("standard_code"), F.lit("] Vật liệu: "), _said("material"), F.lit("\nTrọng lượng riêng: "), _said("unit_weight"), F.lit(" "), _said("unit"))
    return F.when(_said("standard_code") != "", F.concat(text, F.when(_said(requirement) != "", F.concat(F.lit("\n"), _said(requirement))).otherwise("")))


def summary_text(counts: str = "counts") -> Column:
    """K3: the text of a building (building, project, and a list of class and n)."""
    lines = F.transform(counts, lambda x: F.concat(F.lit("  - "), x["class"], F.lit(": "), x["n"].cast("string"), F.lit("\n")))
    return F.concat(F.lit("Tổng quan công trình: "), _said("building"), F.lit("\nDự án: "), _said("project"), F.lit("\n"), F.array_join(lines, ""))


def keyword_hits(articles: DataFrame, keywords: DataFrame, per_query: int = 3, per_keyword: int = 3) -> DataFrame:
    """K3: for the first keywords of each query (query_id, pos, keyword) the first articles of the keyword search: query_id, pos, key, rank, text,
    score.  Each distinct keyword is searched once.  articles: key, standard_code, article_number, title, content."""
    by = Window.partitionBy("query_id").orderBy("pos")
    first = keywords.withColumn("r_", F.row_number().over(by)).where(F.col("r_") <= per_query).drop("r_")
    asked = first.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("query")).distinct()
    hits = keyword_search(articles, asked, per_keyword, "key", "content").withColumnRenamed("query_id", "keyword")
    return first.join(hits, "keyword").join(articles.select("key", article_text().alias("text")), "key").select("query_id", "pos", "key", "rank", "text", "score")


def merge_candidates(df: DataFrame, priority: str = "priority", ordinal: str = "ordinal", chars: int = 200) -> DataFrame:
    """K4: of candidates with the same first characters the one of the smallest priority, then ordinal."""
    by = Window.partitionBy("query_id", F.substring("text", 1, chars)).orderBy(priority, ordinal)
    return df.withColumn("r_", F.row_number().over(by)).where("r_ = 1").drop("r_")


def rank_candidates(df: DataFrame, k: int = 20, ordinal: str = "ordinal") -> DataFrame:
    """K5: rank by score (missing: 0), ties by ordinal, the first k."""
    by = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), ordinal)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def apply_rerank(df: DataFrame, rankings: DataFrame, k: int = 5) -> DataFrame:
    """K6: candidates (query_id, rank from 1) in the order of a list of indices from 0 ("2, 0, 7"): with at most k all stay; else valid,
    distinct indices in order; if there are none, the first k.  rankings: query_id, ranking."""
    sized = df.withColumn("n_", F.count("*").over(Window.partitionBy("query_id")))
    listed = rankings.select("query_id", F.posexplode(F.split("ranking", r"[,\s]+")).alias("pos", "x")).withColumn("rank", F.expr("try_cast(x AS INT)") + 1)
    first = listed.where("rank IS NOT NULL").groupBy("query_id", "rank").agg(F.min("pos").alias("pos"))
    j = sized.join(first, ["query_id", "rank"], "left")
    any_ = F.count("pos").over(Window.partitionBy("query_id")) > 0
    order = F.when(F.col("n_") <= k, F.col("rank")).when(any_, F.col("pos")).otherwise(F.col("rank"))
    j = j.withColumn("order_", order).where("order_ IS NOT NULL")
    small = F.col("n_") <= k
    by = Window.partitionBy("query_id").orderBy("order_", "rank")
    return j.withColumn("new_rank", F.row_number().over(by)).where(small | (F.col("new_rank") <= k)).drop("n_", "order_", "pos")


def build_context(df: DataFrame, chars: int = 1600) -> DataFrame:
    """K7: by question, "[i] (source, article) text" in order of rank."""
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("standard_code", F.lit("")), F.lit(", "), F.coalesce("article_number", F.lit("")), F.lit(") "), F.substring("text", 1, chars))
    return df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def citations(df: DataFrame, k: int = 5, chars: int = 200) -> DataFrame:
    """K8: by question, the first k documents as an array of structs."""
    row = F.struct("rank", "standard_code", "article_number", F.substring("text", 1, chars).alias("text_preview"), F.coalesce("source", F.lit("vector")).alias("source"))
    return df.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("citations"))


def parse_model_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """K9: a model's JSON without its code fence, as a struct; null where it can't be read."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(col)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    parsed = F.from_json(F.when(bare.startswith("{"), bare), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("p_", parsed).withColumn("parsed", F.when(F.col("p_._bad").isNull(), F.col("p_").dropFields("_bad"))).drop("p_")


def confidence_label(confidence: Column) -> Column:
    out = F.lit(CONFIDENCE[-1][1])
    for least, label in reversed(CONFIDENCE[:-1]):
        out = F.when(confidence >= least, label).otherwise(out)
    return out


def score_confidence(df: DataFrame, failed: str | None = None) -> DataFrame:
    """Confidence, should_retry and label from the four scores (missing: 0.5); 0.85 for general chat and answers under 50 characters,
    0.7 for a failed evaluation.  df: intent, response and the scores."""
    total = reduce(Column.__add__, [F.coalesce(F.col(c).cast("double"), F.lit(0.5)) * w for c, w in WEIGHTS.items()])
    own = F.bround(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 2)
    plain = (F.col("intent") == "general_chat") | (F.length("response") < 50)
    bad = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    value = F.when(plain, 0.85).when(bad, 0.7).otherwise(own)
    return df.withColumn("confidence", value).withColumn("should_retry", ~plain & ~bad & (own < 0.4)).withColumn("label", confidence_label(F.col("confidence")))
