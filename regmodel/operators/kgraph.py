"""Knowledge-graph tables and fixed-depth traversals (F).

A node table for each label, one edge table (src_label, src, rel, dst_label, dst).  Every traversal is a chain of equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import matching

#: Keywords that a read-only query must not hold, and how it may start.
BLOCKED = [
    "DELETE", "DETACH", "CREATE", "MERGE", "SET",
    "REMOVE", "DROP", "LOAD", "CSV", "FOREACH",
    "USING", "PERIODIC", "COMMIT",
    "APOC", "DBMS", "GRANT", "DENY", "REVOKE",
]
STARTS = ["MATCH", "WITH", "OPTIONAL", "UNWIND", "CALL DB.INDEX.FULLTEXT"]

def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the one of the largest ordinal."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("rank_ = 1").drop("rank_")


def edges_of(df: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str) -> DataFrame:
    ends = df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).distinct()  # labels are no part of what is shuffled
    return ends.select(F.lit(src_label).alias("src_label"), "src", F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), "dst")


def build_edges(chapters: DataFrame, sections: DataFrame, articles: DataFrame, reqs: DataFrame) -> DataFrame:
    """the edges of the flattened standards, each once."""
    return reduce(
        DataFrame.unionByName,
        [
            edges_of(chapters, "Standard", "standard_code", "CONTAINS", "Chapter", "chapter_id"),
            edges_of(sections, "Chapter", "chapter_id", "HAS_SECTION", "Section", "section_id"),
            edges_of(articles, "Section", "section_id", "HAS_ARTICLE", "Article", "article_id"),
            edges_of(reqs, "Article", "article_id", "SPECIFIES", "Requirement", "req_id"),
        ],
    )


def build_nodes(standards: DataFrame, chapters: DataFrame, sections: DataFrame, articles: DataFrame, reqs: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """a node table for each label, one row a key.  Rows written later replace the properties of earlier ones: the largest
    ``order`` wins where a table has that column, else the largest row."""
    tables = {"Standard": (standards, "standard_code"), "Chapter": (chapters, "chapter_id"), "Section": (sections, "section_id"), "Article": (articles, "article_id"), "Requirement": (reqs, "req_id")}

    def nodes(df: DataFrame, key: str) -> DataFrame:
        if order in df.columns:
            return last_wins(df, [key], order).drop(order)
        # dealt by key first: most keys come once, so sorting every task's rows to aggregate them in part gains nothing
        return df.repartition(key).groupBy(key).agg(F.max(F.struct(*df.columns)).alias("n_")).select("n_.*")

    return {label: nodes(*table) for label, table in tables.items()}


def domain_nodes(classifies: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """material nodes (the last unit weight wins) and the edges CLASSIFIES and FOR_MATERIAL."""
    nodes = last_wins(materials, ["material"], "req_id").select("material", "unit_weight", "unit")
    edges = edges_of(classifies, "Requirement", "req_id", "CLASSIFIES", "BuildingType", "building_type").unionByName(edges_of(materials, "Requirement", "req_id", "FOR_MATERIAL", "Material", "material"))
    return nodes, edges


def reference_edges(standards: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placeholder nodes, edges).  refs: std_id, target, rel.  A superseded standard that is not there becomes a
    placeholder of status "superseded", a related one a placeholder without status; nothing refers to itself."""
    refs = refs.where("target <> std_id")
    missing = refs.join(standards.select(F.col("std_id").alias("target")), "target", "left_anti")
    nodes = missing.groupBy("target").agg(F.max(F.when(F.col("rel") == "SUPERSEDES", "superseded")).alias("status"))
    return nodes, refs.select("std_id", "rel", "target").distinct()


def rebuild_standards(graph: DataFrame, new: DataFrame, key: str = "standard_code") -> DataFrame:
    """rows of the standards in ``new`` are replaced."""
    return graph.join(new.select(key).distinct(), key, "left_anti").select(*graph.columns).unionByName(new.select(*graph.columns))


def prune_standards(standards: DataFrame, chapters: DataFrame, keep: DataFrame, key: str = "standard_code") -> DataFrame:
    """standards that own chapters and are not kept go; placeholders stay.  An empty keep is an error."""
    if keep.isEmpty():
        raise ValueError("nothing to keep: the graph would be emptied")
    owned = chapters.select(key).distinct().join(keep.select(key), key, "left_anti")
    return standards.join(owned, key, "left_anti")


def prune_content(standards: DataFrame, chapters: DataFrame, sections: DataFrame, articles: DataFrame, reqs: DataFrame, keep: DataFrame, key: str = "standard_code") -> tuple[DataFrame, ...]:
    """``prune_standards`` and what the standards hold: chapters, sections, articles and requirements go with them.  Each level is
    one equi-join with the keys that the level above lost, which are stored, so that no level goes through all above it."""
    left = [prune_standards(standards, chapters, keep, key)]
    gone = chapters.select(key).distinct().join(keep.select(key), key, "left_anti")
    for level, parent, own in ((chapters, key, "chapter_id"), (sections, "chapter_id", "section_id"), (articles, "section_id", "article_id"), (reqs, "article_id", "req_id")):
        left.append(level.join(gone, parent, "left_anti").select(*level.columns))
        if own != "req_id":  # nothing hangs on requirements
            gone = stored(level.join(gone, parent, "left_semi").select(own).distinct(), "gone")
    return tuple(left)


def graph_stats(edges: DataFrame) -> DataFrame:
    """count by relationship and by label of the ends, the largest first."""
    edges = stored(edges, "edges")  # read three times
    rel = edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relationship"))
    ends = edges.select(F.col("src_label").alias("name"), F.col("src").alias("key")).union(edges.select("dst_label", "dst")).distinct()
    return rel.unionByName(ends.groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))).orderBy("kind", F.desc("n"), "name")


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over an inverted index.  queries: query_id, query.  Terms of the queries cut the postings before they are shuffled;
    rank 1 to k, ties by key."""
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    sized = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("ts")).withColumn("len", F.size("ts"))
    total = sized.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = sized.select("key", "len", F.explode("ts").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("term", "key", "len").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df_, "term").join(wanted, "term").join(F.broadcast(total), F.lit(True))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    sums = scored.groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return sums.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def requirements_for_building_type(edges: DataFrame, codes: list[str]) -> DataFrame:
    """F8: from building types back over requirement, article, section and chapter to the standard.  Edges are merged, not broadcast: the size
    of the compressed files that they come from says little about that of their rows, which the driver would hold."""
    hop = lambda rel, src, dst: edges.where(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst)).hint("merge")
    start = hop("CLASSIFIES", "req_id", "building_type").where(F.col("building_type").isin(codes))
    return (
        start.join(hop("SPECIFIES", "article_id", "req_id"), "req_id")
        .join(hop("HAS_ARTICLE", "section_id", "article_id"), "article_id")
        .join(hop("HAS_SECTION", "chapter_id", "section_id"), "section_id")
        .join(hop("CONTAINS", "standard_code", "chapter_id"), "chapter_id")
        .select("building_type", "standard_code", "chapter_id", "section_id", "article_id", "req_id")
    )


def requirements_for_topic(articles: DataFrame, reqs: DataFrame, topic: str, code: str | None = None) -> DataFrame:
    """articles whose text or titles hold the topic, with their requirements if there are any."""
    t = topic.lower()
    hit = reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(t) for c in ("content", "title", "section_title", "chapter_title") if c in articles.columns])
    rows = articles.where(hit if code is None else hit & (F.col("standard_code") == code))
    return rows.join(reqs, "article_id", "left")


def related_standards(refs: DataFrame, codes: DataFrame) -> DataFrame:
    """by code, the sorted distinct neighbours by RELATED_TO and by SUPERSEDES; empty lists where there are none.  codes: std_id."""
    own = codes.select("std_id").distinct()
    side = lambda rel, name: refs.where(F.col("rel") == rel).groupBy("std_id").agg(F.array_sort(F.collect_set("target")).alias(name))
    out = own.join(side("RELATED_TO", "related"), "std_id", "left").join(side("SUPERSEDES", "superseded"), "std_id", "left")
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    return out.select("std_id", F.coalesce("related", empty).alias("related"), F.coalesce("superseded", empty).alias("superseded"))


def material_properties(materials: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """materials whose name holds the text, with req_id, article_id, section_id, chapter_id and standard_code as far as the chain
    of edges reaches; null beyond."""
    hop = lambda rel, src, dst: edges.where(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst))
    rows = materials.where(F.lower("material").contains(name.lower()))
    rows = rows.join(hop("FOR_MATERIAL", "req_id", "material"), "material", "left").join(hop("SPECIFIES", "article_id", "req_id"), "req_id", "left")
    rows = rows.join(hop("HAS_ARTICLE", "section_id", "article_id"), "article_id", "left").join(hop("HAS_SECTION", "chapter_id", "section_id"), "section_id", "left")
    return rows.join(hop("CONTAINS", "standard_code", "chapter_id"), "chapter_id", "left")


def requirements_for_topics(articles: DataFrame, reqs: DataFrame, topics: DataFrame) -> DataFrame:
    """F9 for many topics at once: topic, standard_code, article_id, with the articles' requirements if there are any.  topics: topic; an
    empty one names nothing.  Topics are counted first: up to ``matching.SLICE`` of them go to all tasks, and only articles that hold one are shuffled, with
    their topics in a list; more are dealt into slices."""
    topics = topics.select("topic").distinct()
    columns = [c for c in ("content", "title", "section_title", "chapter_title") if c in articles.columns]
    text = F.concat_ws("\x00", *[F.lower(c) for c in columns])
    few = topics.select("topic", F.lower("topic").alias("phrase")).where("phrase <> ''").limit(matching.SLICE + 1).collect()
    if len(few) <= matching.SLICE:
        found = matching.held_of(articles.select(F.col("article_id").cast("string").alias("article_id"), "standard_code", text.alias("text")), [r.phrase for r in few])
        named = topics.sparkSession.createDataFrame(few, "topic string, phrase string")
        rows = found.join(reqs.hint("merge"), "article_id", "left").withColumn("phrase", F.explode("phrases")).drop("phrases")
        return rows.join(F.broadcast(named), "phrase").select("article_id", "topic", "standard_code", *[c for c in reqs.columns if c != "article_id"])
    rows = matching.holds(articles.select(F.lit("").alias("grp"), F.col("article_id").cast("string").alias("key"), text.alias("text")), topics.select(F.lit("").alias("grp"), F.lower("topic").alias("phrase")))
    named = topics.select("topic", F.lower("topic").alias("phrase")).distinct().join(rows, "phrase").select("topic", F.col("key").alias("article_id"))
    return named.join(articles.select("article_id", "standard_code"), "article_id").join(reqs, "article_id", "left")


def _first_of(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r_", F.row_number().over(by)).where(F.col("r_") <= k).drop("r_")


def article_pairs(articles: DataFrame, types: DataFrame, pairs: DataFrame, topic: str | None = None, k: int = 15) -> DataFrame:
    """``cross_reference`` without texts: code1, code2, article1, article2.  articles and types are read several times, so stored ones are best.

    Pairs of standards are stored with a number, which stands for them in all that is shuffled.  Titles go by contents (``matching.titles_met``); of the
    articles of a standard that reach a building type, only the first k can be among the first k pairs."""
    c = F.col
    own, kinds = _own(articles, topic), types.select(c("article_id").cast("string").alias("article_id"), "building_type").distinct()
    size = own.groupBy("code").agg(F.count("*").alias("n"))
    pairs = pairs.select("code1", "code2").distinct()
    for n in (1, 2):
        pairs = pairs.join(size.select(c("code").alias(f"code{n}"), c("n").alias(f"n{n}")), f"code{n}")
    pairs = stored(pairs.withColumn("grp", F.monotonically_increasing_id()), "pairs")
    side = lambda n, m: pairs.select("grp", c(f"code{n}").alias("code"), c(f"n{n}").alias("own_"), c(f"n{m}").alias("other_")).join(own, "code").select("grp", "article_id", "about", F.explode(matching.places(n, m, c("own_"), c("other_"))).alias("p"))
    met = matching.titles_met(side(1, 2).unionByName(side(2, 1)).select("grp", "article_id", "about", "p.*"))
    typed = own.select("code", "article_id", "about").distinct().join(kinds, "article_id")
    key = ["code", "building_type"]

    def both(one: DataFrame, two: DataFrame) -> DataFrame:
        one = pairs.select("grp", "code2", c("code1").alias("code")).join(_first_of(one, key, ["article_id"], k), "code").select("grp", "building_type", c("article_id").alias("article_id1"), c("code2").alias("code"))
        return one.join(_first_of(two, key, ["article_id"], k), key).select("grp", "article_id1", c("article_id").alias("article_id2"))

    if topic is None:
        met = met.union(both(typed, typed))
    else:  # an article about the topic goes with all others, another one only with those about it
        met = met.union(both(typed.where("about"), typed)).union(both(typed.where("NOT about"), typed.where("about")))
    rank = F.dense_rank().over(Window.partitionBy("grp").orderBy("article_id1", "article_id2"))
    first = met.withColumn("r_", rank).where(c("r_") <= k).select("grp", "article_id1", "article_id2").distinct()
    return first.join(pairs, "grp").select("code1", "code2", c("article_id1").alias("article1"), c("article_id2").alias("article2"))


def _own(articles: DataFrame, topic: str | None) -> DataFrame:
    about = F.lit(True) if topic is None else F.coalesce(F.col("content").contains(topic), F.lit(False))
    return articles.select(F.col("standard_code").alias("code"), F.col("article_id").cast("string").alias("article_id"), "title", "content", about.alias("about"))


def cross_reference(articles: DataFrame, types: DataFrame, pairs: DataFrame, topic: str | None = None, k: int = 15) -> DataFrame:
    """of each pair of standards the first k article pairs, by article1 and article2, where one's content holds the other's title, or both
    reach one building type; with a topic, one of the two contents must hold it.  articles: standard_code, article_id, title,
    content; types: article_id, building_type; pairs: code1, code2.  Empty titles name nothing."""
    own = _own(articles, None)
    text = lambda n: own.select(F.col("code").alias(f"code{n}"), F.col("article_id").alias(f"article{n}"), F.col("title").alias(f"title{n}"), F.substring("content", 1, 300).alias(f"content{n}"))
    out = article_pairs(articles, types, pairs, topic, k).join(text(1), ["code1", "article1"]).join(text(2), ["code2", "article2"])
    return out.select("code1", "code2", "article1", "title1", "content1", "article2", "title2", "content2")


def check_unique_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """keys that a node table holds more than once: label, key, n."""
    one = lambda label, df, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(label).alias("label"), "key", "n")
    return reduce(DataFrame.unionByName, [one(label, df, key) for label, (df, key) in tables.items()])


def audit_generated_queries(df: DataFrame, col: str) -> DataFrame:
    """ok and reason of each query in a log: the first of empty, too_long, multiple, start, keyword, no_return."""
    q = F.trim(F.coalesce(F.col(col), F.lit("")))
    up = F.upper(q)
    reason = (
        F.when(q == "", "empty")
        .when(F.length(q) > 2000, "too_long")
        .when(q.contains(";"), "multiple")
        .when(~up.rlike("^(" + "|".join(x.replace(".", r"\.") for x in STARTS) + ")"), "start")
        .when(up.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(BLOCKED)})($|[^\p{{L}}\p{{N}}_])"), "keyword")
        .when(~up.contains("RETURN"), "no_return")
    )
    return df.select("*", reason.isNull().alias("ok"), reason.alias("reason"))


def rows_to_context(df: DataFrame, group: str, order: str, columns: list[str], max_rows: int = 20, chars: int = 500) -> DataFrame:
    """by group, the first rows as lines "key: value"; nulls and empty values are left out, long ones cut."""
    def value(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.when(F.length(v) > chars, F.concat(F.substring(v, 1, chars), F.lit("..."))).otherwise(v)))

    first = df.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank_") <= max_rows)
    lines = first.select(group, "rank_", F.array_join(F.array_compact(F.array(*map(value, columns))), "\n").alias("text_"))
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "text_"))), lambda x: x["text_"]), "\n\n").alias("context"))


def citation_graph(citations: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F16: nodes and edges of an answer view.  citations: answer_id, idx, standard_code, article_number; types: answer_id, building_type."""
    standards = citations.select("answer_id", F.lit("standard").alias("kind"), F.col("standard_code").alias("node")).distinct()
    article = F.concat(F.lit("art_"), F.col("idx").cast("string"))
    articles = citations.select("answer_id", F.lit("article").alias("kind"), article.alias("node"))
    kinds = types.select("answer_id", F.lit("building_type").alias("kind"), F.col("building_type").alias("node")).distinct()
    edges = citations.select("answer_id", F.col("standard_code").alias("src"), article.alias("dst")).unionByName(types.distinct().join(citations, "answer_id").select("answer_id", F.col("building_type").alias("src"), article.alias("dst")))
    return standards.unionByName(articles).unionByName(kinds), edges
