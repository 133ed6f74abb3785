"""Queries of readers, sinks and refreshes over files that are written from the given tables (A, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_path, stored
from ..operators import clauses, vectors
from ..sources import readers
from ..streaming import state
from .base import fixture, query, table

#: Documents of a catalog envelope.
ENVELOPE = 500

_SOURCE = "concat(substr(standard_name, 10), '/', CAST(year AS STRING))"
_SAFE = f"regexp_replace({_SOURCE}, '[^\\pL\\pN._-]+', '_', 'g')"


def _corpus(spark, d):
    """All standards with their articles nested; a source is a priority and a year, in a name that is no file name."""
    s = fixture(spark, d, "fx_standards").select("std_id", "standard_code", "standard_name", "year", "eff_status", F.expr(_SOURCE).alias("source_id"))
    nested = clauses.nest_articles(fixture(spark, d, "fx_articles"), "std_id")
    return s.join(nested, "std_id", "left").drop("std_id")


def _report(corpus):
    return corpus.groupBy("source_id").agg(F.count("*").alias("standards"), F.count("chapters").alias("parsed"))


@query("a1_read_standards", "SELECT standard_code, chapter_number, section_number, article_number, title, content FROM fx_articles JOIN fx_standards USING (std_id)")
def a1(spark, d):
    """The articles of all standards as they are read back from the files."""
    path = new_path(spark, "standards")
    readers.write_standards(_corpus(spark, d), path)
    return clauses.unnest_articles(readers.read_standards(spark, path, lines=True))


@query("a6_write_standards", f"""WITH s AS (SELECT *, {_SOURCE} AS source_id, {_SAFE} AS source_file, std_id IN (SELECT std_id FROM fx_articles) AS has FROM fx_standards)
SELECT source_file, source_id, count(*) AS written, count(*) AS reported, count(*) FILTER (has) AS parsed FROM s GROUP BY ALL""")
def a6(spark, d):
    """By source, the folder that it lies in and how many standards were written there, beside what the report says."""
    path, report = new_path(spark, "standards"), new_path(spark, "report")
    corpus = stored(_corpus(spark, d), "corpus")  # read three times
    readers.write_standards(corpus, path)
    readers.write_standards(corpus, path, _report(corpus), report)  # anew: nothing comes twice
    back = readers.read_standards(spark, path, lines=True).groupBy("source_file", "source_id").agg(F.count("*").alias("written"))
    said = spark.read.schema("source_id string, standards long, parsed long").json(report)
    return back.join(said, "source_id").select("source_file", "source_id", "written", F.col("standards").alias("reported"), "parsed")


@query("a2_read_catalog", "SELECT CAST(id AS STRING) AS id, doc_num, title, doc_type, issue_date, eff_status, html_chars, kind, file_name, scanned FROM fx_catalog")
def a2(spark, d):
    """Catalogs of some hundred documents each, an envelope a file."""
    rows = fixture(spark, d, "fx_catalog")
    file = F.struct(F.col("file_name").alias("fileName"), "kind", "text_chars", "scanned")
    doc = F.struct(
        F.col("id").cast("string").alias("id"), F.col("doc_num").alias("docNum"), "title", F.col("doc_type").alias("docType"), F.col("issue_date").alias("issueDate"),
        F.col("eff_status").alias("effStatus"), F.struct(F.col("html_chars").alias("chars")).alias("html"), F.array(file).alias("attachments"),
    )
    parts = max(1, -(-rows.count() // ENVELOPE))
    path = new_path(spark, "catalogs")
    envelopes = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("e")).agg(F.collect_list(doc).alias("documents")).select("documents")
    envelopes.write.option("maxRecordsPerFile", 1).json(path)
    one = F.col("attachments")[0]
    return readers.read_catalog(spark, path).select(
        "id", F.col("docNum").alias("doc_num"), "title", F.col("docType").alias("doc_type"), F.col("issueDate").alias("issue_date"), F.col("effStatus").alias("eff_status"),
        F.col("html.chars").cast("long").alias("html_chars"), one["kind"].alias("kind"), one["fileName"].alias("file_name"), one["scanned"].alias("scanned"),
    )


@query("a5_read_parsed_models", "SELECT concat('M', split_part(global_id, '-', 1), '.ifc') AS filename, global_id, ifc_type, storey, material, CAST(CAST(z0 AS INT) AS STRING) AS level FROM fx_elements")
def a5(spark, d):
    """A model of each order, a line each."""
    row = F.struct("global_id", "ifc_type", F.col("global_id").alias("name"), "storey", "material", F.create_map(F.lit("level"), F.col("z0").cast("int").cast("string")).alias("properties"))
    file = F.concat(F.lit("M"), F.substring_index("global_id", "-", 1), F.lit(".ifc"))
    path = new_path(spark, "parsed-models")
    fixture(spark, d, "fx_elements").groupBy(file.alias("filename")).agg(F.collect_list(row).alias("elements")).write.json(path)
    back = readers.read_parsed_models(spark, path, lines=True).select("filename", F.explode("elements").alias("e"))
    return back.select("filename", "e.global_id", "e.ifc_type", "e.storey", "e.material", F.col("e.properties")["level"].alias("level"))


@query("a7_replace_partitions", """SELECT user_id % 40 AS source_id, event_id, 1 AS version FROM events WHERE user_id % 40 % 3 > 0
UNION ALL SELECT user_id % 40, event_id, 2 FROM events WHERE user_id % 40 % 3 = 0 AND event_id % 10 > 0""")
def a7(spark, d):
    """Every third source is written again with fewer rows, twice; the others stay."""
    rows = table(spark, d, "events").select((F.col("user_id") % 40).alias("source_id"), "event_id")
    path = new_path(spark, "by-source")
    readers.replace_partitions(rows.withColumn("version", F.lit(1)), path)
    for _ in range(2):
        readers.replace_partitions(rows.where("source_id % 3 = 0 AND event_id % 10 > 0").withColumn("version", F.lit(2)), path)
    return spark.read.schema("event_id long, version int, source_id long").parquet(path).select("source_id", "event_id", "version")


# --- S --------------------------------------------------------------------------------------------------------------
@query("s4_refresh", """SELECT page_id AS source_id, CASE WHEN page_id % 5 IN (0, 2) THEN 3 ELSE 0 END AS run, CASE WHEN page_id % 5 = 2 THEN length(html) + 1 ELSE length(html) END AS chars FROM pages
UNION ALL SELECT -run, run, n FROM (VALUES (0, 2), (1, 0), (2, 1), (3, 2)) v(run, n)""")
def s4(spark, d):
    """The index after four runs, and with negative ids how many steps each run took: pages but every fifth, the same again, all pages with
    some changed while the second step fails, and that once more."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("content"))
    old = pages.where("source_id % 5 > 0")
    new = pages.withColumn("content", F.when(F.col("source_id") % 5 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    held = {"index": None, "files": old.limit(0), "state": {}}
    took = []
    for run, (files, broken) in enumerate(((old, False), (old, False), (new, True), (new, False))):
        digests = files.select(F.col("source_id").cast("string").alias("name"), F.encode("content", "UTF-8").alias("content"))

        def parse(files=files):
            held["changed"] = stored(state.diff_corpus(held["files"], files).where("state <> 'removed'"), "changed")
            return {"sources": held["changed"].count()}

        def ingest(files=files, broken=broken, run=run):
            if broken:
                raise OSError("the index can't be reached")
            rows = files.join(held["changed"], "source_id", "left_semi").select(F.col("source_id").cast("string").alias("id"), "source_id", F.lit(run).alias("run"), F.length("content").alias("chars"))
            held["index"] = stored(rows if held["index"] is None else vectors.upsert_by_source(held["index"], rows), "index")
            held["files"] = files
            return {}

        def root(digests=digests):
            return state.corpus_tree(digests).where("level = 0").first()["digest"]

        report, held["state"] = state.refresh([("parse", parse), ("ingest", ingest)], root, held["state"])
        took.append((-run, run, sum(r["status"] == "ok" for r in report)))
    counts = spark.createDataFrame(took, "source_id long, run int, chars int")
    return held["index"].select("source_id", F.col("run").cast("int").alias("run"), "chars").unionByName(counts)


@query("s5_refresh_stream", """WITH p AS (SELECT page_id % 40 AS source_id, page_id, page_id % 3 > 0 AS again, bool_or(page_id % 3 > 0) OVER (PARTITION BY page_id % 40) AS named FROM pages)
SELECT source_id, page_id, CASE WHEN source_id % 4 = 0 AND named THEN 2 ELSE 1 END AS version FROM p WHERE source_id % 4 > 0 OR again OR NOT named UNION ALL SELECT 40 + source_id, page_id, 2 FROM p WHERE source_id % 4 = 0""")
def s5(spark, d):
    """A table by source, kept by a stream that runs twice: all sources first, then new files with every fourth source anew (fewer rows) and as
    many new ones.  A batch replaces the sources that it names (one that it doesn't name stays), so that it may come twice."""
    pages = table(spark, d, "pages").select((F.col("page_id") % 40).alias("source_id"), "page_id")
    files, out, log = (new_path(spark, n) for n in ("arrivals", "kept", "kept-log"))
    again = pages.where("source_id % 4 = 0")
    first = pages.withColumn("version", F.lit(1))
    second = again.where("page_id % 3 > 0").unionByName(again.withColumn("source_id", F.col("source_id") + 40)).withColumn("version", F.lit(2))
    for rows in (first, second):
        rows.write.mode("append").parquet(files)
        stream = spark.readStream.schema(rows.schema).parquet(files)

        def upsert(batch, n):
            readers.replace_partitions(batch, out)

        state.refresh_stream(stream, upsert, log).awaitTermination()
    return spark.read.schema("page_id long, version int, source_id long").parquet(out).select("source_id", "page_id", "version")
