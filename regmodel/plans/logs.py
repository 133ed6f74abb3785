"""Queries of conversations, logs, limits and refresh (L, S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import new_path, shared_dir, stored
from ..operators import logs
from ..streaming import state
from .base import fixture, query, table


@query("l1_history", "SELECT conv_id, string_agg(concat(role, ': ', left(text, 200)), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r <= 6 GROUP BY conv_id")
def l1(spark, d):
    return logs.history(table(spark, d, "conversations"))


@query("l2_title", "SELECT conv_id, CASE WHEN length(t) <= 60 THEN t ELSE concat(regexp_replace(left(t, 60), ' [^ ]*$', ''), '...') END AS title FROM (SELECT conv_id, trim(text) AS t FROM conversations WHERE turn = 0) x")
def l2(spark, d):
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", logs.title(F.col("text")).alias("title"))


_CONVS = "SELECT conv_id, conv_id % 3 AS user_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id"


def _convs(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.max("conv_id") % 3).alias("user_id"), F.max("turn").alias("updated_at"))


@query("l3_list_conversations", f"SELECT * FROM ({_CONVS}) t WHERE user_id = 1 ORDER BY updated_at DESC, conv_id LIMIT 20 OFFSET 2")
def l3(spark, d):
    return logs.list_conversations(_convs(spark, d), 1, 20, 2)


@query("l4_messages_of", "SELECT turn, role, CAST(CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS INT) AS n FROM conversations WHERE conv_id = 3")
def l4(spark, d):
    m = table(spark, d, "conversations").withColumn("citations", F.when(F.col("turn") % 2 == 1, '[{"standard_code":"QCVN 06","article_number":"1.1"}]'))
    return logs.messages_of(m, 3).select("turn", "role", F.size("citations").alias("n"))


@query("l5_delete_conversations", "SELECT conv_id, count(*) AS n FROM conversations WHERE NOT (conv_id % 3 = 1 AND conv_id % 2 = 0) GROUP BY conv_id")
def l5(spark, d):
    c = _convs(spark, d)
    _, left = logs.delete_conversations(c, table(spark, d, "conversations"), c.where("conv_id % 2 = 0").select("conv_id"), 1)
    return left.groupBy("conv_id").agg(F.count("*").alias("n"))


_FOLDED = """WITH a AS (SELECT *, CASE WHEN feedback = lag(feedback) OVER w THEN 0 ELSE 1 END AS s FROM fx_feedback WINDOW w AS (PARTITION BY message_id ORDER BY ts, event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY message_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT message_id, run, any_value(feedback) AS feedback, count(*) AS n FROM b GROUP BY ALL) SELECT message_id, CASE WHEN n % 2 = 1 THEN feedback END AS feedback FROM c QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY run DESC) = 1"""


@query("l6_fold_feedback", _FOLDED)
def l6(spark, d):
    return logs.fold_feedback(fixture(spark, d, "fx_feedback"))


@query("l7_resolve_client_ip", "SELECT event_id, CASE WHEN user_id % 4 < 2 AND event_id % 3 > 0 THEN '203.0.113.7' WHEN user_id % 4 = 3 THEN 'unknown' WHEN user_id % 4 = 0 THEN concat('10.0.', CAST(user_id % 200 AS STRING), '.1') WHEN user_id % 4 = 1 THEN '172.16.0.9' ELSE concat('8.8.', CAST(user_id % 200 AS STRING), '.1') END AS client_ip FROM events")
def l7(spark, d):
    u = F.col("user_id")
    octet = (u % 200).cast("string")
    peer = F.when(u % 4 == 0, F.concat(F.lit("10.0."), octet, F.lit(".1"))).when(u % 4 == 1, "172.16.0.9").when(u % 4 == 2, F.concat(F.lit("8.8."), octet, F.lit(".1")))
    e = table(spark, d, "events").select("event_id", peer.alias("peer"), F.when(F.col("event_id") % 3 == 0, "300.1.1.1").otherwise("203.0.113.7, 10.0.0.1").alias("forwarded"))
    return logs.resolve_client_ip(e, ["10.0.0.0/8", "172.16.0.0/12"]).select("event_id", "client_ip")


@query("l8_audit_counts", "SELECT user_id, event_type AS action, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_id % 2 = 0 THEN 'design' ELSE 'consult' END AS mode, count(*) AS n FROM events GROUP BY ALL")
def l8(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 2 == 0, '{"mode":"design"}').alias("detail"), F.col("ts").alias("created_at"))
    return logs.audit_counts(e).withColumn("day", F.col("day").cast("string"))


@query("l9_rate_limit_fixed")
def l9(spark, d):
    return logs.rate_limit_fixed(fixture(spark, d, "fx_hits"), 3, 86400.0)


@query("l10_rate_limit_sliding")
def l10(spark, d):
    return logs.rate_limit_sliding(fixture(spark, d, "fx_hits"), 3, 86400.0)


@query("l11_quota_usage", "SELECT k, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM fx_hits GROUP BY ALL HAVING count(*) > 2")
def l11(spark, d):
    return logs.quota_usage(fixture(spark, d, "fx_hits"), 86400, 2)


@query("l12_wait_label", "SELECT event_id, CASE WHEN value * 30 >= 3600 THEN concat(CAST(CAST(ceil(value * 30 / 3600) AS BIGINT) AS STRING), ' giờ') WHEN value * 30 >= 60 THEN concat(CAST(CAST(ceil(value * 30 / 60) AS BIGINT) AS STRING), ' phút') ELSE concat(CAST(greatest(CAST(ceil(value * 30) AS BIGINT), 1) AS STRING), ' giây') END AS label FROM events WHERE value IS NOT NULL")
def l12(spark, d):
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", logs.wait_label(F.col("value") * 30).alias("label"))


# --- S --------------------------------------------------------------------------------------------------------------
@query("s1_fingerprint", "SELECT sha256(string_agg(concat('p', CAST(page_id AS STRING), ':', sha256(html)), chr(10) ORDER BY concat('p', CAST(page_id AS STRING), ':', sha256(html)))) AS fingerprint FROM pages WHERE page_id % 5 > 0")
def s1(spark, d):
    name = F.concat(F.when(F.col("page_id") % 5 == 0, "_").otherwise(""), F.lit("p"), F.col("page_id").cast("string"))
    return state.fingerprint(table(spark, d, "pages").select(name.alias("name"), F.encode("html", "UTF-8").alias("content")))


@query("s6_diff_corpus", "SELECT page_id AS source_id, CASE WHEN page_id % 5 = 0 THEN 'added' WHEN page_id % 5 = 1 THEN 'removed' ELSE 'changed' END AS state FROM pages WHERE page_id % 5 < 3")
def s6(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("content"))
    new = p.where("source_id % 5 <> 1").withColumn("content", F.when(F.col("source_id") % 5 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return state.diff_corpus(p.where("source_id % 5 <> 0"), new)


@query("s7_step_report", "SELECT user_id AS run_id, count(*) FILTER (event_type = 'error') = 0 AS ok, round(sum(value), 6) AS seconds, count(*) AS steps, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def s7(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("seconds"))
    return state.step_report(e)


def _stream(spark, d, name: str, key: str, view, batches: int = 4):
    """A table as a stream of files that arrive in order of time, some batches of them; a key's rows of a batch lie in one file."""
    rows = view(table(spark, d, name)).withColumn("at_", F.unix_seconds(F.col("ts").cast("timestamp")))
    cuts = [None, *rows.agg(F.percentile_approx("at_", [i / batches for i in range(1, batches)], 1000)).first()[0], None]
    path = new_path(spark, f"{name}-stream")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.lit(True) if lo is None else F.col("at_") >= lo) & (F.lit(True) if hi is None else F.col("at_") < hi))
        part.drop("at_").repartition(2, key).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("at_").schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("s2_rate_limit_stream")
def s2(spark, d):
    hits = _stream(spark, d, "events", "k", lambda e: e.select("event_id", F.concat(F.lit("chat:"), F.col("user_id").cast("string")).alias("k"), "ts"))
    out = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}"
    q = state.rate_limit_stream(hits, 3, 86400.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stored(spark.read.parquet(out), "hits")


@query("s3_feedback_stream", _FOLDED)
def s3(spark, d):
    rows = _stream(spark, d, "events", "message_id", lambda e: e.where("event_type IN ('click', 'error')").select("event_id", F.col("user_id").alias("message_id"), "ts", F.when(F.col("event_type") == "click", "like").otherwise("dislike").alias("feedback")))
    out = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    q = state.feedback_stream(rows).writeStream.foreachBatch(put).option("checkpointLocation", out + "-log").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("message_id").agg(F.max_by("feedback", "batch").alias("feedback"))


_TREE_FILES = "SELECT sha256(concat('p', CAST(page_id AS STRING))) AS h, concat('p', CAST(page_id AS STRING), ':', sha256(html)) AS x FROM pages"


@query("s1_corpus_tree", f"""WITH f AS ({_TREE_FILES}), b AS (SELECT h[1:2] AS prefix, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest FROM f GROUP BY h[1:2]),
c AS (SELECT prefix[1:1] AS prefix, sha256(string_agg(concat(prefix, ':', digest), chr(10) ORDER BY prefix)) AS digest FROM b GROUP BY prefix[1:1]) SELECT prefix, 2 AS level, digest FROM b UNION ALL SELECT prefix, 1, digest FROM c UNION ALL SELECT '', 0, sha256(string_agg(concat(prefix, ':', digest), chr(10) ORDER BY prefix)) FROM c""")
def s1b(spark, d):
    pages = table(spark, d, "pages")
    files = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return state.corpus_tree(files, max(1, pages.count() // 200))  # two levels, whatever the table's size
