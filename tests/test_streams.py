"""Keyed state over several micro-batches, and trees of digests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from regmodel.operators import logs
from regmodel.streaming import state

BEGIN = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, make, mode):
    """The rows that a stream gives over the batches, with each batch's number."""
    source, got = tmp_path / "in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b={i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "b=*"))
    q = make(stream).writeStream.foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "log")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


@pytest.mark.parametrize("kind", ["sliding", "fixed"])
def test_limits_over_batches(spark, tmp_path, kind):
    rng = random.Random(5)
    times = sorted(rng.randrange(4000) for _ in range(160))
    hits = [(i, f"k{rng.randrange(4)}", BEGIN + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    batches = [hits[i : i + 40] for i in range(0, 160, 40)]
    for b in batches:
        rng.shuffle(b)  # within a batch the order is that of time
    schema = "event_id long, k string, ts timestamp"
    got = run(spark, tmp_path, batches, schema, lambda s: state.rate_limit_stream(s, 3, 600.0, kind), "append")
    batch = {"sliding": logs.rate_limit_sliding, "fixed": logs.rate_limit_fixed}[kind](spark.createDataFrame(hits, schema), 3, 600.0)
    key = lambda r: (r[-5], r[-2], round(r[-1], 3))
    assert sorted(map(key, got)) == sorted(map(key, batch.collect())) and len({n for n, *_ in got}) == 4


def test_late_hits_and_expiry(spark, tmp_path):
    at = lambda s: BEGIN + dt.timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "a", at(1)), (3, "a", at(2))], [(4, "b", at(5000))], [(5, "b", at(5001)), (6, "a", at(100))], [(7, "a", at(5100)), (8, "a", at(5101))]]
    got = run(spark, tmp_path, batches, "event_id long, k string, ts timestamp", lambda s: state.rate_limit_stream(s, 2, 600.0), "append")
    assert {r[1]: r[4] for r in got} == {1: True, 2: True, 3: False, 4: True, 5: True, 7: True, 8: True}  # 6 is later than the watermark
    info = spark.read.format("statestore").option("stateVarName", "live").load(str(tmp_path / "log")).collect()
    assert {r.key.k for r in info} == {"a", "b"}


def test_feedback_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), BEGIN + dt.timedelta(seconds=i), rng.choice(["like", "dislike"])) for i in range(60)]
    schema = "event_id long, message_id long, ts timestamp, feedback string"
    got = run(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]], schema, state.feedback_stream, "update")
    last, now = {}, {}
    for _, m, value in sorted(got):
        last[m] = value
    for _, m, _, value in rows:
        now[m] = None if now.get(m) == value else value
    assert last == now and len(got) == 9


@pytest.mark.parametrize("leaf", [1, 7, 1000])
def test_trees(spark, leaf):
    files = [(f"f{i}", bytes([i % 7, i % 251])) for i in range(300)] + [("_report", b"x")]
    df = lambda rows: spark.createDataFrame(rows, "name string, content binary")
    a = state.corpus_tree(df(files), leaf).cache()
    root = lambda t: t.where("level = 0").first().digest
    assert a.where("level = 0").count() == 1 and root(state.corpus_tree(df(files[::-1]), leaf)) == root(a)
    assert root(state.corpus_tree(df([*files[:-1], ("_report", b"y")]), leaf)) == root(a)
    changed = [(n, b"new" if n == "f17" else c) for n, c in files if n != "f30"] + [("extra", b"e")]
    b = state.corpus_tree(df(changed), leaf).cache()
    depth = a.agg(F.max("level")).first()[0]
    want = {r[0] for r in spark.createDataFrame([("f17",), ("f30",), ("extra",)], "n string").select(F.substring(F.sha2("n", 256), 1, depth)).collect()}
    assert root(a) != root(b) and {r.prefix for r in state.changed_buckets(a, b).collect()} == want
    assert state.changed_buckets(a, a).count() == 0
    assert state.corpus_tree(df(files).limit(0)).count() == 0
