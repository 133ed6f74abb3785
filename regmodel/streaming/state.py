"""Rate limits and feedback as keyed state over streams, and the incremental refresh (S)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.storage import stored
from ..operators.logs import fixed_decision, sliding_decision

_HIT = "event_id long, k string, ts timestamp, accepted boolean, retry_after double"
#: Rows that a stateful step gives back at once.
SLICE = 10_000
#: The state store that typed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_typed_state(spark) -> None:
    for k, v in STORE.items():
        spark.conf.set(k, v)


def _in_order(parts: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Nanoseconds, ids and further columns of a key's rows of a batch by time and id.  Part after part, only these columns are kept."""
    held = [[p["ts"].astype("datetime64[ns]").astype("int64").to_numpy(), p["event_id"].to_numpy("int64"), *(p[c].to_numpy() for c in columns)] for p in parts]
    arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.lexsort((arrays[1], arrays[0]))
    return [x[order] for x in arrays]


class _Limiter(StatefulProcessor):
    """The accepted hits of a key within a window (a list, as long as the limit at most), or the end of its window and the hits in it; a timer
    that clears them when the watermark is a window past the key's last hit."""

    def __init__(self, kind: str, limit: int, window: float):
        self.kind, self.limit, self.window = kind, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "at double")
        self.open = handle.getValueState("open", "ends double, n long")
        self.due = handle.getValueState("due", "at long")

    def _load(self) -> dict:
        if self.kind == "sliding":
            return {"live": [x[0] for x in self.live.get()]}
        ends, n = self.open.get() if self.open.exists() else (None, None)
        return {} if ends is None else {"end": ends, "n": n}

    def _save(self, own: dict) -> None:
        if self.kind == "fixed":
            self.open.update((own["end"], own["n"]))
        elif own["live"]:
            self.live.put([(x,) for x in own["live"]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        decide = {"fixed": fixed_decision, "sliding": sliding_decision}[self.kind](self.limit, self.window)
        at, ids = _in_order(rows)
        due = at // 1_000_000 > timerValues.getCurrentWatermarkInMs()
        at, ids = at[due], ids[due]
        if not len(at):
            return
        own = self._load()
        got = [decide(own, t) for t in (at / 1e9).tolist()]
        self._save(own)
        late = max(int(at[-1] // 1_000_000 + self.window * 1000), self.due.get()[0] if self.due.exists() else 0)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(late)
        self.due.update((late,))
        for lo in range(0, len(got), SLICE):
            part = slice(lo, lo + SLICE)
            yield pd.DataFrame({"event_id": ids[part], "k": key[0], "ts": pd.to_datetime(at[part]), "accepted": [a for a, _ in got[part]], "retry_after": [w for _, w in got[part]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.live, self.open, self.due):
            state.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "k": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[ns]"), "accepted": pd.Series(dtype=bool), "retry_after": pd.Series(dtype="float64")})


def rate_limit_stream(stream: DataFrame, limit: int, window: float, kind: str = "sliding") -> DataFrame:
    """A decision for each hit (event_id, k, ts), of a batch in order of time.  The watermark is the window: hits later than that are dropped,
    and a key's state goes when the watermark passes its last hit by a window.  What a task holds is a key's times and ids of one batch."""
    use_typed_state(stream.sparkSession)
    rows = stream.select("event_id", "k", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{int(window)} seconds")
    return rows.groupBy("k").transformWithStateInPandas(_Limiter(kind, limit, window), _HIT, "Append", "EventTime")


class _Toggle(StatefulProcessor):
    """A message's feedback as it stands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "feedback string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.now.get()[0] if self.now.exists() else None
        for value in _in_order(rows, "feedback")[2].tolist():
            now = None if value == now else value
        self.now.update((now,))
        yield pd.DataFrame({"message_id": [key[0]], "feedback": pd.Series([now], dtype=object)})


def feedback_stream(stream: DataFrame) -> DataFrame:
    """S3: the toggled feedback of a message after each batch (event_id, message_id, ts, feedback): the same value again clears."""
    use_typed_state(stream.sparkSession)
    rows = stream.select("event_id", "message_id", "ts", "feedback")
    return rows.groupBy("message_id").transformWithStateInPandas(_Toggle(), "message_id long, feedback string", "Update", "None")


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest over the names and contents of all files whose name does not begin with "_", in order of name; "" for none.  Files
    are digested where they lie; only a name and a digest of each are brought together.  files: name, content."""
    rows = files.where(~F.col("name").startswith("_")).select(F.concat("name", F.lit(":"), F.sha2("content", 256)).alias("x"))
    joined = rows.agg(F.array_join(F.array_sort(F.collect_list("x")), "\n").alias("j"))
    return joined.select(F.when(F.col("j") == "", "").otherwise(F.sha2("j", 256)).alias("fingerprint"))


def corpus_tree(files: DataFrame, leaf_files: int = 256) -> DataFrame:
    """S1 as a tree: prefix, level, digest.  Files (name, content) lie in buckets by the first hexadecimal digits of their name's sha256, as many
    that a bucket holds about ``leaf_files``; a bucket's digest is the sha256 of its sorted lines "name:digest", a node's that of its
    children's "prefix:digest".  Level 0 is the root, of prefix "".  Trees of as many levels are equal where corpora are; no task holds
    more than a bucket's lines.  Names that begin with "_" don't count."""
    rows = stored(files.where(~F.col("name").startswith("_")).select(F.sha2("name", 256).alias("h"), F.concat("name", F.lit(":"), F.sha2("content", 256)).alias("x")), "file-digests")
    depth, size = 0, rows.count()
    while size > leaf_files * 16**depth:
        depth += 1
    return _tree_of(rows, depth)


def _tree_of(rows: DataFrame, depth: int) -> DataFrame:
    """The tree of stored lines (h, x), with buckets of so many digits."""
    nodes = rows.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("digest"))
    levels = [stored(nodes.withColumn("level", F.lit(depth)), "tree-buckets")]
    for k in range(depth - 1, -1, -1):
        below = F.array_sort(F.collect_list(F.concat("prefix", F.lit(":"), "digest")))
        up = levels[-1].groupBy(F.substring("prefix", 1, k).alias("up")).agg(F.sha2(F.array_join(below, "\n"), 256).alias("digest"))
        levels.append(up.select(F.col("up").alias("prefix"), "digest", F.lit(k).alias("level")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("prefix", "level", "digest")


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """The prefixes of the deepest level where two trees of as many levels differ, found from the root down: below equal nodes nothing is compared."""
    depth = old.agg(F.max("level")).first()[0] or 0
    at = None
    for k in range(depth + 1):
        a, b = (t.where(F.col("level") == k).select("prefix", F.col("digest").alias(n)) for t, n in ((old, "was"), (new, "is")))
        if at is not None:
            a, b = (t.withColumn("up", F.substring("prefix", 1, k - 1)).join(at, "up", "left_semi").drop("up") for t in (a, b))
        differ = a.join(b, "prefix", "full").where(~F.col("was").eqNullSafe(F.col("is"))).select("prefix")
        at = stored(differ.select(F.col("prefix").alias("up")), "changed-nodes")
    return at.select(F.col("up").alias("prefix"))


def diff_corpus(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources that were added, changed or removed, by digest.  Both: source_id, content."""
    a, b = (df.select("source_id", F.sha2(F.encode("content", "UTF-8"), 256).alias(n)) for df, n in ((old, "was"), (new, "is")))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "source_id", "full").select("source_id", state.alias("state")).where("state IS NOT NULL")


def step_report(steps: DataFrame) -> DataFrame:
    """run_id, ok (no step failed), seconds, steps and failed.  steps: run_id, name, status, seconds."""
    return steps.groupBy("run_id").agg((F.count_if(F.col("status") == "failed") == 0).alias("ok"), F.round(F.sum("seconds"), 6).alias("seconds"), F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))


def refresh(steps: list[tuple[str, Callable[[], dict]]], print_of: Callable[[], str], state: dict, force: bool = False, index_empty: bool = False) -> tuple[list[dict], dict]:
    """Run the steps (name, function) if forced, changed since ``state`` or the index is empty.  The first failure ends the run; the state
    moves on only after the last step; unchanged input gives one skipped step with its reason."""
    now = print_of()
    if not (force or index_empty or now != state.get("fingerprint")):
        return [{"name": n, "status": "skipped", "seconds": 0.0, "detail": {"reason": "unchanged"}} for n, _ in steps], state
    report = []
    for name, step in steps:
        began = time.monotonic()
        try:
            detail, status = step() or {}, "ok"
        except Exception as error:  # a step may fail in any way; the report says how
            detail, status = {"error": str(error)}, "failed"
        report.append({"name": name, "status": status, "seconds": time.monotonic() - began, "detail": detail})
        if status == "failed":
            return report, state
    return report, {"fingerprint": now}


def refresh_stream(files: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """New files of a folder, batch by batch, into ``upsert`` (which replaces by source, so that a batch may come twice)."""
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


