"""Conversations, feedback, addresses, quotas and rate limits (L)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits by kind, in hits and seconds.
QUOTAS = {"chat_minute": (20, 60), "chat_day": (300, 86400), "ifc_minute": (5, 60), "login": (10, 900), "register": (5, 900)}
NO_HISTORY = "(không có)"


def history(messages: DataFrame, n: int = 10, prompt_n: int = 6, chars: int = 200, order: str = "turn") -> DataFrame:
    """L1: conv_id and its prompt history: of the last n messages the last prompt_n, oldest first, as "role: text" cut at chars.
    The rank window keeps n rows a conversation before anything is collected."""
    by = Window.partitionBy("conv_id").orderBy(F.desc(order))
    last = messages.withColumn("r_", F.row_number().over(by)).where(F.col("r_") <= min(n, prompt_n))
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("r_")).alias("o"), line.alias("t"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("history")).withColumn("history", F.when(F.col("history") == "", NO_HISTORY).otherwise(F.col("history")))


def title(text: Column, limit: int = 60) -> Column:
    """L2: the first 60 characters of a message; a longer one is cut at its last space and gets dots."""
    t = F.trim(text)
    cut = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("...")))


def list_conversations(convs: DataFrame, user, limit: int = 20, offset: int = 0) -> DataFrame:
    """L3: a user's conversations, the last updated first."""
    return convs.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), "conv_id").offset(offset).limit(min(limit, 100))


def messages_of(messages: DataFrame, conv: int, schema: str = "array<struct<standard_code:string,article_number:string>>") -> DataFrame:
    """L4: the messages of a conversation in order, with their citations read from JSON (none: an empty list)."""
    empty = F.expr(f"CAST(array() AS {schema})")
    return messages.where(F.col("conv_id") == conv).withColumn("citations", F.coalesce(F.from_json("citations", schema), empty)).orderBy("turn")


def delete_conversations(convs: DataFrame, messages: DataFrame, ids: DataFrame, user) -> tuple[DataFrame, DataFrame]:
    """What is left of both tables after the owner deletes conversations; others' are not touched."""
    gone = convs.where(F.col("user_id") == user).join(ids.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id")
    return convs.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def fold_feedback(events: DataFrame, key: str = "message_id", value: str = "feedback") -> DataFrame:
    """The state after all toggles: the same value again clears, another replaces.  It is the last value if its last run has
    odd length, else null."""
    by = Window.partitionBy(key).orderBy("ts", "event_id")
    changed = F.coalesce((F.col(value) != F.lag(value).over(by)).cast("int"), F.lit(1))
    runs = events.withColumn("run_", changed).withColumn("run_", F.sum("run_").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(key, "run_", value).agg(F.count("*").alias("n_"))
    last = sizes.groupBy(key).agg(F.max_by(F.struct(value, "n_"), "run_").alias("l"))
    return last.select(key, F.when(F.col("l.n_") % 2 == 1, F.col(f"l.{value}")).alias(value))


def ipv4(text: Column) -> Column:
    """A dotted address as a number, null if it is none."""
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    good = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(good, F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def resolve_client_ip(df: DataFrame, trusted: list[str], peer: str = "peer", header: str = "forwarded") -> DataFrame:
    """The forwarded address if the peer lies in a trusted network and the header is an address; else the peer; else "unknown".  IPv6
    headers are checked by shape."""
    inside = F.lit(False)
    p = ipv4(F.col(peer))
    for net in trusted:
        base, _, bits = net.partition("/")
        shift = 32 - int(bits or 32)
        number = int.from_bytes(bytes(map(int, base.split("."))), "big")
        inside = inside | (F.shiftright(p, shift) == (number >> shift))
    first = F.trim(F.split(F.coalesce(F.col(header), F.lit("")), ",")[0])
    valid = ipv4(first).isNotNull() | first.rlike(r"^(?=[^:]*:[^:]*:)[0-9A-Fa-f:]{2,39}$")
    return df.withColumn("client_ip", F.when(F.coalesce(inside, F.lit(False)) & valid, first).otherwise(F.coalesce(peer, F.lit("unknown"))))


def audit_rows(df: DataFrame) -> DataFrame:
    """user_id, action, detail (JSON, null when empty), ip, created_at.  df has detail as a struct or null."""
    json = F.to_json("detail")
    return df.withColumn("detail", F.when(json != "{}", json)).select("user_id", "action", "detail", "ip", "created_at")


def audit_counts(audit: DataFrame) -> DataFrame:
    """By user, action, day and mode of the detail (default consult)."""
    mode = F.coalesce(F.get_json_object("detail", "$.mode"), F.lit("consult"))
    return audit.groupBy("user_id", "action", F.to_date("created_at").alias("day"), mode.alias("mode")).agg(F.count("*").alias("n"))


_DECISIONS = "event_id long, k string, ts timestamp, accepted boolean, retry_after double"


def _by_key(events: DataFrame, decide) -> DataFrame:
    """Rows of a key in order of time through a small state machine, streamed: keys are sorted within partitions, and the state that is
    held is one key's, however many hits it has."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for part in parts:
            ok, wait = [], []
            for k, t in zip(part["k"], part["ts"].astype("int64") / 1e9 if part["ts"].dtype.name.endswith("[ns]") else part["ts"].astype("datetime64[ns]").astype("int64") / 1e9, strict=True):
                if k != key:
                    key, state = k, {}
                a, w = decide(state, t)
                ok.append(a)
                wait.append(w)
            yield part.assign(accepted=ok, retry_after=wait)

    rows = events.select("event_id", "k", "ts").repartition("k").sortWithinPartitions("k", "ts", "event_id")
    return rows.mapInPandas(run, _DECISIONS)


def fixed_decision(limit: int, window: float):
    """A window opens at a key's first hit; all hits count; from limit + 1 on they are rejected with what is left of it."""

    def decide(state: dict, t: float) -> tuple[bool, float]:
        if not state or t >= state["end"]:
            state.update(end=t + window, n=0)
        state["n"] += 1
        return (True, 0.0) if state["n"] <= limit else (False, state["end"] - t)

    return decide


def sliding_decision(limit: int, window: float):
    """A hit is accepted if fewer than limit accepted ones lie in the last seconds; rejected ones don't count."""

    def decide(state: dict, t: float) -> tuple[bool, float]:
        live = state["live"] = [x for x in state.get("live", []) if x > t - window]
        if len(live) < limit:
            live.append(t)
            return True, 0.0
        return False, window - (t - live[0])

    return decide


def rate_limit_fixed(events: DataFrame, limit: int, window: float) -> DataFrame:
    """A decision for each event (event_id, k, ts)."""
    return _by_key(events, fixed_decision(limit, window))


def rate_limit_sliding(events: DataFrame, limit: int, window: float) -> DataFrame:
    """A decision for each event."""
    return _by_key(events, sliding_decision(limit, window))


def quota_usage(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Keys and tumbling windows with more hits than the limit: k, start, n."""
    return events.groupBy("k", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("k", F.col("w.start").alias("start"), "n")


def wait_label(seconds: Column) -> Column:
    """Whole hours from an hour on, whole minutes from a minute on, else seconds, one at least; rounded up."""
    up = lambda x: F.ceil(x).cast("string")
    return F.when(seconds >= 3600, F.concat(up(seconds / 3600), F.lit(" giờ"))).when(seconds >= 60, F.concat(up(seconds / 60), F.lit(" phút"))).otherwise(F.concat(F.greatest(F.ceil(seconds), F.lit(1)).cast("string"), F.lit(" giây")))
