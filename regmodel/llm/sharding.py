"""Operator 8: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered from 0 in order of (doc_id, checksum, size).  With n rows, numbers are written as pairs (l, r) in base
(a, b), a = ceil(sqrt(n)), b = ceil(n / a), and go through rounds that add a function of one half to the other; that is a
permutation of a * b >= n numbers.  A number that leaves 0 .. n - 1 is permuted again until it is back (cycle walking; at
most a of the a * b numbers lie outside, so walks are short).  The permuted number p gives shard p mod shards and slot
p div shards: any row's place can be computed from its number alone, shard sizes differ by one at most (law ``rows``),
and slots have no gaps.

All of it is DataFrame expressions.  Numbers come from ranges of doc_id cut at quantiles: rows are numbered within a
range, and the counts of the ranges, a row each, are summed up before.  Texts are read once and never shuffled.

Defined cases: a null text has size 16 and checksum 0; null doc_ids come first; rows equal in id, checksum and size are
interchangeable and get neighbouring numbers; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 40
OVERHEAD = 16
PRIME = 2147483647
#: Fixed keys of the rounds: any numbers below PRIME do.
KEYS = [(1013904223 * (i + 1) % PRIME, 1664525 * (i + 7) % PRIME, 69069 * (3 * i + 5) % PRIME, 40692 * (i + 11) ** 3 % PRIME) for i in range(8)]
WALKS = 16
RANGES = 512


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def permute(x: int, n: int, keys: list[tuple[int, int, int, int]] = KEYS) -> int:
    """The same permutation for one number, on the driver: where row x of n goes."""
    a, b = halves(n)
    while True:
        left, right = divmod(x, b)
        for i, (k1, k2, k3, k4) in enumerate(keys):
            v = left if i % 2 else right
            f = ((v + k1) * (v + k2) % PRIME * k3 + k4) % PRIME
            left, right = (left, (right + f) % b) if i % 2 else ((left + f) % a, right)
        x = left * b + right
        if x < n:
            return x


def permuted(x: Column, n: int, keys: list[tuple[int, int, int, int]] = KEYS) -> Column:
    a, b = (F.lit(v).cast("long") for v in halves(n))
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"k{j}") for j, v in enumerate(k, 1)], F.lit(i % 2 == 1).alias("odd")) for i, k in enumerate(keys)])

    def step(s: Column, k: Column) -> Column:
        v = F.when(k["odd"], s["l"]).otherwise(s["r"])
        f = (((v + k["k1"]) * (v + k["k2"])) % PRIME * k["k3"] + k["k4"]) % PRIME
        return F.struct(F.when(k["odd"], s["l"]).otherwise((s["l"] + f) % a).alias("l"), F.when(k["odd"], (s["r"] + f) % b).otherwise(s["r"]).alias("r"))

    def once(v: Column) -> Column:
        left = (v - v % b) / b
        return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), (v % b).alias("r")), step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), x.cast("long"), lambda v, i: F.when((i > 0) & (v < n), v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not return")).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: under this law growing moves rows), row_number."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = common.materialize(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        ),
        "sharding-rows",
    )
    ranges = max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(at).cast("int"))
    sizes = sorted((r["range"], r["count"]) for r in rows.groupBy("range").count().collect())  # a row for each range
    before, n = [], 0
    for k, count in sizes:
        before.append((k, n))
        n += count
    before = spark.createDataFrame(before, "range int, before long")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY `range` ORDER BY doc_id, text_crc32, size) - 1 AS within").join(F.broadcast(before), "range")
    p = F.col("p")
    return (
        numbered.select("doc_id", "size", "text_crc32", (F.col("before") + F.col("within")).alias("row_number"))
        .withColumn("p", permuted(F.col("row_number"), n))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (p % shards).cast("int").alias("shard"), ((p - p % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"))


def _oracle(walks: int = 6) -> str:
    step = ["s0 AS (SELECT *, row_number AS x, n.n AS n, ceil(sqrt(n.n))::BIGINT AS a, ((n.n + ceil(sqrt(n.n))::BIGINT - 1) // ceil(sqrt(n.n))::BIGINT) AS b FROM numbered, n)"]
    k = 0
    for walk in range(walks):
        go = f"({'TRUE' if walk == 0 else 'x >= n'})"
        step.append(f"s{k + 1} AS (SELECT *, {go} AS go, x // b AS l, x % b AS r FROM (SELECT * {'EXCLUDE (go, l, r)' if walk else ''} FROM s{k}))")
        k += 1
        for i, (k1, k2, k3, k4) in enumerate(KEYS):
            v = "l" if i % 2 else "r"
            f = f"(((({v} + {k1}) * ({v} + {k2})) % {PRIME}) * {k3} + {k4}) % {PRIME}"
            step.append(f"s{k + 1} AS (SELECT * REPLACE ({f'(r + {f}) % b AS r' if i % 2 else f'(l + {f}) % a AS l'}) FROM s{k})")
            k += 1
        step.append(f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN go THEN l * b + r ELSE x END AS x) FROM s{k})")
        k += 1
    shift = "c"
    for _ in range(8):
        shift = f"(xor({shift} >> 1, ({shift} & 1) * 3988292384))" if shift == "c" else f"list_transform([{shift}], lambda c: xor(c >> 1, (c & 1) * 3988292384))[1]"
    return f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda c: {shift}) AS tab),
d AS (SELECT doc_id, (coalesce(strlen(text), 0) + {OVERHEAD})::BIGINT AS size,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) END::BIGINT AS text_crc32
  FROM documents, t),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
n AS (SELECT count(*) AS n FROM documents),
{', '.join(step)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, (x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, row_number FROM s{k}"""


ORACLE = _oracle()
