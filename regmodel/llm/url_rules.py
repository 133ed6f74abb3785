"""Operator 10: url filter by a sort-merge range join.

A host is written backwards by labels (``org.example.``), so that a rule's host covers an interval of such keys: the host
and all its subdomains.  Urls and rule intervals are dealt into ranges of keys, each interval to all ranges that it
touches, and sorted; one sweep over a range keeps the stack of rules whose interval is open (intervals of hosts are
nested or apart) and gives each url the longest rule of the stack whose path its own path starts with.

Ranges are cut at quantiles of a sample of (key, path, page_id), so that a host with a third of all urls fills as many
ranges as it needs.  The sample's size is fixed by the number of ranges.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; a rule with an empty host fits
none; of rules of equal length the first by host, path and verdict wins; null and repeated page_ids stay as they are;
empty tables of urls or of rules are allowed; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
SAMPLE_PER_RANGE = 64


def lower(host: Column) -> Column:
    """A-Z only: other letters of a host are told apart."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Open:
    """The rules of an open interval, by their paths: of each path the verdict that comes first, and the paths' lengths, falling."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.rules, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str, rule: str) -> None:
        at = bisect_left(self.lengths, -len(path))
        if at == len(self.lengths) or self.lengths[at] != -len(path):
            self.lengths.insert(at, -len(path))
        self.rules[path] = min(self.rules.get(path, (verdict, rule)), (verdict, rule))

    def longest(self, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest path that a path starts with: one look for each length, however many rules there are."""
        for n in self.lengths[bisect_left(self.lengths, -len(path)) :]:
            found = self.rules.get(path[:-n] if n else "")
            if found:
                return found
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: list[_Open] = []
    for batch in batches:
        pages, hosts, paths, rules, verdicts = [], [], [], [], []
        for key, kind, path, verdict, rule, page, host in zip(*(batch.column(k).to_pylist() for k in range(1, 8)), strict=True):
            while open_ and not key.startswith(open_[-1].key):
                open_.pop()
            if kind == 0:
                if not open_ or open_[-1].key != key:
                    open_.append(_Open(key, host))
                open_[-1].add(path, verdict, rule)
                continue
            fits = [(-len(found[1]), mine.host, *found) for mine in open_ if (found := mine.longest(path))]
            best = min(fits)[2:] if fits else None
            pages.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(best and best[1])
            verdicts.append(best and best[0])
        if pages:
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict.  rules: verdict, host, path.  The length of a rule is that of host and path."""
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    rules = rules.select("verdict", lower(F.col("host")).alias("host"), "path").where(F.col("host") != "").distinct()
    rules = rules.withColumn("key", reversed_host(F.col("host")))

    order = ["key", "path", "page_id"]
    sample = urls.orderBy(F.xxhash64(*order)).select(*order).limit(SAMPLE_PER_RANGE * ranges).collect()  # bounded by the number of ranges
    sample = sorted((r["key"], r["path"], r["page_id"] if r["page_id"] is not None else -(1 << 63)) for r in sample)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (3, 2, 0)), strict=True)
            part = [bisect_right(cuts, (k, p, i if i is not None else -(1 << 63))) for k, p, i in keys]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(3).to_pylist()
            row = [(k, part) for k, key in enumerate(keys) for part in range(bisect_left(cuts, (key,)), bisect_right(cuts, (key + "\U0010ffff",)) + 1)]
            taken = pa.RecordBatch.from_struct_array(batch.to_struct_array().take(pa.array([k for k, _ in row], pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p in row], pa.int32()), *taken.columns], names=["part", *batch.schema.names])

    u = urls.mapInArrow(deal, "part int, page_id long, host string, path string, key string")
    r = rules.mapInArrow(spread, "part int, verdict string, host string, path string, key string")
    events = u.select("part", "key", F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"), "page_id", "host").unionByName(
        r.select("part", "key", F.lit(0).alias("kind"), "path", "verdict", F.concat("host", "path").alias("rule"), F.lit(None).cast("long").alias("page_id"), "host")
    )
    swept = events.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "kind", "path", "page_id").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(common.table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {', '.join(map(str, RULES))}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  row_number() OVER () AS rid FROM r),
m AS (SELECT u.rid, u.page_id, u.host, u.path, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY u.rid ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost, rpath, verdict) AS k
  FROM u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE k = 1"""
