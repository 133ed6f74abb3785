"""Quality rules and sharding against plain Python."""

import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from regmodel.llm import quality, sharding

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the sun goes down behind the old red barn\nyes\nyes\n\n \n"),
    (2, "a b c d e f g h " * 6), (3, None), (4, ""), (5, "#tag $5 <b> 100% | x & y *"), (6, "one"), (6, "one"), (None, "w " * 25), (7, "\u00a0nbsp is\u2003a word\x0bvt\x0cff\rcr ü"),
    (8, " ".join(f"u{i}" for i in range(50)) + " " + " ".join(f"u{i}" for i in range(10, 30))), (9, "x\r\nx\r\nx y\nX"),
]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_measures(spark, data):
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, llr int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, 1), (2, 0), (3, None)], "doc_id long, quality int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs, labels).collect())
    assert got == Counter((i, *measures(t)) for i, t in TEXTS)
    real = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    for r in quality.judge(real, spark.read.parquet(f"{data}/labels.parquet")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(texts[r.doc_id])
        assert r.kept <= (not r.base_failed)


def test_ratio(spark):
    """The same counts and scores by Spark's hash of each word and pair, row by row."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa dd"), (3, "ee")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    table = quality.ratios(docs, quality.trusted(labels))
    h = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("aa", "bb", "cc", "dd", "ee")}
    pair = lambda a, b: spark.range(1).select(F.xxhash64(F.lit(h[a]), F.lit(h[b]))).first()[0] % quality.BUCKETS
    good = [h["aa"] % quality.BUCKETS, h["bb"] % quality.BUCKETS, h["cc"] % quality.BUCKETS, pair("aa", "bb"), pair("bb", "cc")]
    raw = Counter([*good, h["aa"] % quality.BUCKETS, h["dd"] % quality.BUCKETS, pair("aa", "dd"), h["ee"] % quality.BUCKETS])
    n, m = sum(raw.values()) + quality.BUCKETS, len(good) + quality.BUCKETS
    want = [math.log((Counter(good)[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(quality.BUCKETS)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(table, want))
    score = quality.judge(docs, labels).where("doc_id = 1").first().llr
    assert abs(score - sum(want[b] for b in good) / 5) < 1e-12


def test_keep_good(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in TEXTS], "doc_id long, text string, kept int, row_ int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, cut=-99.0)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in TEXTS if not measures(t)[-1])
    assert quality.keep_good(docs.limit(0), labels).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000))
def test_permutation(n):
    assert sorted(sharding.permute(i, n) for i in range(n)) == list(range(n))


def test_shards(spark):
    rows = [(i if i % 9 else None, "t" * (i % 5) if i % 4 else None, 1) for i in range(500)] + [(7, "same", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.assign(docs, 7).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 503 and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for r in got:
        p = sharding.permute(r.row_number, 503)
        assert (r.shard, r.slot, r.law, r.grown_shard) == (p % 7, p // 7, "rows", None)
    order = sorted(got, key=lambda r: r.row_number)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in order]
    assert keys == sorted(keys) and [r.row_number for r in order] == list(range(503))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 7} >= {(20, zlib.crc32(b"same"))}
    assert sharding.assign(docs.limit(0)).count() == 0


def test_verdicts_of_all_documents(spark, data):
    """Counts, ratios, scores and verdicts of every document by plain Python and the hash's reference implementation."""
    import xxhash

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality == 1}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    buckets = {}
    for d, text in docs.items():
        h = [one(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        buckets[d] = [x % quality.BUCKETS for x in h] + [signed(long(b, long(a, 42))) % quality.BUCKETS for a, b in zip(h, h[1:])]
    raw, target = Counter(), Counter()
    for d, b in buckets.items():
        raw.update(b)
        target.update(b if d in good else ())
    n, m = raw.total() + quality.BUCKETS, target.total() + quality.BUCKETS
    lam = [math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(quality.BUCKETS)]
    for r in quality.query(spark, data).collect():
        score = sum(lam[b] for b in buckets[r.doc_id]) / len(buckets[r.doc_id]) if buckets[r.doc_id] else 0.0
        assert abs(r.llr - score) < 1e-9
        assert r.kept == (not measures(docs[r.doc_id])[-1] and score >= quality.CUT)


def test_all_trusted_rows_count(spark, monkeypatch):
    """However small the map of ids is, and however often an id comes."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"w{i % 5} x{i}") for i in range(300)] + [(5, "again w1")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 2, "doc_id long, quality int")
    want = quality.ratios(docs, quality.trusted(labels))
    monkeypatch.setattr(quality, "MAP_BITS", 6)
    assert quality.ratios(docs, quality.trusted(labels)) == want
    assert [math.isclose(x, 0) for x in quality.ratios(docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NOT NULL").selectExpr("doc_id AS trusted_id").distinct())] == [True] * quality.BUCKETS
