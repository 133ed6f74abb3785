"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from regmodel.llm import manifest
from tests import compare


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and for each leaf its (left, right) by level."""
    paths = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            left, right = (level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else "")
            paths[k].append((left, right))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def wanted(docs):
    """Rows of the query; docs: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append((d[0] is not None, d[0] or 0, leaf_of(d), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subs = [], {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        subs[g] = tree([x[2] for x in groups[g]])
    root, tops = tree([subs[g][0] for g in names])
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, d), path in zip(groups[g], subs[g][1], strict=True):
            bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
            h = leaf_of((*d[:3], d[3] + 1, d[4])) if bad else leaf
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((d[0], leaf, subs[g][0], root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(spark, tmp_path, docs, name):
    spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", leaf string, tree int").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in manifest.query(spark, f"{tmp_path}/{name}").collect()), key=repr)


def made(n, langs, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["a", None, "ü:1"]), rng.choice(langs), rng.choice([None, 3, 70]), rng.choice([None, "", "tä xt", "1:a"])) for i in rng.sample(range(10 * n), n)]
    return docs + docs[: n // 5] + [(None, None, None, None, None)] * 3


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_trees(spark, tmp_path, monkeypatch, bits):
    """Several tiers, languages with one leaf, repeated rows, null ids and languages."""
    monkeypatch.setattr(manifest, "BITS", bits)
    docs = made(40, ["en", "de", None, "", "é", "Z"], bits) + [(5000, "s", "one", 1, "t" * 100_000)]
    assert got(spark, tmp_path, docs, "many") == wanted(docs)


def test_small_tables(spark, tmp_path):
    one = [(14, "s", "en", 2, "hi")]
    rows = got(spark, tmp_path, one, "one")
    assert rows == wanted(one) and rows[0][2] == rows[0][3] == rows[0][1] and rows[0][4] == sha("")
    three = [(i, "s", None, 2, "hi") for i in range(3)]
    assert got(spark, tmp_path, three, "three") == wanted(three)
    assert got(spark, tmp_path, [], "none") == []


def test_query_and_sql(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    frame = manifest.query(spark, data).toPandas()
    rows = sorted(map(tuple, frame.itertuples(index=False)), key=repr)
    assert rows == wanted(docs)
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 3
    assert compare.rows(frame) == compare.rows(compare.database(data).sql(manifest.ORACLE).df())


def test_a_changed_proof_or_leaf_fails(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(21)], SCHEMA)
    rows = manifest.build(docs, manifest.digest(*[F.col(c) for c in manifest.FIELDS]), "lang", "doc_id")
    wrong = F.transform("path", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right")))
    seen = rows.select((manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"), (manifest.fold(F.col("leaf"), wrong) == F.col("root")).alias("swapped"), F.size("path").alias("n")).collect()
    assert all(r.good and not r.swapped and r.n == 5 for r in seen) and len(seen) == 21
