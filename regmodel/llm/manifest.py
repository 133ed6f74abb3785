"""Operator 12: Merkle manifest of a dataset by nested-struct rollup.

Each row is a leaf: the sha256 of its fields, each with its length.  The leaves of a group ascend by id; two at a time become
the sha256 of their digests, until one node is left, the group's subroot; the subroots, by group, likewise give the root.

Ranks come from one sort in ranges: a row's position in its range, and what the ranges before hold of its group.  The
last ``BITS`` binary digits of a rank are columns; within a block (the rows with equal further digits) they are grouped
away one after another, and each time the structs of two neighbours are nested into the struct of their parent.  A block
has 2 ** BITS leaves at most and is dealt out once: all its levels are grouped where it lies.  Blocks are the leaves of the next
tier, until a tier has one block a group.  On the way back each block meets what stands above it (two rows that are
grouped, no join), and nested transforms walk down its struct, gather the siblings and explode them to one proof a leaf.

A proof is a list of (left, right): the digests to the left and to the right of a node, either of them empty.  ``fold``
gives the root that a leaf and its proof lead to.

Defined cases: a null field is ``-``; rows without a group are a group, the first one; rows of one id ascend by their digests (null ids
first), and equal leaves are interchangeable; a single leaf is its subroot, a single subroot the root; an empty table gives no rows; extra
columns are ignored; a very long text is digested where it is read and not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits of a rank that are grouped away within a block.
BITS = 8
PATH = "array<struct<left:string,right:string>>"


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of each column, with its length in bytes, one after the other."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (tree, item struct with id and leaf) with rank, within the tree, and depth, the levels above its leaves."""
    # equal leaves are parted by their place in the input, so that however many there are, they fill many ranges
    keyed = common.materialize(leaves.select("tree", "item", F.monotonically_increasing_id().alias("tie")), "digests")  # texts are read once
    order = ["tree", F.col("item.id").asc_nulls_first(), "item.leaf", "tie"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "item", F.monotonically_increasing_id().alias("at"))
    placed = common.materialize(placed.withColumn("part", F.shiftright("at", 33)), "leaves")
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("tree").orderBy("part")) - F.col("n")  # a row for each range that a tree reaches into
    parts = common.materialize(parts.select("tree", "part", "first", ahead.alias("ahead"), F.sum("n").over(W.partitionBy("tree")).alias("total")), "ranges")
    depth = F.length(F.bin(F.col("total") - 1)) * (F.col("total") > 1).cast("int")
    return placed.join(parts, ["tree", "part"]).select("tree", "item", (F.col("at") - F.col("first") + F.col("ahead")).alias("rank"), depth.cast("int").alias("depth"))


def _tier(nodes: DataFrame, level: int) -> DataFrame:
    """tree, block, depth, node: the blocks of nodes (tree, rank, depth, node struct with hash), whose level above the leaves is given."""
    digits = [f"d{k}" for k in range(BITS)]
    rows = nodes.select("tree", F.shiftright("rank", BITS).alias("block"), "depth", *[F.shiftright("rank", k).bitwiseAND(1).cast("int").alias(d) for k, d in enumerate(digits)], "node")
    rows = rows.repartition("tree", "block")
    for k, d in enumerate(digits):
        keys = ["tree", "block", "depth", *digits[k + 1 :]]
        rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(d, "node"))), lambda x: x["node"]).alias("kids"))
        parent = F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256)
        rows = rows.select(*keys, F.struct(F.when(F.col("depth") > level + k, parent).otherwise(F.col("kids")[0]["hash"]).alias("hash"), "kids").alias("node"))
    return common.materialize(rows, f"tier-{level}")


def _proofs(node: Column, path: Column, depth: Column, level: int, k: int) -> Column:
    """(item, path) of each leaf below a node that stands k levels above its block's leaves; path: from the node up."""
    if not k:
        return F.array(F.struct(node["item"].alias("item"), path.alias("path")))
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        left = F.when(i == 1, kids[0]["hash"]).otherwise("")
        right = F.when((i == 0) & (F.size(kids) > 1), F.get(kids, F.lit(1))["hash"]).otherwise("")
        here = F.when(depth > level + k - 1, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), path)).otherwise(path)
        return _proofs(kid, here, depth, level, k - 1)

    return F.flatten(F.transform(kids, below))


def _unfold(blocks: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """tree, item, path, subroot, root of each leaf of the blocks; above: tree, block, path, subroot, root of each block."""
    lacking = [F.lit(None).cast(t).alias(c) for c, t in (("path", PATH), ("subroot", "string"), ("root", "string"))]
    kind = blocks.schema["node"].dataType
    both = blocks.select("tree", "block", "depth", "node", *lacking).unionByName(above.select("tree", "block", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(kind).alias("node"), "path", "subroot", "root"))
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("depth", "node", "path", "subroot", "root")])
    return met.select("tree", F.explode(_proofs(F.col("node"), F.col("path"), F.col("depth"), level, BITS)).alias("x"), "subroot", "root").select("tree", "x.item", "x.path", "subroot", "root")


def _rollup(nodes: DataFrame, tops) -> DataFrame:
    """tree, item, path, subroot, root of every leaf.  nodes: tree, item, rank, depth; tops: from (tree, hash) of all trees to tree, path, subroot and root."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    tiers, level = [], 0
    rows = nodes.select("tree", "rank", "depth", F.struct(F.col("item.leaf").alias("hash"), "item").alias("node"))
    while not tiers or level < deepest:
        tiers.append(_tier(rows, level))
        rows = tiers[-1].select("tree", F.col("block").alias("rank"), "depth", F.struct(F.col("node.hash").alias("hash"), F.struct("block").alias("item")).alias("node"))
        level += BITS
    above = tops(tiers[-1].select("tree", F.col("node.hash").alias("hash"))).withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(tiers))):
        out = _unfold(tiers[k], above, k * BITS)
        if k:
            above = common.materialize(out.select("tree", F.col("item.block").alias("block"), "path", "subroot", "root"), "proofs")
    return out


def build(rows: DataFrame, leaf: Column, group: str, order: str, *payload: Column) -> DataFrame:
    """id, leaf, (payload), path, subroot, root of each row."""
    # a null group comes before all others, which keep their order
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.struct(F.col(f"`{order}`").alias("id"), leaf.alias("leaf"), *payload).alias("item"))

    def tops(subroots: DataFrame) -> DataFrame:
        top = ranked(subroots.select(F.lit("").alias("tree"), F.struct(F.col("tree").alias("id"), F.col("hash").alias("leaf")).alias("item")))
        none = F.array().cast(PATH)
        out = _rollup(top, lambda root: root.select("tree", none.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root")))
        return common.materialize(out.select(F.col("item.id").alias("tree"), "path", F.col("item.leaf").alias("subroot"), "root"), "subroots")

    return _rollup(ranked(leaves), tops).select("item.*", "path", "subroot", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    columns = [F.col(c) for c in FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed & F.col("n_chars").isNotNull(), digest(*[c + 1 if name == "n_chars" else c for name, c in zip(FIELDS, columns, strict=True)]))
    rows = build(docs, digest(*columns), "lang", "doc_id", tampered.alias("tampered"))
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL unrolls, within a language and above the languages.
_LEVELS, _TOP = 18, 4


def _tree(source: str, name: str, levels: int) -> list[str]:
    """Tables name_0 to name_levels of (g, i, h, n) from source (g, i, h): the nodes of each level, n of them in the tree."""
    out = [f"{name}_0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {source})"]
    for k in range(levels):
        out.append(f"{name}_{k + 1} AS (SELECT g, i // 2 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 1) // 2 AS n FROM {name}_{k} GROUP BY g, i // 2, n)")
    return out


def _climb(source: str, name: str, levels: int, out: str) -> list[str]:
    """Tables that carry proof (siblings so far) and t (the digest so far) of source (id columns, g, i, proof, t) up the tree."""
    steps = []
    for k in range(levels):
        here = f"{name}_{k}"
        steps.append(
            f"{out}_{k} AS (SELECT c.* REPLACE (CASE WHEN m.n > 1 THEN c.proof || coalesce(s.h, '') ELSE c.proof END AS proof,"
            f" CASE WHEN m.n > 1 THEN sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.t ELSE c.t || coalesce(s.h, '') END) ELSE c.t END AS t, c.i // 2 AS i)"
            f" FROM {source if not k else f'{out}_{k - 1}'} c JOIN {here} m ON m.g = c.g AND m.i = c.i LEFT JOIN {here} s ON s.g = c.g AND s.i = xor(c.i, 1))"
        )
    return steps


def _oracle() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: f"sha256({' || '.join(part(n if c == 'n_chars' else c) for c in FIELDS)})"
    shift = "c"
    for _ in range(8):
        shift = f"(xor({shift} >> 1, ({shift} & 1) * 3988292384))" if shift == "c" else f"list_transform([{shift}], lambda c: xor(c >> 1, (c & 1) * 3988292384))[1]"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    steps = [
        f"t AS (SELECT list_transform(range(0, 256), lambda c: {shift}) AS tab)",
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS h, CASE WHEN {crc} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('(n_chars + 1)')} END AS bad FROM documents, t)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d)",
        *_tree("l", "a", _LEVELS),
        f"r AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS lang FROM a_{_LEVELS})",
        *_tree("r", "b", _TOP),
        "c AS (SELECT doc_id, h AS leaf, g, i, '' AS proof, coalesce(bad, h) AS t FROM l)",
        *_climb("c", "a", _LEVELS, "p"),
        f"u AS (SELECT p.* REPLACE ('' AS g, r.i AS i), r.h AS subroot FROM p_{_LEVELS - 1} p JOIN r ON r.lang = p.g)",
        *_climb("u", "b", _TOP, "q"),
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = b.h AS verified FROM q_{_TOP - 1}, b_{_TOP} b"


ORACLE = _oracle()
