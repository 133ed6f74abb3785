"""What several branches of a query read is made once, and what is written is compressed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from regmodel.operators import clauses, kgraph, layouts
from regmodel.plans import layouts as plans
from regmodel.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def flat(spark):
    rows = [(s, "1", "1.1", f"1.1.{n}", "Lối đi", "Chiều rộng không nhỏ hơn 900 mm.") for s in ("A", "B") for n in (1, 2)]
    rows = spark.createDataFrame(rows, "standard_code string, chapter_number string, section_number string, article_number string, title string, content string")
    return clauses.flatten_standards(rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("standard_code").orderBy("article_number"))).where("ordinal > 0"))


def test_flattened(spark):
    """the articles' own plan runs once, not for each of the four tables."""
    assert [t.count() for t in flat(spark)] == [2, 2, 4, 4]
    assert not any("Window" in plan(t) for t in flat(spark))


def test_pruned(spark):
    """a level meets what the level above lost, and no more."""
    tables = flat(spark)
    codes = tables[0].select("standard_code").distinct()
    left = kgraph.prune_content(codes, *tables, codes.where("standard_code = 'A'"))
    assert [t.count() for t in left] == [1, 1, 1, 2, 2]
    assert [plan(t).count("Join ") for t in left[2:]] == [1, 1, 1]


def test_nodes_are_sorted_once(spark):
    """F18."""
    tables = flat(spark)
    nodes = kgraph.build_nodes(tables[0].select("standard_code").distinct(), *tables)
    assert nodes["Article"].count() == 4
    assert plan(nodes["Article"]).count(" Sort ") == 1


def test_large_source(spark, tmp_path):
    """a source is dealt over files, which are compressed and read back whole."""
    path = str(tmp_path / "standards")
    rows = spark.range(2000).select(F.concat(F.lit("QCVN "), F.col("id").cast("string")).alias("standard_code"), F.lit("a/b").alias("source_id"), F.lit("x" * 500).alias("scope"))
    readers.write_standards(rows, path)
    files = [f for f in Path(path).rglob("part-*")]
    assert {f.parent.name for f in files} == {"source_file=a_b"}
    assert all(f.name.endswith(".json.gz") for f in files) and sum(f.stat().st_size for f in files) < 200_000
    assert readers.read_standards(spark, path, lines=True).select("standard_code").distinct().count() == 2000


def test_layouts(spark, data):
    """the joins that make the fixture run once, not for each rule."""
    got = layouts.layout_violations(*plans._placed(spark, data), plans.kinds(spark))
    assert "Window" not in plan(got)
