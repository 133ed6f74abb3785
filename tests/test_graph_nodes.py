"""Node tables, and content that goes with its standard."""

from __future__ import annotations

import unicodedata

from regmodel.operators import corpus, kgraph, models


def _content(spark):
    chapters = spark.createDataFrame([("A", "A_ch1"), ("B", "B_ch1")], "standard_code string, chapter_id string")
    sections = spark.createDataFrame([("A_ch1", "A_sec1"), ("B_ch1", "B_sec1")], "chapter_id string, section_id string")
    articles = spark.createDataFrame([("A_sec1", "A_art1", "old", 1), ("A_sec1", "A_art1", "new", 2), ("B_sec1", "B_art1", "b", 1)], "section_id string, article_id string, content string, n int")
    reqs = spark.createDataFrame([("A_art1", "A_req0"), ("B_art1", "B_req0")], "article_id string, req_id string")
    return chapters, sections, articles, reqs


def test_last_write_wins(spark):
    standards = spark.createDataFrame([("A",), ("B",), ("A",)], "standard_code string")
    nodes = kgraph.build_nodes(standards, *_content(spark), order="n")
    assert {k: v.count() for k, v in nodes.items()} == {"Standard": 2, "Chapter": 2, "Section": 2, "Article": 2, "Requirement": 2}
    assert {r.article_id: r.content for r in nodes["Article"].collect()} == {"A_art1": "new", "B_art1": "b"}


def test_prune_content(spark):
    standards = spark.createDataFrame([("A",), ("B",), ("P",)], "standard_code string")
    left = kgraph.prune_content(standards, *_content(spark), spark.createDataFrame([("A",)], "standard_code string"))
    assert sorted(r.standard_code for r in left[0].collect()) == ["A", "P"]  # P owns nothing: a placeholder
    assert [sorted({r[-1] for r in df.select(key).collect()}) for df, key in zip(left[1:], ("chapter_id", "section_id", "article_id", "req_id"), strict=True)] == [["A_ch1"], ["A_sec1"], ["A_art1"], ["A_req0"]]


def test_spaces_need_a_storey(spark):
    elements = spark.createDataFrame([("M", "e", "IfcWall", "T1", "")], "model string, global_id string, ifc_type string, storey string, material string")
    spaces = spark.createDataFrame([("M", "s", "T1"), ("M", "t", "T2"), ("M", "u", "")], "model string, global_id string, storey string")
    nodes, edges = models.build_bim_graph(elements, spaces)
    assert sorted(r.key for r in nodes.where("label = 'Space'").collect()) == ["s", "t", "u"]
    assert sorted(r.dst for r in edges.where("rel = 'CONTAINS'").collect()) == ["e", "s"]


def test_decomposed_titles(spark):
    title = unicodedata.normalize("NFD", "Quy chuẩn xây dựng")
    rows = spark.createDataFrame([(1, title, "Thông tư"), (2, title, unicodedata.normalize("NFD", "Bản dịch")), (3, None, None)], "id int, title string, doc_type string")
    assert [(r.id, r.matched_by) for r in corpus.select_regulations(rows).collect()] == [(1, "Quy chuẩn xây dựng")]


def test_stats_read_stored_edges(spark):
    from regmodel.operators import kgraph

    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "x string, y string")
    stats = kgraph.graph_stats(kgraph.edges_of(rows, "A", "x", "R", "B", "y"))
    assert [tuple(r) for r in stats.collect()] == [("B", 2, "label"), ("A", 1, "label"), ("R", 2, "relationship")]
    assert "ExistingRDD" not in stats._jdf.queryExecution().executedPlan().toString()
