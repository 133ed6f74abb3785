"""Requirements of many topics: few topics shuffle no text, many give the same rows."""

from __future__ import annotations

from regmodel.operators import kgraph, matching


def test_topics(spark, monkeypatch):
    """F17."""
    articles = spark.createDataFrame([("A", "a1", "Lối đi 1", "x"), ("A", "a2", "lối đi 12", "Cửa"), ("B", "b1", "Sàn", None), ("B", "b2", None, "CỬA đi"), ("B", "b3", "", "")], "standard_code string, article_id string, title string, content string")
    reqs = spark.createDataFrame([("a1", 0), ("a1", 1), ("a2", 0)], "article_id string, req_no int")
    topics = spark.createDataFrame([("Lối đi 1",), ("LỐI ĐI 1",), ("cửa",), ("cửa",), ("đi 12",), ("",), (None,), ("mái",)], "topic string")
    one = ("Lối đi 1", "LỐI ĐI 1")
    want = sorted([(t, "A", "a1", n) for t in one for n in (0, 1)] + [(t, "A", "a2", 0) for t in (*one, "cửa", "đi 12")] + [("cửa", "B", "b2", None)], key=repr)
    rows = lambda: sorted((tuple(r) for r in kgraph.requirements_for_topics(articles, reqs, topics).select("topic", "standard_code", "article_id", "req_no").collect()), key=repr)
    plan = kgraph.requirements_for_topics(articles, reqs, topics)._jdf.queryExecution().executedPlan().toString()
    assert rows() == want and "slice" not in plan and "SortMergeJoin" in plan
    monkeypatch.setattr(matching, "SLICE", 2)
    assert rows() == want
    assert "slice" in kgraph.requirements_for_topics(articles, reqs, topics)._jdf.queryExecution().executedPlan().toString()
    assert kgraph.requirements_for_topics(articles, reqs, topics.limit(0)).count() == 0
