"""Steps over lines that group by document shuffle them once."""

from __future__ import annotations

import re

from regmodel.operators import clauses, corpus, structure


def shuffles(df) -> int:
    """Exchanges of a plan that has not run."""
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_tree(spark):
    """F8: what follows the reading of the lines."""
    placed = spark.createDataFrame([(1, 1, "Một.", "1", "chapter", "1.1", "clause")], "doc_id long, line_no long, line string, chapter string, kind string, clause string, role string")
    assert shuffles(structure.fold(placed)[1]) == 1


def _read(spark):
    lines = spark.createDataFrame([(1, 1, "Chương 1 CHUNG"), (1, 2, "1.1 Một"), (1, 3, "hai")], "doc_id long, line_no long, line string")
    return lines, spark.createDataFrame([(1, 2, "1.1", "Một")], "doc_id long, line_no long, number string, rest string")


def test_assigned_lines(spark):
    """F35."""
    got = clauses.assign_lines(*_read(spark))
    assert shuffles(got) == 1
    assert sorted(got.collect()) == [(1, 1, "Chương 1 CHUNG", "0", "0"), (1, 2, "Một", "1.1", "1"), (1, 3, "hai", "1.1", "1")]


def test_chapter_titles(spark):
    """F33."""
    got = clauses.chapter_titles(*_read(spark))
    assert shuffles(got) == 1
    assert [tuple(r) for r in got.collect()] == [(1, "1", "chapter", "CHUNG", 1, 1)]


def test_split_numbers(spark):
    """one order of the lines serves all windows."""
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(["1.1", "2.2", "Hai", "1.3", "Ba", "4.4", "5.5", "6.6", "Sáu"])], "doc_id long, line_no long, line string")
    got = corpus.join_split_numbers(lines)
    assert got._jdf.queryExecution().executedPlan().toString().count(" Sort ") == 1
    assert [r.line for r in got.orderBy("line_no").collect()] == ["1.1", "2.2 Hai", "1.3 Ba", "4.4", "5.5", "6.6 Sáu"]
