"""Lines of a regulation are joined while they are read."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pytest

from regmodel.functions.arrow import values
from regmodel.operators import clauses, structure

from .test_structure import BODY

KEY = ["doc_id", "chapter", "kind", "clause", "heads", "text", "first_line", "n_lines", "head"]
MORE = "\nmột hai.\r\nba bốn\n- năm\nPHỤ LỤC B (quy định)\nYÊU CẦU THÊM\nHình 1.\nB.1 Quy định\nB.1.1 Nội dung\n4.1 Sau phụ lục\n12.3 Xa\nPHỤ LỤC C\nđuôi"


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_pieces(spark, batch):
    """what is shuffled again is a row for each clause, body and title, the same as from the lines one by one."""
    lines = spark.createDataFrame([(d, i, x) for d in ("a", "b") for i, x in enumerate(((BODY if d == "a" else "Lời đầu") + MORE).split("\n"))], "doc_id string, line_no int, line string")
    skeleton = clauses.skeleton_of(lines)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = structure.read_pieces(lines, skeleton).select(*KEY).collect()
        want = structure._pieces(structure.place_lines(lines, skeleton)).select(*KEY).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 15 < len(got) < lines.count() - 15


def test_values():
    for column in (pa.array(["a", None, "Đ"]), pa.array([1, 2]), pa.array([1, None], pa.int32()), pa.array([True, False]), pa.array([True, None]), pa.array([1.5, None]), pa.array([dt.datetime(2026, 1, 1)]), pa.array([["x"], None]), pa.array([], pa.string())):
        assert values(column) == column.to_pylist() and list(map(type, values(column))) == list(map(type, column.to_pylist()))
