"""The tree of a regulation."""

import pytest
from pyspark.sql import functions as F

from regmodel.operators import clauses, structure

BODY = """BỘ QUẢN LÝ
Điều 1. Ban hành quy chuẩn về bãi đỗ xe.
1 QUY ĐỊNH CHUNG
1.1 Đối tượng áp dụng
1.1.1 Quy chuẩn này áp dụng cho bãi đỗ xe
ngầm và nổi.
1.1.2 Không áp dụng cho:
a) Xe đạp;
b) Xe máy.
1.2 Từ ngữ
Các từ ngữ được hiểu như dưới đây.
2 YÊU CẦU KỸ THUẬT
(bắt buộc)
Chương này nêu các yêu cầu chung.
2.1 Đường dốc
2.1.1 Độ rộng đường dốc không nhỏ hơn 3,5 m.
2.5 m là chiều cao tối thiểu.
2.1.2 Khoảng cách không quá 1.200 mm.
2.1.2.1 Chỗ khó được phép tăng.
Bảng 2
1.1 Bãi nhỏ 2,5
3 THỰC HIỆN
3.1 Cơ quan quản lý hướng dẫn thực hiện."""


def parsed(spark, text):
    rows = [(1, i, x) for i, x in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    return lines, structure.parse_regulations(lines).orderBy("position").collect()


def test_chapters_sections_articles(spark):
    lines, rows = parsed(spark, BODY)
    a = {r.number: r for r in rows}
    assert [r.number for r in rows] == ["0", "1.1.1", "1.1.2", "1.2", "2.0", "2.1.1", "2.1.2", "3.1"]
    assert {(r.chapter, r.kind, r.chapter_title) for r in rows} == {("0", "preamble", "Phần mở đầu"), ("1", "chapter", "QUY ĐỊNH CHUNG"), ("2", "chapter", "YÊU CẦU KỸ THUẬT (bắt buộc)"), ("3", "chapter", "THỰC HIỆN")}
    assert a["0"].content == "BỘ QUẢN LÝ Điều 1. Ban hành quy chuẩn về bãi đỗ xe."
    assert a["1.1.1"].section_title == "Đối tượng áp dụng" and a["1.1.1"].content == "1.1.1 Quy chuẩn này áp dụng cho bãi đỗ xe ngầm và nổi."
    assert a["1.1.2"].content.split("\n") == ["1.1.2 Không áp dụng cho:", "a) Xe đạp;", "b) Xe máy."]
    assert a["1.2"].content == "1.2 Từ ngữ Các từ ngữ được hiểu như dưới đây." and a["1.2"].title == "Từ ngữ"
    assert a["2.0"].content == "Chương này nêu các yêu cầu chung." and a["2.0"].section == "2.0"
    assert a["2.1.1"].content.endswith("\n2.5 m là chiều cao tối thiểu.")
    assert a["2.1.2"].content == "2.1.2 Khoảng cách không quá 1.200 mm.\n2.1.2.1 Chỗ khó được phép tăng. Bảng 2\n1.1 Bãi nhỏ 2,5".replace(". Bảng", ".\nBảng")
    assert a["2.1.1"].title == "Độ rộng đường dốc không nhỏ hơn 3,5 m." and a["3.1"].title == "Cơ quan quản lý hướng dẫn thực hiện."
    size = lambda df, c: df.select(F.sum(F.length(F.regexp_replace(c, r"\s", "")))).first()[0]
    given = size(lines, "line")
    heads = sum(len("".join(x.split())) for x in ("1QUY ĐỊNH CHUNG", "1.1Đối tượng áp dụng", "2YÊU CẦU KỸ THUẬT", "(bắt buộc)", "2.1Đường dốc", "3THỰC HIỆN"))
    kept = sum(len("".join(r.content.split())) for r in rows)
    assert kept + heads == given  # headings live on as titles, all else as content


def test_annex_without_clauses(spark):
    filler = "\n".join(f"Ghi chú thêm {i}." for i in range(9))
    _, rows = parsed(spark, f"{BODY}\n{filler}\nPHỤ LỤC K (tham khảo)\nSƠ ĐỒ MINH HỌA\nHình K.1 Sơ đồ bãi đỗ.\nPhụ lục A nêu ở trên.")
    assert rows[-1].number == "K.0" and rows[-1].kind == "annex" and rows[-1].chapter_title == "Phụ lục K (tham khảo) SƠ ĐỒ MINH HỌA"
    assert rows[-1].content == "Hình K.1 Sơ đồ bãi đỗ.\nPhụ lục A nêu ở trên."
    assert rows[-2].number == "3.1" and "Ghi chú thêm 8." in rows[-2].content


def test_annex_with_clauses_and_a_reference(spark):
    _, rows = parsed(spark, BODY + "\nPHỤ LỤC B (quy định)\nYÊU CẦU THÊM\nB.1 Quy định chung\nB.1.1 Nội dung được áp dụng cùng\nPhụ lục C. Nội dung này nối câu trước.")
    assert (rows[-1].chapter, rows[-1].kind, rows[-1].chapter_title, rows[-1].section_title) == ("B", "annex", "Phụ lục B (quy định) YÊU CẦU THÊM", "Quy định chung")
    assert "Phụ lục C. Nội dung này" in rows[-1].content


def test_table_rows_in_an_annex_are_no_chapters(spark):
    filler = "\n".join(f"Dòng bảng {i}." for i in range(12))
    _, rows = parsed(spark, f"{BODY}\nPHỤ LỤC A (tham khảo)\n{filler}\n4 Phòng họp, phòng khách\n4.1 Phòng họp lớn 300 lux\n5.1 Phòng khách 200 lux")
    assert [r.chapter for r in rows if r.kind != "chapter"] == ["0", "A"] and "4.1 Phòng họp lớn 300 lux" in rows[-1].content


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_batches(spark, batch):
    """A document over many batches, and many in one, give the same rows; no document is mixed with another."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = spark.createDataFrame([(d, i, x) for d in range(5) for i, x in enumerate(BODY.split("\n"))], "doc_id int, line_no long, line string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = structure.parse_regulations(lines).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by = {d: sorted((r.position, r.number, r.content, r.chapter_title) for r in rows if r.doc_id == d) for d in range(5)}
    assert len(by[0]) == 8 and all(by[d] == by[0] for d in by)


def test_nothing(spark):
    lines = spark.createDataFrame([(1, 1, "Không có mục.")], "doc_id long, line_no int, line string")
    assert [(r.number, r.content) for r in structure.parse_regulations(lines).collect()] == [("0", "Không có mục.")]
    assert structure.parse_regulations(lines.limit(0)).count() == 0
    assert clauses.clause_candidates(lines).count() == 0
