"""Literal cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regmodel.operators import chunks, clauses, corpus, kgraph, logs, models, retrieval, specs, vectors
from regmodel.sources import readers
from regmodel.streaming import state


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("1.500", 1500.0), ("1,5", 1.5), ("2.5", 2.5), ("12.000,5", 12000.5)])
def test_numbers(spark, text, value):
    assert one(spark, clauses.vn_number(F.col("t")), t=text) == value


def test_requirements(spark):
    df = spark.createDataFrame([("1.1", "Lối đi. Chiều rộng không nhỏ hơn 500 mm; diện tích tối thiểu 30 m2 và tối đa 1.500 mm cho cửa.")], "article_number string, content string")
    got = [(r.req_no, r.type, r.min_value, r.max_value, r.unit) for r in clauses.extract_requirements(df).orderBy("req_no").collect()]
    assert got == [(0, "minimum_value", 500.0, None, "mm"), (1, "minimum_value", 30.0, None, "m²"), (2, "maximum_value", None, 1500.0, "mm")]
    first = clauses.extract_requirements(df).orderBy("req_no").first()
    assert first.description.startswith("Điều 1.1: Chiều rộng không nhỏ hơn 500 mm")


REGULATION = """QUY CHUẨN
1 QUY ĐỊNH CHUNG
1.1 Phạm vi
1.1.1 Quy chuẩn này quy định về nhà ở.
2.5 m là chiều cao
1.1.2 Áp dụng cho nhà mới.
2.1 Yêu cầu
2.1.1 Chiều rộng không nhỏ hơn 900 mm.
1.1 2,5
2.1.2 Chiều cao không quá 3 m.
3.1 Tổ chức thực hiện."""


def test_skeleton(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(REGULATION.split("\n"))], "doc_id long, line_no long, line string")
    found = clauses.clause_skeleton(clauses.annex_cut(lines, clauses.clause_candidates(lines)))
    assert [r.number for r in found.orderBy("line_no").collect()] == ["1.1", "1.1.1", "1.1.2", "2.1", "2.1.1", "2.1.2", "3.1"]
    assigned = clauses.assign_lines(lines, found).orderBy("line_no").collect()
    assert assigned[0].clause == "0" and assigned[4].clause == "1.1.1" and assigned[8].clause == "2.1.1"


def test_chapter_titles(spark):
    text = "Mở đầu\n1 QUY ĐỊNH CHUNG\nCỦA QUY CHUẨN\n(quy định)\nlời dẫn\n1.1 Phạm vi\nChương 2. Yêu cầu kỹ thuật\n2.1 Lối đi\nxa\nPHỤ LỤC A (quy định)\nA.1 Bảng số"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, line_no long, line string")
    got = clauses.chapter_titles(lines, clauses.clause_skeleton(clauses.clause_candidates(lines))).orderBy("first_line").collect()
    assert [(r.chapter, r.kind, r.title, r.first_line, r.last_line) for r in got] == [("1", "chapter", "QUY ĐỊNH CHUNG CỦA QUY CHUẨN (quy định)", 1, 3), ("2", "chapter", "Yêu cầu kỹ thuật", 6, 6), ("A", "annex", "Phụ lục A (quy định)", 9, 9)]


def test_order_key():
    assert sorted(["B.1", "Đ.1", "D.1", "10.1", "2.1", "E.1"], key=clauses.order_key) == ["2.1", "10.1", "B.1", "D.1", "Đ.1", "E.1"]


def test_split_numbers(spark):
    text = ["1.1", "Phạm vi", "2.1", "2.5 m", "3", "QUY ĐỊNH CHUNG", "Mục lục ........ 12", "1.2", "1.3", "Tiếp"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_no long, line string")
    got = [r.line for r in corpus.join_split_numbers(lines).orderBy("line_no").collect()]
    assert got == ["1.1 Phạm vi", "2.1", "2.5 m", "3 QUY ĐỊNH CHUNG", "1.2", "1.3 Tiếp"]


def test_split_text_loses_nothing(spark):
    text = "\n".join(["Câu một. " * 30, "x" * 3000, "ngắn", "Câu hai; " * 400])
    rows = chunks.split_text(spark.createDataFrame([(text,)], "t string"), "t", 200).orderBy("part").collect()
    assert all(len(r.piece) <= 200 for r in rows) and rows[0].parts == len(rows)
    assert "".join("".join(r.piece.split()) for r in rows) == "".join(text.split())


def test_format_requirements(spark):
    schema = "array<struct<description:string,values:string,min_value:double,max_value:double,unit:string,condition:string,exception:string>>"
    df = spark.createDataFrame([([("Rộng", '{"a":"1","b":{"c":2}}', 1.5, None, "m", "khi mới", None)],)], f"r {schema}")
    text = df.select(chunks.format_requirements(F.col("r")).alias("t")).first().t
    assert text == "Yêu cầu kỹ thuật:\n• Rộng\n  - a: 1\n  - b: c: 2\n  Giá trị tối thiểu: 1.5 m\n  Điều kiện: khi mới"


def test_uuid5(spark):
    import uuid

    name = "qcvn|doc-1|3"
    assert one(spark, vectors.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_upsert_and_prune(spark):
    index = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("n1", None)], "id string, source_id string")
    new = spark.createDataFrame([("a9", "a"), ("n1", None)], "id string, source_id string")
    out = vectors.upsert_by_source(index, new)
    assert sorted(r.id for r in out.collect()) == ["a9", "b1", "n1"]
    assert sorted(r.id for r in vectors.upsert_by_source(out, new).collect()) == ["a9", "b1", "n1"]
    assert [r.id for r in vectors.prune_sources(out, ["b"]).collect()] == ["b1"]
    with pytest.raises(ValueError):
        vectors.prune_sources(out, [])


@pytest.mark.parametrize(("query", "reason"), [("MATCH (n) RETURN n", None), ("", "empty"), ("MATCH (n) DETACH DELETE n RETURN n", "keyword"), ("MATCH (n) RETURN n; DROP x", "multiple"), ("DROP INDEX x", "start"), ("MATCH (n:Dataset) RETURN n", None), ("MATCH (n)", "no_return")])
def test_guard(spark, query, reason):
    row = kgraph.audit_generated_queries(spark.createDataFrame([(query,)], "q string"), "q").first()
    assert (row.ok, row.reason) == (reason is None, reason)


@pytest.mark.parametrize(("value", "label"), [(0.85, 0), (0.84, 1), (0.7, 1), (0.69, 2), (0.5, 2), (0.49, 3), (0.3, 3), (0.29, 4)])
def test_labels(spark, value, label):
    assert one(spark, retrieval.confidence_label(F.col("v")), v=value) == retrieval.CONFIDENCE[label][1]


def test_rate_limits(spark):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    hits = spark.createDataFrame([(i, "k", at(s)) for i, s in enumerate((0, 10, 31))], "event_id long, k string, ts timestamp")
    for f in (logs.rate_limit_fixed, logs.rate_limit_sliding):
        got = [(r.accepted, round(r.retry_after, 6)) for r in f(hits, 1, 30.0).orderBy("event_id").collect()]
        assert got == [(True, 0.0), (False, 20.0), (True, 0.0)]


def test_stream_equals_batch(spark, data):
    from regmodel.plans import logs as plans

    key = lambda df: sorted((r.event_id, r.accepted, round(r.retry_after, 3)) for r in df.collect())
    assert key(plans.s2(spark, data)) == key(plans.l10(spark, data))


def test_file_kinds(spark):
    rows = [(b"%PDF-1.4",), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..",), (b"PK..word/document.xml..",), (b"PK..other",), (b"<html>",)]
    assert [r.kind for r in readers.with_kind(spark.createDataFrame(rows, "content binary")).collect()] == ["pdf", "doc", "docx", None, None]


def test_step_files(spark, tmp_path):
    (tmp_path / "a.ifc").write_text("ISO-10303-21;\n#1=IFCWALL('g;x',#2,$,'T\\X2\\01B0\\X0\\\u1eddng');\n#2=IFCOWNERHISTORY(#3);\nEND;")
    rows = readers.read_step(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r["class"], r.refs) for r in rows] == [(1, "IFCWALL", [2]), (2, "IFCOWNERHISTORY", [3])]
    assert rows[0].args == "'g;x',#2,$,'T\u01b0\u1eddng'"


def test_standards_round_trip(spark, tmp_path):
    row = spark.createDataFrame([("QCVN 1", "a", "vbpl:1")], "standard_code string, standard_name string, source_id string")
    readers.write_standards(row, str(tmp_path / "out"), row, str(tmp_path / "report"))
    back = readers.read_standards(spark, str(tmp_path / "out" / "*"))
    assert back.first().standard_code == "QCVN 1"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"standard_name": "no code"}')
    with pytest.raises(ValueError):
        readers.read_standards(spark, str(tmp_path / "bad"))


def test_replace_partitions(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "v int, source_id string")
    readers.replace_partitions(make([(1, "a"), (2, "b")]), str(tmp_path / "t"))
    readers.replace_partitions(make([(3, "a")]), str(tmp_path / "t"))
    assert sorted((r.v, r.source_id) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "b"), (3, "a")]


def test_catalog_and_models(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"metadata": {}, "documents": [{"id": "1", "docNum": "a"}, {"id": "2", "docNum": "b"}]}')
    assert readers.read_catalog(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "m.json").write_text('{"filename": "f", "elements": [{"global_id": "1", "ifc_type": "IfcWall"}]}')
    assert models.explode_models(readers.read_parsed_models(spark, str(tmp_path / "m.json")))[1].count() == 1
    readers.write_foundation_json(specs.foundation_supports(spark.createDataFrame([(1, 60000.0, 2, 12000.0, 1500.0)], "spec_id int, total_length double, num_spans int, deck_width double, girder_height double")), str(tmp_path / "f"))
    assert len(spark.read.json(str(tmp_path / "f")).first().supports) == 3
    readers.append_audit(spark.createDataFrame([(1, "a", ("x",), "ip", "t")], "user_id int, action string, detail struct<m:string>, ip string, created_at string"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).first().detail == '{"m":"x"}'


def test_refresh():
    done: list[str] = []
    ok = [("ingest", lambda: done.append("i")), ("graph", lambda: done.append("g"))]
    report, saved = state.refresh(ok, lambda: "f1", {})
    assert [r["status"] for r in report] == ["ok", "ok"] and saved == {"fingerprint": "f1"}
    report, _ = state.refresh(ok, lambda: "f1", saved)
    assert {r["status"] for r in report} == {"skipped"} and done == ["i", "g"]
    report, _ = state.refresh(ok, lambda: "f1", saved, force=True)
    assert len(done) == 4
    state.refresh(ok, lambda: "f1", saved, index_empty=True)
    assert len(done) == 6

    def fail():
        raise RuntimeError("no graph")

    report, after = state.refresh([ok[0], ("graph", fail), ("last", fail)], lambda: "f2", saved)
    assert [r["status"] for r in report] == ["ok", "failed"] and after == saved


def test_refresh_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"source_id": "a", "v": 1}')
    put = lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))
    files = spark.readStream.schema("source_id string, v int").json(str(tmp_path / "in"))
    state.refresh_stream(files, put, str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_chapter_number_takes_no_clause(spark):
    rows = [(1, 0, "1"), (1, 1, "1.1 PHẠM VI ÁP DỤNG"), (1, 2, "2"), (1, 3, "QUY ĐỊNH CHUNG")]
    got = corpus.join_split_numbers(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).orderBy("line_no").collect()
    assert [r.line for r in got] == ["1", "1.1 PHẠM VI ÁP DỤNG", "2 QUY ĐỊNH CHUNG"]
