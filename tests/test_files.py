"""Files of several standards, nesting, hit texts, boxes and styles of meshes."""

import pytest

from regmodel.operators import clauses, models, retrieval
from regmodel.sources import readers


def test_several_standards_of_one_source(spark, tmp_path):
    rows = [("A 1", "s/1"), ("A 2", "s/1"), ("B 1", "s 2")]
    df = spark.createDataFrame(rows, "standard_code string, source_id string").coalesce(1)
    readers.write_standards(df, str(tmp_path / "out"))
    back = readers.read_standards(spark, str(tmp_path / "out"), lines=True)
    assert sorted((r.standard_code, r.source_id, r.source_file) for r in back.collect()) == [("A 1", "s/1", "s_1"), ("A 2", "s/1", "s_1"), ("B 1", "s 2", "s_2")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('[{"standard_code": "A 1"},\n {"standard_code": "A 2"}]')
    (tmp_path / "one" / "_report.json").write_text("no json")
    assert readers.read_standards(spark, str(tmp_path / "one")).count() == 2
    (tmp_path / "one" / "b.json").write_text('{"standard_code": "",\n "year": 2}')
    with pytest.raises(ValueError):
        readers.read_standards(spark, str(tmp_path / "one"))


def test_nest_and_unnest(spark):
    rows = [("S", 3, "2", "2.1", "2.1.1", None, "c"), ("S", 1, "1", "1.2", "1.2.1", "t", ""), ("S", 2, "1", "1.1", "1.1.1", "t", None), ("S", 4, "1", "1.2", "1.2.2", "u", "d"), ("T", 1, None, None, "1", "v", "e")]
    df = spark.createDataFrame(rows, "standard_code string, ordinal int, chapter_number string, section_number string, article_number string, title string, content string")
    nested = clauses.nest_articles(df)
    assert [[s.number for s in c.sections] for c in nested.where("standard_code = 'S'").first().chapters] == [["1.2", "1.1"], ["2.1"]]
    back = clauses.unnest_articles(nested).collect()
    assert [tuple(r) for r in back if r.standard_code == "S"] == [(k, c, s, n, t, x) for k, o, c, s, n, t, x in [rows[1], rows[3], rows[2], rows[0]]]
    assert [tuple(r) for r in back if r.standard_code == "T"] == [("T", None, None, "1", "v", "e")]
    assert clauses.nest_articles(df.limit(0)).count() == 0


def test_hit_texts(spark):
    rows = [("Q 1", "1.1", "t", "c", "r"), ("Q 1", None, None, "c", ""), ("Q 1", "1", "t", "c", None)]
    df = spark.createDataFrame(rows, "standard_code string, article_number string, title string, content string, requirement string")
    got = [r[0] for r in df.select(retrieval.article_text("requirement")).collect()]
    assert got == ["[Q 1] Điều 1.1: t\nc\n\nYêu cầu: r", "[Q 1] Điều : \nc", "[Q 1] Điều 1: t\nc"]
    m = spark.createDataFrame([("Q", "thép", 7850.0, "kg/m³", "r"), ("Q", "gỗ", 600.0, "kg/m³", ""), ("", "x", 1.0, "u", "r"), (None, "x", 1.0, "u", "r")], "standard_code string, material string, unit_weight double, unit string, requirement string")
    got = [r[0] for r in m.select(retrieval.material_text()).collect()]
    assert got == ["[Q] Vật liệu: thép\nTrọng lượng riêng: 7850.0 kg/m³\nr", "[Q] Vật liệu: gỗ\nTrọng lượng riêng: 600.0 kg/m³", None, None]


def test_keyword_hits(spark):
    articles = spark.createDataFrame([(i, "Q", str(i), "t", text) for i, text in enumerate(["red", "red red", "red blue", "blue", "red green", "green", ""])], "key long, standard_code string, article_number string, title string, content string")
    keywords = spark.createDataFrame([(1, 0, "red"), (1, 2, "blue"), (1, 5, "none"), (1, 7, "green"), (2, 0, "green")], "query_id long, pos int, keyword string")
    got = {(r.query_id, r.pos, r["rank"]): r.key for r in retrieval.keyword_hits(articles, keywords).collect()}
    assert {k[:2] for k in got} == {(1, 0), (1, 2), (2, 0)}  # the third keyword hits nothing, the fourth isn't asked
    assert [got[1, 0, r] for r in (1, 2, 3)] == [1, 0, 2] and (1, 0, 4) not in got
    assert [got[2, 0, r] for r in (1, 2)] == [5, 4]


def test_model_bounds_and_style(spark):
    face = [0, 1, 2]
    rows = [("M", "a", "IfcWall", [0.0, 0, 0, 1.004, 2, 3, 0, 0, 0], face), ("M", "b", "IfcWall", [-1.0, 0, 0, 1, 5, 3, 0, 0, 0], face), ("M", "c", "IfcOther", [0.0, 0, 0, 1, 2, 9.126, 0, 0, 0], face),
            ("M", "d", "IfcSpace", [99.0] * 9, face), ("M", "e", "IfcWall", [99.0] * 6, face), ("N", "f", "IfcWall", [99.0] * 9, [0])]
    rows = [(m, g, t, [float(x) for x in v], f) for m, g, t, v, f in rows]
    meshes = spark.createDataFrame(rows, "model string, global_id string, ifc_type string, v array<double>, f array<int>")
    got = models.model_bounds(meshes).collect()
    assert [r.asDict() for r in got] == [{"model": "M", "n": 3, "counts": {"Other": 1, "Wall": 2}, "x0": -1.0, "y0": 0.0, "z0": 0.0, "x1": 1.0, "y1": 5.0, "z1": 9.13}]
    rows = [(1, "IfcWindow", None, None), (2, "IfcWall", [0.1234, 0.2, 0.3], 0.25), (3, "IfcOther", None, float("nan")), (4, None, None, None)]
    styled = models.mesh_style(spark.createDataFrame(rows, "id int, ifc_type string, color array<double>, transparency double"))
    assert [(r.id, r.color, r.opacity) for r in styled.orderBy("id").collect()] == [(1, [0.5, 0.85, 1.0], 0.3), (2, [0.123, 0.2, 0.3], 0.75), (3, [0.7] * 3, 1.0), (4, [0.7] * 3, 1.0)]
    assert models.mesh_style(meshes.select("ifc_type")).where("ifc_type = 'IfcSpace'").first().opacity == 0.15
