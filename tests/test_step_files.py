"""Model files are compressed, and properties are shuffled once for what is grouped and what is joined."""

from __future__ import annotations

import re
from pathlib import Path

from regmodel.functions.storage import new_path
from regmodel.operators import models
from regmodel.plans import buildings
from regmodel.sources.step import read_step


def test_files(spark, data, monkeypatch):
    """Text of models takes little disk, and a file is a share of the items."""
    at = []
    monkeypatch.setattr(buildings, "new_path", lambda *a: at.append(new_path(*a)) or at[-1])
    few = buildings._step(spark, data, ("IFCSPACE",)).count()
    monkeypatch.setattr(buildings, "FILE_ITEMS", 1000)
    step = buildings._step(spark, data, ("IFCSPACE",))
    assert step.count() == few == spark.read.parquet(f"{data}/orders.parquet").count()
    assert step.select("file").distinct().count() > 3
    files = [f for p in at for f in Path(p).glob("part-*")]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(spark.read.text(p).selectExpr("sum(octet_length(value) + 1) AS n").first().n for p in at)


def test_compressed_statements(spark, tmp_path):
    """A compressed file is one range: statements over lines, and quotes that hold the mark of an end."""
    text = [f"#{i}= IFCWALL('a;''b',$,\n'x{i};');" for i in range(500)]
    rows = spark.createDataFrame([("\n".join(text),)], "value string")
    for kind in ("gzip", "none"):
        rows.coalesce(1).write.option("compression", kind).text(str(tmp_path / kind))
    got = [sorted((r.id, r.attributes[0], r.attributes[2]) for r in read_step(spark, str(tmp_path / kind)).collect()) for kind in ("gzip", "none")]
    assert got[0] == got[1] == [(i, "'a;''b'", f"'x{i};'") for i in range(500)]


def test_properties_move_once(spark):
    step = spark.createDataFrame([(1, 1, "IFCWALL", ["'w'"])], "file int, id long, class string, attributes array<string>")
    plan = models.element_properties(step, step)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 6
