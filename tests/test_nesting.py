"""No row of nested models grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from regmodel.operators import models
from regmodel.plans import base, buildings


def test_a_row_holds_one_order(spark, data, monkeypatch):
    seen, explode = [], models.explode_models
    monkeypatch.setattr(models, "explode_models", lambda nested: seen.append(nested) or explode(nested))
    buildings.g1(spark, data)
    largest = base.table(spark, data, "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    assert seen[0].agg(F.max(F.size("elements"))).first()[0] == largest
