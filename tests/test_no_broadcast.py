"""Tables that grow with the input are not sent through the driver because their files are small, and columns that a query leaves out are not shuffled."""

from __future__ import annotations

from regmodel.functions.storage import stored
from regmodel.operators import kgraph
from regmodel.plans import registry


def test_edges(spark):
    """the edges of all standards are stored in few bytes."""
    rows = [("Standard", "A", "CONTAINS", "Chapter", "A1"), ("Chapter", "A1", "HAS_SECTION", "Section", "A1.1"), ("Section", "A1.1", "HAS_ARTICLE", "Article", "a"), ("Article", "a", "SPECIFIES", "Requirement", "r"), ("Requirement", "r", "CLASSIFIES", "BuildingType", "F1"), ("Requirement", "r", "CLASSIFIES", "BuildingType", "F2")]
    edges = stored(spark.createDataFrame(rows, "src_label string, src string, rel string, dst_label string, dst string"), "edges")
    got = kgraph.requirements_for_building_type(edges, ["F1"])
    assert [tuple(r) for r in got.collect()] == [("F1", "A", "A1", "A1.1", "a", "r")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_node_columns(spark, data):
    """what requirements say is not made and shuffled for their keys."""
    plan = registry.QUERIES["f1_node_tables"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "max_value" not in plan and "description" not in plan
