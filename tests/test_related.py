"""All standards have their neighbours."""

from __future__ import annotations

from collections import defaultdict

from regmodel.plans import base, graph


def test_every_standard(spark, data):
    want = defaultdict(lambda: (set(), set()))
    for r in graph._refs(spark, data).select("std_id", "rel", "target").collect():
        if r.rel in ("RELATED_TO", "SUPERSEDES"):
            want[str(r.std_id)][r.rel == "SUPERSEDES"].add(str(r.target))
    ids = [str(r.std_id) for r in base.fixture(spark, data, "fx_standards").select("std_id").collect()]
    got = sorted((r.std_id, r.related, r.superseded) for r in graph.f10(spark, data).collect())
    assert got == sorted((i, *(",".join(sorted(x)) for x in want[i])) for i in set(ids))
