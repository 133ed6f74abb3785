"""Lines keep their cuts where they have met the lines across them."""

from __future__ import annotations

import random
import re

from regmodel.operators import layouts


def test_segments(spark):
    """against plain Python, with rooms without extent, lines that nothing crosses and lots without axes; lines are shuffled for their meeting only."""
    rng = random.Random(6)
    rects = [(p, rng.randrange(2), f"r{i}", *(rng.randrange(0, 6) for _ in range(2)), *(rng.randrange(0, 4) for _ in range(2)), rng.random() < 0.3) for p in range(12) for i in range(rng.randrange(1, 6))]
    axes = [(p, a) for p in range(0, 12, 2) for a in (2, 3, 3, 9)]
    lot = (0, 1, 6, 5)
    rows = spark.createDataFrame(rects, "program int, floor_idx int, room_id string, x_mm int, y_mm int, w_mm int, d_mm int, outdoor boolean")
    lots = spark.createDataFrame([(p, *lot) for p in range(12)], "program int, x0_mm int, y0_mm int, x1_mm int, y1_mm int")
    got = layouts.wall_segments(rows, lots, spark.createDataFrame(axes, "program int, pos_mm int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 2 and "Window" not in plan
    lines: dict = {}
    for p, f, _, x, y, w, d, open_ in rects:
        own = []
        if y >= lot[1]:
            own += [("v", x, y, y + d), ("v", x + w, y, y + d)] + [("h", y, x, x + w)] * (not (open_ and y == lot[1]))
        if y < lot[1] or not (open_ and y + d == lot[3]):
            own.append(("h", y + d, x, x + w))
        for o, c, lo, hi in own:
            lines.setdefault((p, f, o, c), []).append((lo, hi))
    merged: dict = {}
    for key, parts in lines.items():
        for lo, hi in sorted(parts):
            if key in merged and lo <= merged[key][-1][1]:
                merged[key][-1][1] = max(hi, merged[key][-1][1])
            else:
                merged.setdefault(key, []).append([lo, hi])
    want = set()
    for (p, f, o, c), parts in merged.items():
        for lo, hi in parts:
            cuts = {lo, hi} | {k[3] for k, others in merged.items() if k[:2] == (p, f) and k[2] != o and lo <= k[3] <= hi and any(a <= c <= b for a, b in others)}
            if o == "v" and c in (lot[0], lot[2]):
                cuts |= {a for q, a in axes if q == p and lo <= a <= hi}
            cuts = sorted(cuts)
            out = c in ((lot[0], lot[2]) if o == "v" else (lot[1], lot[3]))
            want |= {(p, f, o, c, a, b, out, 200 if out else 100) for a, b in zip(cuts, cuts[1:], strict=False)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) > 60 and set(found) == want
    assert layouts.wall_segments(rows, lots).count() > 50
