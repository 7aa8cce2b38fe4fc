"""Containment, else nearness, over dense and sparse places, against all pairs."""

import random

from fathomline.operators import spatial


def test_boxes_in_dense_places_meet_few_points(spark, monkeypatch):
    rng = random.Random(1)
    spot = lambda: (float(rng.randint(0, 300)), float(rng.randint(0, 300)))
    points = [(i, *spot()) for i in range(1_500)] + [(1_500 + i, 5_000.0 + 400 * i, 5_000.0) for i in range(5)] + [(2_000 + i, 7.0, 7.0) for i in range(3)]
    boxes = [(i, x - rng.randint(1, 40), y - rng.randint(1, 40), x + rng.randint(1, 40), y + rng.randint(1, 40)) for i, (x, y) in enumerate(spot() for _ in range(600))]
    # long ones whose centres are far from what they hold, empty ones, one as large as all, one in each other's place
    boxes += [(600, 4_990.0, 4_999.0, 5_401.0, 5_001.0), (601, -900.0, -900.0, -890.0, -890.0), (602, 5_010.0, 5_000.5, 5_030.0, 5_009.0), (603, -1e4, -1e4, 1e4, 1e4), (604, 6.0, 6.0, 8.0, 8.0), (605, 6.0, 6.0, 8.0, 8.0), (606, 5_180.0, 4_000.0, 5_820.0, 6_000.0)]
    met, ranked = [], spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda pairs, *args, **more: met.append(pairs.count()) or ranked(pairs, *args, **more))
    got = spatial.contain_else_near(spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(points, "pid long, x double, y double"), 50.0, 60.0)
    want = {}
    for i, x0, y0, x1, y1 in boxes:
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        found = [(0 if x0 <= x <= x1 and y0 <= y <= y1 else 1, (x - cx) ** 2 + (y - cy) ** 2, p) for p, x, y in points]
        found = [f for f in found if f[0] == 0 or f[1] <= 2_500]
        if found:
            want[i] = min(found)
    rows = got.collect()
    assert {r["id"]: (r["mode"], r["d2"], r["pid"]) for r in rows} == want and len(rows) == len(want)
    assert {600, 602, 604, 605} <= set(want) and want[602][0] == 1
    assert sum(met) < 20_000  # all within reach would be 600 times about 100
