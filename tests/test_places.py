import numpy as np
import pytest

from tallyrift.operators import places as P


def in_ring(ring, x, y):
    inside = np.zeros(len(x), bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def some_shapes(rng, n):
    """Rings from the size of a house to that of a country, some shapes of two, one without any."""
    out = []
    for i in range(n):
        rings = []
        for _ in range(1 + (i % 5 == 0)):
            size, (cx, cy) = 2.0 ** rng.uniform(-6, 4), rng.uniform(-20, 20, 2)
            turns = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 12)))
            rings.append([(float(cx + size * np.cos(t) * r), float(cy + size * np.sin(t) * r)) for t, r in zip(turns, rng.uniform(0.3, 1, len(turns)), strict=True)])
        out.append((i, int(rng.integers(0, 30)), rings))
    return [*out, (n, 0, []), (n + 1, 0, [[(1.0, 1.0)]])]


@pytest.mark.parametrize("seed", [1, 2])
def test_holding_shape_against_all_shapes(spark, seed):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-25, 25, (100_000 if seed == 1 else 500, 2))
    shapes = some_shapes(rng, 150)
    want = np.full(len(xy), -1)
    for unit, _, rings in sorted(shapes, key=lambda s: (s[1], s[0]), reverse=True):
        for ring in rings:
            want[in_ring(ring, xy[:, 0], xy[:, 1])] = unit
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(xy.tolist())] + [(-1, None, 1.0), (-2, 1.0, None)] + [(0, *xy[0, ::-1].tolist())], "k long, lat double, lng double")
    table = spark.createDataFrame([(u, o, [[{"x": x, "y": y} for x, y in r] for r in rings]) for u, o, rings in shapes], "unit int, o int, shape array<array<struct<x: double, y: double>>>")
    got = P.holding_shape(points, "k", table, "unit", "o").collect()
    assert len(got) == len(xy) + 3 and {r.k: r.unit for r in got} == {i: None if u < 0 else int(u) for i, u in enumerate(want)} | {-1: None, -2: None}
    assert (want >= 0).sum() > 100
    assert {r.unit for r in P.holding_shape(points, "k", table.limit(0), "unit", "o").collect()} == {None}
    told = {r.k: r.unit for r in P.located(points, "k", table, "unit", "o", points["lng"] > 0, "none").collect()}
    assert told == {i: str(u) if u >= 0 and xy[i, 0] > 0 else "none" for i, u in enumerate(want)} | {-1: "none", -2: "none"}


@pytest.mark.parametrize("spread", ["even", "clumped", "poles", "one"])
def test_nearest_against_all_centroids(spark, spread):
    rng = np.random.default_rng(3)
    n = 1 if spread == "one" else 300
    c = rng.uniform((-60, -170), (60, 170), (n, 2)) if spread == "even" else np.concatenate([rng.normal((-33, -70), 0.01, (n - n // 10, 2)), rng.uniform((-89, -170), (89, 170), (n // 10, 2))])
    c[-1] = c[0]  # a tie
    p = rng.uniform((-90, -180), (90, 180), (2000, 2)) if spread != "poles" else np.stack([rng.choice([-90.0, 90.0, 89.999999], 500), rng.uniform(-180, 180, 500)], axis=1)
    p[:5] = c[0]
    dx, dy = (c[:, 1] - p[:, 1:]) * np.cos(np.radians(p[:, :1])), c[:, 0] - p[:, :1]
    d = dx * dx + dy * dy
    points = spark.createDataFrame([(i, *x) for i, x in enumerate(p.tolist())] + [(-1, None, 0.0), (0, *p[0].tolist())], "k long, lat double, lng double")
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(c.tolist())] + [(-5, None, None)], "unit int, lat double, lng double")
    got = P.nearest_centroid(points, "k", table, "unit").collect()
    assert len(got) == len(p) + 2
    for r in got:
        if r.k < 0:
            assert r.unit is None and r.distance is None
        else:
            assert r.distance == pytest.approx(d[r.k].min(), abs=1e-12) and d[r.k, r.unit] == pytest.approx(d[r.k].min(), abs=1e-12)
            if r.k < 5:
                assert r.unit == 0
    assert {r.unit for r in P.nearest_centroid(points, "k", table.limit(0), "unit").collect()} == {None}
