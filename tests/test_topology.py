import json

import pytest

from tallyrift.sources import readers
from tallyrift.sources import topology as T

#: A hand-made topology: two squares that share a border, a third with a hole, a lake of two islands, a point.
TOPO = {"type": "Topology", "transform": {"scale": [0.5, 2.0], "translate": [10.0, -5.0]},
        "objects": {"other": {"type": "GeometryCollection", "geometries": []},
                    "units": {"type": "GeometryCollection", "geometries": [
                        {"type": "Polygon", "id": 7, "properties": {"name": "left"}, "arcs": [[0, 1]]},
                        {"type": "Polygon", "id": "08", "properties": {"name": "right"}, "arcs": [[-1, 2], [4]]},
                        {"type": "MultiPolygon", "id": "9", "properties": {"name": "lake"}, "arcs": [[[3], [4]], [[-5]]]},
                        {"type": "Point", "id": "p", "properties": {"name": "point"}, "coordinates": [1, 1]},
                        {"type": None, "id": "q"}]}},
        "arcs": [[[2, 0], [0, 2]], [[2, 2], [-2, 0], [0, -2], [2, 0]], [[2, 0], [2, 0], [0, 2], [-2, 0]], [[8, 8], [1, 0], [0, 1], [-1, -1]], [[3, 1], [0, 0], [1, 0], [-1, -1], [0, 1]]]}


def decoded(topo, ref):
    s, t = topo["transform"]["scale"], topo["transform"]["translate"]
    at, out = [0, 0], []
    for d in topo["arcs"][ref if ref >= 0 else ~ref]:
        at = [at[0] + d[0], at[1] + d[1]]
        out.append((at[0] * s[0] + t[0], at[1] * s[1] + t[1]))
    return out if ref >= 0 else out[::-1]


def ring(topo, refs):
    out = []
    for r in refs:
        out += decoded(topo, r)[1 if out else 0 :]
    return out


def geojson(topo, name):
    features = []
    for g in topo["objects"][name]["geometries"]:
        polygons = {"Polygon": lambda g=g: [g["arcs"]], "MultiPolygon": lambda g=g: g["arcs"]}.get(g["type"], lambda: None)()
        kind = None if g["type"] is None else {"type": g["type"], "coordinates": [1, 1]}
        if polygons is not None:
            rings = [[ring(topo, r) for r in p] for p in polygons]
            kind["coordinates"] = rings[0] if g["type"] == "Polygon" else rings
        features.append({"type": "Feature", "properties": {**g.get("properties", {}), "id": str(g["id"])}, "geometry": kind})
    return {"type": "FeatureCollection", "features": features}


def points(df):
    return {r.id: None if r.shape is None else [[(p.x, p.y) for p in line] for line in r.shape] for r in df.collect()}


def test_rings_are_those_of_the_same_geojson(spark, tmp_path):
    for name, what in (("t", TOPO), ("g", geojson(TOPO, "units"))):
        (tmp_path / f"{name}.json").write_text(json.dumps(what))
    got = points(T.topology_features(spark, f"{tmp_path}/t.json", "units"))
    assert got == points(readers.features(spark, f"{tmp_path}/g.json")) and len(got) == 5 and got["7"][0][0] == (11.0, -5.0)
    assert [tuple(r)[:2] for r in T.topology_features(spark, f"{tmp_path}/t.json", "units", ("id", "name")).orderBy("id").collect()] == [("08", "right"), ("7", "left"), ("9", "lake"), ("p", "point"), ("q", None)]
    assert T.topology_features(spark, f"{tmp_path}/t.json", "other").count() == 0


def grid_shapes(spark, n=4, k=5):
    """n x n squares, each side in k steps that bend, so neighbours share bent borders; and an island of its own."""
    bend = lambda x, y: (x + 0.03 * ((3 * y) % 2), y + 0.02 * ((5 * x) % 3))
    def square(i, j):
        line = [(i + s / k, j) for s in range(k)] + [(i + 1, j + s / k) for s in range(k)] + [(i + 1 - s / k, j + 1) for s in range(k)] + [(i, j + 1 - s / k) for s in range(k)]
        turn = (7 * i + 3 * j) % len(line)
        line = line[turn:] + line[:turn]
        line = [bend(round(x, 6), round(y, 6)) for x, y in (line if (i + j) % 2 else line[::-1])]
        return [*line, line[0]]
    rows = [(10 * i + j, [square(i, j)]) for i in range(n) for j in range(n)] + [(99, [[(20.0, 0.0), (21.0, 0.0), (20.5, 0.1), (20.0, 1.0), (20.0, 0.0)], square(30, 3)])]
    kind = "cut int, shape array<array<struct<x: double, y: double>>>"
    return rows, spark.createDataFrame([(u, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for u, rings in rows], kind)


def same_ring(a, b, near):
    a, b = a[:-1], b[:-1]
    for line in (b, b[::-1]):
        for turn in range(len(line)):
            moved = line[turn:] + line[:turn]
            if len(a) == len(moved) and all(abs(p[0] - q[0]) <= near and abs(p[1] - q[1]) <= near for p, q in zip(a, moved, strict=True)):
                return True
    return False


def test_built_topology_has_the_same_rings_and_shared_arcs(spark, tmp_path):
    rows, shapes = grid_shapes(spark)
    arcs, refs = T.arcs_of(shapes, "cut")
    used = {}
    for r in refs.collect():
        used.setdefault(r.arc, []).append((r.unit, r.back))
    assert arcs.count() == len(used) and sum(len(u) == 2 for u in used.values()) >= 24 and max(map(len, used.values())) == 2
    row = T.topology(shapes, "cut", "units", grid=1_000_000).first()
    (tmp_path / "t.json").write_text(row.json)
    assert row.bytes == len(row.json.encode()) and row.arcs_bytes == len(json.dumps(json.loads(row.json)["arcs"], separators=(",", ":")))
    got = points(T.topology_features(spark, f"{tmp_path}/t.json", "units"))
    for unit, rings in rows:
        assert len(got[str(unit)]) == len(rings) and all(same_ring(x, y, 1e-4) for x, y in zip(rings, got[str(unit)], strict=True))


def test_simplified_neighbours_keep_one_border_and_budgets_hold(spark, tmp_path):
    rows, shapes = grid_shapes(spark)
    full, less = (T.topology(shapes, "cut", "units", least).first() for least in (0.0, 0.02))
    assert less.bytes < 0.8 * full.bytes
    (tmp_path / "t.json").write_text(less.json)
    got = points(T.topology_features(spark, f"{tmp_path}/t.json", "units"))
    edges = {}
    for unit, rings in got.items():
        for line in rings:
            assert line[0] == line[-1] and len(line) >= 4
            for a, b in zip(line, line[1:], strict=False):
                edges.setdefault(frozenset((a, b)), set()).add(unit)
    inner = [e for e, u in edges.items() if len(u) == 2]
    assert len(inner) >= 24 and max(len(u) for u in edges.values()) == 2
    with pytest.raises(Exception, match="topology too large"):
        T.topology(shapes, "cut", "units", most=full.bytes - 1).collect()
    with pytest.raises(Exception, match="topology too large"):
        T.topology(shapes, "cut", "units", most=full.bytes, most_arcs=full.arcs_bytes - 1).collect()


def test_smallest_triangles_go_first():
    line = [(0, 0), (1, 0.1), (2, 0), (3, 3), (4, 0)]
    assert T._weighed(line, 0.05) == line and T._weighed(line, 0.5) == [(0, 0), (2, 0), (3, 3), (4, 0)] and T._weighed(line, 100) == [(0, 0), (4, 0)]
    assert T._weighed([(0, 0)], 1) == [(0, 0)] and T._weighed([(0, 0), (1, 1)], 1) == [(0, 0), (1, 1)]
