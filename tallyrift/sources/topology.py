"""Topologies: shapes whose borders are arcs that neighbours share, read from TopoJSON and built from shapes."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def arc_points(spark: SparkSession, path: str) -> DataFrame:
    """(arc, pos, x, y, last) of a TopoJSON file: the points of each arc and the place of its last.

    Quantised arcs hold steps from point to point, which are summed up along each arc; others hold points.
    """
    raw = spark.read.schema("arcs array<array<array<double>>>, transform struct<scale: array<double>, translate: array<double>>").option("multiLine", True).json(path)
    steps = raw.select("transform", F.posexplode("arcs").alias("arc", "line")).select("transform", "arc", F.size("line").alias("_n"), F.posexplode("line").alias("pos", "p"))
    along = Window.partitionBy("arc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda i: F.when(F.col("transform").isNull(), F.col("p")[i]).otherwise(F.sum(F.col("p")[i]).over(along) * F.col("transform.scale")[i] + F.col("transform.translate")[i])
    return steps.select("arc", "pos", at(0).alias("x"), at(1).alias("y"), (F.col("_n") - 1).alias("last"))


def topology_features(spark: SparkSession, path: str, name: str, ids: Sequence[str] = ("id",)) -> DataFrame:
    """(ids, shape) of an object of a TopoJSON file, as ``readers.features`` gives them for GeoJSON: the outer rings of
    polygons, one or many; other geometries have none. An id is a property, or the geometry's own.

    Rings are stitched by a join of their arcs' numbers; a negative number is an arc from its end, and the first point of
    every arc but a ring's first is the last of the one before.
    """
    geometry = "struct<type: string, id: string, properties: map<string,string>, arcs: string>"
    raw = spark.read.schema(f"objects struct<`{name}`: struct<geometries: array<{geometry}>>>").option("multiLine", True).json(path)
    every = raw.select(F.posexplode(F.col(f"objects.`{name}`.geometries")).alias("_g", "g"))
    one, many = F.from_json("g.arcs", "array<array<int>>"), F.from_json("g.arcs", "array<array<array<int>>>")
    outer = F.when(F.col("g.type") == "Polygon", F.slice(one, 1, 1)).when(F.col("g.type") == "MultiPolygon", F.transform(many, lambda p: p[0]))
    own = [F.coalesce(F.element_at("g.properties", i), F.col("g.id") if i == "id" else F.lit(None)).alias(i) for i in ids]
    refs = every.select("_g", F.posexplode(outer).alias("_ring", "_arcs")).select("_g", "_ring", F.posexplode("_arcs").alias("_k", "_ref"))
    back = F.col("_ref") < 0
    wanted = refs.select("_g", "_ring", "_k", back.alias("_back"), F.when(back, -F.col("_ref") - 1).otherwise(F.col("_ref")).alias("arc"))
    points = wanted.join(arc_points(spark, path), "arc").withColumn("_p", F.when(F.col("_back"), F.col("last") - F.col("pos")).otherwise(F.col("pos"))).where((F.col("_k") == 0) | (F.col("_p") > 0))
    rings = points.groupBy("_g", "_ring").agg(F.array_sort(F.collect_list(F.struct("_k", "_p", "x", "y"))).alias("_all"))
    shaped = rings.select("_g", "_ring", F.transform("_all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("_points"))
    shapes = shaped.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_ring", "_points"))), lambda r: r["_points"]).alias("shape"))
    return every.select("_g", *own).join(shapes, "_g", "left").select(*ids, "shape")


def arcs_of(shapes: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Of ``shapes`` (unit, shape): (arcs (arc, points), refs (unit, ring, k, arc, back)).

    A point at which rings part - its neighbours aren't the same two in all of them - is a junction, found by grouping
    points; rings are cut there. Arcs with the same points in either direction are one. A ring without junctions is one
    arc from its least point. Rings are closed, their last point the first; steps of no length are left out.
    """
    rings = shapes.select(F.col(unit).alias("unit"), F.posexplode("shape").alias("ring", "line")).select("unit", "ring", F.posexplode("line").alias("pos", "p"))
    along = Window.partitionBy("unit", "ring").orderBy("pos")
    stepped = rings.withColumn("_was", F.lag("p").over(along)).where(F.col("_was").isNull() | (F.col("_was") != F.col("p"))).drop("_was")
    numbered = stepped.withColumn("pos", F.row_number().over(along) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unit", "ring")) - 1).where("n >= 3")
    open_ = numbered.where("pos < n")  # the last is the first again
    whole = Window.partitionBy("unit", "ring").orderBy("pos")
    ends = Window.partitionBy("unit", "ring").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.coalesce(F.lag("p").over(whole), F.last("p").over(ends)), F.coalesce(F.lead("p").over(whole), F.first("p").over(ends))
    around = open_.withColumn("_sides", F.array_sort(F.array(before, after)))
    parting = around.groupBy("p").agg(F.count_distinct("_sides").alias("_kinds")).where("_kinds > 1").select("p", F.lit(True).alias("_cut"))
    marked = around.join(parting, "p", "left").withColumn("_cut", F.coalesce("_cut", F.lit(False)))
    any_ = Window.partitionBy("unit", "ring")
    begun = marked.withColumn("_none", ~F.max("_cut").over(any_)).withColumn("_least", F.min(F.struct("p", "pos")).over(any_))
    starts = begun.withColumn("_cut", F.col("_cut") | (F.col("_none") & (F.col("pos") == F.col("_least.pos"))))
    first = starts.withColumn("_first", F.min(F.when(F.col("_cut"), F.col("pos"))).over(any_))
    turned = first.withColumn("_at", F.pmod(F.col("pos") - F.col("_first"), F.col("n")))
    ordered = Window.partitionBy("unit", "ring").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = turned.withColumn("k", F.sum(F.col("_cut").cast("int")).over(ordered) - 1).groupBy("unit", "ring", "k").agg(F.array_sort(F.collect_list(F.struct("_at", "p"))).alias("_all"))
    line = pieces.select("unit", "ring", "k", F.transform("_all", lambda x: x["p"]).alias("line"))
    next_ = Window.partitionBy("unit", "ring").orderBy("k")
    closed = line.withColumn("_next", F.coalesce(F.lead(F.col("line")[0]).over(next_), F.first(F.col("line")[0]).over(next_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    full = closed.withColumn("line", F.concat("line", F.array("_next"))).withColumn("_other", F.reverse("line"))
    told = full.withColumn("points", F.least("line", "_other")).withColumn("back", F.col("line") != F.col("points")).select("unit", "ring", "k", "points", "back")
    arcs = told.select("points").distinct().withColumn("arc", F.sha2(F.to_json("points"), 256))
    return arcs.select("arc", "points"), told.select("unit", "ring", "k", F.sha2(F.to_json("points"), 256).alias("arc"), "back")


def _weighed(line: list, least: float) -> list:
    """The points of an arc without those whose triangle with their neighbours is smaller than ``least``; ends stay.

    The smallest goes first, and its neighbours are weighed anew, never below what went (Visvalingam and Whyatt).
    """
    n = len(line)
    area = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
    before, after = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    size = [0.0, *(area(line[i - 1], line[i], line[i + 1]) for i in range(1, n - 1)), 0.0]
    heap = [(size[i], i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        s, i = heapq.heappop(heap)
        if gone[i] or s != size[i]:
            continue
        if s >= least:
            break
        gone[i] = True
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                size[j] = max(s, area(line[before[j]], line[j], line[after[j]]))
                heapq.heappush(heap, (size[j], j))
    return [p for p, g in zip(line, gone, strict=True) if not g]


def simplified(arcs: DataFrame, least: float) -> DataFrame:
    """``arcs`` (arc, points) with fewer points, each arc for itself; so neighbours keep one border. A closed arc keeps four
    points at least."""
    def weigh(batches):
        for rows in batches:
            out = []
            for line in rows["points"]:
                full = [(p["x"], p["y"]) for p in line]
                some = _weighed(full, least)
                if full[0] == full[-1] and len(some) < 4:
                    some = full if len(full) <= 4 else [full[i * (len(full) - 1) // 3] for i in range(4)]
                out.append([{"x": x, "y": y} for x, y in some])
            yield pd.DataFrame({"arc": rows["arc"], "points": out})

    return arcs.mapInPandas(weigh, "arc string, points array<struct<x: double, y: double>>")


def _json_arc(points: Column, scale: Column, shift: Column) -> Column:
    whole = F.transform(points, lambda p: F.struct(F.round((p["x"] - shift[0]) / scale[0]).cast("long").alias("x"), F.round((p["y"] - shift[1]) / scale[1]).cast("long").alias("y")))
    steps = F.transform(whole, lambda p, i: F.array(p["x"] - F.when(i > 0, F.get(whole, i - 1)["x"]).otherwise(0), p["y"] - F.when(i > 0, F.get(whole, i - 1)["y"]).otherwise(0)))
    return F.filter(steps, lambda s, i: (i == 0) | (s[0] != 0) | (s[1] != 0))


def topology(shapes: DataFrame, unit: str, name: str, least: float = 0.0, grid: int = 10_000, most: int | None = None, most_arcs: int | None = None) -> DataFrame:
    """One row (json, bytes, arcs_bytes): ``shapes`` (unit, shape) as TopoJSON on a grid of ``grid`` steps.

    An error where the text has more bytes than ``most`` or its arcs more than ``most_arcs``; the budgets bound the row, which
    is what a browser is sent.
    """
    arcs, refs = arcs_of(shapes, unit)
    kept = simplified(arcs, least)
    box = kept.select(F.explode("points").alias("p")).agg(*(f(f"p.{c}").alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    step = lambda c: F.when(F.col(f"{c}1") > F.col(f"{c}0"), (F.col(f"{c}1") - F.col(f"{c}0")) / (grid - 1)).otherwise(1.0)
    frame = box.select(F.array(step("x"), step("y")).alias("scale"), F.array("x0", "y0").alias("translate"))
    lines = kept.join(F.broadcast(frame)).select("arc", _json_arc(F.col("points"), F.col("scale"), F.col("translate")).alias("line"))
    listed = lines.agg(F.array_sort(F.collect_list(F.struct("arc", "line"))).alias("all"))
    numbers = listed.select(F.posexplode("all").alias("i", "a")).select(F.col("a.arc").alias("arc"), "i")
    placed = refs.join(numbers, "arc").withColumn("i", F.when(F.col("back"), -F.col("i") - 1).otherwise(F.col("i")))
    rings = placed.groupBy("unit", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "i"))), lambda x: x["i"]).alias("ring_arcs"))
    units = rings.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "ring_arcs"))), lambda r: F.array(r["ring_arcs"])).alias("arcs"))
    geometries = units.agg(F.array_sort(F.collect_list(F.struct("unit", "arcs"))).alias("g")).select(F.transform("g", lambda g: F.struct(F.lit("MultiPolygon").alias("type"), g["unit"].cast("string").alias("id"), g["arcs"].alias("arcs"))).alias("geometries"))
    parts = listed.select(F.transform("all", lambda a: a["line"]).alias("arcs")).join(geometries).join(frame)
    text = F.to_json(F.struct(F.lit("Topology").alias("type"), F.struct("scale", "translate").alias("transform"), F.struct(F.struct(F.lit("GeometryCollection").alias("type"), "geometries").alias(name)).alias("objects"), "arcs"))
    made = parts.select(text.alias("json"), F.octet_length(F.to_json("arcs")).alias("arcs_bytes")).withColumn("bytes", F.octet_length("json"))
    over = F.lit(False)
    for c, limit in (("bytes", most), ("arcs_bytes", most_arcs)):
        if limit is not None:
            over = over | (F.col(c) > limit)
    checked = F.when(~over, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("topology too large: "), F.col("bytes"), F.lit(" bytes, arcs "), F.col("arcs_bytes"))))
    return made.select(checked.alias("json"), "bytes", "arcs_bytes")
