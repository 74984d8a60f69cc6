"""Points, shapes and centroids: which shape holds a point, which centroid is nearest.

Both meet by cells of grids, so a task has the points and shapes of some cells and nothing has all of them. Where one
side is small Spark broadcasts it by its size, as in any join; a cell with very many points is split as any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.functions import geo
from tallyrift.lineage import Scratch

#: The finest grid's cells are 2 to the power of this wide; smaller rings lie in them too.
FINEST = -24
#: What a bound on distances gives away to rounding.
SHY = 1 - 1e-9


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def holding_shape(points: DataFrame, key: str, shapes: DataFrame, unit: str, order: str) -> DataFrame:
    """``points`` (key, lat, lng) with the unit of the first shape, in ``order``, that holds them, or null.

    A ring is in the grid whose cells are as wide as its box, next power of two, so it touches four cells at most,
    however large or small it is beside others. A point looks into its cell of each grid that has rings; those are as many as
    rings differ in size by powers of two. Equal points and keys are answered each for itself, points without a place by null.
    """
    rings = shapes.select(F.col(order).alias("_order"), F.col(unit).alias("_unit"), F.explode("shape").alias("_ring")).where(F.size("_ring") > 0).withColumn("_box", geo.box(F.col("_ring")))
    side = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    graded = rings.withColumn("_level", F.greatest(F.ceil(F.log2(F.nullif(side, F.lit(0.0)))), F.lit(FINEST)).cast("int"))
    across = lambda k: F.explode(F.sequence(_cell(F.col(f"_box.{k}0"), F.col("_level")), _cell(F.col(f"_box.{k}1"), F.col("_level"))))
    celled = graded.withColumn("_cx", across("x")).withColumn("_cy", across("y"))
    levels = sorted(r[0] for r in graded.select("_level").distinct().collect())  # a few: powers of two
    places = points.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    looking = places.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumns({"_cx": _cell(F.col("lng"), F.col("_level")), "_cy": _cell(F.col("lat"), F.col("_level"))})
    holds = geo.within_box(F.col("lng"), F.col("lat"), F.col("_box")) & geo.in_ring(F.col("_ring"), F.col("lng"), F.col("lat"))
    found = looking.join(celled, ["_level", "_cx", "_cy"]).where(holds).groupBy("lat", "lng").agg(F.min(F.struct("_order", "_unit")).alias("_first"))
    return points.select(key, "lat", "lng").join(found, ["lat", "lng"], "left").select(key, F.col("_first._unit").alias(unit))


def located(points: DataFrame, key: str, shapes: DataFrame, unit: str, order: str, country: Column, default: str) -> DataFrame:
    """As ``holding_shape``; points without a place, or outside of the country's box, get ``default``."""
    inside = points.select(key, F.when(country, F.col("lat")).alias("lat"), "lng")
    told = holding_shape(inside, key, shapes, unit, order)
    return told.select(key, F.when(F.col(unit).isNotNull(), F.col(unit).cast("string")).otherwise(default).alias(unit))


def nearest_centroid(points: DataFrame, key: str, centroids: DataFrame, unit: str) -> DataFrame:
    """(key, unit, distance) of each point (key, lat, lng): the nearest centroid (unit, lat, lng), the smaller unit on a tie.

    Each round a place looks into its cell and the eight around it; what lies beyond them is at least a cell away, so a
    centroid nearer than that is the nearest. The places that found none such look again in cells four times as wide, until
    nine cells hold every centroid. Cells are as wide at first as centroids lie apart on average. Points without a place, and all if there
    are no centroids, get nulls; centroids without a place are none.
    """
    with Scratch(points.sparkSession, "nearest") as scratch:
        some = lambda df: df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        target = some(centroids.select(unit, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))).select(unit, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
        left = scratch.keep(some(points.select(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))).distinct(), "left")
        ends = lambda df, lat, lng: df.agg(F.count(F.lit(1)).alias("n"), *(f(c) for c in (lat, lng) for f in (F.min, F.max))).first()
        of, at = ends(target, "_lat", "_lng"), ends(left, "lat", "lng")
        found = []
        if of[0] and at[0]:
            wide, reach = max(of[2] - of[1], of[4] - of[3]), max(max(of[2], at[2]) - min(of[1], at[1]), max(of[4], at[4]) - min(of[3], at[3]))
            apart = wide / of[0] ** 0.5 if wide > 2.0**FINEST else 2 * reach + 1
            while True:
                last = apart > reach
                cell = lambda c: F.floor(F.col(c) / apart).cast("long")  # noqa: E731, B023
                near = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: cell(c) + i))  # noqa: E731, B023
                looking = left.withColumn("_cy", near("lat")).withColumn("_cx", near("lng"))
                met = looking.join(target.withColumns({"_cy": cell("_lat"), "_cx": cell("_lng")}), ["_cy", "_cx"])
                best = met.groupBy("lat", "lng").agg(F.min(F.struct(geo.flat_distance(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")).alias("distance"), F.col(unit).alias("unit"))).alias("_best"))
                sure = F.pow(apart * F.cos(F.radians("lat")), F.lit(2.0)) * SHY
                told = scratch.keep(left.join(best if last else best.where(F.col("_best.distance") < sure), ["lat", "lng"], "left"), "told")
                found.append(told.where("_best IS NOT NULL"))
                scratch.forget(left)
                if last or told.where("_best IS NULL").isEmpty():
                    break
                left, apart = scratch.keep(told.where("_best IS NULL").select("lat", "lng"), "left"), 4 * apart
        nothing = left.select("lat", "lng", F.lit(None).cast(f"struct<distance: double, unit: {dict(centroids.dtypes)[unit]}>").alias("_best")).limit(0) if not found else found[0]
        for more in found[1:]:
            nothing = nothing.unionByName(more)
        asked = points.select(key, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
        return asked.join(nothing, ["lat", "lng"], "left").select(key, F.col("_best.unit").alias(unit), F.col("_best.distance").alias("distance"))


def rekeyed(features: DataFrame, code: str, units: DataFrame, unit: str, missing_shape: Column | None = None) -> DataFrame:
    """``features`` by unit, from codes with leading zeros; with ``missing_shape``, units without a feature get that."""
    stripped = F.coalesce(F.col(code).try_cast("int").cast("string"), F.col(code))
    found = features.withColumn(unit, stripped).drop(code).join(units.select(F.col(unit).cast("string").alias(unit)), unit, "left_semi")
    if missing_shape is None:
        return found
    lost = units.select(F.col(unit).cast("string").alias(unit)).join(found.select(unit), unit, "left_anti").withColumn("shape", missing_shape)
    return found.select(unit, "shape").unionByName(lost)
