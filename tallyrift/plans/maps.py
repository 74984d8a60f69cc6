"""Geometry over the test tables: points are the first two parts of embeddings, shapes are made from the nations' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrift.functions import geo
from tallyrift.operators import places as P
from tallyrift.plans.queries import query, r6, table
from tallyrift.sources import topology as T


def points(s, d):
    """Around 33 south, 70 west."""
    v = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", (F.round(v[0].cast("double") * 10, 6) - 33).alias("lat"), (F.round(v[1].cast("double") * 10, 6) - 70).alias("lng"))


_POINTS = "pts AS (SELECT vec_id, round(embedding[1]::DOUBLE * 10, 6) - 33 AS lat, round(embedding[2]::DOUBLE * 10, 6) - 70 AS lng FROM embeddings)"


def centroids(s, d):
    k = F.col("n_nationkey").cast("double")
    return table(s, d, "nation").select(F.col("n_nationkey").alias("cut"), (k % 5 - 35).alias("lat"), (F.floor(k / 5) - 72).alias("lng"))


_CENTROIDS = "cen AS (SELECT n_nationkey AS cut, n_nationkey % 5 - 35.0::DOUBLE AS lat, n_nationkey // 5 - 72.0::DOUBLE AS lng FROM nation)"


@query("nearest_centroid", f"""WITH {_POINTS}, {_CENTROIDS}, far AS (SELECT vec_id, cut, ((c.lng - p.lng) * cos(radians(p.lat))) * ((c.lng - p.lng) * cos(radians(p.lat))) + (c.lat - p.lat) * (c.lat - p.lat) AS x FROM pts p, cen c)
SELECT vec_id, cut, round(x, 6) AS distance FROM far QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x, cut) = 1""", False)
def nearest_centroid(s, d):
    return r6(P.nearest_centroid(points(s, d), "vec_id", centroids(s, d), "cut"), "distance")


def shapes(s, d):
    """A triangle of each nation, of every third one a square beside it too."""
    p = lambda dx, dy: F.struct((F.col("lng") + dx).cast("double").alias("x"), (F.col("lat") + dy).cast("double").alias("y"))
    triangle, square = F.array(p(0, 0), p(1.5, 0.2), p(0.3, 1.4), p(0, 0)), F.array(p(2, 2), p(2.5, 2), p(2.5, 2.5), p(2, 2.5), p(2, 2))
    return centroids(s, d).select("cut", F.when(F.col("cut") % 3 == 0, F.array(triangle, square)).otherwise(F.array(triangle)).alias("shape"))


_RINGS = f"""{_CENTROIDS}, rings AS (SELECT cut, 0 AS ring, [[lng, lat], [lng + 1.5, lat + 0.2], [lng + 0.3, lat + 1.4], [lng, lat]] AS r FROM cen
 UNION ALL SELECT cut, 1, [[lng + 2, lat + 2], [lng + 2.5, lat + 2], [lng + 2.5, lat + 2.5], [lng + 2, lat + 2.5], [lng + 2, lat + 2]] FROM cen WHERE cut % 3 = 0),
edges AS (SELECT cut, ring, r[i][1]::DOUBLE AS x0, r[i][2]::DOUBLE AS y0, r[i + 1][1]::DOUBLE AS x1, r[i + 1][2]::DOUBLE AS y1 FROM rings, unnest(range(1, len(r))) u(i))"""
_HOLD = f"""{_POINTS}, {_RINGS}, hold AS (SELECT vec_id, cut, ring FROM pts, edges WHERE (y0 > lat) <> (y1 > lat) AND lng < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY vec_id, cut, ring HAVING count(*) % 2 = 1)"""


@query("point_in_polygon", f"WITH {_HOLD} SELECT vec_id, min(cut) AS cut FROM pts LEFT JOIN hold USING (vec_id) GROUP BY vec_id", False)
def point_in_polygon(s, d):
    return P.holding_shape(points(s, d), "vec_id", shapes(s, d), "cut", "cut")


@query("locate", f"WITH {_HOLD} SELECT vec_id, coalesce(min(cut) FILTER (lat > -34.5 AND lat < -31 AND lng > -71.5 AND lng < -68)::VARCHAR, '13101') AS cut FROM pts LEFT JOIN hold USING (vec_id) GROUP BY vec_id", False)
def locate(s, d):
    """The unit that holds a point; a fixed one for points outside of the country's box and for those in no unit."""
    inside = (F.col("lat") > -34.5) & (F.col("lat") < -31) & (F.col("lng") > -71.5) & (F.col("lng") < -68)
    return P.located(points(s, d), "vec_id", shapes(s, d), "cut", "cut", inside, "13101")


_MOMENTS = f"{_RINGS}, m AS (SELECT cut, ring, sum(x0 * y1 - x1 * y0) / 2 AS a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 AS x, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 AS y FROM edges GROUP BY ALL)"


@query("largest_ring_centroid", f"WITH {_MOMENTS} SELECT cut, round(x / a, 6) AS lng, round(y / a, 6) AS lat FROM m QUALIFY row_number() OVER (PARTITION BY cut ORDER BY abs(a) DESC, ring) = 1", False)
def largest_ring_centroid(s, d):
    c = shapes(s, d).select("cut", geo.shape_centroid(F.col("shape")).alias("c"))
    return c.select("cut", F.round("c.x", 6).alias("lng"), F.round("c.y", 6).alias("lat"))


@query("area_weighted_centroid", f"WITH {_MOMENTS} SELECT cut, round(sum(x / a * abs(a)) / sum(abs(a)), 4) AS lng, round(sum(y / a * abs(a)) / sum(abs(a)), 4) AS lat FROM m GROUP BY cut", False)
def area_weighted_centroid(s, d):
    c = shapes(s, d).select("cut", geo.weighted_centroid(F.col("shape")).alias("c"))
    return c.select("cut", F.round("c.x", 4).alias("lng"), F.round("c.y", 4).alias("lat"))


@query("longest_ring_mean", f"WITH {_RINGS}, l AS (SELECT cut, r FROM rings QUALIFY row_number() OVER (PARTITION BY cut ORDER BY len(r) DESC, ring) = 1) SELECT cut, round(list_avg(list_transform(r, lambda p: p[1])), 6) AS lng, round(list_avg(list_transform(r, lambda p: p[2])), 6) AS lat FROM l", False)
def longest_ring_mean(s, d):
    c = shapes(s, d).select("cut", geo.longest_ring_mean(F.col("shape")).alias("c"))
    return c.select("cut", F.round("c.x", 6).alias("lng"), F.round("c.y", 6).alias("lat"))


@query("feature_rekey", "SELECT n_nationkey::VARCHAR AS cut, n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 > 0) AS placeholder FROM nation", False)
def feature_rekey(s, d):
    """Shapes by padded codes, some of no unit, and a placeholder for the units without one."""
    features = shapes(s, d).where("cut % 6 > 0").select(F.lpad(F.col("cut").cast("string"), 5, "0").alias("code"), "shape")
    odd = features.limit(1).select(F.lit("x9").alias("code"), "shape")
    units = table(s, d, "nation").select(F.col("n_nationkey").alias("cut"))
    told = P.rekeyed(features.unionByName(odd), "code", units, "cut", F.array().cast(geo.SHAPE))
    return told.select("cut", (F.size("shape") == 0).alias("placeholder"))


@query("centroid_gate", f"WITH {_CENTROIDS} SELECT count(*) AS n, count(*) FILTER (NOT (lat BETWEEN -34 AND -32 AND lng BETWEEN -72 AND -69)) AS outside, bool_or(cut = 7) AS sentinel FROM cen", False)
def centroid_gate(s, d):
    """How many centroids there are, how many lie outside of the country's box, and whether one that must be there is."""
    c = centroids(s, d)
    inside = F.col("lat").between(-34, -32) & F.col("lng").between(-72, -69)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("outside"), F.bool_or(F.col("cut") == 7).alias("sentinel"))


@query("dots_of_features", f"WITH {_CENTROIDS} SELECT cut, CASE WHEN cut % 5 + 1 > 5 THEN 5 ELSE cut % 5 + 1 END * 1.1::DOUBLE + 4.5 AS radius FROM cen JOIN supplier ON s_suppkey = cut WHERE s_suppkey > 3", False)
def dots_of_features(s, d):
    """Features and payload rows of one id, with the size of their dot by level."""
    level = (F.col("cut") % 5 + 1).cast("double")
    payload = table(s, d, "supplier").where("s_suppkey > 3").select(F.col("s_suppkey").alias("cut"))
    return shapes(s, d).join(payload, "cut").select("cut", (level * 1.1 + 4.5).alias("radius"))


@query("topology_arcs", f"""WITH {_RINGS}, v AS (SELECT e.cut, e.ring, e.x0 AS x, e.y0 AS y, list_sort([[e.x1, e.y1], [b.x0, b.y0]]) AS sides FROM edges e JOIN edges b ON e.cut = b.cut AND e.ring = b.ring AND e.x0 = b.x1 AND e.y0 = b.y1),
j AS (SELECT x, y FROM v GROUP BY x, y HAVING count(DISTINCT sides) > 1)
SELECT cut, ring, greatest(1, count(j.x)) AS arcs FROM v LEFT JOIN j USING (x, y) GROUP BY cut, ring""", False)
def topology_arcs(s, d):
    """How many arcs each ring is made of, cut where rings part."""
    return T.arcs_of(shapes(s, d), "cut")[1].groupBy(F.col("unit").alias("cut"), "ring").agg(F.count(F.lit(1)).alias("arcs"))


@query("topology_sizes", f"WITH {_RINGS} SELECT cut, count(*) AS rings FROM rings GROUP BY cut", False)
def topology_sizes(s, d):
    """Rings of each unit as they come back from the built topology."""
    made = T.topology(shapes(s, d), "cut", "units", grid=100_000).select(F.from_json("json", "objects struct<units: struct<geometries: array<struct<id: string, arcs: array<array<array<int>>>>>>>").alias("t"))
    return made.select(F.explode("t.objects.units.geometries").alias("g")).select(F.col("g.id").cast("int").alias("cut"), F.size("g.arcs").cast("long").alias("rings"))
