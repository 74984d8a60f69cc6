"""The reference's queries over the test tables, each with its oracle in DuckDB's SQL.

Units are customers, their regions nations; a population is 1000 plus the absolute balance, small below 3000; families
are order priorities; 2001 is the partial year. Feeds are events, blocks (user, day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.operators import events as E
from tallyrift.operators import stats as S
from tallyrift.operators import titles

LAST, REFERENCE = 2001, 2000
FAMILIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
QUERIES: dict = {}
ORACLES: dict = {}

BASE = f"""WITH dim AS (SELECT c_custkey AS cut, c_name AS name, c_nationkey AS region, 1000 + abs(c_acctbal) AS pop, 1000 + abs(c_acctbal) < 3000 AS low FROM customer),
rates AS (SELECT cut, region, pop, low, year(o_orderdate)::INT AS year, o_orderpriority AS family, count(*) * 1e5 / pop AS rate FROM dim JOIN orders ON o_custkey = cut GROUP BY cut, region, pop, low, year(o_orderdate), o_orderpriority),
totals AS (SELECT cut, region, pop, low, year, sum(rate) AS rate, year = {LAST} AS partial FROM rates GROUP BY cut, region, pop, low, year),
latest AS (SELECT * FROM totals WHERE NOT partial QUALIFY row_number() OVER (PARTITION BY cut ORDER BY year DESC) = 1),
ref AS (SELECT cut, any_value(region) AS region, any_value(pop) AS pop, any_value(low) AS low, round(coalesce(max(rate) FILTER (year = {REFERENCE}), max_by(rate, year), 0), 6) AS rate FROM totals GROUP BY cut),
ev AS (SELECT event_id, user_id, event_type, value, ts::DATE AS day, props FROM events)
"""


def query(name: str, sql: str | None, base: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (BASE if base else "") + sql
        return f
    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def dim(s, d):
    pop = 1000 + F.abs("c_acctbal")
    return table(s, d, "customer").select(F.col("c_custkey").alias("cut"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"), pop.alias("pop"), (pop < 3000).alias("low"))


def rates(s, d):
    """Orders are counted before the join, so the join moves a row for each unit, year and family."""
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cut"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(dim(s, d), "cut").select("cut", "region", "pop", "low", "year", "family", X.per_100k(F.col("n"), F.col("pop")).alias("rate"))


def totals(s, d):
    return S.total_rate(rates(s, d), ["cut", "region", "pop", "low", "year"]).withColumn("partial", F.col("year") == LAST)


def ref(s, d):
    return S.at_year(totals(s, d), REFERENCE).withColumn("rate", F.round("rate", 6)).join(dim(s, d).drop("name"), "cut")


def ev(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), "props")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def iso(day: str):
    return F.date_format(day, "yyyy-MM-dd").alias(day)


def unranked():
    """Ranks with 0 for those that have none."""
    return F.coalesce("place", F.lit(0)).alias("place")


# Roll-ups

@query("rollup_total_rate", "SELECT cut, year, round(rate, 6) AS rate FROM totals")
def rollup_total_rate(s, d):
    return r6(totals(s, d).select("cut", "year", "rate"), "rate")


@query("rollup_region_weighted", "SELECT region, year, round(sum(rate * pop) / sum(pop), 6) AS rate, bool_or(partial) AS partial FROM totals GROUP BY region, year")
def rollup_region_weighted(s, d):
    return r6(S.weighted_mean(totals(s, d), ["region", "year"]), "rate")


@query("rollup_national_weighted", "SELECT year, round(sum(rate * pop) / sum(pop), 6) AS rate, bool_or(partial) AS partial FROM totals GROUP BY year")
def rollup_national_weighted(s, d):
    return r6(S.weighted_mean(totals(s, d), ["year"]), "rate")


@query("rollup_typical_mean", "SELECT region, round(avg(rate), 6) AS rate, count(*) AS n FROM latest WHERE NOT low GROUP BY region")
def rollup_typical_mean(s, d):
    return r6(S.typical_mean(totals(s, d), "region"), "rate")


@query("rollup_region_mean_grouping_sets", "SELECT coalesce(region, -1) AS region, round(avg(rate), 6) AS rate FROM latest GROUP BY GROUPING SETS ((region), ())")
def rollup_region_mean_grouping_sets(s, d):
    rows = r6(S.latest_complete(totals(s, d)).rollup("region").agg(F.avg("rate").alias("rate")), "rate")
    return rows.select(F.coalesce("region", F.lit(-1)).alias("region"), "rate")


@query("rollup_victim_counts", "SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL", False)
def rollup_victim_counts(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("cut"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("rollup_region_size", "SELECT region, round(sum(pop), 4) AS pop, count(*) AS n FROM dim GROUP BY region")
def rollup_region_size(s, d):
    return dim(s, d).groupBy("region").agg(F.round(F.sum("pop"), 4).alias("pop"), F.count(F.lit(1)).alias("n"))


# Ranks and trends

@query("rank_national", "SELECT cut, rate, CASE WHEN NOT low THEN row_number() OVER (PARTITION BY low ORDER BY rate DESC, cut) ELSE 0 END AS place FROM ref")
def rank_national(s, d):
    return S.rank(ref(s, d), "place", "rate", "cut", eligible=~F.col("low")).select("cut", "rate", unranked())


@query("rank_regional", "SELECT cut, region, CASE WHEN NOT low THEN row_number() OVER (PARTITION BY region, low ORDER BY rate DESC, cut) ELSE 0 END AS place FROM ref")
def rank_regional(s, d):
    return S.rank(ref(s, d), "place", "rate", "cut", ["region"], ~F.col("low")).select("cut", "region", unranked())


@query("rank_family", f"SELECT family, cut, round(rate, 6) AS rate, CASE WHEN NOT low THEN row_number() OVER (PARTITION BY family, low ORDER BY round(rate, 6) DESC, cut) ELSE 0 END AS place FROM rates WHERE year = {REFERENCE}")
def rank_family(s, d):
    rows = r6(rates(s, d).where(F.col("year") == REFERENCE), "rate")
    return S.rank(rows, "place", "rate", "cut", ["family"], ~F.col("low")).select("family", "cut", "rate", unranked())


@query("rank_region_position", "SELECT region, round(avg(rate), 6) AS rate, rank() OVER (ORDER BY round(avg(rate), 6) DESC) AS place FROM latest GROUP BY region")
def rank_region_position(s, d):
    means = r6(S.latest_complete(totals(s, d)).groupBy("region").agg(F.avg("rate").alias("rate")), "rate")
    return means.withColumn("place", F.rank().over(Window.orderBy(F.desc("rate"))).cast("long"))


@query("rank_percentile_card", "SELECT cut, place, least(greatest(floor((n - place) * 100.0::DOUBLE / n + 0.5), 1), 99)::BIGINT AS card FROM (SELECT cut, row_number() OVER (ORDER BY rate DESC, cut) AS place, count(*) OVER () AS n FROM ref WHERE NOT low)")
def rank_percentile_card(s, d):
    some = ref(s, d).where("NOT low")
    rows = S.rank(some, "place", "rate", "cut").join(F.broadcast(some.agg(F.count(F.lit(1)).alias("n"))))
    return rows.select("cut", "place", S.percentile_card(F.col("place"), F.col("n")).alias("card"))


@query("trend_three_year", """SELECT cut, CASE WHEN (rate - was) * 100 / nullif(was, 0) > 5 THEN 'up' WHEN (rate - was) * 100 / nullif(was, 0) < -5 THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT cut, rate, lag(rate, 3) OVER w AS was, lead(year) OVER w AS next FROM totals WHERE NOT partial WINDOW w AS (PARTITION BY cut ORDER BY year)) WHERE next IS NULL""")
def trend_three_year(s, d):
    return S.three_step_trend(totals(s, d))


@query("partial_year_flag", "SELECT year(o_orderdate)::INT AS year, strftime(max(o_orderdate), '%Y-%m-%d') AS last, year(o_orderdate) = 2001 AND max(o_orderdate)::DATE < make_date(year(o_orderdate), 12, 31) AS partial FROM orders GROUP BY year(o_orderdate)", False)
def partial_year_flag(s, d):
    rows = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    partial = (F.col("year") == LAST) & (F.col("last") < F.make_date("year", F.lit(12), F.lit(31)))
    return rows.select("year", F.date_format("last", "yyyy-MM-dd").alias("last"), partial.alias("partial"))


# Bands

@query("band_percentile_level", "SELECT cut, CASE WHEN p >= .8 THEN 5 WHEN p >= .6 THEN 4 WHEN p >= .4 THEN 3 WHEN p >= .2 THEN 2 ELSE 1 END::BIGINT AS level FROM (SELECT cut, (rank() OVER (ORDER BY rate) - 1)::DOUBLE / count(*) OVER () AS p FROM ref)")
def band_percentile_level(s, d):
    return S.band_percentile(ref(s, d)).select("cut", "level")


@query("band_qcut", """SELECT cut, CASE WHEN len(list_distinct(e)) < 6 THEN 3 WHEN rate <= e[2] THEN 1 WHEN rate <= e[3] THEN 2 WHEN rate <= e[4] THEN 3 WHEN rate <= e[5] THEN 4 ELSE 5 END::BIGINT AS level
FROM ref, (SELECT quantile_cont(rate, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM ref)""")
def band_qcut(s, d):
    return S.band_quantile_cut(ref(s, d), "rate").select("cut", "level")


@query("band_value_threshold", """SELECT cut, CASE WHEN len(v) = 0 THEN 3 WHEN rate <= v[floor(len(v) * .2)::INT + 1] THEN 1 WHEN rate <= v[floor(len(v) * .4)::INT + 1] THEN 2 WHEN rate <= v[floor(len(v) * .6)::INT + 1] THEN 3 WHEN rate <= v[floor(len(v) * .8)::INT + 1] THEN 4 ELSE 5 END::BIGINT AS level
FROM ref, (SELECT list(rate ORDER BY rate) AS v FROM ref WHERE NOT low)""")
def band_value_threshold(s, d):
    return S.band_by_position(ref(s, d), ref(s, d).where("NOT low")).select("cut", "level")


@query("band_positive_breaks", """SELECT cut, CASE WHEN rate <= v[floor(len(v) * .2)::INT + 1] THEN 1 WHEN rate <= v[floor(len(v) * .4)::INT + 1] THEN 2 WHEN rate <= v[floor(len(v) * .6)::INT + 1] THEN 3 WHEN rate <= v[floor(len(v) * .8)::INT + 1] THEN 4 ELSE 5 END::BIGINT AS level
FROM ref, (SELECT list(rate ORDER BY rate) AS v FROM ref WHERE rate > 0)""")
def band_positive_breaks(s, d):
    return S.band_by_position(ref(s, d), ref(s, d).where("rate > 0")).select("cut", "level")


@query("band_level_max_breaks", """, lv AS (SELECT rate, CASE WHEN p >= .8 THEN 5 WHEN p >= .6 THEN 4 WHEN p >= .4 THEN 3 WHEN p >= .2 THEN 2 ELSE 1 END AS level FROM (SELECT rate, (rank() OVER (ORDER BY rate) - 1)::DOUBLE / count(*) OVER () AS p FROM ref))
SELECT l::BIGINT AS level, last_value(top IGNORE NULLS) OVER (ORDER BY l) AS upper FROM range(1, 6) r(l) LEFT JOIN (SELECT level, max(rate) AS top FROM lv GROUP BY level) ON level = l""")
def band_level_max_breaks(s, d):
    return S.level_breaks(S.band_percentile(ref(s, d)))


@query("band_own_max", """SELECT cut, year, CASE WHEN p >= .8 THEN 5 WHEN p >= .6 THEN 4 WHEN p >= .4 THEN 3 WHEN p >= .2 THEN 2 ELSE 1 END::BIGINT AS level FROM (SELECT cut, year, round(rate, 6) / max(round(rate, 6)) OVER (PARTITION BY cut) AS p FROM totals)""")
def band_own_max(s, d):
    return S.band_own_maximum(r6(totals(s, d), "rate")).select("cut", "year", "level")


@query("band_tiers", """SELECT cut, CASE WHEN place <= round(n * 0.1::DOUBLE) THEN 'top10' WHEN place <= round(n * 0.25::DOUBLE) THEN 'top25' WHEN place >= round(n * 0.9::DOUBLE) THEN 'bottom10' WHEN place >= round(n * 0.75::DOUBLE) THEN 'bottom25' ELSE 'mid' END AS tier
FROM (SELECT cut, row_number() OVER (ORDER BY rate DESC, cut) AS place, count(*) OVER () AS n FROM ref)""")
def band_tiers(s, d):
    r = ref(s, d)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    return S.rank(r, "place", "rate", "cut").join(F.broadcast(n)).select("cut", S.tier(F.col("place"), F.col("n")).alias("tier"))


@query("hist_p97_bins", """, cap AS (SELECT list(rate ORDER BY rate)[floor(count(*) * .97)::INT + 1] AS c FROM ref),
counts AS (SELECT least(23, floor(rate / c * 24))::BIGINT AS bin, count(*) AS n FROM ref, cap GROUP BY 1)
SELECT b AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / max(coalesce(n, 0)) OVER (), 6) AS share FROM range(24) r(b) LEFT JOIN counts ON bin = b""")
def hist_p97_bins(s, d):
    return r6(S.histogram_p97(ref(s, d)), "share")


# Composite

@query("composite_normalised_metric", """, v AS (SELECT list(rate ORDER BY rate) AS l FROM ref), e AS (SELECT l[floor(len(l) * .01)::INT + 1] AS lo, l[len(l) - floor(len(l) * .01)::INT] AS hi FROM v)
SELECT cut, round(CASE WHEN hi > lo THEN (least(greatest(rate, lo), hi) - lo) * 100 / (hi - lo) ELSE 0 END, 6) AS scaled FROM ref, e""")
def composite_normalised_metric(s, d):
    return r6(S.winsorised(ref(s, d), "rate", "scaled").select("cut", "scaled"), "scaled")


WEIGHTS = {"urgent": 0.4, "high": 0.3, "low_priority": 0.3}
_METRICS = f"""m AS (SELECT cut, max(rate) FILTER (family = '1-URGENT') AS urgent, max(rate) FILTER (family = '2-HIGH') AS high, max(rate) FILTER (family = '5-LOW') AS low_priority FROM rates WHERE year = {REFERENCE} GROUP BY cut),
sc AS (SELECT cut, (coalesce(urgent, 0) * .4 + coalesce(high, 0) * .3 + coalesce(low_priority, 0) * .3) / nullif((urgent IS NOT NULL)::INT * .4 + (high IS NOT NULL)::INT * .3 + (low_priority IS NOT NULL)::INT * .3, 0) AS raw,
 ((urgent IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low_priority IS NOT NULL)::INT)::BIGINT AS n_metrics FROM m),
scored AS (SELECT cut, round(coalesce(raw, 0), 6) AS score, n_metrics FROM sc)"""


def scored(s, d):
    rows = rates(s, d).where(F.col("year") == REFERENCE).groupBy("cut").pivot("family", FAMILIES).agg(F.max("rate"))
    rows = rows.select("cut", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"), F.col("`5-LOW`").alias("low_priority"))
    return r6(S.weighted_score(rows, WEIGHTS), "score").select("cut", "score", "n_metrics")


def winsorised_scores(s, d):
    """The reference's index: each metric clipped and scaled over all units first, then weighed; a unit without workers'
    figures, here one without a supplier of its number, has one metric less available."""
    rows = rates(s, d).where(F.col("year") == REFERENCE).groupBy("cut", "region").pivot("family", FAMILIES).agg(F.max("rate"))
    rows = rows.select("cut", "region", *(F.round(F.col(f"`{c}`"), 6).alias(n) for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low_priority"))))
    for m in WEIGHTS:
        rows = S.winsorised(rows, m, f"scaled_{m}")
    rows = S.weighted_score(rows, {f"scaled_{m}": w for m, w in WEIGHTS.items()})
    have = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut"), F.lit(True).alias("have"))
    return r6(rows.join(have, "cut", "left"), "score").select("cut", "region", "score", F.greatest(F.col("n_metrics") - F.col("have").isNull().cast("long"), F.lit(0)).alias("n_metrics"))


@query("composite_score", f", {_METRICS} SELECT cut, score, n_metrics FROM scored")
def composite_score(s, d):
    return scored(s, d)


@query("composite_rank_level", f", {_METRICS} SELECT cut, row_number() OVER (ORDER BY score DESC, cut) AS place, CASE WHEN len(list_distinct(e)) < 6 THEN 3 WHEN score <= e[2] THEN 1 WHEN score <= e[3] THEN 2 WHEN score <= e[4] THEN 3 WHEN score <= e[5] THEN 4 ELSE 5 END::BIGINT AS level FROM scored, (SELECT quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scored)")
def composite_rank_level(s, d):
    return S.band_quantile_cut(S.rank(scored(s, d), "place", "score", "cut")).select("cut", "place", "level")


_EDGE = "e_{m} AS (SELECT l[floor(len(l) * .01)::INT + 1] AS lo, l[len(l) - floor(len(l) * .01)::INT] AS hi FROM (SELECT list(round({m}, 6) ORDER BY round({m}, 6)) FILTER ({m} IS NOT NULL) AS l FROM m))"
_SCALED = "CASE WHEN {m} IS NULL THEN NULL WHEN e_{m}.hi > e_{m}.lo THEN (least(greatest(round({m}, 6), e_{m}.lo), e_{m}.hi) - e_{m}.lo) * 100 / (e_{m}.hi - e_{m}.lo) ELSE 0 END AS {m}"


@query("composite_winsorised", f""", m AS (SELECT cut, region, max(rate) FILTER (family = '1-URGENT') AS urgent, max(rate) FILTER (family = '2-HIGH') AS high, max(rate) FILTER (family = '5-LOW') AS low_priority FROM rates WHERE year = {REFERENCE} GROUP BY cut, region),
{", ".join(_EDGE.format(m=m) for m in WEIGHTS)},
x AS (SELECT cut, region, {", ".join(_SCALED.format(m=m) for m in WEIGHTS)} FROM m, {", ".join(f"e_{m}" for m in WEIGHTS)}),
y AS (SELECT cut, region, round(coalesce((coalesce(urgent, 0) * .4 + coalesce(high, 0) * .3 + coalesce(low_priority, 0) * .3) / nullif((urgent IS NOT NULL)::INT * .4::DOUBLE + (high IS NOT NULL)::INT * .3::DOUBLE + (low_priority IS NOT NULL)::INT * .3::DOUBLE, 0), 0), 6) AS score,
 greatest((urgent IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low_priority IS NOT NULL)::INT - (cut NOT IN (SELECT s_suppkey FROM supplier))::INT, 0)::BIGINT AS n_metrics FROM x)
SELECT cut, score, n_metrics, row_number() OVER (ORDER BY score DESC, cut) AS place, row_number() OVER (PARTITION BY region ORDER BY score DESC, cut) AS place_in_region FROM y""")
def composite_winsorised(s, d):
    told = S.rank(winsorised_scores(s, d), "place", "score", "cut")
    return S.rank(told, "place_in_region", "score", "cut", ["region"]).drop("region")


@query("exposure_denominator", """, w AS (SELECT o_custkey AS cut, sum(o_totalprice) AS workers FROM orders GROUP BY 1)
SELECT cut, round(CASE WHEN workers IS NULL OR workers / pop > 5 THEN pop ELSE workers END, 4) AS denominator, coalesce(workers / pop > 5, false) AS capped FROM dim LEFT JOIN w USING (cut)""")
def exposure_denominator(s, d):
    w = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cut")).agg(F.sum("o_totalprice").alias("workers"))
    rows = dim(s, d).join(w, "cut", "left").select("cut", S.exposure_denominator(F.col("workers"), F.col("pop")).alias("x"))
    return rows.select("cut", F.round("x.denominator", 4).alias("denominator"), "x.capped")


# Comparison

@query("pairs_same_region", "SELECT a.region, count(*) AS n FROM dim a JOIN dim b ON a.region = b.region AND a.cut < b.cut GROUP BY a.region")
def pairs_same_region(s, d):
    return dim(s, d).groupBy("region").agg(F.count(F.lit(1)).alias("m")).select("region", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("n")).where("n > 0")


_NEAR = """SELECT a.cut, b.cut AS other, round(abs(a.rate - b.rate), 6) AS gap, row_number() OVER (PARTITION BY a.cut ORDER BY round(abs(b.rate - a.rate), 6), b.cut) AS place
FROM ref a JOIN ref b ON a.region = b.region AND a.cut <> b.cut AND NOT a.low AND NOT b.low QUALIFY place <= """


@query("nearest_comparable", _NEAR + "1")
def nearest_comparable(s, d):
    return E.nearest(ref(s, d).where("NOT low"), "cut", "region", "rate", 1).withColumn("gap", F.round("gap", 6))


@query("nearest_comparables_5", _NEAR + "5")
def nearest_comparables_5(s, d):
    return E.nearest(ref(s, d).where("NOT low"), "cut", "region", "rate", 5).withColumn("gap", F.round("gap", 6))


@query("nearest_comparable_national", """, pool AS (SELECT cut, region, rate, count(*) OVER (PARTITION BY region) - 1 AS others FROM ref WHERE NOT low)
SELECT a.cut, b.cut AS other, round(abs(a.rate - b.rate), 6) AS gap, row_number() OVER (PARTITION BY a.cut ORDER BY round(abs(b.rate - a.rate), 6), b.cut) AS place
FROM pool a JOIN pool b ON a.cut <> b.cut AND (a.others < 2 OR a.region = b.region) QUALIFY place <= 1""")
def nearest_comparable_national(s, d):
    """As nearest_comparable, but from all regions where the own has fewer than two others."""
    return E.nearest(ref(s, d).where("NOT low"), "cut", "region", "rate", 1, least=2)


@query("dominant_families", "SELECT cut, year, family, n FROM (SELECT cut, year, family, row_number() OVER (PARTITION BY cut, year ORDER BY round(rate, 6) DESC, family) AS n FROM rates) WHERE n <= 2")
def dominant_families(s, d):
    w = Window.partitionBy("cut", "year").orderBy(F.round("rate", 6).desc(), "family")
    return rates(s, d).withColumn("n", F.row_number().over(w).cast("long")).where("n <= 2").select("cut", "year", "family", "n")


@query("pair_divergent_family", f"""SELECT a.region AS one, b.region AS two, max_by(a.family, (abs(a.r - b.r), -ascii(a.family))) AS family
FROM (SELECT region, family, round(avg(rate), 6) AS r FROM rates GROUP BY ALL) a JOIN (SELECT region, family, round(avg(rate), 6) AS r FROM rates GROUP BY ALL) b ON a.family = b.family AND a.region + 1 = b.region GROUP BY 1, 2""")
def pair_divergent_family(s, d):
    m = r6(rates(s, d).groupBy("region", "family").agg(F.avg("rate").alias("r")), "r")
    b = m.select((F.col("region") - 1).alias("region"), "family", F.col("r").alias("r2"))
    return m.join(b, ["region", "family"]).groupBy(F.col("region").alias("one"), (F.col("region") + 1).alias("two")).agg(
        F.max_by("family", F.struct(F.abs(F.col("r") - F.col("r2")), -F.ascii("family"))).alias("family"))


@query("shared_complete_year", "SELECT max(year)::INT AS year FROM (SELECT year FROM totals WHERE NOT partial AND cut IN (1, 2, 3) GROUP BY year HAVING count(DISTINCT cut) = (SELECT count(DISTINCT cut) FROM totals WHERE cut IN (1, 2, 3)))")
def shared_complete_year(s, d):
    t = totals(s, d).where(F.col("cut").isin(1, 2, 3))
    want = t.agg(F.count_distinct("cut").alias("want"))
    years = t.where("NOT partial").groupBy("year").agg(F.count_distinct("cut").alias("n"))
    return years.join(F.broadcast(want)).where("n = want").agg(F.max("year").alias("year"))


@query("top_bottom_10", "(SELECT 'top' AS side, cut, rate FROM (SELECT * FROM ref ORDER BY rate DESC, cut LIMIT 10)) UNION ALL (SELECT 'bottom', cut, rate FROM (SELECT * FROM ref ORDER BY rate, cut LIMIT 10))")
def top_bottom_10(s, d):
    r = ref(s, d)
    side = lambda name, order: r.orderBy(order, "cut").limit(10).select(F.lit(name).alias("side"), "cut", "rate")
    return side("top", F.desc("rate")).unionByName(side("bottom", F.asc("rate")))


@query("ratings_by_year_map", "SELECT cut, string_agg(year || '=' || round(rate)::BIGINT, ',' ORDER BY year) AS rates FROM totals WHERE NOT partial GROUP BY cut")
def ratings_by_year_map(s, d):
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", F.col("year"), F.round("rate").cast("long"))))
    return totals(s, d).where("NOT partial").groupBy("cut").agg(F.array_join(pairs, ",").alias("rates"))


@query("directory_sort", "SELECT cut, name, row_number() OVER (ORDER BY (rate = 0)::INT, rate, name) AS n FROM ref JOIN (SELECT cut, name FROM dim) USING (cut)")
def directory_sort(s, d):
    rows = ref(s, d).join(dim(s, d).select("cut", "name"), "cut").withColumn("key", F.when(F.col("rate") == 0, float("inf")).otherwise(F.col("rate")))
    return S.rank(rows, "n", "key", "cut", descending=False).select("cut", "name", "n")


# Facets

@query("facet_family", "SELECT 'event_type' AS dimension, event_type AS key, count(*) AS n FROM ev GROUP BY event_type")
def facet_family(s, d):
    return E.facet_counts(ev(s, d), ["event_type"])


@query("facet_region", "SELECT 'region' AS dimension, (user_id % 16)::VARCHAR AS key, count(*) AS n FROM ev GROUP BY 2")
def facet_region(s, d):
    return E.facet_counts(ev(s, d).withColumn("region", F.col("user_id") % 16), ["region"])


@query("facet_window_counts", "SELECT count(*) FILTER (day >= m) AS last_1, count(*) FILTER (day >= m - 6) AS last_7, count(*) FILTER (day >= m - 29) AS last_30 FROM ev, (SELECT max(day) AS m FROM ev)")
def facet_window_counts(s, d):
    return E.window_counts(ev(s, d), "day")


@query("facet_window_tags", "SELECT CASE WHEN day = m THEN 'today' WHEN day >= m - 6 THEN '7d' WHEN day >= m - 29 THEN '30d' ELSE 'older' END AS tag, count(*) AS n FROM ev, (SELECT max(day) AS m FROM ev) GROUP BY 1")
def facet_window_tags(s, d):
    newest = ev(s, d).agg(F.max("day").alias("m"))
    return ev(s, d).join(F.broadcast(newest)).groupBy(E.window_tag(F.col("day"), F.col("m")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("facet_month_union", "SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT event_id) AS n, count(DISTINCT event_id) FILTER (src = 'current') AS n_current FROM (SELECT *, 'archive' AS src FROM ev WHERE day < DATE '2024-01-20' UNION ALL SELECT *, 'current' FROM ev WHERE day >= DATE '2024-01-15') GROUP BY 1")
def facet_month_union(s, d):
    e = ev(s, d)
    both = e.where("day < DATE '2024-01-20'").withColumn("src", F.lit("archive")).unionByName(e.where("day >= DATE '2024-01-15'").withColumn("src", F.lit("current")))
    ids = both.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "event_id").agg(F.bool_or(F.col("src") == "current").alias("now"))
    return ids.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count_if("now").alias("n_current"))


@query("facet_self_excluding", """SELECT 'event_type' AS dimension, event_type AS key, count(*) FILTER (user_id % 4 IN (1, 2)) AS n FROM ev WHERE value > 10 GROUP BY event_type
UNION ALL SELECT 'region', (user_id % 4)::VARCHAR, count(*) FILTER (event_type IN ('click', 'view')) FROM ev WHERE value > 10 GROUP BY user_id % 4""")
def facet_self_excluding(s, d):
    return E.self_excluding_counts(ev(s, d).withColumn("region", F.col("user_id") % 4), {"event_type": ["click", "view"], "region": [1, 2]}, F.col("value") > 10)


_DAYS = """days AS (SELECT x::DATE AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(m - 29, m, INTERVAL 1 DAY)) AS x FROM (SELECT max(day) AS m FROM ev)) LEFT JOIN ev ON day = x::DATE GROUP BY 1)"""


@query("facet_day_histogram", f", {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, round(n * 100.0::DOUBLE / max(n) OVER (), 6) AS pct FROM days")
def facet_day_histogram(s, d):
    return r6(E.day_histogram(ev(s, d), "day"), "pct").withColumn("day", iso("day"))


@query("facet_peak_day", f", {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n FROM days ORDER BY n DESC, day LIMIT 1")
def facet_peak_day(s, d):
    return E.peak(E.day_histogram(ev(s, d), "day")).select(iso("day"), "n")


@query("facet_day_strip", "SELECT strftime(x::DATE, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(greatest(min(day), max(day) - 13), max(day), INTERVAL 1 DAY)) AS x FROM ev) LEFT JOIN ev ON day = x::DATE AND event_type = 'click' GROUP BY 1")
def facet_day_strip(s, d):
    e = ev(s, d)
    span = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence(F.greatest("a", F.date_sub("b", 13)), "b")).alias("day"))
    counts = e.where("event_type = 'click'").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return span.join(counts, "day", "left").select(iso("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("facet_top5_latest4", "(SELECT 'family' AS kind, event_type AS key, count(*) AS n FROM ev GROUP BY event_type ORDER BY n DESC, key LIMIT 5) UNION ALL (SELECT 'latest', event_id::VARCHAR, 1 FROM ev ORDER BY day DESC, event_id LIMIT 4)")
def facet_top5_latest4(s, d):
    e = ev(s, d)
    top = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(5).select(F.lit("family").alias("kind"), F.col("event_type").alias("key"), "n")
    return top.unionByName(e.orderBy(F.desc("day"), "event_id").limit(4).select(F.lit("latest").alias("kind"), F.col("event_id").cast("string").alias("key"), F.lit(1).cast("long").alias("n")))


# Texts and URLs

@query("text_keyword_filter", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'moron|idiot|license|copyright')", False)
def text_keyword_filter(s, d):
    return table(s, d, "documents").where(F.lower("text").rlike("moron|idiot|license|copyright")).select("doc_id")


@query("text_forbidden_terms", "SELECT doc_id, len(regexp_extract_all(' ' || strip_accents(lower(text)) || ' ', '[^a-z0-9](trash|clown|scum)')) AS n FROM documents WHERE regexp_matches(lower(text), 'trash|clown|scum')", False)
def text_forbidden_terms(s, d):
    n = F.size(F.regexp_extract_all(F.concat(F.lit(" "), X.norm(F.col("text")), F.lit(" ")), F.lit("[^a-z0-9](trash|clown|scum)"), F.lit(0))).cast("long")
    return table(s, d, "documents").where(F.lower("text").rlike("trash|clown|scum")).select("doc_id", n.alias("n"))


@query("text_retag", "SELECT doc_id, CASE WHEN source = 'src1' AND regexp_matches(text, '(?i)the|der|las') AND NOT regexp_matches(text, '(?i)license') THEN 'retagged' ELSE source END AS source FROM documents", False)
def text_retag(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.when((F.col("source") == "src1") & t.rlike("(?i)the|der|las") & ~t.rlike("(?i)license"), "retagged").otherwise(F.col("source")).alias("source"))


@query("text_visible_html", r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\s+', ' ', 'g'))) AS digest FROM pages""", False)
def text_visible_html(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(X.visible_text(F.col("html")), 256).alias("digest"))


@query("text_norm", "SELECT doc_id, sha256(strip_accents(lower(text))) AS digest FROM documents", False)
def text_norm(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.norm(F.col("text")), 256).alias("digest"))


@query("text_slug_accents", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[\x27`‘’]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS digest FROM documents""", False)
def text_slug_accents(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.slug(F.col("text")), 256).alias("digest"))


@query("text_title_key", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""", False)
def text_title_key(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.title_key(F.col("text")), 256).alias("digest"))


@query("text_slug", r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""", False)
def text_slug(s, d):
    return table(s, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("text_citation", r"""SELECT event_id, CASE WHEN trim(o) <> '' THEN trim(o) || '. ' ELSE 's. a. ' END || CASE WHEN d IS NULL THEN '(s. f.)' ELSE '(' || year(d) || ', ' || day(d) || ' de ' ||
 CASE month(d) WHEN 1 THEN 'enero' WHEN 2 THEN 'febrero' WHEN 3 THEN 'marzo' WHEN 12 THEN 'diciembre' END || ')' END || '. ' || coalesce(props, '') || '. ' || coalesce(u, '') AS citation
FROM (SELECT event_id, props, CASE WHEN event_type = 'click' THEN '  ' WHEN event_type = 'view' THEN NULL ELSE ' ' || event_type END AS o, CASE WHEN event_id % 7 > 1 THEN day END AS d, CASE WHEN event_id % 5 > 0 THEN 'https://x.y/' || event_id END AS u FROM ev)""")
def text_citation(s, d):
    """With missing outlets, dates that aren't dates or aren't there, and missing addresses."""
    kind, n = F.col("event_type"), F.col("event_id")
    outlet = F.when(kind == "click", "  ").when(kind == "view", None).otherwise(F.concat(F.lit(" "), kind))
    date = F.when(n % 7 == 0, "31 de mayo").when(n % 7 > 1, F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T08:00:00")))
    url = F.when(n % 5 > 0, F.concat(F.lit("https://x.y/"), n))
    return ev(s, d).select("event_id", X.citation(outlet, date, F.col("props"), url).alias("citation"))


@query("text_word_count", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents", False)
def text_word_count(s, d):
    return table(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("n"))


_CANON = "CASE WHEN position('?' IN url) = 0 THEN url WHEN q = '' THEN split_part(url, '?', 1) ELSE split_part(url, '?', 1) || '?' || q END"
_Q = "SELECT page_id, url, array_to_string(list_filter(string_split(substr(url, position('?' IN url) + 1), '&'), lambda p: NOT starts_with(lower(p), 'utm_')), '&') AS q FROM pages"


@query("url_canonical_dedup", f"SELECT page_id, c AS url FROM (SELECT page_id, {_CANON} AS c FROM ({_Q})) QUALIFY row_number() OVER (PARTITION BY c ORDER BY page_id) = 1", False)
def url_canonical_dedup(s, d):
    rows = table(s, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))
    return E.first_wins([rows], "url", "page_id")


@query("url_id", "SELECT page_id, substr(sha256(url), 1, 16) AS id FROM pages", False)
def url_id(s, d):
    return table(s, d, "pages").select("page_id", X.url_id(F.col("url")).alias("id"))


@query("url_scheme_guard", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^https?:')", False)
def url_scheme_guard(s, d):
    return table(s, d, "pages").where(X.safe_scheme(F.col("url"))).select("page_id")


@query("csv_formula_guard", r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS cell FROM documents", False)
def csv_formula_guard(s, d):
    return table(s, d, "documents").select("doc_id", X.csv_guard(F.col("text")).alias("cell"))


@query("csv_formula_guard_whole", r"SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END) AS digest FROM documents", False)
def csv_formula_guard_whole(s, d):
    """As csv_formula_guard, by the cell's digest."""
    return table(s, d, "documents").select("doc_id", F.sha2(X.csv_guard(F.col("text")), 256).alias("digest"))


@query("number_formats", "SELECT o_orderkey, floor(o_totalprice + 0.5)::BIGINT AS js, round_even(o_totalprice, 0) AS even, translate(format('{:,.1f}', o_totalprice), ',.', '.,') AS es FROM orders", False)
def number_formats(s, d):
    x = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", X.js_round(x).alias("js"), X.even_round(x).alias("even"), X.locale_text(x).alias("es"))


# State

@query("seen_anti_join", "SELECT event_id FROM ev WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM ev WHERE day < DATE '2024-01-03')")
def seen_anti_join(s, d):
    e = ev(s, d).withColumn("url", F.concat_ws("/", "user_id", "event_type"))
    return E.unseen(e, e.where("day < DATE '2024-01-03'"), "url").select("event_id")


_LEDGER = """ledger AS (SELECT user_id AS id, CASE user_id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'permanent_failure' END AS status, user_id % 3 AS attempts FROM ev WHERE user_id % 5 < 3 GROUP BY user_id),
outcomes AS (SELECT user_id AS id, CASE WHEN count(*) % 2 = 0 THEN 'fetched' ELSE 'failed' END AS new FROM ev WHERE user_id % 5 > 0 GROUP BY user_id)"""


def ledger(s, d):
    k = F.col("id") % 4
    return ev(s, d).select(F.col("user_id").alias("id")).distinct().where("id % 5 < 3").select(
        "id", F.when(k == 0, "fetched").when(k == 1, "pending").when(k == 2, "failed").otherwise("permanent_failure").alias("status"), (F.col("id") % 3).alias("attempts"))


@query("pending_selection", f", {_LEDGER} SELECT DISTINCT user_id AS id FROM ev WHERE user_id NOT IN (SELECT id FROM ledger WHERE status IN ('fetched', 'permanent_failure'))")
def pending_selection(s, d):
    return E.pending(ev(s, d).select(F.col("user_id").alias("id")).distinct(), ledger(s, d), "id")


@query("ledger_upsert", f""", {_LEDGER} SELECT coalesce(l.id, o.id) AS id, CASE WHEN coalesce(status IN ('fetched', 'permanent_failure'), false) OR new IS NULL THEN status WHEN new = 'failed' AND coalesce(attempts, 0) + 1 >= 3 THEN 'permanent_failure' ELSE new END AS status,
(coalesce(attempts, 0) + CASE WHEN coalesce(status IN ('fetched', 'permanent_failure'), false) OR new IS NULL THEN 0 ELSE 1 END)::BIGINT AS attempts FROM ledger l FULL JOIN outcomes o ON l.id = o.id""")
def ledger_upsert(s, d):
    out = ev(s, d).where("user_id % 5 > 0").groupBy(F.col("user_id").alias("id")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "fetched").otherwise("failed").alias("status"))
    return E.ledger_upsert(ledger(s, d), out, "id")


_PARTS = "(SELECT *, 0 AS part FROM ev WHERE day {one} UNION ALL SELECT *, 1 FROM ev WHERE day {two})"


def _merged(s, d, one, two):
    e = ev(s, d)
    return E.first_wins([e.where(one), e.where(two)], "user_id", "event_id").select("user_id", "event_id")


@query("merge_existing_wins", "SELECT user_id, event_id FROM " + _PARTS.format(one="< DATE '2024-01-10'", two=">= DATE '2024-01-05'") + " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1")
def merge_existing_wins(s, d):
    return _merged(s, d, "day < DATE '2024-01-10'", "day >= DATE '2024-01-05'")


@query("merge_current_wins", "SELECT user_id, event_id FROM " + _PARTS.format(one=">= DATE '2024-01-25'", two="< DATE '2024-01-28'") + " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1")
def merge_current_wins(s, d):
    return _merged(s, d, "day >= DATE '2024-01-25'", "day < DATE '2024-01-28'")


@query("window_archive_split", "SELECT slot, count(*) AS n FROM (SELECT CASE WHEN event_id % 97 = 0 OR day >= DATE '2024-02-10' - 30 THEN 'current' ELSE strftime(day, '%Y-%m') END AS slot FROM ev) GROUP BY slot")
def window_archive_split(s, d):
    rows = ev(s, d).withColumn("date", F.when(F.col("event_id") % 97 == 0, "unknown").otherwise(F.date_format("day", "yyyy-MM-dd")))
    return E.split_by_age(rows, "date", F.lit("2024-02-10").cast("date")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_digest", "SELECT lang, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest, count(*) AS n FROM (SELECT lang, sha256(text) AS h FROM documents) GROUP BY lang", False)
def corpus_digest(s, d):
    return E.digest(table(s, d, "documents").select("lang", F.sha2("text", 256).alias("h")), "h", ["lang"])


@query("corpus_digest_ranges", "SELECT lang, sha256(string_agg(d, chr(10) ORDER BY p)) AS digest, sum(n)::BIGINT AS n FROM (SELECT lang, substr(h, 1, 2) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM (SELECT lang, sha256(text) AS h FROM documents) GROUP BY 1, 2) GROUP BY lang", False)
def corpus_digest_ranges(s, d):
    """The digest of a language's ranges of hashes, whose own digests tasks of their own make: for corpora of any size."""
    return E.digest_ranges(table(s, d, "documents").select("lang", F.sha2("text", 256).alias("h")), "h", ["lang"])


@query("corpus_state", "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY 1", False)
def corpus_state(s, d):
    return table(s, d, "documents").groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("lang") == "en").alias("english"))


@query("fetch_cap_priority", "SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS p FROM ev) ORDER BY p, event_id LIMIT 100")
def fetch_cap_priority(s, d):
    return ev(s, d).orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").limit(100).select("event_id")


# Matching

@query("resolver_ambiguity", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(n_name) = lower((SELECT n2.n_name FROM nation n2 WHERE n2.n_nationkey = s_nationkey)) QUALIFY count(*) OVER (PARTITION BY s_suppkey) = 1", False)
def resolver_ambiguity(s, d):
    n = table(s, d, "nation")
    named = table(s, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), X.norm(F.col("n_name")).alias("key")), "s_nationkey")
    found = named.join(n.select("n_name", X.norm(F.col("n_name")).alias("key")), "key")
    return found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("s_suppkey"))).where("c = 1").select("s_suppkey", "n_name")


@query("pairs_in_block", "SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = b.event_type AND a.event_id < b.event_id")
def pairs_in_block(s, d):
    return E.block_pairs(ev(s, d).select("event_id", "user_id", "day", "event_type"), ["user_id", "day", "event_type"], "event_id").select("event_id_a", "event_id_b")


@query("dedup_greedy", None)
def dedup_greedy(s, d):
    """Turns of a conversation, each compared with those kept before it; the whole texts count, normalised."""
    rows = table(s, d, "conversations").select("conv_id", "turn", X.title_key(F.col("text")).alias("title"))
    return titles.greedy_titles(rows, ["conv_id"], "turn", "title").select("conv_id", "turn")


#: The ratio of two short texts: twice the characters in matching blocks over all. The longest common run comes first, the
#: earliest in the one and then in the other, and then what lies before it and behind it, until nothing matches.
_RATIO = """, runs AS (SELECT k, a, b, 0 AS i0, len(a) AS i1, 0 AS j0, len(b) AS j1, 0 AS got FROM two
 UNION ALL SELECT k, a, b, CASE side WHEN 0 THEN i0 ELSE i + n END, CASE side WHEN 0 THEN i ELSE i1 END, CASE side WHEN 0 THEN j0 ELSE j + n END, CASE side WHEN 0 THEN j ELSE j1 END, CASE side WHEN 0 THEN n ELSE 0 END
 FROM (SELECT r.*, best.i, best.j, best.n FROM runs r, LATERAL (SELECT i, j, n FROM unnest(range(r.i0, r.i1)) x(i), unnest(range(r.j0, r.j1)) y(j), unnest(range(1, 40)) z(n)
   WHERE n <= r.i1 - i AND n <= r.j1 - j AND substr(r.a, i::INT + 1, n::INT) = substr(r.b, j::INT + 1, n::INT) ORDER BY n DESC, i, j LIMIT 1) best), (VALUES (0), (1)) s(side)),
ratio AS (SELECT k, CASE WHEN len(any_value(a)) + len(any_value(b)) = 0 THEN 1 ELSE 2.0::DOUBLE * sum(got) / (len(any_value(a)) + len(any_value(b))) END AS ratio FROM runs GROUP BY k)
"""


@query("dedup_greedy_pairs", """WITH RECURSIVE named AS (SELECT p_partkey, p_partkey // 2 AS k, p_name || ' ' || lower(p_type) AS t FROM part),
two AS (SELECT x.k, y.t AS a, x.t AS b FROM named x JOIN named y ON x.k = y.k AND x.p_partkey % 2 = 0 AND y.p_partkey % 2 = 1)""" + _RATIO + "SELECT p_partkey FROM named LEFT JOIN ratio USING (k) WHERE p_partkey % 2 = 0 OR coalesce(ratio, 0) < 0.82", False)
def dedup_greedy_pairs(s, d):
    """Parts two by two: the second goes if it is like the first."""
    rows = table(s, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("k"), X.title_key(F.concat_ws(" ", "p_name", "p_type")).alias("title"))
    return titles.greedy_titles(rows, ["k"], "p_partkey", "title").select("p_partkey")


@query("cluster_digest", "SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR)) AS digest, count(*) AS n FROM ev GROUP BY user_id")
def cluster_digest(s, d):
    return E.digest(ev(s, d).select("user_id", F.col("event_id").cast("string").alias("e")), "e", ["user_id"], ",")


_LABEL = "quality = 1 AS t, toxic = 1 AS p, doc_id % 3 > 0 AS a"


@query("pair_metrics", f"""SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn_prefiltered + fn_rejected, 0)::DOUBLE AS recall FROM (
SELECT count(*) FILTER (t AND p AND a) AS tp, count(*) FILTER (NOT t AND p AND a) AS fp, count(*) FILTER (t AND NOT p) AS fn_prefiltered, count(*) FILTER (t AND p AND NOT a) AS fn_rejected, count(*) FILTER (NOT t AND NOT (p AND a)) AS tn FROM (SELECT {_LABEL} FROM labels))""", False)
def pair_metrics(s, d):
    return E.pair_metrics(table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 3 > 0)


@query("classifier_metrics", "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS accuracy, round(avg((toxic IS NULL)::INT), 6) AS null_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang", False)
def classifier_metrics(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return r6(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == 1).cast("int")).alias("accuracy"), F.avg(F.col("toxic").isNull().cast("int")).alias("null_rate")), "accuracy", "null_rate")


# Gates

@query("gate_violations", "SELECT 'rate' AS rule, count(*) FILTER (NOT coalesce(rate BETWEEN 0 AND 400, false)) AS n FROM totals UNION ALL SELECT 'year', count(*) FILTER (NOT coalesce(year BETWEEN 1995 AND 2000, false)) FROM totals")
def gate_violations(s, d):
    return E.violations(totals(s, d), {"rate": F.col("rate").between(0, 400), "year": F.col("year").between(1995, 2000)})


@query("facet_integrity", """SELECT (SELECT count(*) FROM ev) AS n, (SELECT count(*) FROM ev WHERE event_type NOT IN ('click', 'view', 'purchase')) AS no_family,
(SELECT count(*) FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 16)) AS no_region, (SELECT count(DISTINCT event_type) FROM ev WHERE event_type NOT IN ('click', 'view', 'purchase')) AS phantom""")
def facet_integrity(s, d):
    """Events of no known family, of no unit in the first 16 regions, and families that nobody expects."""
    e = ev(s, d).withColumn("known", F.col("event_type").isin("click", "view", "purchase"))
    units = dim(s, d).where("region < 16").select(F.col("cut").alias("user_id"), F.lit(True).alias("found"))
    found = e.join(units, "user_id", "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("no_family"), F.count_if(F.col("found").isNull()).alias("no_region"),
                     F.count_distinct(F.when(~F.col("known"), F.col("event_type"))).alias("phantom"))


@query("rate_count_consistency", "SELECT count(*) AS n, count(*) FILTER (abs(rate - c * 1e5 / pop) > 0.5) AS off FROM totals JOIN (SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, count(*) AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) USING (cut, year)")
def rate_count_consistency(s, d):
    """Rates against counts of another source, in which orders of one status are missing: their units and years are off."""
    c = table(s, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("cut"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("c"))
    return totals(s, d).join(c, ["cut", "year"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("rate") - F.col("c") * 1e5 / F.col("pop")) > 0.5).alias("off"))


@query("json_property", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS line FROM ev")
def json_property(s, d):
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return ev(s, d).select("event_id", F.get_json_object("props", "$.k").alias("k"), line.alias("line"))


@query("payload_projection", f"SELECT cut, round(rate)::BIGINT AS rate, level FROM (SELECT cut, rate, CASE WHEN p >= .8 THEN 5 WHEN p >= .6 THEN 4 WHEN p >= .4 THEN 3 WHEN p >= .2 THEN 2 ELSE 1 END::BIGINT AS level FROM (SELECT cut, rate, (rank() OVER (ORDER BY rate) - 1)::DOUBLE / count(*) OVER () AS p FROM ref))")
def payload_projection(s, d):
    return S.band_percentile(ref(s, d)).select("cut", F.round("rate").cast("long").alias("rate"), "level")
