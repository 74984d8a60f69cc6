"""Directories, boards, layers and further listings over the test tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.operators import boards as B
from tallyrift.operators import stats as S
from tallyrift.plans.queries import FAMILIES, REFERENCE, dim, ev, query, r6, rates, ref, table, totals


def named(s, d):
    return ref(s, d).join(dim(s, d).select("cut", "name"), "cut")


_NAMED = "named AS (SELECT ref.*, name FROM ref JOIN (SELECT cut, name FROM dim) USING (cut))"


# Directory and search

@query("directory_rank", "SELECT cut, CASE WHEN rate > 300 THEN row_number() OVER (PARTITION BY rate > 300 ORDER BY rate DESC, cut) ELSE 0 END AS place FROM ref")
def directory_rank(s, d):
    """Places among the units that have a rate (here of more than 300), low populations too."""
    return S.rank(ref(s, d), "place", "rate", "cut", eligible=F.col("rate") > 300).select("cut", F.coalesce("place", F.lit(0)).alias("place"))


@query("directory_levels", f"""SELECT cut, CASE WHEN rate > 0 THEN CASE WHEN rate <= v[floor(len(v) * .2)::INT + 1] THEN 1 WHEN rate <= v[floor(len(v) * .4)::INT + 1] THEN 2 WHEN rate <= v[floor(len(v) * .6)::INT + 1] THEN 3 WHEN rate <= v[floor(len(v) * .8)::INT + 1] THEN 4 ELSE 5 END ELSE 3 END::BIGINT AS level
FROM (SELECT cut, CASE WHEN cut % 9 = 0 THEN 0 ELSE rate END AS rate FROM ref), (SELECT list(rate ORDER BY rate) AS v FROM ref WHERE NOT low AND cut % 9 > 0 AND rate > 0)""")
def directory_levels(s, d):
    """Thresholds of the positive rates of units that aren't small; a unit without a rate is in the middle band."""
    rows = ref(s, d).withColumn("rate", F.when(F.col("cut") % 9 == 0, 0.0).otherwise(F.col("rate")))
    told = S.band_by_position(rows, rows.where("NOT low AND rate > 0"))
    return told.select("cut", F.when(F.col("rate") > 0, F.col("level")).otherwise(3).alias("level"))


@query("directory_matches", f", {_NAMED} SELECT cut FROM named WHERE contains(lower(name), '#0000000') AND region = 7")
def directory_matches(s, d):
    return named(s, d).where(B.Board(q=" R#0000000 ", region=7, scope=("q", "region")).column()).select("cut")


@query("directory_by_region", f", {_NAMED} SELECT cut, row_number() OVER (ORDER BY region DESC, name) AS n FROM named")
def directory_by_region(s, d):
    """Regions downwards, names upwards within one."""
    rows = S.rank(named(s, d), "at", "cut", "cut", ["region"], descending=False)
    before = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("region")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("region", "before"), "region").select("cut", (F.col("before") + F.col("at")).alias("n"))


@query("search_prefix", "SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'small') ORDER BY p_partkey LIMIT 8", False)
def search_prefix(s, d):
    return table(s, d, "part").where(F.startswith(F.lower("p_name"), F.lower(F.lit("SMALL")))).orderBy("p_partkey").limit(8).select("p_partkey")


@query("search_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND p_partkey NOT IN (0, 3) ORDER BY p_partkey LIMIT 6", False)
def search_contains(s, d):
    """Whatever the case and accents; not those that are chosen already."""
    return table(s, d, "part").where(F.contains(X.norm(F.col("p_name")), X.norm(F.lit("RÍNG"))) & ~F.col("p_partkey").isin(0, 3)).orderBy("p_partkey").limit(6).select("p_partkey")


@query("match_highlight", "SELECT p_partkey, CASE WHEN i = 0 THEN p_name ELSE substr(p_name, 1, i - 1) END AS head, CASE WHEN i = 0 THEN '' ELSE substr(p_name, i, 3) END AS hit, CASE WHEN i = 0 THEN '' ELSE substr(p_name, i + 3) END AS tail FROM (SELECT *, instr(lower(p_name), 'lar') AS i FROM part)", False)
def match_highlight(s, d):
    m = X.marked_match(F.col("p_name"), " LÁR")
    return table(s, d, "part").select("p_partkey", m["head"].alias("head"), m["match"].alias("hit"), m["tail"].alias("tail"))


# Boards

def year_rates(s, d, year):
    """All units with their rate of a year, 0 without one."""
    some = totals(s, d).where(F.col("year") == year).select("cut", F.round("rate", 6).alias("rate"))
    return dim(s, d).join(some, "cut", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


_YEAR = "yr AS (SELECT d.cut, d.name, d.region, d.low, coalesce(round(t.rate, 6), 0) AS rate FROM dim d LEFT JOIN totals t ON t.cut = d.cut AND t.year = 1997)"


@query("board_year_rank", f", {_YEAR} SELECT cut, rate, CASE WHEN low THEN 0 ELSE row_number() OVER (PARTITION BY low ORDER BY rate DESC, cut) END AS place, false AS shown FROM yr")
def board_year_rank(s, d):
    """Places of another year than the latest, which aren't shown."""
    told = S.rank(year_rates(s, d, 1997), "place", "rate", "cut", eligible=~F.col("low"))
    return told.select("cut", "rate", F.coalesce("place", F.lit(0)).alias("place"), F.lit(1997 == REFERENCE).alias("shown"))


@query("board_matches", f", {_YEAR} SELECT count(*) FILTER (NOT low AND region = 3) AS shown, count(*) FILTER (low AND region = 3) AS hidden FROM yr")
def board_matches(s, d):
    """Rows that match, and those that only the rule on low populations hides."""
    b = B.Board(region=3, hide_low=True, scope=("q", "region", "low"))
    return year_rates(s, d, 1997).agg(F.count_if(b.column()).alias("shown"), F.count_if(b.hidden_by_low()).alias("hidden"))


@query("board_page", f", {_YEAR} SELECT cut FROM yr WHERE NOT low ORDER BY rate DESC, cut LIMIT 60 OFFSET 60")
def board_page(s, d):
    return B.page(year_rates(s, d, 1997).where("NOT low"), [F.desc("rate"), F.asc("cut")], 1).select("cut")


@query("board_blocks", f", {_YEAR} SELECT cut, row_number() OVER (ORDER BY low, rate DESC, cut) AS n FROM yr")
def board_blocks(s, d):
    return B.blocks_in_order(year_rates(s, d, 1997), "rate", "cut").select("cut", "n")


@query("board_regions", f", {_YEAR} SELECT coalesce(region, -1) AS region, round(avg(rate), 6) AS mean FROM yr WHERE NOT low GROUP BY GROUPING SETS ((region), ())")
def board_regions(s, d):
    """The means of a chosen year, of each region and of all; units without a rate count as 0."""
    means = year_rates(s, d, 1997).where("NOT low").rollup("region").agg(F.avg("rate").alias("mean"))
    return r6(means, "mean").select(F.coalesce("region", F.lit(-1)).alias("region"), "mean")


@query("region_listing", "SELECT region, cut, row_number() OVER (PARTITION BY region ORDER BY place NULLS LAST, cut) AS n FROM (SELECT region, cut, CASE WHEN NOT low THEN row_number() OVER (PARTITION BY low ORDER BY rate DESC, cut) END AS place FROM ref)")
def region_listing(s, d):
    """Each region's units by their national place, those without one last."""
    told = S.rank(ref(s, d), "place", "rate", "cut", eligible=~F.col("low"))
    return S.rank(told.withColumn("key", F.coalesce("place", F.lit(2**53))), "n", "key", "cut", ["region"], descending=False).select("region", "cut", "n")


@query("hub_cards", f"""SELECT family, round(avg(rate), 6) AS mean, max_by(cut, (round(rate, 6), -cut)) AS top FROM rates WHERE year = {REFERENCE} AND NOT low GROUP BY family""")
def hub_cards(s, d):
    """Each family's mean and its first unit."""
    some = rates(s, d).where((F.col("year") == REFERENCE) & ~F.col("low"))
    return some.groupBy("family").agg(F.round(F.avg("rate"), 6).alias("mean"), F.max_by("cut", F.struct(F.round("rate", 6), -F.col("cut"))).alias("top"))


@query("home_extremes", "(SELECT 'lowest' AS side, cut FROM ref WHERE NOT low ORDER BY rate, cut LIMIT 6) UNION ALL (SELECT 'highest', cut FROM ref WHERE NOT low ORDER BY rate DESC, cut DESC LIMIT 6)")
def home_extremes(s, d):
    some = ref(s, d).where("NOT low")
    side = lambda name, *order: some.orderBy(*order).limit(6).select(F.lit(name).alias("side"), "cut")
    return side("lowest", "rate", "cut").unionByName(side("highest", F.desc("rate"), F.desc("cut")))


@query("lowest_in_rollout", "SELECT cut, rate FROM ref WHERE NOT low AND cut IN (SELECT s_suppkey FROM supplier) ORDER BY rate, cut LIMIT 15")
def lowest_in_rollout(s, d):
    """Of the units that are released."""
    open_ = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut"))
    return ref(s, d).where("NOT low").join(open_, "cut", "left_semi").orderBy("rate", "cut").limit(15).select("cut", "rate")


@query("region_top_bottom", "(SELECT 'top' AS side, cut FROM ref WHERE region = 13 ORDER BY rate DESC, cut LIMIT 10) UNION ALL (SELECT 'bottom', cut FROM ref WHERE region = 13 ORDER BY rate, cut LIMIT 10)")
def region_top_bottom(s, d):
    r = ref(s, d).where("region = 13")
    side = lambda name, order: r.orderBy(order, "cut").limit(10).select(F.lit(name).alias("side"), "cut")
    return side("top", F.desc("rate")).unionByName(side("bottom", F.asc("rate")))


@query("comparator_order", "SELECT cut, row_number() OVER (ORDER BY rate DESC NULLS LAST, cut) AS n FROM (SELECT s_suppkey AS cut FROM supplier UNION ALL SELECT -1) LEFT JOIN ref USING (cut)")
def comparator_order(s, d):
    """Chosen units by rate; those that aren't loaded yet come last."""
    chosen = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut")).unionByName(s.range(1).select(F.lit(-1).cast("long").alias("cut")))
    rows = chosen.join(ref(s, d).select("cut", "rate"), "cut", "left").withColumn("key", F.coalesce(-F.col("rate"), F.lit(float("inf"))))
    return S.rank(rows, "n", "key", "cut", descending=False).select("cut", "n")


@query("snapshot_order", "SELECT cut, year, row_number() OVER (ORDER BY cut, year) AS n FROM (SELECT DISTINCT cut, year FROM totals)")
def snapshot_order(s, d):
    """Snapshots are written in the order of unit and year."""
    rows = totals(s, d).select("cut", "year").distinct().withColumn("key", F.col("cut") * 10000 + F.col("year"))
    return S.rank(rows, "n", "key", "year", descending=False).select("cut", "year", "n")


@query("city_page", "SELECT cut, round(rate, 6) AS rate, round((rate - m) * 100 / m, 4) AS pct, n AS eligible FROM latest, (SELECT avg(rate) AS m, count(*) AS n FROM latest WHERE NOT low) WHERE cut = 10")
def city_page(s, d):
    """One unit's latest rate and how far it is from the typical one."""
    last = S.latest_complete(totals(s, d))
    mean = S.typical_mean(totals(s, d)).select(F.col("rate").alias("m"), F.col("n").alias("eligible"))
    return last.where("cut = 10").join(F.broadcast(mean)).select("cut", F.round("rate", 6).alias("rate"), F.round(X.signed_pct(F.col("rate"), F.col("m")), 4).alias("pct"), "eligible")


@query("series_span", "SELECT cut, min(year)::INT AS first, max(year)::INT AS last, round(max(rate), 6) AS most FROM totals WHERE NOT partial GROUP BY cut")
def series_span(s, d):
    return totals(s, d).where("NOT partial").groupBy("cut").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.round(F.max("rate"), 6).alias("most"))


@query("panel_value", "SELECT cut, round(coalesce(max(rate) FILTER (year = 1996), max_by(rate, year)), 6) AS rate FROM totals GROUP BY cut")
def panel_value(s, d):
    """The chosen year's rate, else the last one's, partial or not."""
    return totals(s, d).groupBy("cut").agg(F.round(F.coalesce(F.max(F.when(F.col("year") == 1996, F.col("rate"))), F.max_by("rate", "year")), 6).alias("rate"))


@query("one_family_rate", "SELECT cut, round(max(rate) FILTER (family = '3-MEDIUM'), 6) AS rate FROM rates WHERE year = 1998 GROUP BY cut")
def one_family_rate(s, d):
    """A family's rate in a year, whose name may be a number or a text; null where the unit has the year but not the family."""
    some = rates(s, d).withColumn("year", F.col("year").cast("string")).where(F.col("year").try_cast("int") == 1998)
    return some.groupBy("cut").agg(F.round(F.max(F.when(F.col("family") == "3-MEDIUM", F.col("rate"))), 6).alias("rate"))


@query("featured_rates", "SELECT cut, coalesce(string_agg(year || '=' || round(rate)::BIGINT, ',' ORDER BY year) FILTER (family = '1-URGENT'), '') AS urgent FROM rates GROUP BY cut")
def featured_rates(s, d):
    """A family's rates by year as a map; empty where there is none."""
    pair = F.when(F.col("family") == "1-URGENT", F.struct(F.col("year"), F.round("rate").cast("long").alias("rate")))
    maps = rates(s, d).groupBy("cut").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("m"))
    return maps.select("cut", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("urgent"))


@query("family_vector", f"SELECT cut, year, coalesce(max(round(rate)) FILTER (family = '1-URGENT'), 0)::BIGINT AS a, coalesce(max(round(rate)) FILTER (family = '5-LOW'), 0)::BIGINT AS e, greatest(max(round(rate)), 1)::BIGINT AS most FROM rates GROUP BY cut, year")
def family_vector(s, d):
    """Rates in the catalog's order, 0 for a family without one, and the largest, 1 at least."""
    got = rates(s, d).groupBy("cut", "year").agg(F.map_from_entries(F.collect_list(F.struct("family", F.round("rate").cast("long")))).alias("m"))
    vector = F.array(*(F.coalesce(F.element_at("m", f), F.lit(0)) for f in FAMILIES))
    return got.select("cut", "year", vector[0].alias("a"), vector[4].alias("e"), F.greatest(F.array_max(vector), F.lit(1)).alias("most"))


@query("chart_summary", f""", one AS (SELECT family, round(rate, 6) AS r FROM rates WHERE cut = 1 AND year = {REFERENCE}), two AS (SELECT family, round(rate, 6) AS r FROM rates WHERE cut = 2 AND year = {REFERENCE}),
b AS (SELECT f AS family, coalesce(one.r, 0) AS a, coalesce(two.r, 0) AS b FROM unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) u(f) LEFT JOIN one ON one.family = f LEFT JOIN two ON two.family = f)
SELECT count(*) FILTER (a < b) AS lower, max_by(family, (abs(a - b), -ascii(family))) AS widest, max(greatest(a, b, 1)) AS scale FROM b""")
def chart_summary(s, d):
    """In how many families the first unit is lower, where the gap is widest, and what the bars are scaled by."""
    all_ = s.createDataFrame([(f,) for f in FAMILIES], "family string")
    side = lambda cut, name: rates(s, d).where((F.col("cut") == cut) & (F.col("year") == REFERENCE)).select("family", F.round("rate", 6).alias(name))
    rows = all_.join(side(1, "a"), "family", "left").join(side(2, "b"), "family", "left").fillna(0.0)
    return rows.agg(F.count_if(F.col("a") < F.col("b")).alias("lower"), F.max_by("family", F.struct(F.abs(F.col("a") - F.col("b")), -F.ascii("family"))).alias("widest"), F.max(F.greatest("a", "b", F.lit(1.0))).alias("scale"))


@query("divergence_factor", """, m AS (SELECT region, family, round(avg(rate), 6) AS r FROM rates GROUP BY ALL), p AS (SELECT a.region AS one, a.family, a.r AS x, b.r AS y FROM m a JOIN m b ON a.family = b.family AND a.region + 1 = b.region)
SELECT one, family, round(CASE WHEN least(x, y) > 0 THEN greatest(x, y) / least(x, y) ELSE greatest(x, y) END, 6) AS factor FROM p QUALIFY row_number() OVER (PARTITION BY one ORDER BY abs(x - y) DESC, family) = 1""")
def divergence_factor(s, d):
    """Where two neighbours differ most, and how many times the larger rate is the smaller one."""
    m = r6(rates(s, d).groupBy("region", "family").agg(F.avg("rate").alias("x")), "x")
    both = m.join(m.select((F.col("region") - 1).alias("region"), "family", F.col("x").alias("y")), ["region", "family"])
    low, high = F.least("x", "y"), F.greatest("x", "y")
    factor = F.round(F.when(low > 0, high / low).otherwise(high), 6)
    best = both.groupBy(F.col("region").alias("one")).agg(F.min_by(F.struct("family", factor.alias("factor")), F.struct(-F.abs(F.col("x") - F.col("y")), "family")).alias("b"))
    return best.select("one", "b.family", "b.factor")


# Layers

@query("band_counts", ", lv AS (SELECT low, CASE WHEN p >= .8 THEN 5 WHEN p >= .6 THEN 4 WHEN p >= .4 THEN 3 WHEN p >= .2 THEN 2 ELSE 1 END AS level FROM (SELECT low, (rank() OVER (ORDER BY rate) - 1)::DOUBLE / count(*) OVER () AS p FROM ref)) SELECT l AS level, count(level) AS all_units, count(level) FILTER (NOT low) AS eligible FROM range(1, 6) r(l) LEFT JOIN lv ON level = l GROUP BY l")
def band_counts(s, d):
    n = S.band_percentile(ref(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("a"), F.count_if(~F.col("low")).alias("e"))
    levels = s.range(1, 6).withColumnRenamed("id", "level")
    return levels.join(F.broadcast(n), "level", "left").select("level", F.coalesce("a", F.lit(0)).alias("all_units"), F.coalesce("e", F.lit(0)).alias("eligible"))


_LAYER = """, x AS (SELECT cut, CASE WHEN cut % 4 = 0 THEN 0 WHEN cut % 10 = 1 THEN NULL ELSE rate END AS v FROM ref), b AS (SELECT list(v ORDER BY v) AS l FROM x WHERE v > 0),
lv AS (SELECT v, CASE WHEN coalesce(v, 0) <= l[floor(len(l) * 1 / 5)::INT + 1] THEN 1 WHEN v <= l[floor(len(l) * 2 / 5)::INT + 1] THEN 2 WHEN v <= l[floor(len(l) * 3 / 5)::INT + 1] THEN 3 WHEN v <= l[floor(len(l) * 4 / 5)::INT + 1] THEN 4 ELSE 5 END AS level FROM x, b) """


def _layer(s, d):
    return ref(s, d).select("cut", F.when(F.col("cut") % 4 == 0, 0.0).when(F.col("cut") % 10 == 1, None).otherwise(F.col("rate")).alias("value"))


@query("layer_family", _LAYER + "SELECT l AS level, count(level) AS n FROM range(6) r(l) LEFT JOIN lv ON level = l GROUP BY l")
def layer_family(s, d):
    return B.layer_counts(B.layer_levels(_layer(s, d), "family"))


@query("layer_homicide", _LAYER + "SELECT l AS level, count(k) AS n FROM range(6) r(l) LEFT JOIN (SELECT CASE WHEN v > 0 THEN level ELSE 0 END AS k FROM lv) ON k = l GROUP BY l")
def layer_homicide(s, d):
    return B.layer_counts(B.layer_levels(_layer(s, d), "homicide"))


@query("layer_composite", "SELECT l AS level, count(k) AS n FROM range(6) r(l) LEFT JOIN (SELECT CASE WHEN cut % 7 = 0 THEN 3 ELSE cut % 5 + 1 END AS k FROM dim) ON k = l GROUP BY l")
def layer_composite(s, d):
    rows = dim(s, d).select("cut", F.when(F.col("cut") % 7 > 0, F.col("cut") % 5 + 1).alias("value"))
    return B.layer_counts(B.layer_levels(rows, "composite"))


@query("hist_band_bins", """, p AS (SELECT rate FROM ref WHERE rate > 0), c AS (SELECT list(rate ORDER BY rate) AS l FROM p), cap AS (SELECT l[least(len(l), floor(len(l) * .97)::INT + 1)] AS c, l FROM c)
SELECT b AS bin, floor(b * c / 24 + 0.5)::BIGINT AS lo, floor((b + 1) * c / 24 + 0.5)::BIGINT AS hi, CASE WHEN (b + 0.5) / 24 * c <= l[floor(len(l) * .2)::INT + 1] THEN 1 WHEN (b + 0.5) / 24 * c <= l[floor(len(l) * .4)::INT + 1] THEN 2 WHEN (b + 0.5) / 24 * c <= l[floor(len(l) * .6)::INT + 1] THEN 3 WHEN (b + 0.5) / 24 * c <= l[floor(len(l) * .8)::INT + 1] THEN 4 ELSE 5 END::BIGINT AS band FROM range(24) r(b), cap""")
def hist_band_bins(s, d):
    """The bins' bounds and the band of their middles."""
    r = ref(s, d)
    cap = S.at_places(r.where("rate > 0"), "rate", lambda n: [min(n, int(n * 0.97) + 1)]).select(F.col("_b0").alias("cap"))
    bins = s.range(24).select(F.col("id").alias("bin")).join(F.broadcast(cap)).join(F.broadcast(B.quantile_breaks(r, "rate")))
    edge = lambda i: X.js_round(i * F.col("cap") / 24)
    return bins.select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), B.level_by_breaks((F.col("bin") + 0.5) / 24 * F.col("cap")).alias("band"))


@query("band_labels", """, c AS (SELECT list(rate ORDER BY rate) AS l FROM ref WHERE rate > 0), b AS (SELECT [floor(l[floor(len(l) * .2)::INT + 1] + 0.5)::BIGINT, floor(l[floor(len(l) * .4)::INT + 1] + 0.5)::BIGINT, floor(l[floor(len(l) * .6)::INT + 1] + 0.5)::BIGINT, floor(l[floor(len(l) * .8)::INT + 1] + 0.5)::BIGINT] AS q FROM c)
SELECT i AS level, CASE WHEN i = 5 THEN format('{:,}', q[4] + 1) || '+' ELSE format('{:,}', CASE WHEN i = 1 THEN 0 ELSE q[i - 1] + 1 END) || ' – ' || format('{:,}', q[i]) END AS label FROM range(1, 6) r(i), b""")
def band_labels(s, d):
    b = B.quantile_breaks(ref(s, d), "rate").select(F.array(*(X.js_round(F.col(f"_b{i}")) for i in range(4))).alias("q"))
    levels = s.range(1, 6).select(F.col("id").alias("level")).join(F.broadcast(b))
    at = F.col("level").cast("int")
    return levels.select("level", X.band_label(F.when(at > 1, F.get("q", at - 2)), F.get("q", at - 1)).alias("label"))


@query("shape_styles", "SELECT cut, ['#1', '#2', '#3', '#4', '#5'][CASE WHEN cut % 7 = 0 THEN 3 ELSE cut % 5 + 1 END] AS color, CASE WHEN (CASE WHEN cut % 7 = 0 THEN 3 ELSE cut % 5 + 1 END) <> 3 THEN 0.06 WHEN cut % 7 = 0 OR cut % 4 = 0 THEN 0.35 ELSE 0.75 END::DOUBLE AS opacity FROM dim")
def shape_styles(s, d):
    """Colors by band with one band isolated; faint where there is no value or none but 0."""
    level = F.when(F.col("cut") % 7 > 0, F.col("cut") % 5 + 1)
    value = F.when(F.col("cut") % 7 > 0, F.col("cut") % 4)
    f = B.fill(level, value, ["#1", "#2", "#3", "#4", "#5"], isolated=3)
    return dim(s, d).select("cut", f["color"].alias("color"), f["opacity"].alias("opacity"))


# Feeds

def cards(s, d):
    """Events with their unit's region and name."""
    units = dim(s, d).select(F.col("cut").alias("user_id"), "region", "name")
    return ev(s, d).join(units, "user_id", "left").select("event_id", F.col("event_type").alias("family"), "region", "name", F.col("day").alias("date"))


@query("feed_filtered", "SELECT event_id FROM ev JOIN dim ON cut = user_id WHERE event_type IN ('click', 'view') AND region IN (1, 4, 9) AND day >= (SELECT max(day) FROM ev) - 6 AND contains(name, '0001')")
def feed_filtered(s, d):
    f = B.Filters.of("?family=click,view,&region=1,4,9&window=7d&q=%200001%20&day=2024-1-1")
    newest = ev(s, d).agg(F.max("day").alias("newest"))
    return cards(s, d).join(F.broadcast(newest)).where(f.column(F.col("newest"))).select("event_id")


_CARDS = "c AS (SELECT event_id, event_type AS family, region, day, day >= m AS d1, day >= m - 6 AS d7, day >= m - 29 AS d30 FROM ev LEFT JOIN dim ON cut = user_id, (SELECT max(day) AS m FROM ev))"


@query("feed_options", f""", {_CARDS} SELECT 'family' AS dimension, k AS key, count(event_id) FILTER (region IN (1, 4) AND d7) AS n FROM unnest(['click', 'view', 'nothing']) u(k) LEFT JOIN c ON family = k GROUP BY k
UNION ALL SELECT 'region', k, count(event_id) FILTER (family IN ('click') AND d7) FROM unnest(['1', '4', '99']) u(k) LEFT JOIN c ON region::VARCHAR = k GROUP BY k
UNION ALL SELECT 'window', k, CASE k WHEN 'today' THEN (SELECT count(*) FROM c WHERE d1 AND family = 'click' AND region IN (1, 4)) WHEN '7d' THEN (SELECT count(*) FROM c WHERE d7 AND family = 'click' AND region IN (1, 4)) ELSE (SELECT count(*) FROM c WHERE d30 AND family = 'click' AND region IN (1, 4)) END FROM unnest(['today', '7d', '30d']) u(k)
UNION ALL SELECT 'day', k, count(event_id) FILTER (family = 'click' AND region IN (1, 4) AND d7) FROM unnest(['2024-01-28', '2024-01-02']) u(k) LEFT JOIN c ON strftime(day, '%Y-%m-%d') = k GROUP BY k""")
def feed_options(s, d):
    """Counts of all options, each under the other filters only."""
    f = B.Filters.of("family=click&region=1,4&window=7d")
    return B.option_counts(cards(s, d), f, {"family": ["click", "view", "nothing"], "region": ["1", "4", "99"], "window": ["today", "7d", "30d"], "day": ["2024-01-28", "2024-01-02"]})


@query("feed_by_month", "SELECT strftime(day, '%Y-%m') AS month, event_id, row_number() OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY day DESC, event_id) AS n FROM ev")
def feed_by_month(s, d):
    """Each month's rows from the newest on."""
    rows = ev(s, d).withColumns({"month": F.date_format("day", "yyyy-MM"), "key": -F.unix_date("day")})
    return S.rank(rows, "n", "key", "event_id", ["month"], descending=False).select("month", "event_id", "n")


@query("feed_by_block", "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY ALL")
def feed_by_block(s, d):
    return ev(s, d).groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_safe_headlines", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id) AS n FROM ev WHERE NOT contains(props, '7')) WHERE n <= 6")
def latest_safe_headlines(s, d):
    """Six of each unit, those with a forbidden term left out before."""
    w = Window.partitionBy("user_id").orderBy(F.desc("day"), "event_id")
    return ev(s, d).where(~F.contains("props", F.lit("7"))).withColumn("n", F.row_number().over(w).cast("long")).where("n <= 6").select("user_id", "event_id", "n")


@query("feed_of_layer", "SELECT event_id FROM ev WHERE event_type = CASE 'homicide' WHEN 'homicide' THEN 'view' ELSE 'homicide' END AND day = DATE '2024-01-11'")
def feed_of_layer(s, d):
    """Events of the family that the map's layer stands for, of a day."""
    layers = {"homicide": "view"}
    return ev(s, d).where((F.col("event_type") == layers["homicide"]) & (F.col("day") == F.lit("2024-01-11").cast("date"))).select("event_id")


@query("candidate_cap", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 200", False)
def candidate_cap(s, d):
    return table(s, d, "events").where("event_type = 'signup'").orderBy("event_id").limit(200).select("event_id")


@query("newest_first", "SELECT event_id, row_number() OVER (ORDER BY day DESC, event_id) AS n FROM ev")
def newest_first(s, d):
    rows = ev(s, d).withColumn("key", -F.unix_date("day"))
    return S.rank(rows, "n", "key", "event_id", descending=False).select("event_id", "n")


@query("pulse", "(SELECT 'day' AS kind, strftime(day, '%Y-%m-%d') AS key, count(*) AS n FROM ev WHERE day > (SELECT max(day) FROM ev) - 30 GROUP BY day) UNION ALL (SELECT 'family', event_type, count(*) FROM ev GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 5) UNION ALL (SELECT 'latest', event_id::VARCHAR, 1 FROM ev ORDER BY day DESC, event_id LIMIT 4)")
def pulse(s, d):
    """Counts of the last 30 days' days, the five largest families of all, the four latest rows."""
    e = ev(s, d)
    newest = e.agg(F.max("day").alias("m"))
    days = e.join(F.broadcast(newest)).where(F.col("day") > F.date_sub("m", 30)).groupBy(F.date_format("day", "yyyy-MM-dd").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    top = e.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(5)
    last = e.orderBy(F.desc("day"), "event_id").limit(4).select(F.col("event_id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), "key", "n")
    return kind("day", days).unionByName(kind("family", top)).unionByName(kind("latest", last))
