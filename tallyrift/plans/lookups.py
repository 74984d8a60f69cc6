"""Joins of names, keys and clusters over the test tables, each with its oracle.

The catalog of names is the table of parts (names repeat, so the first of a slug counts) or that of nations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.operators import events as E
from tallyrift.operators import matching as M
from tallyrift.operators import titles
from tallyrift.plans.queries import LAST, REFERENCE, dim, ev, query, r6, rates, ref, table, totals


def _titles(s, d):
    """Names as a feed writes them: in capitals, with accents and signs; some are of nothing in the catalog."""
    p = table(s, d, "part")
    said = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.col("p_name"), F.lit(" unknown"))).otherwise(F.translate(F.upper("p_name"), "AEO ", "ÁÉÓ_"))
    return p.select("p_partkey", said.alias("title"))


_SLUG = "regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_SAID = "CASE WHEN p_partkey % 11 = 0 THEN p_name || ' unknown' ELSE translate(upper(p_name), 'AEO ', 'ÁÉÓ_') END"
_MATCH = f"""WITH t AS (SELECT p_partkey, {_SLUG.format(x=_SAID)} AS k FROM part), c AS (SELECT {_SLUG.format(x='p_name')} AS k, min(p_partkey) AS first FROM part GROUP BY 1) """


@query("match_names", _MATCH + "SELECT p_partkey, first AS entry FROM t JOIN c USING (k)", False)
def match_names(s, d):
    found, _ = M.match_names(_titles(s, d), "title", table(s, d, "part").withColumn("entry", F.col("p_partkey")), "p_name", "p_partkey", ["entry"])
    return found.select("p_partkey", "entry")


@query("match_names_unmatched", _MATCH + "SELECT p_partkey FROM t WHERE k NOT IN (SELECT k FROM c)", False)
def match_names_unmatched(s, d):
    _, lost = M.match_names(_titles(s, d), "title", table(s, d, "part").withColumn("entry", F.col("p_partkey")), "p_name", "p_partkey", ["entry"])
    return lost.select("p_partkey")


@query("resolver_hint", """WITH c AS (SELECT p_name AS name, p_size AS region, min(p_partkey) AS id FROM part WHERE p_size < 30 GROUP BY ALL),
q AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN p_brand WHEN p_partkey % 17 = 0 THEN NULL ELSE upper(p_name) END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size::VARCHAR ELSE substr(p_size::VARCHAR, 1, 1) END AS hint FROM part),
a AS (SELECT q.p_partkey, q.hint, c.id, c.region::VARCHAR AS region, count(c.id) OVER (PARTITION BY q.p_partkey) AS n FROM q LEFT JOIN c ON lower(q.name) = c.name)
SELECT p_partkey, CASE WHEN max(n) = 1 THEN min(id) ELSE coalesce(min(id) FILTER (region = hint), min(id) FILTER (contains(region, hint))) END AS id FROM a GROUP BY p_partkey""", False)
def resolver_hint(s, d):
    p = table(s, d, "part")
    catalog = p.where("p_size < 30").groupBy(F.col("p_name").alias("name"), F.col("p_size").alias("region")).agg(F.min("p_partkey").alias("id"))
    k = F.col("p_partkey")
    asked = p.select("p_partkey", F.when(k % 13 == 0, F.col("p_brand")).when(k % 17 == 0, None).otherwise(F.upper("p_name")).alias("said"),
                     F.when(k % 3 == 0, None).when(k % 3 == 1, F.col("p_size").cast("string")).otherwise(F.substring(F.col("p_size").cast("string"), 1, 1)).alias("hint"))
    return M.resolve(asked, "said", "hint", catalog, "name", "region", "id", ["id"]).select("p_partkey", "id")


@query("key_else_slug", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 100000 + user_id ELSE user_id END AS cut, 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS slug FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, -1, 'nobody' FROM events WHERE event_id % 4 = 0)
SELECT event_id, coalesce(a.c_nationkey, b.c_nationkey) AS region FROM e LEFT JOIN customer a ON a.c_custkey = cut LEFT JOIN customer b ON b.c_name = slug""", False)
def key_else_slug(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    rows = table(s, d, "events").select("event_id", F.when(n % 4 == 0, -1).when(n % 3 == 0, 100000 + u).otherwise(u).alias("cut"),
                                        F.when(n % 4 == 0, "nobody").otherwise(F.concat(F.lit("Customer#"), F.lpad(u.cast("string"), 9, "0"))).alias("slug"))
    return M.either_key(rows, "cut", "slug", dim(s, d).select("cut", F.col("name").alias("slug"), "region"), ["region"]).select("event_id", "region")


@query("placed_incidents", "SELECT event_id, s_nationkey AS region, round(s_acctbal, 6) AS y FROM events JOIN supplier ON s_suppkey = user_id", False)
def placed_incidents(s, d):
    """Events at their place; those without one go."""
    places = table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("region"), F.round("s_acctbal", 6).alias("y"))
    return table(s, d, "events").join(places, "user_id").select("event_id", "region", "y")


@query("unplaced_incidents", "SELECT event_id, 'centroid_fail' AS stage FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)", False)
def unplaced_incidents(s, d):
    lost = table(s, d, "events").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "left_anti")
    return lost.select("event_id", F.lit("centroid_fail").alias("stage"))


@query("region_buckets", "SELECT c_nationkey AS region, count(*) AS n, (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)) AS unresolved FROM events JOIN customer ON c_custkey = user_id WHERE c_custkey % 10 > 0 GROUP BY c_nationkey", False)
def region_buckets(s, d):
    """Events by their unit's region; those of no known unit are counted beside, in no bucket."""
    known = table(s, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("region"))
    found = table(s, d, "events").join(known, "user_id", "left").groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    lost = found.agg(F.coalesce(F.sum(F.when(F.col("region").isNull(), F.col("n"))), F.lit(0)).alias("unresolved"))
    return found.where("region IS NOT NULL").join(F.broadcast(lost))


@query("rates_with_population", """SELECT c.c_custkey AS cut, round(coalesce(r.rate, 0), 6) AS rate, round(coalesce(s.s_acctbal, 0), 6) AS pop, coalesce(s.s_acctbal, 0) < 5000 AS low
FROM customer c LEFT JOIN (SELECT cut, rate FROM totals WHERE year = 1999) r ON r.cut = c_custkey LEFT JOIN supplier s ON s_suppkey = c_custkey""")
def rates_with_population(s, d):
    """All units with their rate and population, 0 where there is none; no population counts as a low one."""
    r = totals(s, d).where("year = 1999").select("cut", "rate")
    pop = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut"), F.col("s_acctbal").alias("pop"))
    rows = dim(s, d).select("cut").join(r, "cut", "left").join(pop, "cut", "left")
    return rows.select("cut", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"), F.round(F.coalesce("pop", F.lit(0.0)), 6).alias("pop"), (F.coalesce("pop", F.lit(0.0)) < 5000).alias("low"))


@query("two_measures", """SELECT coalesce(a.cut, b.cut) AS cut, coalesce(a.year, b.year) AS year, n_done, n_open, b.cut IS NOT NULL AS has_open FROM
(SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) a FULL JOIN
(SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, nullif(count(*), 1) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) b ON a.cut = b.cut AND a.year = b.year""", False)
def two_measures(s, d):
    """Two measures by unit and year; null is what a measure says there, which isn't the same as no row of it."""
    o = table(s, d, "orders").withColumns({"cut": F.col("o_custkey"), "year": F.year("o_orderdate")})
    done = o.where("o_orderstatus = 'F'").groupBy("cut", "year").agg(F.count(F.lit(1)).alias("n_done"))
    open_ = o.where("o_orderstatus = 'O'").groupBy("cut", "year").agg(F.nullif(F.count(F.lit(1)), F.lit(1)).alias("n_open"), F.lit(True).alias("has"))
    return done.join(open_, ["cut", "year"], "full").select("cut", "year", "n_done", "n_open", F.coalesce("has", F.lit(False)).alias("has_open"))


@query("survey_cross_check", """SELECT count(*) AS joined, count(*) FILTER (lower(p_name) <> lower(said)) AS mismatched FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE upper(p_name) END AS said FROM part) x JOIN part USING (p_partkey)""", False)
def survey_cross_check(s, d):
    """A join by key, and how many of its rows carry another name than the key's."""
    p = table(s, d, "part")
    survey = p.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, F.col("p_type")).otherwise(F.upper("p_name")).alias("said"))
    both = survey.join(p.select("p_partkey", "p_name"), "p_partkey")
    return both.agg(F.count(F.lit(1)).alias("joined"), F.count_if(X.norm(F.col("p_name")) != X.norm(F.col("said"))).alias("mismatched"))


@query("enrichment", "SELECT s_suppkey AS cut, CASE WHEN s_suppkey % 3 = 0 THEN round(s_acctbal, 2) WHEN s_suppkey % 6 = 1 THEN -1.0 END::DOUBLE AS share FROM supplier", False)
def enrichment(s, d):
    """A column that is set for the covered keys only; the others keep what they had."""
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut"), "s_acctbal")
    rows = sup.select("cut", F.when(F.col("cut") % 6 == 1, -1.0).alias("share"))
    return M.enrich(rows, sup.where("cut % 3 = 0").select("cut", F.round("s_acctbal", 2).alias("share")), "cut", "share")


@query("rejected_minus_incidents", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-01 12:00:00')", False)
def rejected_minus_incidents(s, d):
    e = table(s, d, "events")
    return E.unseen(e.where("event_type = 'error'").select("user_id").distinct(), e.where("event_type = 'purchase' AND ts < TIMESTAMP '2024-01-01 12:00:00'"), "user_id")


@query("consolidate_rejected", "SELECT user_id, event_id FROM ev WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(day, '%Y-%m-%d'), event_id) = 1")
def consolidate_rejected(s, d):
    """The first of each id, by file and place in it; files are days here."""
    rows = ev(s, d).where("event_type = 'error'").withColumn("place", F.struct("day", "event_id"))
    return E.first_wins([rows], "user_id", "place").select("user_id", "event_id")


@query("key_differences", """SELECT k AS cut, 'missing' AS fault FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) WHERE k NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND event_id % 50 = 0)
UNION ALL SELECT DISTINCT user_id, 'orphan' FROM events WHERE event_type = 'view' AND event_id % 50 = 0 AND user_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT user_id, 'duplicate' FROM events WHERE event_type = 'view' AND event_id % 50 = 0 GROUP BY user_id HAVING count(*) > 1""", False)
def key_differences(s, d):
    have = table(s, d, "events").where("event_type = 'view' AND event_id % 50 = 0").select(F.col("user_id").alias("cut"))
    return M.key_differences(have, table(s, d, "supplier").select(F.col("s_suppkey").alias("cut")), "cut")


@query("pairs_enabled", """WITH c AS (SELECT c_custkey::VARCHAR AS cut, c_nationkey AS region, c_custkey AS ord FROM customer WHERE c_custkey < 300),
p AS (SELECT least(a.cut, b.cut) AS one, greatest(a.cut, b.cut) AS other, a.region, row_number() OVER (ORDER BY a.region, least(a.ord, b.ord), greatest(a.ord, b.ord)) AS n FROM c a JOIN c b ON a.region = b.region AND a.ord < b.ord)
SELECT one || '-vs-' || other AS pair, region, n <= 20 AS enabled FROM p""", False)
def pairs_enabled(s, d):
    """The pairs of a region's units, the smaller key as text first; the first 20 in input order are enabled."""
    c = table(s, d, "customer").where("c_custkey < 300").select(F.col("c_custkey").cast("string").alias("cut"), F.col("c_nationkey").alias("region"), F.col("c_custkey").alias("ord"))
    pairs = c.join(c.select("region", F.col("cut").alias("cut_b"), F.col("ord").alias("ord_b")), "region").where("ord < ord_b")
    first = pairs.orderBy("region", "ord", "ord_b").limit(20).select("ord", "ord_b", F.lit(True).alias("on"))
    told = pairs.join(F.broadcast(first), ["ord", "ord_b"], "left")
    return told.select(F.concat_ws("-vs-", F.least("cut", "cut_b"), F.greatest("cut", "cut_b")).alias("pair"), "region", F.coalesce("on", F.lit(False)).alias("enabled"))


@query("comparables_with_page", """, near AS (SELECT a.cut, b.cut AS other, row_number() OVER (PARTITION BY a.cut ORDER BY round(abs(b.rate - a.rate), 6), b.cut) AS place FROM ref a JOIN ref b ON a.region = b.region AND a.cut <> b.cut AND NOT a.low AND NOT b.low QUALIFY place <= 5)
SELECT cut, other FROM near WHERE (least(cut, other) + greatest(cut, other)) % 4 = 0""")
def comparables_with_page(s, d):
    """Of the five nearest of each unit those pairs that have a page: first the five, then the filter."""
    near = E.nearest(ref(s, d).where("NOT low"), "cut", "region", "rate", 5).select("cut", "other")
    keyed = near.withColumns({"one": F.least("cut", "other"), "two": F.greatest("cut", "other")})
    pages = keyed.select("one", "two").distinct().where("(one + two) % 4 = 0")
    return keyed.join(pages, ["one", "two"], "left_semi").select("cut", "other")


@query("versus_page", f""", top AS (SELECT region, min(cut) AS a, max(cut) AS b FROM dim GROUP BY region HAVING min(cut) < max(cut)), nat AS (SELECT year, sum(rate * pop) / sum(pop) AS rate FROM totals GROUP BY year)
SELECT top.a, top.b, round(x.rate, 6) AS rate_a, round(y.rate, 6) AS rate_b, coalesce(n.year, (SELECT max(year) FROM nat WHERE year < {LAST}))::INT AS year, round(coalesce(n.rate, (SELECT rate FROM nat WHERE year = {LAST} - 1)), 6) AS national
FROM top LEFT JOIN latest x ON x.cut = a LEFT JOIN latest y ON y.cut = b LEFT JOIN nat n ON n.year = least(x.year, y.year)""")
def versus_page(s, d):
    """Pairs with both sides' latest complete rates and the national one of the year they share, else its last complete."""
    from tallyrift.operators import stats as S

    t = totals(s, d)
    last = S.latest_complete(t).select("cut", "rate", "year")
    nat = S.weighted_mean(t, ["year"]).select("year", F.col("rate").alias("national"))
    other = nat.where(F.col("year") < LAST).agg(F.max("year").alias("y"), F.max_by("national", "year").alias("r"))
    pairs = dim(s, d).groupBy("region").agg(F.min("cut").alias("a"), F.max("cut").alias("b")).where("a < b")
    side = lambda k: last.select(F.col("cut").alias(k), F.col("rate").alias(f"rate_{k}"), F.col("year").alias(f"year_{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("year", F.least("year_a", "year_b"))
    told = both.join(nat, "year", "left").join(F.broadcast(other))
    return r6(told.select("a", "b", "rate_a", "rate_b", F.coalesce(F.when(F.col("national").isNotNull(), F.col("year")), "y").alias("year"), F.coalesce("national", "r").alias("national")), "rate_a", "rate_b", "national")


@query("shared_year_or_own", """, pairs AS (SELECT cut AS a, cut + 1 AS b FROM dim WHERE cut + 1 IN (SELECT cut FROM dim)), done AS (SELECT DISTINCT cut, year FROM totals WHERE NOT partial AND cut % 7 + 1995 <> year),
shared AS (SELECT a, b, max(x.year) AS year FROM pairs LEFT JOIN done x ON x.cut = a JOIN done y ON y.cut = b AND y.year = x.year GROUP BY a, b)
SELECT a, b, coalesce(s.year, (SELECT max(year) FROM done WHERE cut = pairs.a), 0)::INT AS year FROM pairs LEFT JOIN shared s USING (a, b)""")
def shared_year_or_own(s, d):
    """The newest complete year that both units of a pair have; without one the first's own, 0 where it has none."""
    pairs = dim(s, d).select(F.col("cut").alias("a"), (F.col("cut") + 1).alias("b")).join(dim(s, d).select(F.col("cut").alias("b")), "b", "left_semi")
    done = totals(s, d).where("NOT partial AND cut % 7 + 1995 <> year").select("cut", "year").distinct()
    years = pairs.join(done.select(F.col("cut").alias("a"), "year"), "a").join(done.select(F.col("cut").alias("b"), "year"), ["b", "year"])
    shared = years.groupBy("a", "b").agg(F.max("year").alias("shared"))
    own = done.groupBy(F.col("cut").alias("a")).agg(F.max("year").alias("own"))
    return pairs.join(shared, ["a", "b"], "left").join(own, "a", "left").select("a", "b", F.coalesce("shared", "own", F.lit(0)).alias("year"))


@query("region_focus", "SELECT c_custkey AS cut FROM customer WHERE c_nationkey = 5", False)
def region_focus(s, d):
    """The units of the region that an address names, padded or not; none where it names a unit, or no region there is."""
    wanted = focus("?region=%2005&cut=x")
    return dim(s, d).where(F.col("region").cast("string") == wanted).select("cut")


def focus(search: str) -> str | None:
    """The region of ?region=, without blanks and leading zeros; None where ?cut= has a unit's four or five digits."""
    from re import fullmatch, sub
    from urllib.parse import parse_qs

    said = parse_qs(search.removeprefix("?"), keep_blank_values=True)
    if fullmatch(r"\d{4,5}", said.get("cut", [""])[0]) or not said.get("region", [""])[0]:
        return None
    return sub(r"^0+(?=\d)", "", said["region"][0].strip())


@query("golden_pairs", "SELECT doc_id, coalesce(d.lang, 'embedded') AS lang FROM (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)", False)
def golden_pairs(s, d):
    """Kept pairs with what their rows say today, else what was kept with them."""
    kept = table(s, d, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1000000).otherwise(0)).alias("doc_id"), F.lit("embedded").alias("was"))
    return kept.join(table(s, d, "documents").select("doc_id", "lang"), "doc_id", "left").select("doc_id", F.coalesce("lang", "was").alias("lang"))


@query("region_files", "SELECT c_custkey AS cut, CASE WHEN c_nationkey BETWEEN 1 AND 16 THEN c_nationkey ELSE c_nationkey // 10 END::VARCHAR AS file FROM customer", False)
def region_files(s, d):
    return dim(s, d).select("cut", X.region_file(F.col("region").cast("string")).alias("file"))


# Pairs of titles, clusters

def _turns(s, d):
    """Whole texts as they are: case and accents count."""
    return table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("title"))


@query("token_set_pairs", None)
def token_set_pairs(s, d):
    """The proposed pairs of each block."""
    return titles.proposed_pairs(_turns(s, d), ["conv_id"], "turn", "title").withColumn("score", F.round("score", 6))


#: Ten pairs of names that are easily taken for one another, with their codes and a headline each.
CONFUSABLE = (
    ("Los Andes", "5301", "Robo con violencia registrado en Los Andes", "Los Angeles", "8301", "Detienen a sospechoso de hurto en Los Angeles"),
    ("Quilaco", "8308", "Denuncian abigeato en sector rural de Quilaco", "Quilleco", "8309", "Incendio intencional afecta bodega en Quilleco"),
    ("San Carlos", "16301", "Riña con arma blanca deja un herido en San Carlos", "San Pablo", "10307", "Sustraen vehículo estacionado en San Pablo"),
    ("Colina", "13301", "Vecinos denuncian estafa telefónica en Colina", "Molina", "7304", "Encuentran vehículo con encargo por robo en Molina"),
    ("Caldera", "3102", "Fiscalización detecta contrabando en el puerto de Caldera", "Calera", "5502", "Detienen a conductor en estado de ebriedad en Calera"),
    ("Chanco", "7202", "Incautan drogas en control vehicular en Chanco", "Lanco", "14103", "Denuncian violencia intrafamiliar en Lanco"),
    ("Cochrane", "11301", "Reportan extravío de turista en Cochrane", "Colchane", "1403", "Carabineros detecta ingreso irregular de migrantes en Colchane"),
    ("Pemuco", "16105", "Vecinos denuncian corte de cercos y abigeato en Pemuco", "Penco", "8107", "Riña vecinal termina con detenido en Penco"),
    ("Peumo", "6112", "Roban maquinaria agrícola en Peumo", "Pirque", "13202", "Detienen a conductor tras persecución en Pirque"),
    ("Talca", "7101", "Asalto a local comercial en el centro de Talca", "Taltal", "2104", "Naufragio de embarcación menor reportado en Taltal"),
)


@query("golden_draft", None)
def golden_draft(s, d):
    """All pairs of the chosen block, the proposed ones of further blocks, and the fixed pairs that belong to no block: a pair's
    place among them is its id, their score is that of any pair."""
    turns = _turns(s, d)
    chosen = M.scored_pairs(turns.where("conv_id = 1"), ["conv_id"], "turn", "title").select("conv_id", "one", "other", "score", "proposed", F.lit("mandatory").alias("category"))
    sampled = titles.proposed_pairs(turns.where("conv_id != 1"), ["conv_id"], "turn", "title").select("conv_id", "one", "other", "score", F.lit(True).alias("proposed"), F.lit("sampled").alias("category"))
    made = s.createDataFrame([(int(x[1]), int(x[4]), x[2], x[5]) for x in CONFUSABLE], "one long, other long, a string, b string")
    fixed = made.select(F.lit(-1).cast("long").alias("conv_id"), "one", "other", M.token_set("a", "b").alias("score"), F.lit(True).alias("proposed"), F.lit("confusable").alias("category"))
    return chosen.unionByName(sampled).unionByName(fixed).withColumn("score", F.round("score", 6))


@query("cluster_components", """, x AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events),
g AS (SELECT event_id, user_id, event_type, sum(CASE WHEN was IS NULL OR ts - was > INTERVAL 20 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM x JOIN (SELECT event_id, event_type FROM events) USING (event_id)),
c AS (SELECT event_id AS node, min(event_id) OVER w AS root, count(*) OVER w AS size FROM g WINDOW w AS (PARTITION BY user_id, event_type, k))
SELECT node, root, size, CASE WHEN size <= 4 THEN 'cluster' ELSE 'flagged' END AS kind FROM c WHERE size > 1""")
def cluster_components(s, d):
    """Components of merges: an event merges with the user's next of its kind within 20 hours."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumns({"next": F.lead("event_id").over(w), "then": F.lead("ts").over(w)})
    edges = e.where("then - ts <= INTERVAL 20 HOUR").select(F.col("event_id").alias("a"), F.col("next").alias("b"))
    return M.clusters(edges, "a", "b")


@query("supplemental_buckets", """, b AS (SELECT user_id, day, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5 AND user_id > 1),
r AS (SELECT *, 74 + sum(n * (n - 1) // 2) OVER (ORDER BY user_id, day) AS total FROM b)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n FROM r WHERE total <= 100""")
def supplemental_buckets(s, d):
    """Whole blocks of 2 to 5 in order, until the pairs, 74 at first, would be more than 100."""
    sizes = ev(s, d).where("user_id > 1").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 5")
    return M.whole_blocks(sizes, ["user_id", "day"], (F.col("n") * (F.col("n") - 1) / 2).cast("long"), 74, 100).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("stale_baselines", "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE (lang, n_chars) IS DISTINCT FROM (CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars END)", False)
def stale_baselines(s, d):
    """Kept rows that say other than today's."""
    k = F.col("doc_id")
    docs = table(s, d, "documents").select("doc_id", "lang", "n_chars")
    kept = table(s, d, "labels").join(docs, "doc_id").select("doc_id", F.struct(F.when(k % 6 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(k % 8 == 0, None).otherwise(F.col("n_chars")).alias("n_chars")).alias("was"))
    return kept.join(docs.select("doc_id", F.struct("lang", "n_chars").alias("now")), "doc_id").where(~F.col("was").eqNullSafe(F.col("now"))).select("doc_id")


@query("payload_ids", "SELECT cut, CASE WHEN a THEN 'payload only' ELSE 'topology only' END AS side FROM (SELECT coalesce(x.cut, y.cut) AS cut, y.cut IS NULL AS a, x.cut IS NULL AS b FROM (SELECT DISTINCT cut FROM rates WHERE year = 1996) x FULL JOIN (SELECT cut FROM dim WHERE NOT low) y ON x.cut = y.cut) WHERE a OR b")
def payload_ids(s, d):
    """Ids that only one of two outputs has."""
    one, two = rates(s, d).where("year = 1996").select("cut").distinct(), dim(s, d).where("NOT low").select("cut")
    return one.join(two, "cut", "left_anti").withColumn("side", F.lit("payload only")).unionByName(two.join(one, "cut", "left_anti").withColumn("side", F.lit("topology only")))


@query("aligned_years", f"SELECT {REFERENCE} AS year, count(DISTINCT y) = 1 AS aligned FROM (SELECT max(year) AS y FROM totals WHERE year <= {REFERENCE} UNION ALL SELECT max(year) FROM totals WHERE year <= {REFERENCE} AND NOT low UNION ALL SELECT max(year) FROM rates WHERE year <= {REFERENCE} AND family = '5-LOW')")
def aligned_years(s, d):
    """Whether three sources have the same reference year."""
    t = totals(s, d).where(F.col("year") <= REFERENCE)
    years = [t.agg(F.max("year").alias("y")), t.where("NOT low").agg(F.max("year").alias("y")), rates(s, d).where((F.col("year") <= REFERENCE) & (F.col("family") == "5-LOW")).agg(F.max("year").alias("y"))]
    all_ = years[0].unionByName(years[1]).unionByName(years[2])
    return all_.agg(F.lit(REFERENCE).alias("year"), (F.count_distinct("y") == 1).alias("aligned"))
