"""What is published, classified and checked, over the test tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.operators import checks as C
from tallyrift.operators import events as E
from tallyrift.operators import publishing as P
from tallyrift.operators import stats as S
from tallyrift.plans.queries import FAMILIES, LAST, REFERENCE, dim, ev, query, r6, rates, ref, table, totals

# The words by which a feed's items are taken for crime news, and those that a headline must not have.
CRIME_WORDS = ("homicidio asesinato femicidio balacera tiroteo disparo matar muerto fallecido robo asalto hurto portonazo encerronas carjacking receptacion receptación narco droga "
               "cocaine cocaina cocaína marihuana fentanilo armas tráfico trafico delito delincuente imputado detenido detenidos carabinero pdi investigaciones fiscalia fiscalía "
               "formalizacion formalización condena prisión prision pandilla victima víctima agresor encubrimiento narcotráfico narcotrafico").split() + ["herido a bala", "tren de aragua", "banda criminal", "crimen organizado"]
FORBIDDEN = ("zona peligrosa", "area peligrosa", "comuna peligrosa", "barrio peligroso", "ranking definitivo", "zona segura garantizada", "zona segura", "100% seguro", "seguridad garantizada",
             "la mas segura", "mas peligrosa", "mas peligroso", "el mas seguro", "dangerous zone", "dangerous area", "dangerous commune", "dangerous neighborhood", "definitive ranking", "guaranteed safe",
             "100% safe", "guaranteed safety", "the safest", "most dangerous")
# What is a sexual crime, unless somebody died of it.
SEXUAL = r"violaci[oó]n|viol[oó]|violad[ao]r?e?s?|\babuso sexual|estupro|grooming|pornograf[ií]a infantil|connotaci[oó]n sexual|acoso sexual|agresi[oó]n sexual|abuso deshonesto|ultraje|\bsexual\b"
DEATH = r"muri[oó]|muerte|asesin|homicid|femicid|parricid|cad[aá]ver|fallec|occiso|degollad"
FAMILY_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}


def quoted(words) -> str:
    from re import escape

    return "|".join(escape(w).replace("\\ ", " ").replace("\\%", "%") for w in words)


def _news(s, d):
    """Turns of conversations as headlines: some get a crime's, a forbidden or an accented word in front."""
    k = F.col("conv_id") * 7 + F.col("turn")
    words = ["Robo en la zona", "El MÁS SEGURO", "violación y muerte", "abuso SEXUAL", "<b>Tráfico</b> de x", "un 100% safe y", "insegura", "Zona segurament"]
    head = F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(head, F.lit(" "), "text").alias("title"))


_NEWS = """news AS (SELECT conv_id, turn, ['Robo en la zona', 'El MÁS SEGURO', 'violación y muerte', 'abuso SEXUAL', '<b>Tráfico</b> de x', 'un 100% safe y', 'insegura', 'Zona segurament'][(conv_id * 7 + turn) % 8 + 1] || ' ' || text AS title FROM conversations)"""


@query("news_keywords", f"WITH {_NEWS} SELECT conv_id, turn FROM news WHERE {' OR '.join(f'''contains(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '{w}')''' for w in CRIME_WORDS)}", False)
def news_keywords(s, d):
    """Titles, without tags, that have one of the words anywhere in them."""
    return _news(s, d).where(F.lower(X.strip_tags(F.col("title"))).rlike(quoted(CRIME_WORDS))).select("conv_id", "turn")


@query("news_forbidden", f"WITH {_NEWS} SELECT conv_id, turn FROM news WHERE {' OR '.join(f'''contains(strip_accents(lower(title)), '{w}')''' for w in FORBIDDEN)}", False)
def news_forbidden(s, d):
    return _news(s, d).where(X.norm(F.col("title")).rlike(quoted(FORBIDDEN))).select("conv_id", "turn")


@query("forbidden_between_words", f"""WITH {_NEWS}, t AS (SELECT conv_id, turn, ' ' || strip_accents(lower(title)) || ' ' AS x FROM news), hits AS (
{' UNION ALL '.join(f"SELECT conv_id, turn, '{w}' AS term, regexp_extract(x, '[^a-z0-9]({w})[^a-z0-9].{{0,99}}') AS m FROM t WHERE regexp_matches(x, '[^a-z0-9]{w}[^a-z0-9]')" for w in FORBIDDEN)})
SELECT conv_id, turn, term FROM hits WHERE NOT contains(m, 'anan')""", False)
def forbidden_between_words(s, d):
    """The first place of each term between other signs than letters and digits, unless what follows allows it."""
    x = F.concat(F.lit(" "), X.norm(F.col("title")), F.lit(" "))
    each = _news(s, d).withColumn("x", x).where(F.col("x").rlike(quoted(FORBIDDEN))).select("conv_id", "turn", "x", F.explode(F.array(*map(F.lit, FORBIDDEN))).alias("term"))
    hit = F.expr(r"regexp_extract(x, concat('(?<![a-z0-9])', term, '(?![a-z0-9]).{0,100}'), 0)")
    return each.withColumn("m", hit).where((F.col("m") != "") & ~F.contains("m", F.lit("anan"))).select("conv_id", "turn", "term")


@query("retag_counts", f"""WITH {_NEWS}, f AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'armas' ELSE 'vida' END AS family, regexp_matches(title, '(?i){SEXUAL}') AS sexual, regexp_matches(title, '(?i){DEATH}') AS death FROM news)
SELECT CASE WHEN family = 'vida' AND sexual AND NOT death THEN 'sexuales' ELSE family END AS family, count(*) AS n, count(*) FILTER (family = 'vida' AND sexual AND NOT death) AS flipped FROM f GROUP BY 1""", False)
def retag_counts(s, d):
    """Families after the correction, and how many rows it changed; a second run changes nothing."""
    t, was = F.col("title"), F.when(F.col("conv_id") % 3 == 0, "armas").otherwise("vida")
    now = F.when((F.col("was") == "vida") & t.rlike(f"(?i){SEXUAL}") & ~t.rlike(f"(?i){DEATH}"), "sexuales").otherwise(F.col("was"))
    return _news(s, d).withColumn("was", was).groupBy(now.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") != now).alias("flipped"))


# Addresses and ids

@query("fetch_guard", r"""SELECT page_id FROM (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'http://u:p@a.b/' WHEN 2 THEN 'ftp://a.b/' WHEN 3 THEN 'http://[::1]:80/' WHEN 4 THEN 'http://172.20.1.1/' WHEN 5 THEN 'http://8.8.8.8:80/' ELSE url END AS url FROM pages) WHERE regexp_matches(url, '^https?://') AND url NOT IN ('http://127.0.0.1/x', 'http://u:p@a.b/', 'http://[::1]:80/', 'http://172.20.1.1/')""", False)
def fetch_guard(s, d):
    """Addresses that may be fetched: no users in them, no private or local hosts."""
    odd = ["http://127.0.0.1/x", "http://u:p@a.b/", "ftp://a.b/", "http://[::1]:80/", "http://172.20.1.1/", "http://8.8.8.8:80/"]
    k = (F.col("page_id") % 8).cast("int")
    url = F.coalesce(F.get(F.array(*map(F.lit, odd)), k), F.col("url"))
    return table(s, d, "pages").where(X.safe_to_fetch(url)).select("page_id")


#: Hosts that name one address in several ways; of these only the last four may be fetched.
_HOSTS = ("[0:0:0:0:0:0:0:1]", "[0::1]", "[::ffff:7f00:1]", "[::ffff:a00:1]", "[::127.0.0.1]", "[fe80::1]", "[fc00::7]", "[2001:db8::1]", "[1::2::3]", "2130706433", "0x7f.1", "0177.0.0.1", "localhost", "a.localhost", "169.254.169.254",
          "[2606:4700::1111]", "[::ffff:8.8.8.8]", "[2a00:1450:0:0:0:0:0:1]:8443", "localhost.cl")


@query("fetch_guard_literals", f"SELECT page_id, page_id % {len(_HOSTS) + 1} AS form FROM pages WHERE page_id % {len(_HOSTS) + 1} >= {len(_HOSTS) - 4} AND (page_id % {len(_HOSTS) + 1} < {len(_HOSTS)} OR regexp_matches(url, '^https?://'))", False)
def fetch_guard_literals(s, d):
    """Pages at their own address, or at one whose host is written in some way that a resolver would read as an address."""
    k = (F.col("page_id") % (len(_HOSTS) + 1)).cast("int")
    url = F.coalesce(F.concat(F.lit("http://"), F.get(F.array(*map(F.lit, _HOSTS)), k), F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1)), F.col("url"))
    return table(s, d, "pages").where(X.safe_to_fetch(url)).select("page_id", k.cast("long").alias("form"))


@query("incident_rows", "SELECT page_id, substr(sha256(u), 1, 16) AS id FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'javascript:x' WHEN page_id % 7 = 0 THEN NULL ELSE url END AS u FROM pages) WHERE regexp_matches(lower(u), '^https?:')", False)
def incident_rows(s, d):
    k = F.col("page_id")
    return P.incident(table(s, d, "pages").select("page_id", F.when(k % 5 == 0, "javascript:x").when(k % 7 == 0, None).otherwise(F.col("url")).alias("url"))).select("page_id", "id")


@query("rejected_records", r"SELECT page_id, substr(sha256(url), 1, 16) AS id, length(substr(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 500)) AS n, sha256(substr(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 500)) AS digest FROM pages", False)
def rejected_records(s, d):
    """Rejected items as they are kept: no tags, 500 characters of their description at most, which is the record's limit."""
    said = F.substring(F.trim(X.strip_tags(F.col("html"))), 1, 500)
    return table(s, d, "pages").select("page_id", X.url_id(F.col("url")).alias("id"), F.length(said).cast("long").alias("n"), F.sha2(said, 256).alias("digest"))


@query("seen_pruned", "SELECT user_id FROM (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE max(day) END AS day FROM ev GROUP BY user_id) WHERE coalesce(day, DATE '1970-01-01') >= DATE '2024-03-29' - 60")
def seen_pruned(s, d):
    """Of the ledger of seen users those of the last 60 days; dates that aren't any are old."""
    seen = ev(s, d).groupBy("user_id").agg(F.max("day").alias("day")).select("user_id", F.when(F.col("user_id") % 9 == 0, "yesterday").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("date"))
    return P.seen_pruned(seen, "date", F.lit("2024-03-29").cast("date")).select("user_id")


@query("article_objects", "SELECT doc_id, sha256(text) AS text_sha256, length(text) AS char_count FROM documents", False)
def article_objects(s, d):
    """Texts as they are archived: 2 MB at most, cut between characters before they are hashed."""
    t = X.cut_bytes(F.col("text"), 2 * 1024 * 1024)
    return table(s, d, "documents").select("doc_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).cast("long").alias("char_count"))


@query("feed_outlets", "SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type WHEN user_id % 3 = 0 THEN 'Search' ELSE 'outlet ' || user_id END AS outlet, CASE WHEN event_type IN ('view', 'click') THEN 'link' || event_id WHEN event_id % 2 = 0 THEN 'guid' || event_id ELSE 'link' || event_id END AS url FROM ev")
def feed_outlets(s, d):
    """Outlets and addresses by feed: a search feed's outlet is its item's source, else the search's name; addresses are
    links in some feeds and ids in others, links where there is no id."""
    kind, n, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    source = F.when(u % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" outlet "), u))
    guid, link = F.when(n % 2 == 0, F.concat(F.lit("guid"), n)), F.concat(F.lit("link"), n)
    outlet = F.when(kind != "view", kind).otherwise(F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("Search")))
    return ev(s, d).select("event_id", outlet.alias("outlet"), F.when(kind.isin("view", "click"), link).otherwise(F.coalesce(guid, link)).alias("url"))


@query("publication_dates", "SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 THEN DATE '2024-06-30' ELSE ts::DATE END, '%Y-%m-%d') AS day FROM events", False)
def publication_dates(s, d):
    """The date in UTC, today's where there is none that reads."""
    said = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    day = F.coalesce(F.try_to_timestamp(said, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("date"), F.lit("2024-06-30").cast("date"))
    return table(s, d, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("freshness", "SELECT event_type, date_diff('second', max(ts), TIMESTAMP '2024-02-02 12:00:00') / 86400.0::DOUBLE <= 3 AS fresh FROM events GROUP BY event_type", False)
def freshness(s, d):
    """Whether the newest row of each kind is 3 days old at most."""
    age = F.timestamp_diff("SECOND", F.max(F.col("ts").cast("timestamp")), F.lit("2024-02-02 12:00:00").cast("timestamp")) / 86400.0
    return table(s, d, "events").groupBy("event_type").agg((age <= 3).alias("fresh"))


# Texts

@query("recovered_json", """SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE (props::JSON ->> '$.k') END AS k FROM events""", False)
def recovered_json(s, d):
    """The JSON at the start of an answer, in a fence or with prose behind it; null where there is none."""
    n, p = F.col("event_id") % 4, F.col("props")
    said = F.when(n == 0, p).when(n == 1, F.concat(p, F.lit(' and {so} on, "quoted}"'))).when(n == 2, F.concat(F.lit("well, "), p)).otherwise(F.concat(F.lit("```json\n"), p, F.lit("\n```")))
    return table(s, d, "events").select("event_id", F.get_json_object(X.leading_json(said), "$.k").alias("k"))


@query("hint_as_text", "SELECT event_id, (props::JSON ->> '$.k') AS hint FROM events", False)
def hint_as_text(s, d):
    """A field that comes as a number or a text, as text."""
    return table(s, d, "events").select("event_id", F.from_json("props", "k string")["k"].alias("hint"))


@query("pair_envelopes", "SELECT conv_id, '{\"titular_a\":\"' || min(turn) || '\",\"titular_b\":\"' || max(turn) || ' \\\"q\\\"\"}' AS said FROM conversations GROUP BY conv_id", False)
def pair_envelopes(s, d):
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("\n "), F.min("turn")).alias("a"), F.concat(F.max("turn"), F.lit('  "q" ')).alias("b"))
    return rows.select("conv_id", X.pair_envelope(F.col("a"), F.col("b")).alias("said"))


@query("code_labels", "SELECT DISTINCT o_orderpriority AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS label, upper(substr(lower(o_orderpriority), 3, 1)) || substr(lower(o_orderpriority), 4) AS fallback, replace(o_orderpriority, ' ', '') AS plain FROM orders", False)
def code_labels(s, d):
    """Names of codes, the code where it has none; the code with a capital; the code without blanks."""
    code = F.col("o_orderpriority")
    return table(s, d, "orders").select(code.alias("code"), X.label(code, FAMILY_LABELS).alias("label"), X.capitalised(F.substring(F.lower(code), 3, 100)).alias("fallback"), X.without_space(code).alias("plain")).distinct()


@query("short_numbers", "SELECT o_orderkey, regexp_replace(format('{:,.1f}', floor(o_totalprice / 100 * 10 + 0.5) / 10), '\\.0$', '') AS said FROM orders", False)
def short_numbers(s, d):
    return table(s, d, "orders").select("o_orderkey", X.short_number(F.col("o_totalprice") / 100).alias("said"))


@query("region_phrases", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'Región Metropolitana' WHEN 1 THEN 'Región del Maule' WHEN 2 THEN 'Región del Biobío' ELSE 'Región de ' || r_name END AS phrase FROM region", False)
def region_phrases(s, d):
    name = F.coalesce(F.get(F.array(*map(F.lit, ("Metropolitana", "Maule", "Biobío"))), F.col("r_regionkey")), F.col("r_name"))
    return table(s, d, "region").select("r_regionkey", X.region_phrase(name).alias("phrase"))


# Prose, JSON

_BANK = [(1, "trend=up", "{name} is rising, at place {place} of {all}."), (1, "trend=down", "{name} is falling, at place {place} of {all}."), (1, "trend=stable", "{name} is steady, at place {place} of {all}."),
         (2, None, "Its rate was {rate}, {unknown}."), (3, "low=true", "Few people live there."), (4, None, "Since its first year it has {change}.")]


@query("unit_prose", f""", x AS (SELECT cut, row_number() OVER (ORDER BY rate DESC, cut) AS place, count(*) OVER () AS n, rate, low FROM ref), f AS (SELECT cut, min_by(rate, year) AS first, max_by(rate, year) AS last FROM totals WHERE NOT partial GROUP BY cut),
t AS (SELECT cut, CASE WHEN (rate - was) * 100 / nullif(was, 0) > 5 THEN 'rising' WHEN (rate - was) * 100 / nullif(was, 0) < -5 THEN 'falling' ELSE 'steady' END AS trend FROM (SELECT cut, rate, lag(rate, 3) OVER w AS was, lead(year) OVER w AS next FROM totals WHERE NOT partial WINDOW w AS (PARTITION BY cut ORDER BY year)) WHERE next IS NULL)
SELECT cut, name || ' is ' || trend || ', at place ' || place || ' of ' || n || '.' || chr(10) || chr(10) || 'Its rate was ' || format('{{:,}}', floor(rate + 0.5)::BIGINT) || ', {{unknown}}.' || chr(10) || chr(10) || CASE WHEN low THEN 'Few people live there.' || chr(10) || chr(10) ELSE '' END
 || 'Since its first year it has ' || CASE WHEN (last - first) * 100 / first > 5 THEN 'increased' WHEN (last - first) * 100 / first < -5 THEN 'decreased' ELSE 'remained' END || '.' AS text FROM x JOIN f USING (cut) JOIN t USING (cut) JOIN (SELECT cut, name FROM dim) USING (cut)""")
def unit_prose(s, d):
    """Paragraphs by trend and size, from a table of templates."""
    r = ref(s, d)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    done = totals(s, d).where("NOT partial").groupBy("cut").agg(F.min_by("rate", "year").alias("first"), F.max_by("rate", "year").alias("last"))
    facts = S.rank(r, "place", "rate", "cut").join(done, "cut").join(S.three_step_trend(totals(s, d)), "cut").join(dim(s, d).select("cut", "name"), "cut").join(F.broadcast(n))
    values = {"name": F.col("name"), "place": F.col("place"), "all": F.col("n"), "rate": F.format_number(X.js_round(F.col("rate")), 0), "change": P.change_word(F.col("last"), F.col("first"), ("increased", "decreased", "remained"))}
    pairs = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    bank = s.createDataFrame(_BANK, "place int, choice string, template string")
    return P.prose(facts.withColumn("values", pairs), "cut", bank, ["trend", "low"], "values")


@query("pair_prose", """, p AS (SELECT a.cut AS a, b.cut AS b, a.rate AS x, b.rate AS y FROM ref a JOIN ref b ON b.cut = a.cut + 1)
SELECT a, CASE WHEN x > y THEN a || ' is ' || regexp_replace(format('{:,.1f}', floor(abs(x - y) * 10 + 0.5) / 10), '\\.0$', '') || ' higher than ' || b WHEN x < y THEN a || ' is ' || regexp_replace(format('{:,.1f}', floor(abs(x - y) * 10 + 0.5) / 10), '\\.0$', '') || ' lower than ' || b ELSE a || ' equals ' || b END || '.' AS text FROM p""")
def pair_prose(s, d):
    """Two units against each other, by direction; swapped, the text says the opposite."""
    r = ref(s, d)
    both = r.select(F.col("cut").alias("a"), F.col("rate").alias("x")).join(r.select((F.col("cut") - 1).alias("a"), F.col("cut").alias("b"), F.col("rate").alias("y")), "a")
    side = F.when(F.col("x") > F.col("y"), "higher").when(F.col("x") < F.col("y"), "lower").otherwise("equal")
    values = F.create_map(F.lit("a"), F.col("a").cast("string"), F.lit("b"), F.col("b").cast("string"), F.lit("gap"), X.short_number(F.abs(F.col("x") - F.col("y"))))
    bank = s.createDataFrame([(1, "side=higher", "{a} is {gap} higher than {b}."), (1, "side=lower", "{a} is {gap} lower than {b}."), (1, "side=equal", "{a} equals {b}.")], "place int, choice string, template string")
    return P.prose(both.withColumns({"side": side, "values": values}), "a", bank, ["side"], "values")


@query("item_lists", """WITH n AS (SELECT n_regionkey AS region, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation)
SELECT region, '{"@context":"https://schema.org","@type":"ItemList","name":"By reported incidence","numberOfItems":' || count(*) || ',"itemListElement":[' || string_agg('{"position":' || p || ',"@type":"ListItem","name":"' || name || '","url":"https://a.b/commune/' || replace(lower(name), '_', '-') || '/"}', ',' ORDER BY p) || ']}' AS json FROM n GROUP BY region""", False)
def item_lists(s, d):
    rows = S.rank(table(s, d, "nation").withColumnRenamed("n_regionkey", "region"), "position", "n_nationkey", "n_nationkey", ["region"], descending=False)
    url = F.concat(F.lit("https://a.b/commune/"), X.slug(F.col("n_name")), F.lit("/"))
    return P.item_list(rows, "region", "position", "n_name", url, F.lit("By reported incidence"))


@query("address_pairs", "SELECT n_nationkey, '/commune/' || replace(lower(n_name), '_', '-') || '/' AS en, '/es/comuna/' || replace(lower(n_name), '_', '-') || '/' AS es FROM nation", False)
def address_pairs(s, d):
    return table(s, d, "nation").select("n_nationkey", P.address_pair(("commune", "comuna"), X.slug(F.col("n_name"))).alias("p")).select("n_nationkey", "p.*")


@query("sitemap", "SELECT page_id FROM pages WHERE NOT (page_id % 3 = 0 AND page_id % 2 = 1)", False)
def sitemap(s, d):
    """Pages that are listed: those of units only if released, here the even ones."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://a.b/es/comuna/"), F.when(F.col("page_id") % 2 == 0, "on").otherwise("off"), F.lit("/"))).otherwise(F.col("url"))
    return table(s, d, "pages").where(P.on_sitemap(url, ["on"])).select("page_id")


@query("home_blob", """SELECT cut, '{"n":"' || name || '","s":"' || replace(lower(name), '#', '-') || '","r":' || floor(rate + 0.5)::BIGINT || ',"p":' || low::INT || '}' AS json FROM ref JOIN (SELECT cut, name FROM dim) USING (cut)""")
def home_blob(s, d):
    """Rows with short names, a rounded rate and 0 or 1 for a flag."""
    rows = ref(s, d).join(dim(s, d).select("cut", "name"), "cut")
    return rows.select("cut", F.to_json(F.struct(F.col("name").alias("n"), X.slug(F.col("name")).alias("s"), X.js_round(F.col("rate")).alias("r"), F.col("low").cast("int").alias("p"))).alias("json"))


@query("meta_index", "SELECT cut, name, replace(lower(name), '#', '-') AS slug, region, round(pop)::BIGINT AS population, low FROM dim")
def meta_index(s, d):
    return dim(s, d).select("cut", "name", X.slug(F.col("name")).alias("slug"), "region", F.round("pop").cast("long").alias("population"), "low")


@query("family_catalog", "SELECT * FROM (VALUES (0, '1-URGENT', true), (1, '2-HIGH', false), (2, '3-MEDIUM', false), (3, '4-NOT SPECIFIED', false), (4, '5-LOW', true)) t(ordinal, family, featured)", False)
def family_catalog(s, d):
    """The families in the catalog's order and which are featured."""
    return s.createDataFrame([(i, f, f in ("1-URGENT", "5-LOW")) for i, f in enumerate(FAMILIES)], "ordinal int, family string, featured boolean")


@query("pins", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE event_type || ' (es)' END AS title, CASE WHEN s_suppkey IS NOT NULL THEN '/es/comuna/' || replace(lower(s_name), '#', '-') || '/' END AS link FROM events LEFT JOIN supplier ON s_suppkey = user_id", False)
def pins(s, d):
    """Titles in the language, else as they are, and a link where the unit has a page."""
    units = table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("/es/comuna/"), X.slug(F.col("s_name")), F.lit("/")).alias("link"))
    spanish = F.when(F.col("event_id") % 5 > 0, F.concat("event_type", F.lit(" (es)")))
    return table(s, d, "events").join(units, "user_id", "left").select("event_id", F.coalesce(spanish, "event_type").alias("title"), "link")


@query("sparkline", "SELECT cut, string_agg(x || ',' || y, ' ' ORDER BY x) AS points FROM (SELECT cut, (year - 1995) * 10 AS x, floor(20 - 20 * rate / greatest(max(rate) OVER (PARTITION BY cut), 1) + 0.5)::BIGINT AS y FROM totals WHERE NOT partial) GROUP BY cut")
def sparkline(s, d):
    """Points of a line 20 high, the largest rate (1 at least) on top."""
    t = totals(s, d).where("NOT partial")
    top = t.groupBy("cut").agg(F.greatest(F.max("rate"), F.lit(1.0)).alias("top"), F.sort_array(F.collect_list(F.struct("year", "rate"))).alias("all"))
    point = lambda p: F.concat_ws(",", (p["year"] - 1995) * 10, X.js_round(20 - 20 * p["rate"] / F.col("top")))
    return top.select("cut", F.array_join(F.transform("all", point), " ").alias("points"))


# Ledgers, reports, gates

@query("ledger_state", """, l AS (SELECT user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'rejected' WHEN user_id % 5 = 1 THEN NULL ELSE 'incident' END AS kind, CASE user_id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'failed' WHEN 2 THEN 'permanent_failure' ELSE 'new' END AS status, count(*) AS chars FROM ev GROUP BY user_id)
SELECT CASE WHEN kind = 'rejected' THEN 'rejected' ELSE 'incidents' END AS kind, count(*) FILTER (status = 'fetched') AS fetched_ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('fetched', 'failed', 'permanent_failure')) AS pending, count(*) FILTER (status = 'permanent_failure') AS permanent_failure, coalesce(sum(chars) FILTER (status = 'fetched'), 0)::BIGINT AS chars FROM l GROUP BY 1""")
def ledger_state(s, d):
    """Statuses by kind; rows without a kind are incidents, unknown statuses pending."""
    k = F.col("user_id")
    rows = ev(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("chars")).select(F.when(k % 5 == 0, "rejected").when(k % 5 == 1, None).otherwise("incident").alias("kind"),
        F.when(k % 4 == 0, "fetched").when(k % 4 == 1, "failed").when(k % 4 == 2, "permanent_failure").otherwise("new").alias("status"), "chars")
    st = F.col("status")
    return rows.groupBy(F.when(F.col("kind") == "rejected", "rejected").otherwise("incidents").alias("kind")).agg(
        F.count_if(st == "fetched").alias("fetched_ok"), F.count_if(st == "failed").alias("failed"), F.count_if(~st.isin("fetched", "failed", "permanent_failure")).alias("pending"),
        F.count_if(st == "permanent_failure").alias("permanent_failure"), F.coalesce(F.sum(F.when(st == "fetched", F.col("chars"))), F.lit(0)).alias("chars"))


@query("manifest", "SELECT '2024-02-10' AS generated, count(*) AS total_incidents, 2 AS schema_version FROM ev")
def manifest(s, d):
    return ev(s, d).agg(F.lit("2024-02-10").alias("generated"), F.count(F.lit(1)).alias("total_incidents"), F.lit(2).alias("schema_version"))


@query("call_budget", "SELECT strftime(day, '%Y-%m-%d') AS run, count(*) AS calls, 3 + sum(count(*)) OVER (ORDER BY day) AS total, 2 * count(*) FILTER (event_type = 'error') + 1 AS worst FROM ev GROUP BY day")
def call_budget(s, d):
    """Calls of each run and up to it, and what the next would need at worst: two for each pending row and one."""
    runs = ev(s, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("run")).agg(F.count(F.lit(1)).alias("calls"), (2 * F.count_if(F.col("event_type") == "error") + 1).alias("worst"))
    return P.cumulative(runs, "run", "calls", 3)


@query("audit_sample", "SELECT count(*) AS sampled, count(s_suppkey) AS valid, round(count(s_suppkey) / count(*)::DOUBLE, 6) AS accuracy, count(s_suppkey) >= 0.9 * count(*) AS pass FROM (SELECT user_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 50) LEFT JOIN supplier ON s_suppkey = user_id", False)
def audit_sample(s, d):
    """Of 50 rows, drawn by a hash of their ids, those whose unit there is; nine in ten must be."""
    drawn = table(s, d, "events").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(50)
    units = table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit(True).alias("found"))
    n, ok = F.count(F.lit(1)), F.count("found")
    return drawn.join(units, "user_id", "left").agg(n.alias("sampled"), ok.alias("valid"), F.round(ok / n, 6).alias("accuracy"), (ok >= 0.9 * n).alias("pass"))


@query("value_counts", "SELECT 'user' AS what, user_id::VARCHAR AS value, count(*) AS n FROM ev GROUP BY user_id ORDER BY n DESC, value LIMIT 10")
def value_counts(s, d):
    return ev(s, d).groupBy(F.col("user_id").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(10).select(F.lit("user").alias("what"), "value", "n")


@query("classifier_report", """, a AS (SELECT e.user_id, e.event_type = CASE WHEN e.user_id % 7 = 0 THEN 'view' ELSE e.event_type END AS family_ok, c_nationkey = e.user_id % 25 AS commune_ok, e.event_id % 50 = 0 AS bad, e.value AS latency FROM events e LEFT JOIN customer ON c_custkey = e.user_id)
SELECT user_id % 3 AS arm, count(*) AS n, round(avg(coalesce(commune_ok, false)::INT) FILTER (NOT bad), 6) AS commune, round(avg(family_ok::INT) FILTER (NOT bad), 6) AS family, round(avg((commune_ok IS NULL)::INT), 6) AS null_rate, round(avg(bad::INT), 6) AS parse_failures, round(avg(latency), 6) AS latency, round(count(*) * (2100 * 0.27 + 120 * 1.10) / 1e6, 6)::DOUBLE AS cost FROM a GROUP BY 1""")
def classifier_report(s, d):
    """Two answers against each other: hits among the answers that parse, empty ones, latency, and the price of all calls."""
    e = table(s, d, "events").join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id", "left")
    family = F.col("event_type") == F.when(F.col("user_id") % 7 == 0, "view").otherwise(F.col("event_type"))
    commune, bad = F.col("c_nationkey") == F.col("user_id") % 25, F.col("event_id") % 50 == 0
    share = lambda c, but=None: F.round(F.avg((c if but is None else F.when(~but, c)).cast("int")), 6)
    rows = e.groupBy((F.col("user_id") % 3).alias("arm")).agg(F.count(F.lit(1)).alias("n"), share(F.coalesce(commune, F.lit(False)), bad).alias("commune"), share(family, bad).alias("family"), share(commune.isNull()).alias("null_rate"),
        share(bad).alias("parse_failures"), F.round(F.avg("value"), 6).alias("latency"))
    return rows.withColumn("cost", F.round(F.col("n") * ((2100 * 0.27 + 120 * 1.10) / 1e6), 6))


@query("golden_report", """, g AS (SELECT doc_id, quality = 1 AS merge, doc_id % 3 > 0 AS proposed, doc_id % 5 = 0 AS excluded, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'failsafe' ELSE 'model' END AS source, toxic = 1 AS same, doc_id % 2 = 0 AS high FROM labels)
SELECT tp, fp, fn_prefiltered + fn_rejected AS fn, tn, n, n_failsafe, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn_prefiltered + fn_rejected, 0)::DOUBLE AS recall, round(1 - proposed / n::DOUBLE, 6) AS reduction, n_high, n_aggregate FROM (SELECT
count(*) FILTER (proposed AND merge AND same AND high) AS tp, count(*) FILTER (proposed AND NOT merge AND same AND high) AS fp, count(*) FILTER (NOT proposed AND merge) AS fn_prefiltered, count(*) FILTER (proposed AND merge AND NOT (same AND high)) AS fn_rejected,
count(*) FILTER (proposed AND NOT merge AND NOT (same AND high)) AS tn, count(*) AS n, count(*) FILTER (proposed) AS proposed, count(*) FILTER (proposed AND source IS DISTINCT FROM 'model') AS n_failsafe, count(*) FILTER (proposed AND high) AS n_high,
count(*) FILTER (proposed AND NOT merge AND same AND high AND doc_id % 4 = 0) AS n_aggregate FROM g WHERE NOT excluded)""")
def golden_report(s, d):
    """The kept verdicts against their labels. Pairs that weren't proposed have no verdict, so only missed merges count."""
    k = F.col("doc_id")
    g = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("merge"), (k % 3 > 0).alias("proposed"), (k % 5 == 0).alias("excluded"),
        F.when(k % 3 == 0, None).when(k % 7 == 0, "failsafe").otherwise("model").alias("source"), ((F.col("toxic") == 1) & (k % 2 == 0)).alias("edge"), (k % 2 == 0).alias("high")).where("NOT excluded")
    p, m, e = F.col("proposed"), F.col("merge"), F.col("edge")
    n = lambda c: F.count_if(c)
    rows = g.agg(n(p & m & e).alias("tp"), n(p & ~m & e).alias("fp"), n((~p & m) | (p & m & ~e)).alias("fn"), n(p & ~m & ~e).alias("tn"), F.count(F.lit(1)).alias("n"), n(p & ~F.col("source").eqNullSafe("model")).alias("n_failsafe"),
                 n(p).alias("_p"), n(p & F.col("high")).alias("n_high"), n(p & ~m & e & (k % 4 == 0)).alias("n_aggregate"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return rows.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")), "reduction": F.round(1 - F.col("_p") / F.col("n"), 6)}).drop("_p")


@query("record_gates", "SELECT 'cut' AS rule, count(*) FILTER (NOT regexp_matches(user_id::VARCHAR, '^[0-9]{2,3}$')) AS n FROM ev UNION ALL SELECT 'family', count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'purchase')) FROM ev UNION ALL SELECT 'level', count(*) FILTER (user_id % 6 NOT BETWEEN 1 AND 5) FROM ev UNION ALL SELECT 'outlet', count(*) FILTER (event_id % 11 = 0) FROM ev")
def record_gates(s, d):
    """Rows that break each rule: the key's form, the set of families, levels 1 to 5, an outlet that isn't empty."""
    outlet = F.when(F.col("event_id") % 11 == 0, "").otherwise("x")
    return E.violations(ev(s, d), {"cut": F.col("user_id").cast("string").rlike("^[0-9]{2,3}$"), "family": F.col("event_type").isin("click", "view", "signup", "purchase"), "level": (F.col("user_id") % 6).between(1, 5), "outlet": outlet != ""})


@query("size_gates", "SELECT (SELECT count(*) FROM dim) AS units, (SELECT count(*) FROM ref) >= 136 AS covered, (SELECT count(*) FROM ev) >= 200 AS records, (SELECT sum(m * (m - 1) // 2)::BIGINT FROM (SELECT count(*) AS m FROM dim GROUP BY region)) AS pairs")
def size_gates(s, d):
    """How many units and pairs of a region there are, and whether there are as many records as a source must have."""
    pairs = dim(s, d).groupBy("region").agg(F.count(F.lit(1)).alias("m")).agg(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")).alias("pairs"))
    one = dim(s, d).agg(F.count(F.lit(1)).alias("units"))
    two = ref(s, d).agg((F.count(F.lit(1)) >= 136).alias("covered"))
    three = ev(s, d).agg((F.count(F.lit(1)) >= 200).alias("records"))
    return one.join(two).join(three).join(pairs)


@query("quality_checks", f"""SELECT 1 AS n, 'partial years' AS name, CASE WHEN count(*) FILTER (year = {LAST} AND NOT partial OR year < {LAST} AND partial) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (year = {LAST})::VARCHAR AS evidence FROM totals
UNION ALL SELECT 2, 'range', CASE WHEN count(*) FILTER (rate NOT BETWEEN 0 AND 400) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (rate NOT BETWEEN 0 AND 400)::VARCHAR FROM totals
UNION ALL SELECT 3, 'families sum up', CASE WHEN count(*) FILTER (abs(t.rate - s.rate) > 0.01) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR FROM totals t JOIN (SELECT cut, year, count(*) * 1e5 / (1000 + abs(any_value(c_acctbal))) AS rate FROM (SELECT o_custkey AS cut, year(o_orderdate)::INT AS year FROM orders) JOIN customer ON c_custkey = cut GROUP BY cut, year) s USING (cut, year)
UNION ALL SELECT 4, 'scope of a family', 'DOCUMENTED', count(DISTINCT family)::VARCHAR FROM rates""")
def quality_checks(s, d):
    """Checks as rows, with what they found."""
    t = totals(s, d)
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cut"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("c"))
    again = t.join(o, ["cut", "year"]).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.abs(F.col("rate") - F.col("c") * 1e5 / F.col("pop")) > 0.01).alias("off"))
    year = F.col("year")
    parts = t.agg(F.count_if(((year == LAST) & ~F.col("partial")) | ((year < LAST) & F.col("partial"))).alias("off"), F.count_if(year == LAST).alias("last"), F.count_if(~F.col("rate").between(0, 400)).alias("out"))
    return P.checks([(1, "partial years", parts, F.col("off") == 0, F.col("last")), (2, "range", parts, F.col("out") == 0, F.col("out")), (3, "families sum up", again, F.col("off") == 0, F.col("all")),
                     (4, "scope of a family", rates(s, d).agg(F.count_distinct("family").alias("f")), F.lit(None).cast("boolean"), F.col("f"))])


@query("rederived_rate", "SELECT cut, year, round(count * 1e5 / pop, 6) AS again FROM (SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, count(*) AS count FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY ALL) JOIN dim USING (cut) WHERE contains(lower(name), '00001') AND year = 1998")
def rederived_rate(s, d):
    """One family's rate from the raw rows, of the units whose name has a part, in exactly one year."""
    o = table(s, d, "orders").where((F.col("o_orderpriority") == "2-HIGH") & (F.year("o_orderdate") == 1998)).groupBy(F.col("o_custkey").alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    found = dim(s, d).where(F.contains(F.lower("name"), F.lit("00001"))).join(o, "cut")
    return found.select("cut", F.lit(1998).alias("year"), F.round(X.per_100k(F.col("n"), F.col("pop")), 6).alias("again"))


@query("page_links", r"""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""", False)
def page_links(s, d):
    """All addresses that pages link, each once."""
    return table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).distinct()


@query("all_zero_units", "SELECT cut, bool_and(v = 0) AS all_zero, count(DISTINCT year) AS years FROM (SELECT cut, year, CASE WHEN cut % 11 = 0 OR year = 1999 THEN 0 ELSE rate END AS v FROM totals) GROUP BY cut")
def all_zero_units(s, d):
    """Units all of whose values are 0, as a probe of a source finds them."""
    v = F.when((F.col("cut") % 11 == 0) | (F.col("year") == 1999), 0.0).otherwise(F.col("rate"))
    return totals(s, d).groupBy("cut").agg(F.every(v == 0).alias("all_zero"), F.count_distinct("year").alias("years"))


@query("confident", "SELECT event_id FROM events WHERE value / 100 >= 0.6", False)
def confident(s, d):
    return table(s, d, "events").where(F.col("value") / 100 >= 0.6).select("event_id")


@query("composite_inputs", """, v AS (SELECT o_custkey AS cut, count(*) AS victims FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 2000 GROUP BY 1), w AS (SELECT s_suppkey AS cut, s_acctbal AS workers FROM supplier)
SELECT cut, round(CASE WHEN victims IS NULL OR CASE WHEN workers IS NULL OR workers / pop > 5 THEN pop ELSE workers END <= 0 THEN 0 ELSE victims * 1e5 / CASE WHEN workers IS NULL OR workers / pop > 5 THEN pop ELSE workers END END, 4) AS rate, workers IS NULL AS no_workers FROM dim LEFT JOIN v USING (cut) LEFT JOIN w USING (cut)""")
def composite_inputs(s, d):
    """Units with their victims by workers, or by population where workers are missing or too many; no victims are 0."""
    victims = table(s, d, "orders").where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 2000)).groupBy(F.col("o_custkey").alias("cut")).agg(F.count(F.lit(1)).alias("victims"))
    workers = table(s, d, "supplier").select(F.col("s_suppkey").alias("cut"), F.col("s_acctbal").alias("workers"))
    rows = dim(s, d).join(victims, "cut", "left").join(workers, "cut", "left").withColumn("x", S.exposure_denominator(F.col("workers"), F.col("pop")))
    rate = F.when(F.col("victims").isNull() | (F.col("x.denominator") <= 0), 0.0).otherwise(F.col("victims") * 1e5 / F.col("x.denominator"))
    return rows.select("cut", F.round(rate, 4).alias("rate"), F.col("workers").isNull().alias("no_workers"))


# A map's layers, by id, kind and place of their family in a payload row.
LAYERS = [("ci", "composite", None), ("total", "family", None), ("vida", "family", 0), ("propiedad", "family", 5), ("robos_violentos", "family", 1), ("incivilidades", "family", 6), ("vif", "family", 2), ("drogas", "family", 3),
          ("armas", "family", 4), ("homicidios", "family", None)]


@query("map_layers", "SELECT * FROM (VALUES ('ci', 'composite', -1), ('total', 'family', -1), ('vida', 'family', 0), ('propiedad', 'family', 5), ('robos_violentos', 'family', 1), ('incivilidades', 'family', 6), ('vif', 'family', 2), ('drogas', 'family', 3), ('armas', 'family', 4), ('homicidios', 'family', -1)) t(id, kind, place)", False)
def map_layers(s, d):
    """The layers of a map; -1 where a layer is of no family of a row."""
    return s.createDataFrame(LAYERS, "id string, kind string, place int").fillna(-1)


@query("route_budget", "SELECT 2 * count(*) AS routes, 2 * count(*) <= 18000 AS within, true AS symmetric FROM (SELECT n_nationkey FROM nation UNION ALL SELECT s_suppkey FROM supplier)", False)
def route_budget(s, d):
    """How many pages there are, whether that is within the host's limit, and whether each has its other language's."""
    nations = table(s, d, "nation").select(P.address_pair(("commune", "comuna"), X.slug(F.col("n_name"))).alias("p"))
    units = table(s, d, "supplier").select(P.address_pair(("commune", "comuna"), X.slug(F.col("s_name"))).alias("p"))
    n = F.count("p.en") + F.count("p.es")
    return nations.unionByName(units).agg(n.alias("routes"), (n <= 18_000).alias("within"), (F.count_distinct("p.en") == F.count_distinct("p.es")).alias("symmetric"))


def committed(s, d):
    """What was published: totals with some rates and partial marks that are wrong."""
    k = F.col("cut")
    wrong = F.when(k % 61 == 7, -1.0).when(k % 53 == 4, F.col("rate") + 2).otherwise(F.col("rate"))
    return totals(s, d).withColumns({"rate": wrong, "partial": F.col("partial") & ~((k % 50 == 3) & (F.col("year") == LAST))})


_COMMITTED = f", com AS (SELECT cut, region, pop, year, CASE WHEN cut % 61 = 7 THEN -1 WHEN cut % 53 = 4 THEN rate + 2 ELSE rate END AS rate, rate AS own, partial AND NOT (cut % 50 = 3 AND year = {LAST}) AS partial FROM totals)"
_RULED = [(1, "host", "FAIL"), (2, "families sum up", "FAIL"), (3, "partial years", "FAIL"), (4, "scope of families", "DOCUMENTED"), (5, "one family derived anew", "FAIL"), (6, "one total derived anew", "FAIL"),
          (7, "counts and rates", "FAIL"), (8, "units without events", "DOCUMENTED"), (9, "weighted means", "FAIL"), (10, "range", "FAIL")]


@query("quality_report", f"""{_COMMITTED}, cnt AS (SELECT o_custkey AS cut, year(o_orderdate)::INT AS year, count(*) AS c FROM orders GROUP BY ALL),
w AS (SELECT region, sum(own * pop) / sum(pop) AS a, sum(rate * pop) / sum(pop) AS b FROM com WHERE year = {REFERENCE} GROUP BY region),
t AS (SELECT 1 AS n, NOT regexp_matches(url, '^https?://[a-z.]+\\.example\\.(com|net|org)(/|$)') AS broken, page_id::VARCHAR AS e FROM pages
UNION ALL SELECT 2, abs(rate - own) > 0.01, cut || '-' || year FROM com
UNION ALL SELECT 3, (year = {LAST}) <> partial, cut || '-' || year FROM com
UNION ALL SELECT DISTINCT 4, family = '4-NOT SPECIFIED', family FROM rates
UNION ALL SELECT 5, false, cut || '-' || year FROM rates WHERE cut = 7 AND family = '1-URGENT' AND year = {REFERENCE}
UNION ALL SELECT 6, abs(rate - own) > 1, cut || '-' || year FROM com WHERE cut = 4 AND year = {REFERENCE}
UNION ALL SELECT 7, abs(rate - c * 1e5 / pop) > 0.5, cut::VARCHAR FROM com JOIN cnt USING (cut, year) WHERE year = {REFERENCE}
UNION ALL SELECT 8, coalesce(c, 0) = 0, dim.cut::VARCHAR FROM dim LEFT JOIN (SELECT cut, sum(c) AS c FROM cnt GROUP BY cut) x ON x.cut = dim.cut
UNION ALL SELECT 9, abs(a - b) > 0.000001, region::VARCHAR FROM w
UNION ALL SELECT 10, NOT rate BETWEEN 0 AND 100000, cut || '-' || year FROM com),
g AS (SELECT n, count(*) AS checked, count(*) FILTER (broken) AS broken, array_to_string((list(e ORDER BY e) FILTER (broken))[:20], ' ') AS evidence FROM t GROUP BY n)
SELECT r.n, r.name, CASE WHEN checked IS NULL THEN 'DOCUMENTED' WHEN broken = 0 THEN 'PASS' ELSE severity END AS status, coalesce(checked, 0) AS checked, coalesce(broken, 0) AS broken, coalesce(evidence, '') AS evidence
FROM (VALUES {", ".join(map(str, _RULED))}) r(n, name, severity) LEFT JOIN g ON g.n = r.n""")
def quality_report(s, d):
    """Ten rules on what was published, against what the sources give anew."""
    at = F.concat_ws("-", "cut", "year")
    own = totals(s, d).select("cut", "year", F.col("rate").alias("own"))
    counts = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cut"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("c"))
    com = committed(s, d).join(own, ["cut", "year"])
    ref_ = com.where(F.col("year") == REFERENCE)
    mean = lambda c: F.sum(F.col(c) * F.col("pop")) / F.sum("pop")
    family = rates(s, d).where((F.col("cut") == 7) & (F.col("family") == "1-URGENT") & (F.col("year") == REFERENCE))
    again = table(s, d, "orders").where(f"o_custkey = 7 AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = {REFERENCE}").agg(F.count(F.lit(1)).alias("c"))
    inputs = {"pages": table(s, d, "pages"), "series": com, "families": rates(s, d).select("family").distinct(), "family": family.join(again), "counts": ref_.join(counts, ["cut", "year"]),
              "units": dim(s, d).select("cut").join(counts.groupBy("cut").agg(F.sum("c").alias("c")), "cut", "left"), "means": ref_.groupBy("region").agg(mean("own").alias("a"), mean("rate").alias("b"))}
    on = {1: ("pages", ~F.col("url").rlike(r"^https?://[a-z.]+\.example\.(com|net|org)(/|$)"), F.col("page_id"), None), 2: ("series", F.abs(F.col("rate") - F.col("own")) > 0.01, at, None), 3: ("series", (F.col("year") == LAST) != F.col("partial"), at, None),
          4: ("families", F.col("family") == "4-NOT SPECIFIED", F.col("family"), None), 5: ("family", F.abs(F.col("rate") - F.col("c") * 1e5 / F.col("pop")) > 0.01, at, None), 6: ("series", F.abs(F.col("rate") - F.col("own")) > 1, at, (F.col("cut") == 4) & (F.col("year") == REFERENCE)),
          7: ("counts", F.abs(F.col("rate") - F.col("c") * 1e5 / F.col("pop")) > 0.5, F.col("cut"), None), 8: ("units", F.coalesce("c", F.lit(0)) == 0, F.col("cut"), None), 9: ("means", F.abs(F.col("a") - F.col("b")) > 1e-6, F.col("region"), None), 10: ("series", ~F.col("rate").between(0, 100_000), at, None)}
    rules = [C.Rule(n, name, on[n][0], on[n][1], on[n][2], on[n][3], severity) for n, name, severity in _RULED]
    return C.report(inputs, rules).select("n", "name", "status", "checked", "broken", F.array_join("evidence", " ").alias("evidence"))
