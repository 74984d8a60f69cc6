"""What is published: prose from tables of templates, JSON-LD, address pairs, payload rows, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X


def _pieces(template: Column) -> Column:
    """(key, text) of each piece of a template: the key that stands before the text, null where there is none."""
    def piece(p: Column, i: Column) -> Column:
        key = F.when(i > 0, F.nullif(F.regexp_extract(p, r"^(\w+)\}", 1), F.lit("")))
        text = F.when(i == 0, p).when(key.isNull(), F.concat(F.lit("{"), p)).otherwise(F.substring(p, F.length(key) + 2, F.length(p)))
        return F.struct(key.alias("key"), text.alias("text"))
    return F.transform(F.split(template, r"\{"), piece)


def _joined(pieces: Column, values: Column) -> Column:
    """The pieces with the map's values for their keys; keys that the map doesn't have stay."""
    said = lambda p: F.coalesce(F.element_at(values, p["key"]), F.concat(F.lit("{"), p["key"], F.lit("}")), F.lit(""))
    return F.array_join(F.transform(pieces, lambda p: F.concat(said(p), p["text"])), "")


def filled(template: Column, values: Column) -> Column:
    """The template with each {key} replaced by the map's value; keys that the map doesn't have stay."""
    return _joined(_pieces(template), values)


def prose(facts: DataFrame, key: str, templates: DataFrame, choices: Sequence[str], values: str) -> DataFrame:
    """(key, text): the paragraphs of each row's facts, in the order of ``place``, parted by empty lines.

    ``templates`` (place, choice, template): of each place the template whose choice is one of the row's ``choices``
    columns' values, or that without a choice; a place whose template isn't chosen has no paragraph. ``values`` is a map
    column. The texts are data: what a language or a site says stays out of this code. Templates are cut into their
    pieces and grouped by choice once, not for each row.
    """
    said = F.array(*(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in choices))
    cut = F.collect_list(F.struct("place", "choice", "template", _pieces(F.col("template")).alias("pieces"))).alias("own")
    by_choice = templates.groupBy("choice").agg(cut)
    chosen = F.map_from_entries(F.collect_list(F.when(F.col("choice").isNotNull(), F.struct("choice", "own")))).alias("_chosen")
    bank = by_choice.agg(chosen, F.flatten(F.collect_list(F.when(F.col("choice").isNull(), F.col("own")))).alias("_always"))
    rows = facts.withColumn("_said", F.array_distinct(F.array_compact(said))).join(F.broadcast(bank))
    own = F.flatten(F.array_compact(F.transform("_said", lambda c: F.element_at("_chosen", c))))
    taken = F.array_sort(F.concat("_always", own))
    return rows.select(key, F.array_join(F.transform(taken, lambda t: _joined(t["pieces"], F.col(values))), "\n\n").alias("text"))


def change_word(now: Column, first: Column, words: tuple[str, str, str], threshold: float = 5.0) -> Column:
    """Increased, decreased or stable over a series; a start of 0 is stable."""
    pct = F.when(first > 0, (now - first) * 100 / first).otherwise(0.0)
    return F.when(pct > threshold, words[0]).when(pct < -threshold, words[1]).otherwise(words[2])


def item_list(rows: DataFrame, group: str, place: str, name: str, url: Column, title: Column) -> DataFrame:
    """(group, json): a schema.org list of each group's rows, places from 1 on; the title must be neutral."""
    item = F.struct(F.col(place).alias("position"), F.lit("ListItem").alias("@type"), F.col(name).alias("name"), url.alias("url"))
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), X.neutral_name(title).alias("name"), F.size("items").alias("numberOfItems"), F.col("items").alias("itemListElement"))
    return lists.select(group, F.to_json(body).alias("json"))


def breadcrumb(rows: DataFrame, page: str, place: str, name: str, url: str) -> DataFrame:
    """(page, json): a schema.org list of each page's crumbs in order, numbered from 1 on; one without an address has no item."""
    ordered = rows.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("_p"), F.col(name).alias("name"), F.col(url).alias("item")))).alias("_all"))
    items = F.transform("_all", lambda c, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), c["name"].alias("name"), c["item"].alias("item")))
    return ordered.select(page, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))).alias("json"))


def address_pair(kind: tuple[str, str], slug: Column) -> Column:
    """(en, es): the addresses of a page in both languages."""
    return F.struct(F.concat(F.lit(f"/{kind[0]}/"), slug, F.lit("/")).alias("en"), F.concat(F.lit(f"/es/{kind[1]}/"), slug, F.lit("/")).alias("es"))


def on_sitemap(url: Column, enabled: DataFrame | Sequence[str]) -> Column:
    """Pages of units only if they are released; all others."""
    slug = F.regexp_extract(url, r"/(?:commune|comuna)/([^/]+)/", 1)
    return (slug == "") | slug.isin(*enabled)


def incident(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with their id; those whose address isn't http or https go."""
    return rows.where(X.safe_scheme(F.col(url))).withColumn("id", X.url_id(F.col(url)))


def seen_pruned(seen: DataFrame, date: str, today: Column, days: int = 60) -> DataFrame:
    """What was seen in the last ``days`` days, the first of them too; dates that aren't any count as 1970."""
    return seen.where(X.date_or(F.col(date), F.lit("1970-01-01").cast("date")) >= F.date_sub(today, days))


def cumulative(runs: DataFrame, order: str, calls: str, start: int = 0) -> DataFrame:
    """``runs`` with ``total``, the calls up to each. A log of runs is short: a row for each time that somebody ran it."""
    from pyspark.sql import Window

    return runs.withColumn("total", F.sum(calls).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + start)


def within_budget(runs: DataFrame, order: str, projected: int, most: int) -> int:
    """The total after the last run, if ``projected`` calls more stay within ``most``; else an error."""
    last = runs.agg(F.max_by("total", order).alias("t")).first()["t"] or 0
    if last + projected > most:
        raise ValueError(f"{last} calls made and {projected} to come are more than {most}")
    return last


def checks(results: Sequence[tuple[int, str, DataFrame, Column, Column]]) -> DataFrame:
    """(n, name, status, evidence) of checks (n, name, one row, whether it passes, its evidence); null is DOCUMENTED."""
    out = None
    for n, name, row, ok, evidence in results:
        status = F.when(ok.isNull(), "DOCUMENTED").when(ok, "PASS").otherwise("FAIL")
        part = row.select(F.lit(n).alias("n"), F.lit(name).alias("name"), status.alias("status"), evidence.cast("string").alias("evidence"))
        out = part if out is None else out.unionByName(part)
    return out


def report(results: DataFrame, human: str = "") -> str:
    """Checks as a Markdown table; what a person wrote stays below it."""
    rows = results.orderBy("n").collect()
    lines = ["| # | check | status | evidence |", "|-|-|-|-|", *(f"| {r['n']} | {r['name']} | {r['status']} | {r['evidence']} |" for r in rows)]
    return "\n".join([*lines, "", "<!-- human -->", human.strip(), ""])
