"""Readers: statistic tables in HTML, RSS, JSON envelopes, ledgers, delimited files, sheets. All of them read through Spark.

A file that isn't there is an empty table for those sources that may not exist yet: feeds, envelopes, ledgers.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class _Tables(HTMLParser):
    """Rows of each table: (class of the row, texts of its cells)."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[tuple[str, list[str]]]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append((dict(attrs).get("class") or "", []))
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1][1].append("")
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.tables[-1][-1][1][-1] += data


def stat_rows(html: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(name, class, year, text) of a page's last table. Its header is the first row with a four-digit cell; rows
    before it and rows without any value are labels."""
    page = _Tables()
    page.feed(html or "")
    years: list[str] | None = None
    for kind, cells in page.tables[-1] if page.tables else ():
        cells = [c.strip() for c in cells]
        if years is None:
            if any(len(c) == 4 and c.isdigit() for c in cells):
                years = cells[1:]
            continue
        if len(cells) > 1 and any(cells[1:]):
            for year, text in zip(years, cells[1:], strict=False):
                if len(year) == 4 and year.isdigit():
                    yield cells[0], kind, year, text


@udtf(returnType="name string, css_class string, year string, raw string")
class StatTable:
    """stat_rows as a table function: FROM t, LATERAL stat_table(t.html)."""

    def eval(self, html: str):
        yield from stat_rows(html)


def register(spark: SparkSession) -> None:
    spark.udtf.register("stat_table", StatTable)


def there(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def rss(spark: SparkSession, path: str, outlet: str) -> DataFrame:
    """(title, link, description, pubDate, outlet) of each item; a feed that isn't there or isn't readable has none."""
    schema = "title string, link string, description string, pubDate string"
    if not there(spark, path):
        return spark.createDataFrame([], f"{schema}, outlet string")
    rows = spark.read.schema(f"{schema}, _bad string").option("rowTag", "item").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").format("xml").load(path)
    return rows.where("_bad IS NULL").drop("_bad").withColumn("outlet", F.lit(outlet))


# The feeds, and the queries of those that are searches.
FEEDS = {"BioBioChile": "https://www.biobiochile.cl/static/feed-rss", "Cooperativa": "https://www.cooperativa.cl/noticias/site/tax/port/all/rss_3_158__1.xml",
         "LaTercera": "https://www.latercera.com/arc/outboundfeeds/rss/?outputType=xml", "LaCuarta": "https://www.lacuarta.com/arc/outboundfeeds/rss/?outputType=xml"}
SEARCHES = {"GoogleNews-Nacional": 'homicidio OR balacera OR portonazo OR "crimen organizado" chile when:2d',
            "GoogleNews-Antofagasta": "(homicidio OR balacera OR robo OR portonazo) (Antofagasta OR Calama OR Tocopilla) when:3d",
            "GoogleNews-Tarapaca": '(homicidio OR balacera OR robo) (Iquique OR "Alto Hospicio" OR Tarapaca) when:3d',
            "GoogleNews-Coquimbo": '(homicidio OR balacera OR robo) ("La Serena" OR Coquimbo OR Ovalle) when:3d',
            "GoogleNews-Araucania": "(homicidio OR balacera OR robo OR atentado) (Temuco OR Araucania OR Angol) when:3d"}
SEARCH_BASE, SEARCH_TAIL = "https://news.google.com/rss/search?q=", "&hl=es-419&gl=CL&ceid=CL:es-419"


def feeds(spark: SparkSession) -> DataFrame:
    """(feed, url): the registry, with the addresses of the searches made from their queries."""
    plain = spark.createDataFrame(list(FEEDS.items()), "feed string, url string")
    asked = spark.createDataFrame(list(SEARCHES.items()), "feed string, query string")
    return plain.unionByName(asked.select("feed", F.concat(search_feed(SEARCH_BASE, F.col("query")), F.lit(SEARCH_TAIL)).alias("url")))


def search_feed(base: str, query: Column) -> Column:
    """A search address; spaces as %20."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))


def envelope(spark: SparkSession, path: str, item: str, field: str = "incidents") -> DataFrame:
    """The items of {field: [...]} files; a missing file or a malformed one has none."""
    if not there(spark, path):
        return spark.createDataFrame([], f"{item}, file string")
    raw = spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).option("ignoreMissingFiles", True).json(path)
    return raw.select(F.explode(field).alias("x"), F.col("_metadata.file_name").alias("file")).select("x.*", "file")


def ledger(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines; bad ones and those without a key are skipped, the last row of a key stays. A missing file has none."""
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x"))
    return last.select("x.*")


def sniffed(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter): UTF-8 if it is, else Latin-1; of ; , tab and | the one that the header has most of."""
    try:
        text, encoding = head.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        text, encoding = head.decode("latin-1"), "ISO-8859-1"
    header = text.split("\n", 1)[0]
    return encoding, max(";,\t|", key=header.count)


def delimited(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited file with the first of each column's aliases that it has, whatever its case; keys stay text.

    Where they aren't given, the separator is that which the first line has most of, and the encoding UTF-8 if every line
    of the file is, else Latin-1: lines are tested where they lie, and the first bad one ends the search.
    """
    lines = spark.read.text(path)
    if sep is None:
        head = lines.select(F.col("value").cast("binary").alias("b")).first()
        sep = sniffed(bytes(head["b"]) if head else b"")[1]
    if encoding is None:
        encoding = "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    have = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}
    found = {name: next((have[a.lower()] for a in names if a.lower() in have), None) for name, names in aliases.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"{path} has no column for {missing}")
    return raw.select(*(F.col(f"`{c}`").alias(name) for name, c in found.items()))


def code(x: Column) -> Column:
    """A key without a decimal part and leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"\.0$", ""), "^0+(?=.)", "")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of JSON texts, each an object with id and name."""
    raw = spark.read.text(path, wholetext=True)
    texts = raw.select(F.explode(F.from_json("value", "array<string>")).alias("t"))
    return texts.select(F.from_json("t", "id string, name string").alias("x")).select("x.*")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A binary file's row, if its content has the digest; else an error."""
    rows = spark.read.format("binaryFile").load(path)
    ok = F.sha2("content", 256) == sha256
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).isNull()))


def token_url(token: Column) -> Column:
    """The one http address inside a base64url token, or null where there is none or are several."""
    text = F.decode(F.unbase64(F.translate(token, "-_", "+/")), "ISO-8859-1")
    urls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[\x21-\x7E]+"), F.lit(0)))
    return F.when(F.size(urls) == 1, F.get(urls, 0))


def at_year(rows: DataFrame, year: int, column: str = "year") -> DataFrame:
    """The rows of a year; an error where there are none, rather than an empty table."""
    if rows.where(F.col(column) == year).isEmpty():
        years = sorted(r[0] for r in rows.select(column).distinct().limit(100).collect())
        raise ValueError(f"no rows of {year}; there are {years}")
    return rows.where(F.col(column) == year)


def months(spark: SparkSession, folder: str, item: str, field: str = "incidents") -> DataFrame:
    """The items of a folder's monthly files, with their month; files that aren't called YYYY-MM.json don't count, and
    items without an id get one of their file and place."""
    path = f"{folder.rstrip('/')}/*.json"
    if not there(spark, path):
        return spark.createDataFrame([], f"{item}, month string")
    raw = spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).json(path)
    named = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2})\.json$", 1).alias("month"), F.posexplode(field).alias("n", "x")).where("month != ''")
    return named.select("x.*", "month", "n").withColumn("id", F.coalesce("id", F.concat_ws("-", "month", "n"))).drop("n")


def seen(spark: SparkSession, path: str) -> DataFrame:
    """(url, date) of a ledger {url: date}; a missing or malformed one is empty."""
    if not there(spark, path):
        return spark.createDataFrame([], "url string, date string")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("url", "date"))


def released(spark: SparkSession, path: str, everything: DataFrame, unit: str = "cut", switch: str = "ROLLOUT_ALL") -> DataFrame:
    """The units that {enabled: [...]} lists, or all of them where the environment says so."""
    if os.environ.get(switch) == "true":
        return everything.select(unit)
    return spark.read.schema("enabled array<string>").option("multiLine", True).json(path).select(F.explode("enabled").alias(unit))


def enabled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """one-vs-other of the enabled pairs of a file of pairs."""
    raw = spark.read.schema("cutA string, cutB string, enabled boolean").option("multiLine", True).json(path)
    return raw.where("enabled").select(F.concat_ws("-vs-", "cutA", "cutB").alias("pair"))


def features(spark: SparkSession, path: str, ids: Sequence[str] = ("id",)) -> DataFrame:
    """(ids, shape) of a GeoJSON file: the outer rings of polygons, one or many; other geometries have none."""
    ring = "array<array<double>>"
    schema = f"features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    many = F.from_json("f.geometry.coordinates", f"array<array<{ring}>>")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    outer = F.when(F.col("f.geometry.type") == "Polygon", F.slice(one, 1, 1)).when(F.col("f.geometry.type") == "MultiPolygon", F.transform(many, lambda p: p[0]))
    return rows.select(*(F.element_at("f.properties", i).alias(i) for i in ids), F.transform(outer, lambda r: F.transform(r, point)).alias("shape"))


def _sheet(content: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row's number from 1 on, its cells as text by place) of a sheet of an Office Open XML workbook."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = {s.get("name"): s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet {sheet}; there are {sorted(names)}")
        shared = ["".join(t.text or "" for t in i.iter(f"{main}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open("xl/" + links[names[sheet]].removeprefix("/xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{main}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{main}c"):
                    at = 0
                    for letter in re.match("[A-Z]+", c.get("r"))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (at - len(cells))
                    said = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else c.findtext(f"{main}v")
                    cells[at - 1] = shared[int(said)] if c.get("t") == "s" and said is not None else said
                yield int(row.get("r")), cells
                row.clear()


def sheets(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(path, n, cells) of the rows of a sheet of each workbook; a task reads a workbook. Its binary kind isn't read."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for at, content in zip(files["path"], files["content"], strict=True):
                found = list(_sheet(bytes(content), sheet))
                yield pd.DataFrame({"path": at, "n": [n for n, _ in found], "cells": [c for _, c in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, n int, cells array<string>")


def headed(rows: DataFrame, header: int, columns: Mapping[str, str | int], required: Sequence[str]) -> DataFrame:
    """The rows below a header row, with named columns: by the header's normalised text or by place from 0 on; rows without
    a required one go. An error where the header lacks a column."""
    from tallyrift.functions.scalars import norm

    head = rows.where(F.col("n") == header).select(F.transform("cells", lambda c: F.trim(norm(c))).alias("h")).first()
    names = list(head["h"]) if head else []
    place = {k: v if isinstance(v, int) else names.index(v) if v in names else None for k, v in columns.items()}
    if missing := [k for k, v in place.items() if v is None]:
        raise ValueError(f"the header {names} has no column for {missing}")
    out = rows.where(F.col("n") > header).select(*(F.nullif(F.trim(F.get("cells", v)), F.lit("")).alias(k) for k, v in place.items()))
    return out.dropna(subset=list(required))


# Kidnappings that are only published in print; null is a count that isn't.
KIDNAPPINGS = [("Nacional", 2023, 850), ("Nacional", 2024, 868), ("RM Sur (Fiscalia)", 2024, None), ("RM Centro Norte (Fiscalia)", 2024, None), ("Valparaiso (Fiscalia)", 2024, None)]


def kidnappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KIDNAPPINGS, "region string, year int, secuestros int")


class Tables:
    """Tables by name, read once: the index of units, the catalog, a region's or a unit's series."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.known = spark, folder.rstrip("/"), {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.known[name]

    def year(self, name: str, year: int, column: str = "year") -> DataFrame:
        """The rows of a year; of a table that is partitioned by it no others are read."""
        return self(name).where(F.col(column) == year)


def probed(pages: DataFrame, page: str, html: str, pattern: str, first: int, last: int) -> DataFrame:
    """(code, pages): the numbers from ``first`` to ``last`` that the pattern's group finds in pages, and in how many."""
    found = pages.select(page, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1))).alias("code")).withColumn("code", F.col("code").try_cast("int"))
    return found.where(F.col("code").between(first, last)).groupBy("code").agg(F.count_distinct(page).alias("pages"))
