"""Directories, ranking boards and search: predicates, orders, pages, and the statistics of a map's layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from re import fullmatch
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.functions.scalars import norm
from tallyrift.operators.events import window_tag
from tallyrift.operators.ordering import at_places
from tallyrift.operators.stats import rank

#: Spans of the date presets, in days, the newest one included.
WINDOWS = {"today": 1, "7d": 7, "30d": 30}


@dataclass(frozen=True)
class Filters:
    """What a feed's address asks for."""

    family: tuple[str, ...] = ()
    region: tuple[str, ...] = ()
    window: str = ""
    q: str = ""
    day: str = ""

    @classmethod
    def of(cls, search: str) -> Filters:
        """From ?a=b&c=d; windows and days that aren't any count as not given."""
        said = parse_qs(search.removeprefix("?"), keep_blank_values=True)
        one = lambda k: said.get(k, [""])[0]
        many = lambda k: tuple(v for v in one(k).split(",") if v)
        return cls(many("family"), many("region"), one("window") if one("window") in WINDOWS else "", one("q"), one("day") if fullmatch(r"\d{4}-\d{2}-\d{2}", one("day"), flags=256) else "")

    def address(self) -> str:
        """The query string, without ?, in a fixed order; what isn't given is left out."""
        pairs = (("family", ",".join(self.family)), ("region", ",".join(self.region)), ("window", self.window), ("q", self.q), ("day", self.day))
        return urlencode([(k, v) for k, v in pairs if v])

    def column(self, newest: Column, without: str | None = None, family: str = "family", region: str = "region", date: str = "date", name: str = "name") -> Column:
        """The predicate on rows; ``without`` leaves out one dimension, q always holds. A missing field fails an active filter."""
        parts = {"family": F.col(family).isin(*self.family) if self.family else None, "region": F.col(region).cast("string").isin(*self.region) if self.region else None,
                 "window": F.col(date) >= F.date_sub(newest, WINDOWS[self.window] - 1) if self.window else None, "day": F.date_format(date, "yyyy-MM-dd") == self.day if self.day else None}
        out = F.contains(norm(F.col(name)), norm(F.trim(F.lit(self.q)))) if self.q else F.lit(True)
        for k, c in parts.items():
            if c is not None and k != without:
                out = out & c
        return F.coalesce(out, F.lit(False))


def option_counts(rows: DataFrame, filters: Filters, options: Mapping[str, Sequence[str]], date: str = "date") -> DataFrame:
    """(dimension, key, n) of the options of family, region, window and day, each counted under all filters but its own's;
    0 for options without rows. One pass: a row tells for each dimension whether it passes the others and what it counts for.
    """
    newest = rows.agg(F.max(date).alias("_newest"))
    tag = window_tag(F.col(date), F.col("_newest"))
    windows = F.filter(F.array(F.when(tag == "today", "today"), F.when(tag.isin("today", "7d"), "7d"), F.when(tag != "older", "30d")), lambda x: x.isNotNull())
    keys = {"family": F.array("family"), "region": F.array(F.col("region").cast("string")), "window": windows, "day": F.array(F.date_format(date, "yyyy-MM-dd"))}
    cells = [F.struct(F.lit(d).alias("dimension"), filters.column(F.col("_newest"), d, date=date).alias("ok"), keys[d].alias("keys")) for d in options]
    said = rows.join(F.broadcast(newest)).select(F.explode(F.array(*cells)).alias("c")).select("c.dimension", "c.ok", F.explode("c.keys").alias("key"))
    counts = said.groupBy("dimension", "key").agg(F.count_if("ok").alias("n"))
    all_ = rows.sparkSession.createDataFrame([(d, k) for d, ks in options.items() for k in ks], "dimension string, key string")
    return all_.join(counts, ["dimension", "key"], "left").select("dimension", "key", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Board:
    """What a ranking board is asked for."""

    q: str = ""
    region: int | None = None
    level: int | None = None
    hide_low: bool = False
    scope: Sequence[str] = field(default=("q", "region", "level", "low"))

    def column(self, but: str | None = None) -> Column:
        parts = {"q": F.contains(norm(F.col("name")), norm(F.trim(F.lit(self.q)))) if self.q.strip() else F.lit(True), "region": F.col("region") == self.region if self.region is not None else F.lit(True),
                 "level": F.col("level") == self.level if self.level is not None else F.lit(True), "low": ~F.col("low") if self.hide_low else F.lit(True)}
        out = F.lit(True)
        for k, c in parts.items():
            if k != but and k in self.scope:
                out = out & c
        return out

    def hidden_by_low(self) -> Column:
        """Rows that only the rule on low populations hides."""
        return self.column("low") & F.col("low") if self.hide_low else F.lit(False)


def page(rows: DataFrame, order: Sequence[Column], n: int, size: int = 60) -> DataFrame:
    """The n-th page from 0 on."""
    return rows.orderBy(*order).offset(n * size).limit(size)


def blocks_in_order(rows: DataFrame, by: str, tie: str, out: str = "n", descending: bool = True) -> DataFrame:
    """Rows with ``out``, their place among the eligible and then the low populations, either sorted by ``by``."""
    told = rank(rows.withColumn("_low", F.col("low").cast("int")), "_at", by, tie, ["_low"], descending=descending)
    n = told.agg(F.count_if(F.col("_low") == 0).alias("_n"))
    return told.join(F.broadcast(n)).withColumn(out, F.col("_at") + F.when(F.col("_low") == 1, F.col("_n")).otherwise(0)).drop("_low", "_at", "_n")


def quantile_breaks(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """One row (_b0 ...): the positive values at floor(count * i / n), i from 1 to n - 1."""
    return at_places(rows.where(F.col(value) > 0), value, lambda m: [min(m, m * i // n + 1) for i in range(1, n)])


def level_by_breaks(x: Column, n: int = 5) -> Column:
    """1 to n by the breaks of ``quantile_breaks``; 1 where there are none."""
    out = F.when(F.col("_b0").isNull(), 1)
    for i in range(n - 1):
        out = out.when(x <= F.col(f"_b{i}"), i + 1)
    return out.otherwise(n).cast("long")


def layer_levels(rows: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """``rows`` with level and counted: of a layer of kind composite, homicide, family or total.

    A composite layer has levels of its own, 3 where there is none. Family and homicide layers have quantile breaks of the
    positive values; a homicide layer doesn't count the zeros in any band. A total layer has the levels it comes with.
    """
    if kind == "composite":
        return rows.withColumns({"level": F.coalesce(value, F.lit(3)).cast("long"), "counted": F.lit(True)})
    if kind == "total":
        return rows.withColumn("counted", F.lit(True))
    x = F.coalesce(value, F.lit(0.0))
    told = rows.join(F.broadcast(quantile_breaks(rows, value))).withColumn("level", level_by_breaks(x)).drop(*(f"_b{i}" for i in range(4)))
    return told.withColumn("counted", (x > 0) if kind == "homicide" else F.lit(True))


def layer_counts(rows: DataFrame) -> DataFrame:
    """(level, n) of levels 1 to 5, and level 0: the rows that no band counts."""
    levels = rows.sparkSession.range(6).withColumnRenamed("id", "level")
    n = rows.groupBy(F.when(F.col("counted"), F.col("level")).otherwise(0).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(F.broadcast(n), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def fill(level: Column, value: Column, palette: Sequence[str], isolated: int | None = None) -> Column:
    """(color, opacity) of a shape: faint for no value, fainter still outside of an isolated band."""
    color = F.element_at(F.array(*map(F.lit, palette)), F.coalesce(level, F.lit(3)).cast("int"))
    plain = F.when(value.isNull() | (value == 0), 0.35).otherwise(0.75)
    return F.struct(color.alias("color"), (plain if isolated is None else F.when(F.coalesce(level, F.lit(3)) == isolated, plain).otherwise(0.06)).alias("opacity"))
