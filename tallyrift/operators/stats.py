"""Roll-ups, ranks, trends, bands and the composite index over rate tables.

Tables are long: (unit, region, population, low, year, family, rate). Every ranking takes a tie-breaking column, as an
order by the value alone is not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.operators.ordering import at_places, numbered


def total_rate(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of the families' rates, 0 if all are null.

    They are added one by one, the smallest first: a sum of doubles in the order of arrival, or of partial sums, differs in its last
    bit from run to run, and so does what is rounded or compared from it.
    """
    one_by_one = F.aggregate(F.array_sort(F.collect_list("rate")), F.lit(0.0), lambda total, x: total + x)
    return rates.groupBy(*keys).agg(one_by_one.alias("rate"))


def weighted_mean(rows: DataFrame, keys: Sequence[str], value: str = "rate", weight: str = "pop") -> DataFrame:
    """By population. A null rate counts as 0 with its weight; weights of 0 or less don't count."""
    kept = rows.where(F.col(weight) > 0)
    w = F.sum(weight)
    return kept.groupBy(*keys).agg((F.sum(F.coalesce(value, F.lit(0.0)) * F.col(weight)) / w).alias(value), F.bool_or("partial").alias("partial"))


def latest_complete(totals: DataFrame, unit: str = "cut") -> DataFrame:
    """Each unit's row of its last year that isn't partial."""
    w = Window.partitionBy(unit).orderBy(F.desc("year"))
    return totals.where(~F.col("partial")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def typical_mean(totals: DataFrame, by: str | None = None) -> DataFrame:
    """The plain mean of units at their own last complete years, low populations left out."""
    rows = latest_complete(totals).where(~F.col("low"))
    return rows.groupBy(*([by] if by else [])).agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("n"))


def at_year(totals: DataFrame, year: int, unit: str = "cut") -> DataFrame:
    """(unit, rate): at the year, else at the unit's most recent one, else 0."""
    return totals.groupBy(unit).agg(F.coalesce(F.max(F.when(F.col("year") == year, F.col("rate"))), F.max_by("rate", "year"), F.lit(0.0)).alias("rate"))


def rank(rows: DataFrame, out: str, by: str, tie: str, within: Sequence[str] = (), eligible: Column | None = None, descending: bool = True) -> DataFrame:
    """1..n without gaps or ties among the eligible, null for the others. By ranges, see ``ordering``: no group is one task's."""
    ok = F.coalesce(F.lit(True) if eligible is None else eligible, F.lit(False))
    told, _ = numbered(rows.withColumn("_ok", ok), out, by, tie, [*within, "_ok"], descending)
    return told.withColumn(out, F.when(F.col("_ok"), F.col(out))).drop("_ok")


def three_step_trend(totals: DataFrame, unit: str = "cut", threshold: float = 5.0) -> DataFrame:
    """(unit, trend): the last complete row against the fourth from last; fewer rows, or a start of 0, are stable."""
    w = Window.partitionBy(unit).orderBy("year")
    rows = totals.where(~F.col("partial")).withColumns({"_was": F.lag("rate", 3).over(w), "_last": F.lead("year").over(w).isNull()})
    change = (F.col("rate") - F.col("_was")) * 100 / F.nullif(F.col("_was"), F.lit(0.0))
    kind = F.when(change > threshold, "up").when(change < -threshold, "down").otherwise("stable")
    return rows.where("_last").select(unit, kind.alias("trend"))


def percentile_card(rank_: Column, n: Column) -> Column:
    share = F.floor((n - rank_) * 100.0 / n + 0.5)
    return F.least(F.greatest(share, F.lit(1)), F.lit(99)).cast("long")


# Bands. The seven rules differ in population and in what they do with ties; they aren't interchangeable.

def band_percentile(rows: DataFrame, value: str = "rate") -> DataFrame:
    """By the share of rows that are smaller: fifths, 1 to 5."""
    told, n = numbered(rows, "_rank", value)
    return told.withColumn("level", _fifths((F.col("_rank") - 1) / F.lit(max(n, 1))).cast("long")).drop("_rank")


def _fifths(p: Column) -> Column:
    return F.when(p >= 0.8, 5).when(p >= 0.6, 4).when(p >= 0.4, 3).when(p >= 0.2, 2).otherwise(1)


def band_quantile_cut(rows: DataFrame, value: str = "score") -> DataFrame:
    """By interpolated quintiles, closed on the right; all 3 if two edges fall together."""
    def places(n: int) -> list[int]:
        """The two values around each fifth."""
        return [p for i in range(6) for p in ((n - 1) * i // 5 + 1, min(n, (n - 1) * i // 5 + 2))]

    low = lambda i: F.col(f"_b{2 * i}")
    around = at_places(rows, value, places)
    n = rows.agg(F.count(value).alias("_n"))
    share = lambda i: ((F.col("_n") - 1) * i % 5) / 5
    edges = around.crossJoin(n).select(F.array(*(low(i) + (F.col(f"_b{2 * i + 1}") - low(i)) * share(i) for i in range(6))).alias("_e"))
    e = lambda i: F.get("_e", i)
    apart = F.size(F.array_distinct("_e")) == 6
    level = F.when(~apart, 3).when(F.col(value) <= e(1), 1).when(F.col(value) <= e(2), 2).when(F.col(value) <= e(3), 3).when(F.col(value) <= e(4), 4).otherwise(5)
    return rows.join(F.broadcast(edges)).withColumn("level", level.cast("long")).drop("_e")


def _positions(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row: the values at floor(n * share) in order."""
    return at_places(rows, value, lambda n: [min(n, int(n * s) + 1) for s in shares])


def band_by_position(rows: DataFrame, population: DataFrame, value: str = "rate") -> DataFrame:
    """x up to the value at floor(n * p) for p of .2, .4, .6 and .8 in the population; 3 where that is empty."""
    x, b = F.col(value), [F.col(f"_b{i}") for i in range(4)]
    level = F.when(b[0].isNull(), 3).when(x <= b[0], 1).when(x <= b[1], 2).when(x <= b[2], 3).when(x <= b[3], 4).otherwise(5)
    return rows.join(F.broadcast(_positions(population, value, (0.2, 0.4, 0.6, 0.8)))).withColumn("level", level.cast("long")).drop(*(f"_b{i}" for i in range(4)))


def band_own_maximum(totals: DataFrame, unit: str = "cut") -> DataFrame:
    """By the share of the unit's own largest rate."""
    share = F.col("rate") / F.nullif(F.max("rate").over(Window.partitionBy(unit)), F.lit(0.0))
    return totals.withColumn("level", F.coalesce(_fifths(share), F.lit(1)).cast("long"))


def level_breaks(rows: DataFrame, value: str = "rate") -> DataFrame:
    """(level, upper): the largest value of each level 1 to 5; an empty level carries the one before."""
    levels = rows.sparkSession.range(1, 6).withColumnRenamed("id", "level")
    top = rows.groupBy("level").agg(F.max(value).alias("top"))
    carried = F.last("top", ignorenulls=True).over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    return levels.join(F.broadcast(top), "level", "left").select("level", carried.alias("upper"))


def tier(rank_: Column, n: Column) -> Column:
    """Tenths and quarters of n ranks at either end; the cuts are rounded, halves upwards, and belong to their ends."""
    cut = lambda share: F.floor(n * share + 0.5)
    return F.when(rank_ <= cut(0.1), "top10").when(rank_ <= cut(0.25), "top25").when(rank_ >= cut(0.9), "bottom10").when(rank_ >= cut(0.75), "bottom25").otherwise("mid")


def comparison_band(signed_pct: Column) -> Column:
    """How far above or below a mean: by a fifth, by a half."""
    size, side = F.abs(signed_pct), F.when(signed_pct > 0, "above").otherwise("below")
    return F.when(size >= 50, F.concat(F.lit("high_"), side)).when(size >= 20, F.concat(F.lit("mid_"), side)).otherwise("near")


def histogram_p97(rows: DataFrame, value: str = "rate", bins: int = 24) -> DataFrame:
    """(bin, n, share of the fullest): equal widths from 0 to the positive value at floor(n * .97); larger ones in the last bin."""
    rows = rows.where(F.col(value) > 0)
    cap = _positions(rows, value, (0.97,)).select(F.col("_b0").alias("_cap"))
    at = F.least(F.lit(bins - 1), F.floor(F.col(value) / F.nullif(F.col("_cap"), F.lit(0.0)) * bins))
    counts = rows.join(F.broadcast(cap)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_ = rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return all_.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy()))


# The composite index.

def winsorised(rows: DataFrame, metric: str, out: str, share: float = 0.01) -> DataFrame:
    """0 to 100 between the (k+1)-th smallest and largest non-null values, k = int(share * n); null stays, a constant is 0."""
    edge = at_places(rows, metric, lambda n: [int(n * share) + 1, n - int(n * share)]).select(F.col("_b0").alias("_lo"), F.col("_b1").alias("_hi"))
    x = F.least(F.greatest(F.col(metric), F.col("_lo")), F.col("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) * 100 / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.join(F.broadcast(edge)).withColumn(out, F.when(F.col(metric).isNotNull(), scaled)).drop("_lo", "_hi")


def weighted_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score and n_metrics: the mean of the metrics there are, by their weights; 0 without any."""
    have = {m: F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()}
    total = sum(have.values(), F.lit(0.0))
    value = sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in have.items()), F.lit(0.0))
    return rows.withColumns({"score": F.when(total > 0, value / total).otherwise(0.0), "n_metrics": sum((F.col(m).isNotNull().cast("long") for m in weights), F.lit(0).cast("long"))})


def exposure_denominator(workers: Column, population: Column, cap: float = 5.0) -> Column:
    """(denominator, capped): workers, or the population where they are missing or more than cap to a head."""
    bad = population <= 0
    over = F.coalesce(~bad & (workers / population > cap), F.lit(False))
    return F.struct(F.when(bad | workers.isNull() | over, population).otherwise(workers).alias("denominator"), over.alias("capped"))
