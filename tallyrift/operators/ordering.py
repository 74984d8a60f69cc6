"""Places in one order over a whole table, without a task that sees the table.

Rows are dealt to ranges of values, whose bounds are approximate quantiles, and numbered in their ranges; a range starts
where the counts of those before it end. A value with a large share of the rows has a range of its own, and so have rows
without one: these are dealt further by the tie-breaking column, and without such a column they all have the range's
first place, which needs no order. Values at given places are found from counts of distinct values. What reaches the
driver are the bounds, RANGES at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.lineage import Scratch

#: Ranges at most, and rows from which on a further one is made.
RANGES, ROWS = 1024, 100_000


def _bounds(rows: DataFrame, key: Column, ranges: int, size: int) -> tuple[int, int, list[float]]:
    """(rows with a key, rows without, bounds); a bound that is there twice is a value of many rows."""
    got = rows.select(key.cast("double").alias("k")).agg(F.count("k").alias("n"), F.count(F.lit(1)).alias("all"), F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()
    n = got["n"]
    want = min(ranges, -(-n // size))
    return n, got["all"] - n, [got["q"][i * ranges // want - 1] for i in range(1, want)]


def _below(key: Column, bounds: Sequence[float]) -> Column:
    """How many of the bounds, in order, are smaller; found by way of every 32nd of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    some = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    at = F.size(F.filter(F.lit([s[0] for s in some]), lambda b: b < key)) - 1
    inner = F.size(F.filter(F.get(F.array(*(F.lit(s) for s in some)), F.greatest(at, F.lit(0))), lambda b: b < key))
    return F.when(at < 0, 0).otherwise(at * step + inner)


def numbered(rows: DataFrame, out: str, by: str, tie: str | None = None, within: Sequence[str] = (), descending: bool = False, ranges: int = RANGES, size: int = ROWS) -> tuple[DataFrame, int]:
    """(``rows`` with ``out``, how many of them have a value): the row's place from 1 on in the order of (by, tie), both
    numbers; without a tie-breaking column equal values have the same place, the first. Rows without a value come last.
    """
    key = F.col(by).cast("double") if not descending else -F.col(by).cast("double")
    n, without, bounds = _bounds(rows, key, ranges, size)
    order = [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), *([F.asc(tie)] if tie else [])]
    if not bounds and without <= size:
        place = (F.row_number() if tie else F.rank()).over(Window.partitionBy(*within).orderBy(*order)).cast("long")
        return rows.withColumn(out, place), n
    hot = sorted({b for b, c in zip(bounds, bounds[1:], strict=False) if b == c})
    cuts = sorted(set(bounds))
    many = key.isNull() | key.isin(*hot) if hot else key.isNull()
    part = F.when(key.isNull(), 2 * len(cuts) + 1).otherwise(2 * _below(key, cuts) + (key.isin(*hot).cast("int") if hot else 0))
    tied = F.lit(0)
    if tie and (hot or without > size):
        _, _, ties = _bounds(rows.where(many), F.col(tie), ranges, size)
        tied = F.when(many, _below(F.col(tie).cast("double"), sorted(set(ties)))).otherwise(0)
    own = [*within, "_part", "_tied"]
    dealt = rows.withColumns({"_part": part, "_tied": tied})
    place = (F.row_number() if tie else F.rank()).over(Window.partitionBy(*own).orderBy(*order)).cast("long")
    ranked = dealt.withColumn("_place", place) if tie else dealt.where(~many).withColumn("_place", place).unionByName(dealt.where(many).withColumn("_place", F.lit(1).cast("long")))
    counts = dealt.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part", "_tied").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = starts.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(own)), "_start")
    same = F.lit(True)
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    placed = ranked.join(renamed, same)
    return placed.withColumn(out, F.col("_start") + F.col("_place")).drop("_start", "_place", "_part", "_tied", *(f"_s{i}" for i in range(len(own)))), n


def at_places(rows: DataFrame, by: str, places, ranges: int = RANGES, size: int = ROWS) -> DataFrame:
    """One row (_b0, _b1, ...): the values at the places, from 1 on, that ``places`` gives for the number of values.

    Rows are counted by value first, so a value that half of them have is one row. ``rows`` are computed once.
    """
    kind = dict(rows.dtypes)[by]
    with Scratch(rows.sparkSession, "places") as scratch:
        counts = scratch.keep(rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
        n = counts.agg(F.sum("_n")).first()[0]
        wanted = places(n) if n else []
        found: list = [None] * len(wanted or places(1))
        if wanted:
            _, _, bounds = _bounds(counts, F.col("_v"), ranges, size)
            dealt = counts.withColumn("_part", _below(F.col("_v").cast("double"), sorted(set(bounds))))
            upto = lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            before = dealt.groupBy("_part").agg(F.sum("_n").alias("_n")).withColumn("_before", upto(Window.orderBy("_part")) - F.col("_n")).drop("_n")
            last = dealt.withColumn("_upto", upto(Window.partitionBy("_part").orderBy("_v"))).join(F.broadcast(before), "_part")  # RANGES rows at most
            at = F.col("_before") + F.col("_upto")
            found = list(last.agg(*(F.max(F.when((at >= p) & (at - F.col("_n") < p), F.col("_v"))).alias(f"_b{i}") for i, p in enumerate(wanted))).first())
        scratch.forget(counts)
    return rows.sparkSession.range(1).select(*(F.lit(v).cast(kind).alias(f"_b{i}") for i, v in enumerate(found)))
