"""Event feeds: facets, calendars, ledgers, merges, near-duplicate titles, clusters, gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.operators.ordering import numbered


def facet_counts(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, key, n) of each dimension in one pass, by grouping sets."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions)))
    return rows.select(pairs.alias("_p")).select("_p.*").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def self_excluding_counts(rows: DataFrame, active: Mapping[str, Iterable], text: Column | None = None) -> DataFrame:
    """(dimension, key, n): each dimension is counted under the filters of all others but its own; ``text`` always holds.

    One pass: a row is expanded to the dimensions whose other filters it passes. Keys without rows count 0.
    """
    passes = {d: F.col(d).isin(*keys) if keys else F.lit(True) for d, keys in active.items()}
    base = rows if text is None else rows.where(text)
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key"),
                      _all(F.coalesce(p, F.lit(False)) for o, p in passes.items() if o != d).alias("ok")) for d in active]
    counted = base.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return counted.groupBy("dimension", "key").agg(F.count_if("ok").alias("n"))


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def window_counts(rows: DataFrame, date: str, spans: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """How many rows lie in the last days before the newest date, that one included."""
    newest = rows.agg(F.max(date).alias("_newest"))
    tagged = rows.join(F.broadcast(newest))
    return tagged.agg(*(F.count_if(F.col(date) >= F.date_sub("_newest", s - 1)).alias(f"last_{s}") for s in spans))


def window_tag(date: Column, newest: Column) -> Column:
    return F.when(date == newest, "today").when(date >= F.date_sub(newest, 6), "7d").when(date >= F.date_sub(newest, 29), "30d").otherwise("older")


def day_histogram(rows: DataFrame, date: str, width: int = 30) -> DataFrame:
    """(day, n, pct of the fullest) for each of the last ``width`` days, those without rows too."""
    days = rows.agg(F.max(date).alias("_newest")).select(F.explode(F.sequence(F.date_sub("_newest", width - 1), "_newest")).alias("day"))
    counts = rows.groupBy(F.col(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    full = days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("pct", F.coalesce(F.col("n") * 100.0 / F.nullif(F.max("n").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))


def peak(buckets: DataFrame) -> DataFrame:
    """The fullest bucket, the earliest on a tie; none if all are empty."""
    return buckets.where("n > 0").orderBy(F.desc("n"), "day").limit(1)


def first_wins(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Union in which an earlier part's row of a key beats a later one's; within a part the smallest ``order`` does."""
    union = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        union = p if union is None else union.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_part", order)
    return union.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_part")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def pending(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows that the ledger doesn't have, or has as pending or failed."""
    done = ledger.where(~F.col("status").isin("pending", "failed")).select(key)
    return rows.join(done, key, "left_anti")


def ledger_upsert(ledger: DataFrame, outcomes: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, status, attempts): fetched rows never change, an outcome adds an attempt, ``most`` failures are final."""
    new = outcomes.select(F.col(key).alias("_key"), F.col("status").alias("_new"))
    both = ledger.join(new, F.col(key) == F.col("_key"), "full_outer")
    had = F.coalesce("attempts", F.lit(0))
    fixed = F.coalesce(F.col("status").isin("fetched", "permanent_failure"), F.lit(False)) | F.col("_new").isNull()
    attempts = F.when(fixed, had).otherwise(had + 1)
    status = F.when(fixed, F.col("status")).when((F.col("_new") == "failed") & (had + 1 >= most), "permanent_failure").otherwise(F.col("_new"))
    return both.select(F.coalesce(key, "_key").alias(key), status.alias("status"), attempts.cast("long").alias("attempts"))


def split_by_age(rows: DataFrame, date: str, today: Column, days: int = 30) -> DataFrame:
    """``slot``: current, or the month of an aged row; rows with malformed dates stay current."""
    d = F.when(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date"))
    return rows.withColumn("slot", F.when(d.isNull() | (d >= F.date_sub(today, days)), "current").otherwise(F.date_format(d, "yyyy-MM")))


def digest(rows: DataFrame, value: str, by: Sequence[str] = (), sep: str = "\n") -> DataFrame:
    """SHA-256 of the values in order, whatever the rows' order."""
    joined = F.array_join(F.array_sort(F.collect_list(value)), sep)
    return rows.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def digest_ranges(rows: DataFrame, value: str, by: Sequence[str] = (), sep: str = "\n", prefix: int = 2) -> DataFrame:
    """SHA-256 over the digests, in order, of the ranges of hexadecimal hashes with equal first ``prefix`` digits, each
    that of its hashes in order. No row holds more than a range; the longer the prefix, the smaller ranges are."""
    parts = digest(rows.withColumn("_range", F.substring(value, 1, prefix)), value, [*by, "_range"], sep)
    told = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_range", "digest"))).alias("x"), F.sum("n").alias("n"))
    return told.select(*by, F.sha2(F.array_join(F.col("x.digest"), sep), 256).alias("digest"), "n")


def block_pairs(rows: DataFrame, block: Sequence[str], order: str) -> DataFrame:
    """All pairs a before b of a block, as the reference queries ask for them; blocks are small by their keys."""
    b = rows.select(*block, *(F.col(c).alias(f"{c}_b") for c in rows.columns if c not in block))
    a = rows.select(*block, *(F.col(c).alias(f"{c}_a") for c in rows.columns if c not in block))
    return a.join(b, list(block)).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def pair_metrics(pairs: DataFrame, truth: Column, proposed: Column, accepted: Column) -> DataFrame:
    """Confusion counts, precision and recall; the latter two null on a zero denominator."""
    tp, fp = F.count_if(truth & proposed & accepted), F.count_if(~truth & proposed & accepted)
    missed, refused = F.count_if(truth & ~proposed), F.count_if(truth & proposed & ~accepted)
    tn = F.count_if(~truth & ~(proposed & accepted))
    out = pairs.agg(tp.alias("tp"), fp.alias("fp"), missed.alias("fn_prefiltered"), refused.alias("fn_rejected"), tn.alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn_prefiltered") + F.col("fn_rejected"))})


def nearest(rows: DataFrame, unit: str, within: str, value: str, n: int, least: int = 0, digits: int = 6) -> DataFrame:
    """(unit, other, gap, place): the n closest of the same group by value, the smaller unit on a tie.

    Values count to ``digits`` places; rows without one are left out. The n nearest of a row are among its own value and
    the n distinct ones on either side, and of each the n smallest units other than it: values meet by their places in
    order, which no task sorts as a whole. A unit whose group has fewer than ``least`` others is compared with those of
    all groups.
    """
    rows = rows.where(F.col(value).isNotNull()).select(unit, F.col(within).alias("_pool"), F.round(value, digits).alias(value))
    if not least:
        return _nearest(rows, rows, unit, value, n, digits)
    others = rows.groupBy("_pool").agg((F.count(F.lit(1)) - 1).alias("_others"))
    if others.where(F.col("_others") < least).isEmpty():  # all are compared in their own groups: no order of them all
        return _nearest(rows, rows, unit, value, n, digits)
    sized = rows.join(others, "_pool")
    own = _nearest(sized.where(F.col("_others") >= least).drop("_others"), rows, unit, value, n, digits)
    all_ = F.lit(0).alias("_pool")
    lone = sized.where(F.col("_others") < least).select(unit, all_, value)
    return own.unionByName(_nearest(lone, rows.select(unit, all_, value), unit, value, n, digits))


def _nearest(asking: DataFrame, rows: DataFrame, unit: str, value: str, n: int, digits: int) -> DataFrame:
    smallest = F.row_number().over(Window.partitionBy("_pool", value).orderBy(unit))
    tops = rows.withColumn("_n", smallest).where(F.col("_n") <= n + 1).groupBy("_pool", value).agg(F.array_sort(F.collect_list(unit)).alias("_units"))
    placed, _ = numbered(tops, "_at", value, within=["_pool"])  # values are distinct in their pool
    near = placed.select("_pool", F.explode(F.sequence(F.col("_at") - n, F.col("_at") + n)).alias("_at"), F.col(value).alias("_own"))
    around = near.join(placed, ["_pool", "_at"]).select("_pool", F.col("_own").alias(value), F.col(value).alias("_v"), "_units")
    cut = asking.join(around, ["_pool", value]).select(unit, value, "_v", F.explode("_units").alias("other")).where(F.col("other") != F.col(unit))
    gaps = cut.select(unit, "other", F.round(F.abs(F.col("_v") - F.col(value)), digits).alias("gap"))
    placed = gaps.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy("gap", "other")).cast("long"))
    return placed.where(F.col("place") <= n)


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass; null breaks it."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), (~F.coalesce(c, F.lit(False))).alias("bad")) for k, c in rules.items())))
    return rows.select(pairs.alias("p")).groupBy("p.rule").agg(F.count_if("p.bad").alias("n"))
