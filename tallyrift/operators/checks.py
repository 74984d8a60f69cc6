"""Rules over tables as rows: how many rows each was checked on, how many broke it, and some that did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are shown as evidence for a rule.
SHOWN = 20


@dataclass(frozen=True)
class Rule:
    """``broken`` for the rows of the input ``on`` to which it ``applies``; null breaks it. ``severity`` is the status that broken
    rows give: FAIL, or DOCUMENTED where they are known and explained by ``note``."""

    n: int
    name: str
    on: str
    broken: Column
    evidence: Column
    applies: Column | None = None
    severity: str = "FAIL"
    note: str = ""


def _told(inputs: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(n, broken, evidence): a row for each rule and row that it applies to; all rules of an input in one scan."""
    parts = []
    for name, df in inputs.items():
        cells = [F.when(F.lit(True) if r.applies is None else r.applies, F.struct(F.lit(r.n).alias("n"), F.coalesce(r.broken, F.lit(True)).alias("broken"), r.evidence.cast("string").alias("evidence"))) for r in rules if r.on == name]
        if cells:
            parts.append(df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def violations(inputs: Mapping[str, DataFrame], rules: Sequence[Rule], most: int = SHOWN) -> DataFrame:
    """(n, evidence) of the first ``most`` broken rows of each rule, by their evidence; only so many of a task are shuffled."""
    first = F.row_number().over(Window.partitionBy("n").orderBy("evidence"))
    return _told(inputs, rules).where("broken").withColumn("_at", first).where(F.col("_at") <= most).select("n", "evidence")


def report(inputs: Mapping[str, DataFrame], rules: Sequence[Rule], most: int = SHOWN) -> DataFrame:
    """(n, name, status, checked, broken, evidence, note), a row for each rule.

    PASS where no row broke it, the rule's severity where one did, DOCUMENTED where there was nothing to check.
    """
    unknown = {r.on for r in rules} - set(inputs)
    if unknown or len({r.n for r in rules}) < len(rules):
        raise ValueError(f"rules need their own numbers and known inputs; unknown: {sorted(unknown)}")
    spark = next(iter(inputs.values())).sparkSession
    table = spark.createDataFrame([(r.n, r.name, r.severity, r.note) for r in rules], "n int, name string, severity string, note string")
    counts = _told(inputs, rules).groupBy("n").agg(F.count(F.lit(1)).alias("checked"), F.count_if("broken").alias("broken"))
    shown = violations(inputs, rules, most).groupBy("n").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = table.join(counts, "n", "left").join(shown, "n", "left").select("n", "name", "severity", zero("checked"), zero("broken"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "note")
    status = F.when(F.col("checked") == 0, "DOCUMENTED").when(F.col("broken") == 0, "PASS").otherwise(F.col("severity"))
    return joined.withColumn("status", status).select("n", "name", "status", "checked", "broken", "evidence", "note")


def expected_found(rows: DataFrame, key: str, expected: Sequence[str]) -> DataFrame:
    """(key, expected, n): a row for each value that is expected or there, with its rows; null is no value."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(expected)], f"`{key}` string").withColumn("expected", F.lit(True))
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return found.join(wanted, key, "full").select(key, F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n"))


def recounted(published: DataFrame, count: str, parts: Sequence[DataFrame], row_id: str, bucket: str) -> DataFrame:
    """(bucket, published, counted): what was published for each bucket, and the different ids that the parts have there together.

    An id that several parts have counts once; buckets of one side only have null for the other. Rows without a bucket are left out.
    Ids are made distinct before they are counted, so a full bucket is dealt by its ids.
    """
    ids = reduce(DataFrame.unionByName, [p.select(bucket, row_id) for p in parts]).where(F.col(bucket).isNotNull()).distinct()
    counts = ids.groupBy(bucket).agg(F.count(F.lit(1)).alias("counted"))
    return published.select(bucket, F.col(count).alias("published")).where(F.col(bucket).isNotNull()).join(counts, bucket, "full").select(bucket, "published", "counted")
