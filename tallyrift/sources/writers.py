"""Writers: keyed tables, guarded CSV, JSON, payloads with a size limit, appends that keep what was first, gates."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.functions.scalars import csv_guard
from tallyrift.sources.readers import there


def partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def guarded_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns with a header; no cell starts a formula."""
    df.select(*(csv_guard(F.col(c).cast("string")).alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def payload(df: DataFrame, year: str, most: int = 35_840) -> DataFrame:
    """(year, json): each year's rows as one compact text without nulls; an error beyond ``most`` bytes.

    A year's rows are the units of one country; the limit itself bounds what is collected for it.
    """
    fields = [c for c in df.columns if c != year]
    out = df.groupBy(year).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("json"))
    checked = F.when(F.octet_length("json") <= most, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("payload too large: "), F.octet_length("json"))))
    return out.select(year, checked.alias("json"))


def append_first_seen(new: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't have yet."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the table isn't there before the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    rows = new.dropDuplicates([key])
    (rows if old is None else rows.join(old.select(key), key, "left_anti")).write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _renamed(fs, one, other) -> None:
    if not fs.rename(one, other):  # some file systems say no without an error
        raise OSError(f"{one} can't be renamed to {other}")


def moved(spark: SparkSession, staging: str, path: str) -> None:
    """Put what lies at ``staging`` in the place of ``path``. If that fails what was there comes back.

    Between the two renames there is nothing at the path for a moment; where readers must never meet that, use a
    ``committed.Committed`` table.
    """
    fs, new = _file_system(spark, staging)
    _, at = _file_system(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-old-{uuid.uuid4().hex}")
    had = fs.exists(at)
    if had:
        _renamed(fs, at, old)
    try:
        _renamed(fs, new, at)
    except Exception:
        if had:
            _renamed(fs, old, at)
        raise
    if had:
        fs.delete(old, True)


def whole(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Overwrite a table by way of a staging folder: a job that fails leaves what was there."""
    staging = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(staging)
    moved(df.sparkSession, staging, path)


def gated(df: DataFrame, path: str, passes: Callable[[DataFrame], bool]) -> bool:
    """Overwrite a table if what was written passes; else the last good one stays. Whether it did."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    if passes(spark.read.parquet(staging)):
        moved(spark, staging, path)
        return True
    fs, at = _file_system(spark, staging)
    fs.delete(at, True)
    return False


def keyed_json(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON for each key: key=.../part-*.json."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def one_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A single guarded CSV file with a byte order mark, as spreadsheets want it; for what is published, row by row."""
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        line, text = io.StringIO(), csv.writer
        writer = text(line, lineterminator="\n")
        writer.writerow(columns)
        out.write(bytearray(b"\xef\xbb\xbf"))
        for row in df.select(*(F.coalesce(csv_guard(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns)).toLocalIterator():
            writer.writerow(row)
            if line.tell() > 1 << 20:
                out.write(bytearray(line.getvalue().encode()))
                line.seek(0), line.truncate()
        out.write(bytearray(line.getvalue().encode()))
    finally:
        out.close()


def rewritten(df: DataFrame, path: str, by: str, column: str, now: Column) -> dict[str, int]:
    """Correct a column of a table in place; only partitions in which it changes are written. {changed, kept}."""
    spark = df.sparkSession
    told = df.withColumn("_now", now)
    changed = ~F.col(column).eqNullSafe(F.col("_now"))
    counts = told.agg(F.count_if(changed).alias("changed"), F.count_if(~changed).alias("kept")).first().asDict()
    if counts["changed"]:
        parts = told.where(changed).select(by).distinct()
        staging = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
        told.join(parts, by, "left_semi").withColumn(column, F.col("_now")).drop("_now").write.partitionBy(by).parquet(staging)
        partitions(spark.read.parquet(staging), path, [by])
        fs, at = _file_system(spark, staging)
        fs.delete(at, True)
    return counts


def filled(rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], size: int = 10, failures: int = 3) -> int:
    """Work through the rows that ``path`` doesn't have yet, ``size`` at a time in the order of their key, each lot appended
    as it is done; a lot that fails is tried once more, and after ``failures`` lots in a row it is given up. How many were
    done: a run that ended early goes on where it was. ``size`` grows with what a cluster does at once.
    """
    spark, done, bad, after = rows.sparkSession, 0, 0, None
    while True:
        todo = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if there(spark, path) else rows
        lot = (todo if after is None else todo.where(F.col(key) > after)).orderBy(key).limit(size).cache()
        last = lot.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("k")).first()
        try:
            if not last["n"]:
                return done
            for attempt in (0, 1):
                try:
                    work(lot).write.mode("append").parquet(path)
                    done, bad = done + last["n"], 0
                    break
                except Exception:  # noqa: BLE001  a lot's failure is its own
                    if attempt:
                        bad, after = bad + 1, last["k"]
            if bad >= failures:
                raise RuntimeError(f"{failures} lots in a row failed, the last at {last['k']}")
        finally:
            lot.unpersist()


def state_snapshot(state: DataFrame, folder: str, day: str) -> None:
    """``state``, one row, as <folder>/corpus-state.json and as the day's <folder>/corpus-state-history/<day>.json; a day that
    comes again is written anew, other days stay. Both files are one object and are put in their places whole."""
    spark = state.sparkSession
    rows = state.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError(f"a state is one row, not {len(rows)} or more")
    for name in ("corpus-state.json", f"corpus-state-history/{day}.json"):
        fs, aside = _file_system(spark, f"{folder}/{name}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(rows[0].encode()))
        finally:
            out.close()
        _, at = _file_system(spark, f"{folder}/{name}")
        if fs.exists(at):
            fs.delete(at, False)
        _renamed(fs, aside, at)
