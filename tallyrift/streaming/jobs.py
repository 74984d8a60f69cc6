"""The feed as a stream: rows seen once, a rolling window, and late rows sent to their month instead of dropped."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyrift.lineage import delete, shared_folder
from tallyrift.operators.events import first_wins, split_by_age
from tallyrift.sources.committed import Committed

#: Days that a key is remembered, the last one included.
REMEMBERED = 60


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, ``files`` of them a batch."""
    name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(name[0] + "/" + name[2] + "*")


def unique(rows: DataFrame, key: str, time: str, ttl: str = "60 days") -> DataFrame:
    """Rows whose key hasn't come within ``ttl``."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def run(rows: DataFrame, into: str, checkpoint: str) -> DataFrame:
    """Run a stream to the end of what is there, into a table."""
    q = rows.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(into)


def unseen(rows: DataFrame, key: str, time: str, seen: DataFrame | None = None, days: int = REMEMBERED, late: str = "2 days") -> DataFrame:
    """Rows whose key hasn't come on their day or on the ``days`` days before it; an exact state for each key.

    A key is remembered from the first of its rows, not from those that were held back since; on the day after the last it
    counts as new. Its state goes when the watermark, ``late`` behind the newest row, has passed that day; rows older than the watermark are
    dropped. ``seen`` (key, date) are keys that an earlier ledger remembers; their days count as if they had come then. Rows of
    one key and batch count by their time. A null key is a key.
    """
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    columns, names = timed.schema, timed.columns
    day = F.unix_date(F.to_date(time))
    if seen is None:
        told = timed.withColumn("_until", F.lit(None).cast("int"))
    else:
        last = seen.select(F.col(key).alias("_key"), F.unix_date(F.to_date("date")).alias("_seen")).groupBy("_key").agg(F.max("_seen").alias("_seen"))
        told = timed.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_until", F.col("_seen") + days).drop("_key", "_seen")

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(batches)).sort_values([time], kind="stable")
        first, flags = state.get[0] if state.exists else None, []
        for d, until in zip(got["_day"].tolist(), got["_until"].tolist(), strict=True):
            new = (first is None or d > first + days) and (pd.isna(until) or d > until)
            flags.append(new)
            first = int(d) if new else first
        if first is not None:
            over = (first + days + 1) * 86_400_000
            if over > state.getCurrentWatermarkMs():
                state.update((first,))
                state.setTimeoutTimestamp(over)
            elif state.exists:
                state.remove()
        yield got.loc[flags, names]

    watched = told.withColumn("_day", day).withWatermark(time, late)
    return watched.groupBy(key).applyInPandasWithState(step, columns, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def committed(rows: DataFrame, into: str, checkpoint: str, writer: str = "stream", key: str | None = None) -> DataFrame:
    """Run a stream to the end of what is there, into a table of commits: each batch once, even if it runs again; with
    ``key``, rows whose key is there don't come again."""
    spark = rows.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        table = Committed(spark, into)
        table.append_first_seen(df, key, writer, number) if key else table.append(df, writer, number)

    q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return Committed(spark, into).read()


def rolling_window(rows: DataFrame, key: str, order: str, today: str, into: str, checkpoint: str, days: int = 30) -> DataFrame:
    """Each batch: rows of the last days to the slot ``current``, older ones to their month; a key that is there stays.

    A batch is one commit: where it is killed nothing of it is there, where it runs again after its commit it adds nothing.
    """
    spark = rows.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = first_wins([split_by_age(df, "date", F.lit(today).cast("date"), days)], key, order)
        Committed(spark, into).append_first_seen(new, key, "window", number)

    q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return Committed(spark, into).read()


def daily_counts(rows: DataFrame, time: str, by: str, into: str, checkpoint: str, late: str = "40 days") -> DataFrame:
    """(day, by, n): tumbling days. Each batch puts the days that it changed in place of what they were, in one commit; a day
    stays in the state while rows that belong to it may come, which are dropped once they are ``late`` behind the newest."""
    spark = rows.sparkSession
    counts = rows.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), by, "n")

    def batch(df: DataFrame, number: int) -> None:
        Committed(spark, into).upsert(df, ["day", by], "days", number)

    q = flat.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return Committed(spark, into).read()


def bounded(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of a batch; the others are for the next run."""
    return rows.orderBy(order).limit(most)


def each_apart(parts: dict[str, DataFrame], write) -> dict[str, str]:
    """Write each part for itself; {part: error} of those that failed, which stop no other."""
    failed = {}
    for name, df in parts.items():
        try:
            write(name, df)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {e}"[:500]
    return failed


def _over(spark: SparkSession, home: str, table: DataFrame) -> DataFrame:
    """``table``, which a finished stream wrote at ``home``; its checkpoint goes."""
    delete(spark, f"{home}/state")
    return table


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = folder(spark)
    rows = source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _over(spark, home, daily_counts(rows, "ts", "event_type", f"{home}/out", f"{home}/state"))


def stream_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users each first event's type brought; a user counts once."""
    home = folder(spark)
    rows = source(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    out = _over(spark, home, run(unique(rows, "user_id", "ts"), f"{home}/out", f"{home}/state"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users who haven't had one on that day or the 5 days before the first since; ids divisible by 9 are on a
    ledger of 2023-12-30."""
    home = folder(spark)
    rows = source(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    ledger = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 9 = 0").select("user_id", F.lit("2023-12-30").alias("date")).distinct()
    new = unseen(rows, "user_id", "ts", ledger, days=5, late="40 days")
    return _over(spark, home, committed(new.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), f"{home}/out", f"{home}/state"))


def stream_rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = folder(spark)
    rows = source(spark, f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    out = _over(spark, home, rolling_window(rows, "event_id", "date", "2024-02-10", f"{home}/out", f"{home}/state"))
    return out.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"stream_daily_counts": stream_daily_counts, "stream_seen_dedup": stream_seen_dedup, "stream_rolling_window": stream_rolling_window, "stream_unseen": stream_unseen}
ORACLES = {
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_seen_dedup": "SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS users FROM events",
    # one row of a user after the other: the first beyond what is remembered of the last that counted
    "stream_unseen": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE user_id % 9 <> 0 OR ts::DATE > DATE '2023-12-30' + 5),
x AS (SELECT user_id, min(day) AS day FROM e GROUP BY 1 UNION ALL SELECT user_id, (SELECT min(e.day) FROM e WHERE e.user_id = x.user_id AND e.day > x.day + 5) AS day FROM x WHERE x.day IS NOT NULL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM x WHERE day IS NOT NULL""",
    "stream_rolling_window": "SELECT CASE WHEN ts::DATE >= DATE '2024-02-10' - 30 THEN 'current' ELSE strftime(ts, '%Y-%m') END AS slot, count(*) AS n FROM events GROUP BY 1",
}
