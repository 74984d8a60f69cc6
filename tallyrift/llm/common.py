"""What the operators share: reading a table, cutting lineage into the shared folder, ASCII case folding."""

from __future__ import annotations

import gc
import string
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder for cut lineage where the session names none; only local sessions (tests) use it.
LOCAL_FOLDER = "/tmp/checkpoints/tallyrift"
#: Rows of one number each that are broadcast at most.
SMALL_SIDE = 1_000_000
#: Bits of the sets that keep rows without a part in a join out of its shuffle.
BITS = 1 << 20


#: The tables that the operator at work has written.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, may go without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    It cuts lineage as checkpoint() does, but stays columnar and compressed, and a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def _note(path: str) -> None:
    if (made := _made.get()) is not None:
        made.append(path)


def tidy(operator: Callable) -> Callable:
    """An operator that returns a table, and leaves of what it wrote only what that table still reads.

    An operator within another leaves to it what its own table reads; after an error nothing stays.
    """
    @wraps(operator)
    def run(*args, **kwargs):
        outer, made = _made.get(), []
        token, out = _made.set(made), None
        try:
            out = operator(*args, **kwargs)
            return out
        finally:
            _made.reset(token)
            read = set() if out is None else {f.rpartition("/")[0].rstrip("/").rpartition("/")[2] for f in out.inputFiles()} if made else set()
            for path in made:
                if path.rpartition("/")[2] not in read:
                    _delete(path)
                elif outer is not None:
                    outer.append(path)

    return run


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, Callable[[], object]]:
    """One row of ``df`` for each ``key``, written to the shared folder in buckets, and what drops the table's name.

    The rows are shuffled once, as duplicates go; joins on the key then deal only their other side. There are as many
    buckets as the session has shuffle partitions.
    """
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{table}"
    _note(path)
    rows = df.repartition(n, key).dropDuplicates([key])
    rows.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    release(spark)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more; it does so as the JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, most: int = SMALL_SIDE) -> DataFrame:
    """``df``, a table of one number a row, to be broadcast if it is counted to have at most ``most`` rows; beyond that
    the join shuffles both sides."""
    df = written(df, "side")
    return F.broadcast(df) if df.count() <= most else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in have:
        out = f"_{out}"
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` would also fold other letters."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def in_set(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only if key isn't among the members' keys. Native, by a bit set of BITS bits."""
    place, word, bit, bits = F.pmod(F.col(key), F.lit(BITS)), *(unused(df, x) for x in ("word", "bit", "bits"))
    words = (members.select(place.alias("at")).groupBy(F.floor(F.col("at") / 64).alias(word))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias(bits)))
    out = df.withColumns({word: F.floor(place / 64), bit: (place % 64).cast("int")}).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({bits}, {bit}) & 1L"), F.lit(0)) == 1
    return out.withColumn(name, hit).drop(word, bit, bits)
