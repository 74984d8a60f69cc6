"""Sharding by weighted rendezvous hashing.

Each record scores every shard with a hash of (record key, shard) and goes to the best. The score of a shard does not
depend on how many shards there are, so one more shard only takes records into itself, and losing one only moves its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, unused, whole

#: Modulus and multiplier of the minimal standard generator, from which every shard's coefficients follow.
PRIME, STEP = 2**31 - 1, 48271

N_SHARDS = 24
#: Blocks of a shard in which slots are counted at once; none holds more than its share of the shard.
BLOCKS = 1024


def coefficients(shard: int) -> tuple[int, int]:
    return pow(STEP, 2 * shard + 1, PRIME), pow(STEP, 2 * shard + 2, PRIME)


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two independent 28-bit numbers of the key; a null key counts as the empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))


def _score(x: Column, y: Column, shard: int, weight: float, even: bool) -> Column:
    """-w / ln(u) is Schindelhauer and Schomaker's score: a shard wins with a probability proportional to w. With equal
    weights it orders as u does, which spares the logarithm."""
    a, b = coefficients(shard)
    z = (x * a + y * b) % PRIME
    return z if even else -F.lit(float(weight)) / F.log((z + 0.5) / PRIME)


def rendezvous(x: Column, y: Column, weights: Sequence[float], even: bool) -> Column:
    """(score, neg): of the shard with the highest score, whose number is -neg; ties go to the lower number. Weights of 0
    get nothing."""
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be non-negative and one of them positive")
    return F.array_max(F.array(*(F.struct(_score(x, y, s, w, even).alias("score"), F.lit(-s).alias("neg")) for s, w in enumerate(weights) if w > 0)))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None,
                  added_weight: float | None = None) -> DataFrame:
    """``df`` with a column ``shard``, and ``grown``: the shard once another of ``added_weight`` stands behind the last.

    Narrow: no shuffle, whatever the skew. Rows of one key go together, so one key that holds a third of the rows
    makes its shard that large: under this law the key alone decides. Null keys share a shard. Columns of ``df`` stay;
    one that is called like an output is replaced. An empty table stays empty.
    """
    x, y = key_halves(F.col(key))
    added = weights[-1] if added_weight is None else added_weight
    even = len({*weights, added} if grown else set(weights)) == 1
    name = unused(df, "best")
    best = df.withColumn(name, rendezvous(x, y, weights, even))
    out = {shard: (-F.col(name)["neg"]).cast("int")}
    if grown:
        wins = _score(x, y, len(weights), added, even) > F.col(name)["score"] if added > 0 else F.lit(False)
        out[grown] = F.when(wins, len(weights)).otherwise(-F.col(name)["neg"]).cast("int")
    return best.withColumns(out).drop(name)


def slots(df: DataFrame, shard: str, block: Column, order: Sequence[str], n_blocks: int, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, by block and then by ``order``.

    No task sees more than a block of a shard. The blocks' first slots are a running sum of at most shards x blocks
    counts, which bounds what is broadcast.
    """
    at, n, head, nth = (unused(df, c) for c in ("block", "n", "first", "at"))
    cut = df.withColumn(at, block)
    counts = cut.groupBy(shard, at).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(head))
    within = Window.partitionBy(shard, at).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    ranked = cut.withColumn(nth, F.row_number().over(within).cast("long") - 1)
    return ranked.join(F.broadcast(first), [shard, at]).withColumn(slot, F.col(head) + F.col(nth)).drop(at, head, nth)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 23 by the law ``key``. Null texts count 0 bytes; repeated rows get slots of their own."""
    docs = documents(spark, sf_dir)
    _, y = key_halves(F.col("doc_id"))
    rows = assign_shards(docs, "doc_id", [1.0] * N_SHARDS, grown="grown_shard").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(whole()).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return slots(rows, "shard", F.pmod(y, F.lit(BLOCKS)), ["doc_id", "text_crc32", "size"], BLOCKS)


def _sql_shard(n: int) -> str:
    parts = ", ".join(f"{{'z': (x * {a} + y * {b}) % {PRIME}, 'neg': {-s}}}" for s in range(n) for a, b in [coefficients(s)])
    return f"(-(list_max([{parts}])).neg)::INTEGER"


ORACLE = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(coalesce(text, '')) AS h, coalesce(strlen(text), 0) + 8 AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS x, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 8, 7))::BIGINT AS y
  FROM documents),
dealt AS (
  SELECT doc_id, size, y % {BLOCKS} AS block, {_sql_shard(N_SHARDS)} AS shard, {_sql_shard(N_SHARDS + 1)} AS grown_shard,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM keyed, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt
"""

QUERIES = {"op9_sharding": op9_sharding}
ORACLES = {"op9_sharding": ORACLE}
