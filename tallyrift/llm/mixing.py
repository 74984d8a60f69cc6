"""Mixing sources to target weights by Pfair scheduling.

A source of weight w must get its block j in the slots [floor(j / w), ceil((j + 1) / w)): released there, due there.
Among the released blocks the earliest deadline goes first, with the PD2 rules on ties. With weights that sum to 1 every
source then stays within one block of its share at every slot (Baruah, Cohen, Plaxton and Varvel; Anderson and Srinivasan).

Weights are exact fractions, so the bound holds to the targets themselves, however long the mixture. Tasks make the
schedule of blocks, a row for each, from the sources' counts, in stretches of slots: where a stretch begins, the blocks
that were served are found from the slots just before (``Shares.done_by``). Rows then find their blocks' slots in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, tidy, unused, written

#: Documents of a block; slots of a period of whole slots; blocks of a batch.
BLOCK, PERIOD, AT_ONCE = 16, 1024, 50_000
#: Slots that one task schedules at a time, and tasks that do so.
SLOTS, MOST_TASKS = 1 << 17, 10_000
#: Rows that are ranked in one sort, about, and parts of that size at least.
RANKED, LEAST_PARTS = 100_000, 256


def whole_slots(weights: Mapping, period: int = PERIOD) -> dict:
    """Slots of each source in a period, by largest remainder, one at least; ties by name."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights are positive")
    period, total = max(period, len(weights)), sum(weights.values())
    ideal = {k: w * period / total for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in ideal.items()}
    by_rest = sorted(ideal, key=lambda k: (-(ideal[k] - int(ideal[k])), str(k)))
    spare, at = period - sum(out.values()), 0
    while spare:
        k = by_rest[at % len(by_rest)]
        if spare > 0:
            out[k], spare = out[k] + 1, spare - 1
        elif out[k] > 1:
            out[k], spare = out[k] - 1, spare + 1
        at += 1
    return out


class Shares:
    """Weights as whole numbers, ``own`` of ``whole`` for each source; they count as the exact fractions they are."""

    def __init__(self, weights: Mapping) -> None:
        exact = {k: Fraction(w) for k, w in weights.items()}
        if any(w <= 0 for w in exact.values()):
            raise ValueError("weights are positive")
        one = lcm(*(w.denominator for w in exact.values()))
        self.own = {k: int(w * one) for k, w in exact.items()}
        self.whole = sum(self.own.values())
        #: Slots that no window is longer than.
        self.longest = max(-(-self.whole // w) for w in self.own.values()) + 1

    def release(self, k, j: int) -> int:
        return j * self.whole // self.own[k]

    def due(self, k, j: int) -> int:
        return -(-(j + 1) * self.whole // self.own[k])

    def block(self, k, j: int) -> tuple[int, tuple]:
        """(release, (deadline, PD2's order, source, j))."""
        w, whole, due = self.own[k], self.whole, self.due(k, j)
        overlaps = (j + 1) * whole % w != 0  # the next window begins before this one ends
        group = due
        if overlaps and whole <= 2 * w < 2 * whole:  # the end of the cascade of windows of two slots
            group = -(-(-(-due * (whole - w) // whole)) * whole // (whole - w))
        return self.release(k, j), (due, -int(overlaps), -group, str(k), k, j)

    def line(self, slot: int = 0, done: Mapping | None = None, until: Mapping | None = None) -> Iterator[tuple]:
        """(source, block) of each slot from ``slot`` on, by EDF among the released blocks, after ``done`` blocks of each
        source and up to ``until``."""
        first = {k: done[k] if done else 0 for k in self.own}
        more = lambda k, j: until is None or j < until[k]
        waiting = [self.block(k, j) for k, j in first.items() if more(k, j)]
        heapq.heapify(waiting)
        ready: list[tuple] = []
        while waiting or ready:
            while waiting and waiting[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(waiting)[1])
            *_, k, j = heapq.heappop(ready)
            yield k, j
            if more(k, j + 1):
                heapq.heappush(waiting, self.block(k, j + 1))
            slot += 1

    def done_by(self, slot: int) -> dict:
        """Blocks of each source before ``slot`` in a schedule that keeps all windows, found from the last ``longest`` slots.

        Such schedules pass through these states, whatever came long before: ``longest`` slots back, each source has its
        whole share, and of the windows then open those that end first are taken as served. A schedule by EDF from there
        keeps all later windows, as the sum of open shares at any later end bounds what is put off; and all windows open
        at ``slot`` begin after its start, so any schedule up to there can serve just the same ones.
        """
        start = max(0, slot - self.longest)
        done = {k: start * w // self.whole for k, w in self.own.items()}
        open_ = sorted((k for k, w in self.own.items() if start * w % self.whole), key=lambda k: (self.due(k, done[k]), str(k)))
        for k in open_[: start - sum(done.values())]:
            done[k] += 1
        for k, _ in islice(self.line(start, done), slot - start):
            done[k] += 1
        return done


def line(weights: Mapping) -> Iterator:
    """The source of each slot, without end."""
    return (k for k, _ in Shares(weights).line())


def period_of(slots: Mapping) -> list:
    """The source of each slot of a period."""
    return list(islice(line(slots), sum(slots.values())))


def phases(blocks: Mapping, weights: Mapping) -> Iterator[tuple[int, dict, int, dict]]:
    """(slot, blocks done before, slots, blocks done within) of each phase, by source.

    When a source runs out, the others share its weight: a new phase, in which shares are counted anew. At most one phase
    for each source. Only the slots around a phase's end are gone through, not those before.
    """
    left, done, slot = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0
    while left:
        shares = Shares({k: weights[k] for k in left})
        end = min(shares.release(k, n - 1) for k, n in left.items())
        within = shares.done_by(end)
        for k, j in shares.line(end, within):
            within[k], end = j + 1, end + 1
            if within[k] == left[k]:
                break
        yield slot, {k: done[k] for k in left}, end, within
        slot += end
        for k, n in within.items():
            done[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}


def stretch(shares: Shares, first: int, last: int, within: Mapping, end: int) -> Iterator[tuple]:
    """(source, block) of the slots from ``first`` to ``last`` of a phase of ``end`` slots that has ``within`` blocks."""
    return shares.line(first, shares.done_by(first), within if last >= end else shares.done_by(last))


def schedule(blocks: Mapping, weights: Mapping, slots: int = SLOTS) -> Iterator[tuple]:
    """(source, block, slot, phase) of all blocks, by slot, in stretches of ``slots``."""
    for phase, (slot, before, n, within) in enumerate(phases(blocks, weights)):
        shares = Shares({k: weights[k] for k in within})
        for first in range(0, n, slots):
            for at, (k, j) in enumerate(stretch(shares, first, first + slots, within, n), slot + first):
                yield k, before[k] + j, at, phase


def _scheduled(spark: SparkSession, blocks: Mapping, weights: Mapping) -> DataFrame:
    """The rows of ``schedule`` as (_source, _block, slot, phase), a stretch at a time in tasks of their own.

    The driver has a row for each phase; every task gets the weights, a number for each source.
    """
    names = list(blocks)
    number = {k: i for i, k in enumerate(names)}
    told = [(p, slot, n, [number[k] for k in within], [before[k] for k in within], list(within.values()))
            for p, (slot, before, n, within) in enumerate(phases(blocks, weights))]
    table = spark.createDataFrame(told, "phase int, slot long, n long, source array<int>, before array<long>, within array<long>")
    dealt = table.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long"))))
    tasks = min(MOST_TASKS, sum(-(-row[2] // SLOTS) for row in told))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                here = [names[i] for i in r.source]
                before = dict(zip(here, r.before.tolist(), strict=True))
                line = enumerate(stretch(Shares({k: weights[k] for k in here}), r.first, r.first + SLOTS, dict(zip(here, r.within.tolist(), strict=True)), r.n), r.slot + r.first)
                while batch := [(k, before[k] + j, at, r.phase) for at, (k, j) in islice(line, AT_ONCE)]:
                    yield pd.DataFrame(batch, columns=["_source", "_block", "slot", "phase"])

    return dealt.repartition(max(1, tasks)).mapInPandas(filled, "_source string, _block long, slot long, phase int")


@tidy
def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, power: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, source) with block, slot and seat: read by (slot, seat), sources keep to their weights.

    ``weights`` by source; a source that they leave out, and all of them where none are given, weighs its row count to
    ``power``. A null source is a source. Every row stays, once, rows with null or repeated ids too; other columns aren't
    read, and an empty table gives an empty one. A source's rows are dealt to blocks in an order by hash, so no task ranks
    a whole source. Only a count for each source comes to the driver, which keeps a count for each source and phase. The
    schedule, a row for each block, is made in stretches of SLOTS slots; each also goes through as many slots before its
    begin and its end as the longest window has, one over the smallest weight.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.lit(None).cast("long").alias("h"))
    return _mixed(rows, weights, block, power).drop("h")


def _mixed(rows: DataFrame, weights: Mapping[str, float] | None, block: int = BLOCK, power: float = 0.5) -> DataFrame:
    """``mix`` of rows (doc_id, source, h); h tells apart rows of one id."""
    spark = rows.sparkSession
    parts = max(LEAST_PARTS, -(-rows.count() // RANKED))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(parts)))
    counts = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("source", "_part").orderBy(F.xxhash64("doc_id", "h", F.lit(11)), F.col("doc_id"), F.col("h"))
    ranked = rows.withColumn("_at", F.row_number().over(within).cast("long") - 1)
    ranked = ranked.join(first, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select("doc_id", "source", "h", (F.col("_first") + F.col("_at")).alias("_rank"))
    ranked = ranked.select("doc_id", "source", "h", F.floor(F.col("_rank") / block).alias("block"), (F.col("_rank") % block).alias("seat"))

    sizes = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("_n").alias("n")).collect()}
    given = dict(weights or {})
    target = {k: given.get(k, float(n) ** power) for k, n in sizes.items()}
    blocks = {k: -(-n // block) for k, n in sizes.items()}

    table = written(_scheduled(spark, blocks, target), "schedule")
    return (ranked.join(table, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
            .select("doc_id", "source", "h", "block", "slot", "seat", "phase"))


@tidy
def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """``docs``, all columns, with slot and seat: their places in the mixture. Columns of these names are replaced.

    Places are dealt to the rows' keys - id, source, hash of the text - which are all that is shuffled for them; the texts
    are then shuffled once, to meet their places. Only rows that agree in the whole key are numbered, and they change
    places at will. Null ids are as good as any, since the texts spread them; extra columns stay, whatever their names.
    """
    names = [c for c in docs.columns if c not in ("slot", "seat")]
    key = [unused(docs, c) for c in ("id", "source", "h")]
    text = F.xxhash64("text") if "text" in names else F.lit(None).cast("long")
    keys = [F.col("doc_id").cast("long"), F.col("source").cast("string"), text]
    keyed = docs.select(*(docs[c] for c in names), *(k.alias(c) for k, c in zip(keys, key, strict=True)))
    rows = written(keyed.select(*(F.col(c).alias(n) for c, n in zip(key, ("doc_id", "source", "h"), strict=True))), "keys")
    places = written(_mixed(rows, weights, **options).select("doc_id", "source", "h", "slot", "seat"), "places")
    told = places.select(*(F.col(n).alias(f"{c}_") for c, n in zip(key, ("doc_id", "source", "h"), strict=True)), "slot", "seat")
    own = [f"{c}_" for c in key]
    same = lambda one, other: reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(one, other, strict=True)))
    again = written(places.groupBy("doc_id", "source", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "source", "h"), "again")
    if again.isEmpty():
        return keyed.join(told, same(key, own)).select(*names, "slot", "seat")
    twice = ["doc_id", "source", "h"]
    repeated = again.select(*(F.col(c).alias(f"{k}_again") for c, k in zip(twice, key, strict=True)))
    other = [f"{k}_again" for k in key]
    nth = unused(docs, "nth")
    number = lambda df, by: df.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1))))
    one = keyed.join(repeated, same(key, other), "left_anti").join(told, same(key, own)).select(*names, "slot", "seat")
    many = number(keyed.join(repeated, same(key, other), "left_semi"), key)
    seats = number(told.join(repeated, same(own, other), "left_semi"), own).withColumnRenamed(nth, f"{nth}_")
    return one.unionByName(many.join(seats, same([*key, nth], [*own, f"{nth}_"])).select(*names, "slot", "seat"))


def in_order(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """``docs``, all columns, sorted by the mixture over all partitions: their files, in order, are the mixture."""
    own = {c: unused(docs, f"own_{c}") for c in ("slot", "seat") if c in docs.columns}
    told = placed(docs.select("*", *(F.col(c).alias(a) for c, a in own.items())), weights, **options)
    return told.orderBy("slot", "seat").select(*(F.col(own[c]).alias(c) if c in own else F.col(c) for c in docs.columns))


@tidy
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mixture of sources by the square roots of their sizes; see ``mix``."""
    return mix(written(documents(spark, sf_dir).select("doc_id", "source"), "sources"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
