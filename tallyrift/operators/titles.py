"""Titles like one another: the first of each kind within a block, and pairs that are alike enough.

Both scores have an upper bound in the titles' lengths and characters: a match of m characters can't be longer than the
characters that both have. Bounds are computed for many pairs at once; only pairs that can reach the limit are scored. A
large block is dealt over tasks, none of which holds more than a few thousand titles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.lineage import Scratch
from tallyrift.operators.matching import PROPOSED, token_set_ratio

#: From which ratio on a title is a near copy.
NEAR = 0.82
#: Titles that a round decides in each block, titles that a task compares with them, and of small blocks dealt together.
FIRST, TILE, TOGETHER = 2048, 2048, 5000
#: Titles of a part of a block whose pairs are made, and pairs whose bounds are computed at once.
PART, AT_ONCE = 512, 1 << 15
#: Classes of characters; characters of one class count as the same, which only raises a bound.
CLASSES = 64


def _profile(titles: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, characters of each class) of titles."""
    sizes = np.fromiter(map(len, titles), np.int64, len(titles))
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES
    at = np.repeat(np.arange(len(titles)), sizes) * CLASSES + codes
    return sizes, np.bincount(at, minlength=len(titles) * CLASSES).reshape(-1, CLASSES)


class Kept:
    """Titles that stay, with what tells soon that another is unlike them."""

    def __init__(self, titles: Sequence[str] = (), least: float = NEAR):
        self.least, self.n = least, 0
        self.matchers: list[SequenceMatcher | None] = []
        self.titles: list[str] = []
        self.sizes, self.counts = np.zeros(64, np.int64), np.zeros((64, CLASSES), np.int64)
        for t, size, counts in zip(titles, *_profile(titles), strict=True):
            self.add(t, size, counts)

    def add(self, title: str, size: int, counts: np.ndarray) -> None:
        if self.n == len(self.sizes):
            self.sizes, self.counts = np.concatenate([self.sizes] * 2), np.concatenate([self.counts] * 2)
        self.sizes[self.n], self.counts[self.n] = size, counts
        self.titles.append(title)
        self.matchers.append(None)
        self.n += 1

    def like(self, title: str, size: int, counts: np.ndarray) -> bool:
        """Whether the ratio of ``title`` to any of these reaches the limit."""
        total = np.maximum(self.sizes[: self.n] + size, 1)
        near = np.flatnonzero(2.0 * np.minimum(self.sizes[: self.n], size) / total >= self.least)
        most = 2.0 * np.minimum(self.counts[near], counts).sum(axis=1) / total[near]
        for i in near[np.argsort(-most, kind="stable")][: int((most >= self.least).sum())]:
            if self.matchers[i] is None:
                self.matchers[i] = SequenceMatcher(None, "", self.titles[i])
            self.matchers[i].set_seq1(title)
            if self.matchers[i].ratio() >= self.least:
                return True
        return False


def _block(block: Sequence[str]) -> Column:
    """The block's columns as one text; nulls are a value."""
    return F.to_json(F.struct(*block), {"ignoreNullFields": "false"}) if block else F.lit("")


def greedy_titles(rows: DataFrame, block: Sequence[str], order: str, title: str, least: float = NEAR, first: int = FIRST, tile: int = TILE) -> DataFrame:
    """Rows of each block whose title is less like than ``least`` to all titles kept before them in ``order``.

    That is the lexicographically first independent set of the graph of near copies. A title that was there before stays or
    goes with its first row, so only first rows count. Each round decides the ``first`` titles in order of every block among themselves, in one
    task for a block; those that stay then put out what is like them of the block's others, ``tile`` titles a task. There
    is no table of near pairs: of a thousand copies none meets another but by the one that stays. Blocks of up to
    ``first`` different titles take one round, others one for each ``first`` titles that stay.

    A null title is an empty one; a null order comes last; rows that agree in order go by their titles.
    """
    spark, columns = rows.sparkSession, rows.columns
    with Scratch(spark, "titles") as scratch:
        named = rows.select(_block(block).alias("_block"), F.coalesce(F.col(title), F.lit("")).alias("_title"), F.struct(F.col(order).isNull(), F.col(order)).alias("_at"), F.struct(*columns).alias("_row"))
        heads = scratch.keep(named.groupBy("_block", "_title").agg(F.min("_at").alias("_at"), F.min_by("_row", "_at").alias("_row")), "heads")
        left, kept = scratch.keep(heads.select("_block", "_title", "_at"), "left"), []
        while True:
            sizes = left.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
            told = sizes.agg(F.sum("_size").alias("n"), F.max("_size").alias("most")).first()
            if not told["n"]:
                break
            place = F.row_number().over(Window.partitionBy("_block").orderBy("_at", "_title"))
            leading = scratch.keep(left.withColumn("_n", place).where(F.col("_n") <= first).select("_block", "_title", "_n"), "leading")
            cells = max(1, told["n"] // TOGETHER)
            stays = scratch.keep(leading.groupBy(F.pmod(F.xxhash64("_block"), F.lit(cells)).alias("_cell")).applyInPandas(_decider(least), "_block string, _title string"), "stays")
            kept.append(stays)
            if told["most"] <= first:
                scratch.forget(leading, left)
                break
            dealt = F.ceil(F.col("_size") / tile).cast("int")
            large = sizes.where(F.col("_size") > first).withColumn("_tiles", dealt).drop("_size")
            rest = left.join(leading, ["_block", "_title"], "left_anti").join(large, "_block").withColumn("_tile", F.pmod(F.xxhash64("_title"), F.col("_tiles")).cast("int")).drop("_tiles")
            against = stays.join(large, "_block").select("_block", "_title", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile"))
            told = rest.select("_block", "_title", "_tile").groupBy("_block", "_tile").cogroup(against.groupBy("_block", "_tile")).applyInPandas(_survivors(least), "_block string, _title string")
            further = scratch.keep(told.join(left, ["_block", "_title"]), "left")
            scratch.forget(leading, left)
            left = further
        stay = heads.select("_block", "_title").limit(0) if not kept else kept[0]
        for more in kept[1:]:
            stay = stay.unionByName(more)
        return heads.join(stay, ["_block", "_title"]).select("_row.*")


def _decider(least: float):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, some in pdf.sort_values(["_block", "_n"], kind="stable").groupby("_block", sort=False):
            had = Kept(least=least)
            titles = some["_title"].tolist()
            flags = []
            for t, size, counts in zip(titles, *_profile(titles), strict=True):
                flags.append(new := not had.like(t, size, counts))
                if new:
                    had.add(t, size, counts)
            out.append(some[flags])
        return pd.concat(out)[["_block", "_title"]]

    return decide


def _survivors(least: float):
    def survive(rest: pd.DataFrame, stays: pd.DataFrame) -> pd.DataFrame:
        had, titles = Kept(stays["_title"].tolist(), least), rest["_title"].tolist()
        return rest.loc[[not had.like(*x) for x in zip(titles, *_profile(titles), strict=True)], ["_block", "_title"]]

    return survive


def _bounded(sets: list[set], lengths: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Of pairs of titles those whose token-set ratio can reach ``least``.

    Either side's words, sorted, share at most the characters that both have. Where titles share words, the shared ones alone
    may be likelier than that; how likely follows from their length.
    """
    for at in range(0, len(i), AT_ONCE):
        a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
        m, total = np.minimum(counts[a], counts[b]).sum(axis=1), np.maximum(lengths[a] + lengths[b], 1)
        shorter = np.minimum(lengths[a], lengths[b])
        sure, may = 200.0 * m / total >= least, 200.0 * m / np.maximum(m + shorter, 1) >= least
        for x, y, s in zip(a[may].tolist(), b[may].tolist(), sure[may].tolist(), strict=True):
            if not s:
                both = sets[x] & sets[y]
                n = sum(map(len, both)) + len(both) - 1
                s = bool(both) and (n == min(lengths[x], lengths[y]) or 200.0 * n / (n + min(lengths[x], lengths[y])) >= least)
            if s:
                yield x, y


def _pairs_of(some: pd.DataFrame, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block, the earlier first; ``own``: which of the two parts of a block each is of."""
    order = some["_at"].to_numpy()
    if own is None:
        i, j = np.triu_indices(len(some), 1)
    else:
        one, other = np.flatnonzero(own), np.flatnonzero(~own)
        i, j = np.repeat(one, len(other)), np.tile(other, len(one))
    swap, same = order[i] > order[j], order[i] == order[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return i[~same], j[~same]


def _cells(rows: DataFrame, block: Sequence[str], order: str, title: str, part: int) -> DataFrame:
    """Rows dealt so that every pair of a block meets in one cell: small blocks together, two parts of a large one each."""
    named = rows.select(*block, F.col(order).alias("_at"), F.coalesce(F.col(title), F.lit("")).alias("_title"), _block(block).alias("_block"))
    sizes = named.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    cells = max(1, (sizes.agg(F.sum("_size")).first()[0] or 0) // TOGETHER)
    parts = F.ceil(F.col("_size") / part).cast("int")
    placed = named.join(sizes, "_block").withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("_at", "_title"), F.col("_parts")).cast("int"))
    met = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    small = F.col("_parts") == 1
    return met.withColumns({"_low": F.least("_part", "_with"), "_high": F.greatest("_part", "_with"),
                            "_cell": F.when(small, F.pmod(F.xxhash64("_block"), F.lit(cells)).cast("string")).otherwise(F.col("_block"))}).drop("_size", "_with", "_parts")


def _compared(block: Sequence[str], least: float, work: bool):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for _, some in pdf.groupby("_block", sort=False):
            some = some.reset_index(drop=True)
            own = None if some["_low"].iloc[0] == some["_high"].iloc[0] else (some["_part"] == some["_low"]).to_numpy()
            i, j = _pairs_of(some, own)
            titles = some["_title"].tolist()
            sets = [set(t.split()) for t in titles]
            lengths, counts = _profile([" ".join(s) for s in sets])
            got = [(x, y, token_set_ratio(titles[x], titles[y])) for x, y in _bounded(sets, lengths, counts, i, j, least)]
            found = [g for g in got if g[2] >= least]
            if work:
                out.append(some[list(block)].head(1).assign(pairs=len(i), scored=len(got), proposed=len(found)))
            else:
                x, y, score = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
                out.append(some.loc[x, list(block)].assign(one=some["_at"].to_numpy()[x], other=some["_at"].to_numpy()[y], score=np.array(score, float)))
        return pd.concat(out)

    return compare


def proposed_pairs(rows: DataFrame, block: Sequence[str], order: str, title: str, least: float = PROPOSED, part: int = PART) -> DataFrame:
    """(block, one, other, score) of the pairs of a block, in ``order``, whose token-set ratio is ``least`` or more.

    A block of more than ``part`` titles is dealt in parts, each pair of which is one task's work. Rows without an order, or
    that agree in it, make no pair; a null title has no words and is like nothing.
    """
    kinds, cells = dict(rows.dtypes), _cells(rows.where(F.col(order).isNotNull()), block, order, title, part)
    kind = ", ".join([*(f"{c} {kinds[c]}" for c in block), f"one {kinds[order]}", f"other {kinds[order]}", "score double"])
    return cells.groupBy("_cell", "_low", "_high").applyInPandas(_compared(block, least, False), kind)


def pair_work(rows: DataFrame, block: Sequence[str], order: str, title: str, least: float = PROPOSED, part: int = PART) -> DataFrame:
    """(block, pairs, scored, proposed): the pairs of each block, those that could reach ``least`` and so were scored, and
    those that did."""
    kinds, cells = dict(rows.dtypes), _cells(rows.where(F.col(order).isNotNull()), block, order, title, part)
    kind = ", ".join([*(f"{c} {kinds[c]}" for c in block), "pairs long", "scored long", "proposed long"])
    told = cells.groupBy("_cell", "_low", "_high").applyInPandas(_compared(block, least, True), kind)
    return told.groupBy(*block).agg(*(F.sum(c).alias(c) for c in ("pairs", "scored", "proposed")))
