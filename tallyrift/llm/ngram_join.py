"""Jaccard join of documents on word n-grams, exact, by T-occurrence search.

Every linked pair shares some of the rarest grams of both sets, in any one order of all grams. So grams are counted into
a table of fixed size first, and a set shows only its grams of the least counts, a few more than it may differ in; the
sets that show a gram form a block. Long common passages are thus hardly ever shown. A pair must meet in ``least`` blocks,
so sets with fewer blocks are done. Of the rest, each is checked against the first of its blocks; what that links falls
into components. Only blocks that then still span several components are searched: DivideSkip merges the short inverted
lists and probes the long ones by bisection, for sets of another component that reach the overlap. Every linked
pair of different components meets in such a block, so no link between components is lost; links within one needn't be
looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import bucketed, documents, in_set, tidy, unused, written
from tallyrift.llm.graph import components

#: Sets that one task checks against their leader: so few that a large family is many tasks' work.
FOLLOWERS = 128
#: Sets of a block that one task holds; grams that are counted at once; bytes of a text that are hashed at once.
BLOCK, AT_ONCE, PIECE = 1500, 2_000_000, 1 << 16
#: Counters of the table that orders grams, of which SLICE are summed at once. With more grams only the order is coarser.
COUNTERS, SLICE = 1 << 22, 1 << 12
#: Parts of a sketch for each gram in which a linked pair may differ.
FINE = 4
#: Members up to which a block's sets ask each for itself.
SMALL = 40
#: Long lists that are probed at once.
PROBES = 64
#: Bits of the set by which a worker tells what a later step may need.
BITS = 1 << 22

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


#: White space of the contract.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]*")
#: A number for each byte, the same for a-z and A-Z.
_BYTE = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _MIX) * _ODD)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0


class Shingler:
    """Sets of 64-bit hashes of the runs of ``words`` words. Words are what white space parts, A-Z in lower case.

    A word's hash is a polynomial of its bytes' numbers, as a difference of running sums over a piece of the text.
    """

    def __init__(self, words: int):
        self.words, self.powers, self.inverses = words, *self._powers(PIECE)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        bases = int(_ODD), pow(int(_ODD), -1, 2**64)
        return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64)), dtype=np.uint64) for b in bases)

    def _words(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8)
        if len(b) >= len(self.powers):  # a word longer than a piece
            self.powers, self.inverses = self._powers(2 * len(b))
        edge = np.concatenate([[True], _SPACE[b], [True]])
        at = np.flatnonzero(edge[1:] != edge[:-1])
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * self.powers[: len(b)], dtype=np.uint64))
        return mixed((sums[at[1::2]] - sums[at[::2]]) * self.inverses[at[::2]])

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        pieces, start = [], 0
        while start < len(data):
            end = _WORD.match(data, min(start + PIECE // 2, len(data))).end()
            pieces.append(self._words(data[start:end]))
            start = end
        h = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        if not len(h):
            return h
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out * _ODD + h[i : len(h) - n + 1 + i])
        return np.unique(out)


class Limits:
    """What holds for linked sets, of a similarity of at least num / den.

    Sizes fall into classes such that linked sets lie in one class or in neighbours; a pair goes by its smaller class.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]  # the largest size of each class

    def linked(self, shared: int, one: int, other: int) -> bool:
        return self.den * shared >= self.num * (one + other - shared)

    def overlap(self, size: int) -> int:
        """Grams at least that a set of this size shares with one that it is linked with."""
        return -(-self.num * size // self.den)

    def extra(self, size: int) -> int:
        return min(3 + size // 100, self.overlap(size))

    def least(self, size: int) -> int:
        """Shown grams at least that a set of this size shares: as many as its smallest partner's ``extra``, which is not more than its own."""
        return self.extra(self.overlap(size))

    def shown(self, grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The first grams in the order of (rank, hash): those in which the set may differ, and ``extra`` more."""
        k = len(grams) - self.overlap(len(grams)) + self.extra(len(grams))
        if k >= len(grams):
            return grams
        key = (rank[_counter(grams)].astype(np.uint64) << np.uint64(56)) | (mixed(grams) >> np.uint64(8))
        return grams[np.argpartition(key, k - 1)[:k]]

    def class_of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return bisect_left(self.tops, size)

    def sketch(self, grams: np.ndarray, scheme: int) -> bytes:
        """16 bits of the content of each of many parts. Of a linked pair's, all but ``most`` agree, as equal parts do."""
        n = max(1, FINE * self.most(scheme))
        part = ((grams >> np.uint64(12)) % np.uint64(n)).astype(np.int64)
        total = np.bincount(part, (mixed(grams) >> np.uint64(44)).astype(float), n)
        return (total.astype(np.uint64) & np.uint64(0xFFFF)).astype("<u2").tobytes()

    def most(self, scheme: int) -> int:
        return (self.den - self.num) * self.tops[scheme] // self.num


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams % np.uint64(COUNTERS)).astype(np.int64)


def ranks(source: DataFrame, words: int) -> np.ndarray:
    """A rank for each counter, from the counts of all grams: twice the binary logarithm.

    A task sends its counters in compressed slices; a slice is summed as they come. COUNTERS bytes reach the driver.
    """
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, counts, some, size = Shingler(words), np.zeros(COUNTERS, np.int64), [], 0
        for rows in batches:
            for text in rows["text"]:
                some.append(shingle(text))
                size += len(some[-1])
                if size >= AT_ONCE:
                    counts += np.bincount(_counter(np.concatenate(some)), minlength=COUNTERS)
                    some, size = [], 0
        if size:
            counts += np.bincount(_counter(np.concatenate(some)), minlength=COUNTERS)
        out = []
        for i, c in enumerate(counts.reshape(-1, SLICE)):
            if top := c.max():
                out.append((i, int(top >= 256), zlib.compress(c.astype("<i8" if top >= 256 else "u1").tobytes(), 1)))
        yield pd.DataFrame(out, columns=["slice", "wide", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for i, wide, data in zip(rows["slice"], rows["wide"], rows["counts"], strict=True):
                if i not in sums:
                    sums[i] = np.zeros(SLICE, np.int64)
                sums[i] += np.frombuffer(zlib.decompress(data), "<i8" if wide else "u1")
        yield pd.DataFrame([(i, (2 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes()) for i, c in sums.items()], columns=["slice", "ranks"])

    out = np.zeros(COUNTERS, np.uint8)
    tallies = source.select("text").mapInPandas(tally, "slice int, wide int, counts binary").repartition("slice")
    for i, data in tallies.mapInPandas(add, "slice int, ranks binary").collect():
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(data, np.uint8)
    return out


def set_id(grams: np.ndarray) -> int:
    """A set's name, from which its content is known but for hash collisions; as a signed 64-bit number."""
    total = int(mixed(grams + _ODD).sum(dtype=np.uint64)) ^ (len(grams) * int(_MIX)) & (2**64 - 1)
    return total - (total >> 63 << 64)


def _bits(df: DataFrame, key: str) -> np.ndarray:
    """A bit set of the keys. At most BITS / 64 numbers come to the driver."""
    place = F.pmod(F.col(key), F.lit(BITS))
    rows = df.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    out = np.zeros(BITS // 64, np.int64)
    for w, b in rows.collect():
        out[w] = b
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys % BITS  # numpy's remainder is not negative, as pmod's
    return ((bits[p >> 6] >> (p & 63)) & 1).astype(bool)


class Lists:
    """Inverted lists of members, numbers below ``size``, in one ascending array of list * size + member."""

    def __init__(self, lists: np.ndarray, members: np.ndarray, size: int):
        self.size, self.keys = size, np.sort(lists.astype(np.int64) * size + members)
        self.starts = np.append(0, np.cumsum(np.bincount(lists)))

    @classmethod
    def of(cls, lists: Mapping[int, Sequence[int]]) -> Lists:
        return cls(np.repeat(list(lists), [len(x) for x in lists.values()]), np.concatenate(list(lists.values())), 1 + max(max(x) for x in lists.values()))

    def merged(self, some: np.ndarray) -> np.ndarray:
        """For each member, of how many of these lists it is one."""
        n = self.starts[some + 1] - self.starts[some]
        at = np.arange(n.sum()) + np.repeat(self.starts[some] - np.cumsum(n) + n, n)
        return np.bincount(self.keys[at] - np.repeat(some * self.size, n), minlength=self.size)

    def probed(self, some: np.ndarray, members: np.ndarray) -> np.ndarray:
        """The same for these members only, by bisection of the lists."""
        sought = some[:, None] * self.size + members
        at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        return (self.keys[at] == sought).sum(0)


def divide_skip(lists: Lists | Mapping[int, Sequence[int]], grams: Sequence[int], least: int) -> dict[int, int]:
    """Members of at least ``least`` of the query's lists, with how many: merge the short lists, probe the long ones.

    As members of a cell are few, the merge takes a counter for each in place of a heap; it gives the same counts. Long
    lists are probed PROBES at a time, the shorter first, for the members that can still get there.
    """
    lists, grams = lists if isinstance(lists, Lists) else Lists.of(lists), np.asarray(grams, dtype=np.int64)
    length = lists.starts[grams + 1] - lists.starts[grams]
    own = grams[np.argsort(length, kind="stable")][np.count_nonzero(length < 2):]
    if len(own) < least:
        return {}
    n_long = min(least - 1, int(least / (0.1 * math.log2(length.max()) + 1)), len(own) - 1)
    short, long = own[: len(own) - n_long], own[len(own) - n_long :]
    merged = lists.merged(short)
    found = np.flatnonzero(merged >= max(1, least - n_long))
    count = merged[found]
    for i in range(0, n_long, PROBES):
        if not len(found):
            break
        count = count + lists.probed(long[i : i + PROBES], found)
        stay = count + max(0, n_long - i - PROBES) >= least
        found, count = found[stay], count[stay]
    stay = count >= least
    return dict(zip(found[stay].tolist(), count[stay].tolist(), strict=True))


def search(sets: list[np.ndarray], names: list[int], comps: list[int], asks: list[bool], limits: Limits) -> list[tuple[int, int]]:
    """Links (a, b) from sets that ask to sets of other components, enough to join all that are linked."""
    root = {c: c for c in comps}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(place) > 1
    owner, place = owner[common[place]], (np.cumsum(common) - 1)[place[common[place]]]
    if not len(place):
        return []
    lists = Lists(place, owner, len(sets))
    of = np.split(place, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
    out = []
    for i in np.flatnonzero(asks).tolist():
        n = len(sets[i])
        if len(of[i]) < limits.overlap(n):
            continue
        for j, shared in divide_skip(lists, of[i], limits.overlap(n)).items():
            a, b = top(comps[i]), top(comps[j])
            if a != b and limits.linked(shared, n, len(sets[j])):
                root[max(a, b)] = min(a, b)
                out.append((names[i], names[j]))
    return out


def linked_sets(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, h, set_id, n) of all rows, h the hash of the text, and (set_id, root) of the sets that are linked with another.

    Null and empty texts have no set. See the module for the method; nothing that grows with the corpus is broadcast or
    collected, only tables of a fixed size, and a worker holds one text or BLOCK sets.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rank = docs.sparkSession.sparkContext.broadcast(ranks(source, words))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, limits, seen = Shingler(words), Limits(num, den), set()
        for rows in batches:
            out = []
            for doc, h, text in zip(rows["doc_id"].array, rows["h"], rows["text"], strict=True):
                grams = shingle(text)
                n, name, shown = len(grams), None, None
                if n:
                    name = set_id(grams)
                    if name not in seen:
                        seen.add(name)
                        shown = limits.shown(grams, rank.value).view(np.int64)
                out.append((None if pd.isna(doc) else int(doc), h, name, n, limits.least(n) if n else 0, limits.class_of(n), shown))
            frame = pd.DataFrame(out, columns=["doc_id", "h", "set_id", "n", "least", "class", "grams"])
            # From lists: a frame's column of numbers and None would round them to doubles.
            yield frame.assign(doc_id=pd.array([x[0] for x in out], dtype="Int64"), set_id=pd.array([x[2] for x in out], dtype="Int64"))

    members = written(source.mapInPandas(first, "doc_id long, h long, set_id long, n int, least int, class int, grams array<long>"), "sets")
    # A running first value needs no buffer. A set comes again from other tasks that have copies of it.
    shows = members.select("set_id", F.explode("grams").alias("sig"))
    led = shows.select("sig", "set_id", F.min("set_id").over(_by("sig", "set_id")).alias("lead")).where("set_id != lead")
    led = written(led.dropDuplicates(["sig", "set_id"]), "led")
    # Blocks with the same members become one, whose weight ``w`` is their number: near copies share most shown grams.
    content = led.groupBy("sig").agg(F.min("lead").alias("lead"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.count(F.lit(1)).alias("size"))
    merged = written(content.groupBy("lead", "x", "size").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("w")).select("sig", "lead", "w"), "merged")
    led = written(led.join(merged.select("sig", "w"), "sig"), "led")
    blocks = led.select("sig", "set_id", "w").unionByName(merged.select("sig", F.col("lead").alias("set_id"), "w"))

    # The sets that show enough grams which others show too, and their grams from one document each.
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    alive = blocks.groupBy("set_id").agg(F.sum("w").alias("c"))
    named = members.where("grams IS NOT NULL").groupBy("set_id").agg(F.min(place).alias("place"), F.min("n").alias("n"), F.min("least").alias("least"), F.min("class").alias("class"))
    chosen = written(named.join(alive, "set_id").where("c >= least").drop("c"), "chosen")
    needed = docs.sparkSession.sparkContext.broadcast(_bits(chosen, "set_id"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(words), set()
        for rows in batches:
            out = []
            for text in rows["text"]:
                grams = shingle(text)
                if len(grams):
                    name = set_id(grams)
                    if name not in seen and _has(needed.value, np.array([name]))[0]:
                        seen.add(name)
                        out.append((name, grams.tobytes()))
            yield pd.DataFrame(out, columns=["set_id", "grams"])

    some = in_set(source.withColumn("place", place), chosen, "place", "_in").where("_in").select("text")
    # They are dealt once, in buckets, for all the joins below.
    sets, drop_sets = bucketed(some.mapInPandas(again, "set_id long, grams binary"), "set_id", "grams")

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("set_id", kind="stable")
        found = search([np.frombuffer(g, np.uint64) for g in rows["grams"]], rows["set_id"].tolist(), rows["root"].tolist(), rows["asks"].tolist(), Limits(num, den))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def searched(cells: DataFrame) -> DataFrame:
        """Links between the sets of a cell (sig, deal, asker) that ask and its others."""
        return cells.join(sets, "set_id").groupBy("sig", "deal", "asker").applyInPandas(cell, "a long, b long")

    # Of the sets of fitting size that lead its blocks, each set is checked against the one it shares most grams with.
    about = chosen.select("set_id", "n", "least", "class")
    leading = led.groupBy("set_id", "lead").agg(F.sum("w").alias("c")).join(about, "set_id").where("c >= least")
    leading = leading.join(about.select(F.col("set_id").alias("lead"), F.col("n").alias("m")), "lead").where(_fit("n", "m", num, den))
    best = written(leading.groupBy("set_id").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead")), "best")
    sizes = best.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("deals"))
    followers = best.join(sizes, "lead").select(F.col("lead").alias("sig"), "set_id", F.pmod(F.xxhash64("set_id"), F.col("deals")).cast("int").alias("deal"), F.lit(False).alias("asks"))
    leaders = sizes.select(F.col("lead").alias("sig"), F.col("lead").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(True).alias("asks"))
    first_cells = followers.unionByName(leaders).withColumns({"asker": F.lit(0), "root": F.col("set_id")})
    links = written(searched(written(first_cells, "cells")), "links")
    comps = components(links)

    # Blocks that span components, and all their sets.
    rooted = about.join(comps, F.col("set_id") == F.col("node"), "left").select("set_id", "n", "least", "class", F.coalesce("root", "set_id").alias("root"))
    rooted = written(rooted, "rooted")
    named = written(blocks.join(rooted.select("set_id", "root"), "set_id"), "named")
    open_ = named.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("sig")
    inside = written(named.join(open_, "sig", "left_semi").join(rooted.drop("root"), "set_id"), "inside")
    # A link to a set of another component shows in such blocks of a weight of ``least`` at least. So a set needs to be looked
    # for only in its smallest blocks, those before which not more than all but ``least`` of its weight lies: in one order of
    # blocks, two linked sets' first common one is left.
    totals = inside.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("set_id")
    before = F.sum("w").over(own.orderBy("size", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    ranked = inside.join(totals, "sig").withColumns({"open": F.sum("w").over(own), "before": before})
    all_ = inside
    inside = written(ranked.where("before <= open - least").select("sig", "set_id", "root", "n", "least", "class"), "inside")
    sizes = inside.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    main = written(sizes.groupBy("sig").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("total > most"), "main")

    # In a small block each set asks those of other components, once for all its blocks.
    few = inside.join(main.where(F.col("total") <= SMALL).select("sig"), "sig", "left_semi")
    one = few.select("sig", F.col("set_id").alias("query"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("least").alias("l"), F.col("class").alias("k"))
    met = one.join(few, "sig").where("query < set_id AND r != root").where(_fit("n", "m", num, den))
    met = written(met.select("query", "set_id", "r", "root", F.greatest("l", "least").alias("least"), F.least("k", "class").alias("scheme")).distinct(), "met")
    # Two that meet must have ``least`` shown grams in common.
    common = met.join(all_.select(F.col("set_id").alias("query"), "sig"), "query").join(all_.select("set_id", "sig", "w"), ["set_id", "sig"])
    common = common.groupBy("query", "set_id", "r", "root", "scheme", "least").agg(F.sum("w").alias("c")).where("c >= least")
    met = written(common.select("query", "set_id", "r", "root", "scheme"), "met")

    # Before whole sets travel, their sketches do, to part those that differ too much.
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits = Limits(num, den)
        for rows in batches:
            out = []
            for name, data in zip(rows["set_id"], rows["grams"], strict=True):
                grams = np.frombuffer(data, np.uint64)
                k = limits.class_of(len(grams))
                out += [(name, i, limits.most(i), limits.sketch(grams, i)) for i in (k, k - 1) if i >= 0]
            yield pd.DataFrame(out, columns=["set_id", "scheme", "most", "sketch"])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = [int((np.frombuffer(x, "<u2") != np.frombuffer(y, "<u2")).sum()) <= m for x, y, m in zip(rows["sketch"], rows["other"], rows["most"], strict=True)]
            yield rows.loc[keep, ["query", "set_id", "r", "root"]]

    named_ends = met.select(F.explode(F.array("query", "set_id")).alias("set_id")).distinct()
    sketches = written(sets.join(named_ends, "set_id", "left_semi").mapInPandas(sketched, "set_id long, scheme int, most int, sketch binary"), "sketches")
    both = met.join(sketches.select(F.col("set_id").alias("query"), "scheme", F.col("sketch").alias("other")), ["query", "scheme"]).join(sketches, ["set_id", "scheme"])
    met = written(both.mapInPandas(close, "query long, set_id long, r long, root long").distinct(), "met")
    asking = met.select(F.col("query").alias("sig"), F.col("query").alias("set_id"), F.col("r").alias("root"), F.lit(True).alias("asks")).distinct()
    answering = met.select(F.col("query").alias("sig"), "set_id", "root", F.lit(False).alias("asks")).distinct()
    small = asking.unionByName(answering).withColumns({"deal": F.lit(-1), "asker": F.lit(-1)})

    # Large blocks with the same smallest set are searched as one, since they mostly have the same members. The sets of the
    # largest component needn't ask each other. Both sides are dealt to tasks.
    big = inside.join(main.where(F.col("total") > SMALL).select("sig"), "sig")
    cover = big.groupBy("sig").agg(F.min("set_id").alias("head"))
    together = written(big.join(cover, "sig").select(F.col("head").alias("sig"), "set_id", "root").distinct(), "together")
    shares = together.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("sig")
    many = shares.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).select(
        "sig", "main", F.ceil(F.col("total") / BLOCK).cast("int").alias("deals"), F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("askers"))
    rows = together.join(many, "sig").withColumn("asks", F.col("root") != F.col("main"))
    told = rows.select("sig", "set_id", "root", F.lit(False).alias("asks"), F.pmod(F.xxhash64("set_id"), F.col("deals")).cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"))
    asked = rows.where("asks").select("sig", "set_id", "root", "asks", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.pmod(F.xxhash64("set_id"), F.col("askers")).cast("int").alias("asker"))
    large = told.unionByName(asked).groupBy("sig", "deal", "asker", "set_id", "root").agg(F.max("asks").alias("asks"))
    cells = written(large.unionByName(small.select(*large.columns)), "cells")

    more = written(searched(cells), "links")
    drop_sets()
    if more.isEmpty():
        return members, comps.withColumnRenamed("node", "set_id")
    return members, components(links.unionByName(more)).withColumnRenamed("node", "set_id")


def _fit(one: str, other: str, num: int, den: int):
    return F.least(one, other) * F.lit(den) >= F.greatest(one, other) * F.lit(num)


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


@tidy
def similar_documents(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text).

    Two documents are linked when den x shared >= num x united grams; component_id is the smallest id reachable. A
    document without words, null or empty, is linked with nothing. Repeated rows are equal documents, each with its row;
    other columns aren't read, and an empty table gives an empty one.
    """
    members, comps = linked_sets(docs, words, num, den)
    smallest = members.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    rooted = written(smallest.join(comps, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "least"), "rooted")
    tops = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "tops")
    by_set = written(rooted.join(tops, "root").select("set_id", "component_id"), "by_set")
    rows = members.select("doc_id", "set_id", "n")
    return rows.join(by_set, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word grams have a Jaccard similarity of 0.85 or more."""
    return similar_documents(documents(spark, sf_dir), 4, 85, 100)


@tidy
def drop_similar(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs``, all columns, with one row of each group of linked texts: that with the smallest doc_id.

    Rows are told apart by doc_id and text, so each goes or stays by its own text, whatever other rows have its id.
    Documents without words stay. A row without an id stays only where its group has no id at all. Of a group's rows
    with the same smallest id, or without any, the smallest hash of a text decides; of equal rows any one stays. Extra
    columns stay, whatever their names; an empty table stays empty.
    """
    members, comps = linked_sets(docs, words, num, den)
    rows = members.where("set_id IS NOT NULL").groupBy("doc_id", "h", "set_id").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.join(comps, "set_id", "left").select("doc_id", "h", "n", F.coalesce("root", "set_id").alias("root")), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    i, t, id_, h = (unused(docs, c) for c in ("i", "t", "id", "h"))
    told = written(rows.join(first, "root").select(F.col("doc_id").alias(i), F.col("h").alias(t), "n", stays.alias("stays")), "told")
    same = F.col(id_).eqNullSafe(F.col(i)) & (F.col(h) == F.col(t))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    out = keyed.join(told.where("NOT stays OR n > 1").select(i, t), same, "left_anti")
    repeated = keyed.join(told.where("stays AND n > 1").select(i, t), same, "left_semi").dropDuplicates([id_, h])
    return out.unionByName(repeated).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON sets.doc_id = reach.a GROUP BY sets.doc_id, s
"""

QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLES = {"op5_ngram_join": ORACLE}
