"""Document fingerprints by MinHash.

A text's shingles of WORDS words are hashed; each of PERMUTATIONS universal hash functions (multiply-shift) orders
them, and the smallest value under each is the signature. The share of equal places estimates the Jaccard similarity.
Bands of a signature that agree propose near copies, which their shingles then verify.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import bucketed, documents, in_set, tidy, whole, written
from tallyrift.llm.graph import components
from tallyrift.llm.ngram_join import BLOCK, FOLLOWERS, Limits, search

WORDS, PERMUTATIONS = 5, 128
#: Bands of 4 rows: at a similarity of 0.8 two texts share none of 32 with a probability of 5e-8.
ROWS = 4
#: Documents of a range of ids; ranges at most.
RANGE, RANGES = 4000, 4096
#: Shingles that are permuted at once.
AT_ONCE = 8192

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, (2, PERMUTATIONS), np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Hashes of the runs of ``words`` lower-case words of texts; a shorter text is one run, one without words has none."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, how many of each text)"""
        import xxhash

        digest, split = xxhash.xxh3_64_intdigest, [t.lower().split() for t in texts]
        flat = [w for ws in split for w in ws]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        try:  # a word is hashed wherever it stands: a table of words takes longer than that, and memory
            h = np.fromiter(map(digest, flat), np.uint64, len(flat))
        except UnicodeEncodeError:  # half a surrogate pair
            h = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in flat), np.uint64, len(flat))
        h = np.append(h, np.zeros(self.words, np.uint64))
        out, n = np.zeros(len(flat), np.uint64), len(flat)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        for i in range(self.words):
            x = (out * _ODD) + np.where(left > i, h[i : i + n], np.uint64(i))
            out = (x ^ (x >> np.uint64(31))) * _MIX
            out ^= out >> np.uint64(29)
        keep = (left >= self.words) | (place == 0)
        return out[keep], np.where(sizes > 0, np.maximum(sizes - self.words + 1, 1), 0)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) of 32-bit minima; all ones where a text has no shingles."""
    out = np.full((PERMUTATIONS, len(counts)), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), AT_ONCE):
        x, who = hashes[at : at + AT_ONCE], owner[at : at + AT_ONCE]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        texts, y = who[first], np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _FACTORS[0, p], out=y)
            np.add(y, _FACTORS[1, p], out=y)
            least = np.minimum.reduceat(y, first) >> np.uint64(32)  # the order of the upper halves is that of the whole numbers
            out[p, texts] = np.minimum(out[p, texts], least.astype(np.uint32))
    return np.ascontiguousarray(out.T)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one == other).mean(1)


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as much of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in reading order by range, each range ended by the first row of the next (``peek``). A row without a text
    tells the class of the following ones."""
    shingles = Shingles()
    open_: tuple | None = None  # the row whose next one has not come yet
    class_: int | None = None

    def told(rows: list[tuple]) -> pd.DataFrame:
        """rows: (doc_id, text, next text, class)"""
        own, following = [r[1] for r in rows], [r[2] for r in rows]
        new = [edited(a, b) for a, b in zip(own, following, strict=True)]
        once = list(dict.fromkeys([*own, *following, *new]))
        sig = signatures(*shingles(once))
        at = {t: i for i, t in enumerate(once)}
        a, b, c = (sig[[at[t] for t in x]] for x in (own, new, following))
        return pd.DataFrame({
            "doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "n_chars": [len(t) for t in own],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
            "fingerprint": [x.tobytes().hex() for x in a], "edited_fingerprint": [x.tobytes().hex() for x in b],
            "near_edited": likeness(a, b), "near_next": likeness(a, c), "class_id": pd.array([r[3] for r in rows], dtype="Int64")})

    for rows in batches:
        ready, size = [], 0
        for doc, part, peek, text, named in zip(rows["doc_id"].array, rows["part"], rows["peek"], rows["text"], rows["class_id"].array, strict=True):
            if text is None:
                class_ = None if pd.isna(named) else int(named)
                continue
            if open_ and open_[0] == part:
                ready.append((open_[1], open_[2], text, open_[3]))
                size += len(text)
            open_ = None if peek else (part, None if pd.isna(doc) else int(doc), text, class_)
            if size > 1_000_000:
                yield told(ready)
                ready, size = [], 0
        if ready:
            yield told(ready)


@tidy
def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) and of each text edited with the next one, by descending id; see ``edited``.

    Null texts are empty; null ids come last; rows with equal ids follow the hashes of their texts, and rows equal in
    both are next to each other. A lone document is its own next. One shuffle of the texts, by ranges of ids of about
    RANGE rows; a range also gets the first row of the next one. The driver sees two numbers a range, RANGES at most.
    class_id is that of ``near_classes``; it travels to the ranges as rows of numbers, before the texts' rows.
    """
    classes = near_classes(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    rows = rows.withColumns({"k": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    n = min(RANGES, max(1, -(-rows.count() // RANGE)))
    cuts = sorted({int(x) for x in rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] or ()}) if n > 1 else []
    # Fewer than RANGES bounds: the place of a key among them is found by counting them, in steps of a square root.
    lows = [-(2**63), *cuts]
    step = max(1, int(len(lows) ** 0.5))
    coarse, fine = lows[::step], [lows[i : i + step] for i in range(0, len(lows), step)]
    at = F.size(F.filter(F.lit(coarse), lambda x: x <= F.col("k"))) - 1
    inner = F.size(F.filter(F.get(F.array(*(F.lit(f) for f in fine)), F.col("_at")), lambda x: x <= F.col("k"))) - 1
    in_part = lambda df: df.withColumn("_at", at).withColumn("part", F.col("_at") * step + inner).drop("_at")
    rows = in_part(rows)
    heads = {r["part"]: (r["k"], r["h"]) for r in rows.groupBy("part").agg(F.max(F.struct("k", "h")).alias("m")).select("part", "m.*").collect()}
    order = sorted(heads, reverse=True)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first row of all comes after the last range
    peeks = docs.sparkSession.createDataFrame([(k, h, p) for (k, h), p in before.items()], "k long, h long, ahead int")
    told = rows.join(F.broadcast(peeks), ["k", "h"], "left").select("doc_id", "text", "k", "h", "part", "ahead")
    both = F.when(F.col("ahead").isNull(), F.array(F.struct("part", F.lit(False).alias("peek")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("peek")), F.struct(F.col("ahead").alias("part"), F.lit(True).alias("peek"))))
    dealt = told.select("doc_id", "text", "k", "h", F.inline(both))
    tells = classes.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).groupBy("k", "h").agg(F.min("class_id").alias("class_id"))
    tells = in_part(tells).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "k", "h", "part", F.lit(False).alias("peek"), "class_id")
    dealt = dealt.withColumn("class_id", F.lit(None).cast("long")).unionByName(tells).repartition("part")
    return dealt.sortWithinPartitions("part", "peek", F.desc("k"), F.desc("h"), F.col("text").isNotNull()).select("doc_id", "part", "peek", "text", "class_id").mapInPandas(_compared, _OUT)


def _portions(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _gram_sets(shingles: Shingles, texts: list[str], signed: bool = False) -> Iterator[tuple[int | None, np.ndarray, np.ndarray | None]]:
    """(name of the set, its sorted hashes, signature if ``signed``) of each text; a text without words has no name."""
    for some in _portions(texts):
        hashes, counts = shingles(some)
        sig = signatures(hashes, counts) if signed else [None] * len(some)
        for part, own in zip(np.split(hashes, np.cumsum(counts)[:-1]), sig, strict=True):
            grams = np.unique(part)
            yield (int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None), grams, own


def near_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, h, class_id) of each row, h the hash of its text: classes of texts that share a band and are linked by a
    verified Jaccard similarity, over any number of links; class_id is the smallest id of a class, null if it has none.

    Texts with equal sets are one member. The members of all bands with the same smallest member form a block. Each is
    checked against the leader that it shares most bands with; blocks that then still span several components are
    searched whole, so that every pair of a band is linked over others or was compared. Documents without words are
    classes of their own.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("h", F.xxhash64("text"))

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingles(), set()
        for rows in batches:
            names, bands = [], []
            for name, _, sig in _gram_sets(shingles, rows["text"].tolist(), True):
                names.append(name)
                shown = None
                if name is not None and name not in seen:
                    seen.add(name)
                    sig = sig.view(np.uint64).reshape(PERMUTATIONS // ROWS, ROWS // 2)
                    shown = ((sig[:, 0] * _ODD + sig[:, 1]) * _MIX + np.arange(PERMUTATIONS // ROWS, dtype=np.uint64)).view(np.int64)
                bands.append(shown)
            yield pd.DataFrame({"doc_id": pd.array(rows["doc_id"].array, dtype="Int64"), "h": rows["h"], "name": pd.array(names, dtype="Int64"), "bands": bands})

    members = written(source.mapInPandas(banded, "doc_id long, h long, name long, bands array<long>"), "bands")
    # A running first value needs no buffer. A set comes again from other tasks that have copies of it.
    band = members.where("bands IS NOT NULL").select("name", F.explode("bands").alias("band"))
    first = F.min("name").over(Window.partitionBy("band").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = band.select("name", "band", first.alias("lead")).where("name != lead").groupBy("name", "lead").agg(F.count(F.lit(1)).alias("c"))
    led = written(led, "led")
    blocks = led.select(F.col("lead").alias("sig"), "name").unionByName(led.select(F.col("lead").alias("sig"), F.col("lead").alias("name")).distinct())

    # Their grams, from one text each.
    chosen = members.join(blocks.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("h").alias("h"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingles(), set()
        for rows in batches:
            out = []
            for name, grams, _ in _gram_sets(shingles, rows["text"].tolist()):
                if name is not None and name not in seen:
                    seen.add(name)
                    out.append((name, grams.tobytes()))
            yield pd.DataFrame(out, columns=["name", "grams"])

    some = in_set(source, written(chosen, "chosen"), "h", "_in").where("_in").select("text")
    sets, drop_sets = bucketed(some.mapInPandas(again, "name long, grams binary"), "name", "near_grams")

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name", kind="stable")
        found = search([np.frombuffer(g, np.uint64) for g in rows["grams"]], rows["name"].tolist(), rows["root"].tolist(), rows["asks"].tolist(), Limits(percent, 100))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def searched(cells: DataFrame) -> DataFrame:
        """Links between the sets of a cell (sig, deal, asker) that ask and its others."""
        return written(written(cells, "cells").join(sets, "name").groupBy("sig", "deal", "asker").applyInPandas(cell, "a long, b long"), "links")

    dealt = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    best = written(led.groupBy("name").agg(F.max_by("lead", F.struct("c", "lead")).alias("sig")), "best")
    sizes = best.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("deals"))
    followers = best.join(sizes, "sig").select("sig", "name", dealt("deals").alias("deal"), F.lit(False).alias("asks"))
    leaders = sizes.select("sig", F.col("sig").alias("name"), each("deals").alias("deal"), F.lit(True).alias("asks"))
    links = searched(followers.unionByName(leaders).withColumns({"asker": F.lit(0), "root": F.col("name")}))
    comps = components(links)

    # Blocks that span components. The sets of the largest one needn't ask each other; both sides are dealt to tasks.
    named = written(blocks.join(comps, F.col("name") == F.col("node"), "left").select("sig", "name", F.coalesce("root", "name").alias("root")), "named")
    shares = named.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("sig")
    many = shares.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("total > most").select(
        "sig", "main", F.ceil(F.col("total") / BLOCK).cast("int").alias("deals"), F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("askers"))
    rows = named.join(many, "sig").withColumn("asks", F.col("root") != F.col("main"))
    told = rows.select("sig", "name", "root", F.lit(False).alias("asks"), dealt("deals").alias("deal"), each("askers").alias("asker"))
    asked = rows.where("asks").select("sig", "name", "root", "asks", each("deals").alias("deal"), dealt("askers").alias("asker"))
    more = searched(told.unionByName(asked).groupBy("sig", "deal", "asker", "name", "root").agg(F.max("asks").alias("asks")))
    drop_sets()
    comps = components(links.unionByName(more))

    least = members.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    rooted = written(least.join(comps, F.col("name") == F.col("node"), "left").select("name", F.coalesce("root", "name").alias("root"), "least"), "rooted")
    by_name = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("name", "class_id")
    return members.select("doc_id", "h", "name").join(written(by_name, "by_name"), "name", "left").select(
        "doc_id", "h", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


@tidy
def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row, those with a null id too; see ``near_classes``. ``similarity`` counts in whole hundredths."""
    return near_classes(docs, round(similarity * 100)).select("doc_id", "class_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's and its class of near copies; see ``fingerprints``."""
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLES: dict[str, str] = {}
