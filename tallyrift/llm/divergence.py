"""How far the sources of a language lie apart in their terms, and which terms set a source apart.

Terms of a language with the same counts in the same sources have one sparse count vector. What a pair of sources gets
from a term depends on its vector alone, so every pair is evaluated once for each distinct vector and multiplied by the
number of its terms; only the ranking of terms goes back to the terms themselves.

Within a vector only pairs of sources that both have the term are visited. What a source has alone, and what nobody has,
follows from counts of counts: with f(i, j) = f0(i, j) where neither has the term,

    sum of f(i, j) = V * f0 + sum over i's terms (f(p, q0) - f0) + sum over j's terms (f(p0, q) - f0)
                   + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f0)

so a language with many sources costs as many pairs as its vectors hold, not the square of its sources for each vector.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, small_side, tidy, written

#: Documents of its language in which a term has to be, and places of the report on terms.
LEAST, RANKS = 3, 200
#: Different terms that a task counts before it hands them on.
HELD = 300_000
#: Pairs that numpy evaluates at once.
PAIRS = 2_000_000
#: Groups of a language and a source, rows of three numbers and two names, that are broadcast at most.
GROUPS = 100_000
#: Bytes of a text from which its words are counted one by one, so that no list of them is made.
LONG = 1 << 22
#: Letters and everything beyond ASCII, in UTF-8 and after A-Z became a-z.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, and a row without a term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()),
                     pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            text = text.lower()
            if len(text) < LONG:
                words = TERM.findall(text)
                n.update(words)
                docs.update(set(words))
            else:
                own = Counter(m[0] for m in TERM.finditer(text))
                n.update(own)
                docs.update(own.keys())
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def term_vectors(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, vector) of terms in at least ``least`` documents of their language; vector is the sorted array of
    (source, n). A row without a term lists the sources of each language.

    Null text, lang and source are ''. Repeated rows are documents of their own. One shuffle, of counts.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = docs.select(*groups, text).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    dealt = counts.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return whole.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def _share(count: str | int, total: str, terms: str) -> Column:
    """The smoothed share of a count in parts of 1,000,000,000, 1 at least."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * 1000000000) div ({total} + {terms})")


def _excess(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of sources that a vector has both: what it adds beyond what either has alone, times its terms."""
    f = lambda p, q: (p - q) ** 2 // q
    for batch in batches:
        lists = batch.column("entries")
        flat = lists.flatten()
        g, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("gid", "p", "p0"))
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        times, each = batch.column("times").to_numpy()[row], sizes[row].astype(np.int64)
        first, upto = (np.cumsum(sizes) - sizes)[row], np.cumsum(each)
        at = 0
        while at < len(g):  # entries whose pairs are at most PAIRS, one entry at least
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = each[at:end]
            i = np.repeat(np.arange(at, end), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
            i, j = i[i != j], j[i != j]
            ids, local = np.unique(np.concatenate([g[i], g[j]]), return_inverse=True)
            pairs, inverse = np.unique(local[: len(i)] * len(ids) + local[len(i) :], return_inverse=True)
            value = np.zeros(len(pairs), np.int64)
            np.add.at(value, inverse, times[i] * (f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])))
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(ids)]), pa.array(ids[pairs % len(ids)]), pa.array(value)], ["gid", "other", "value"])
            at = end


@tidy
def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs``; see the query.

    Sums hold while a language has under 10^9 kept terms. Groups are broadcast if counted to be few, else joined by
    shuffles; the result has a row for each pair of them.
    """
    terms = written(term_vectors(docs, least), "terms")
    kept = terms.where("term IS NOT NULL")
    vectors = written(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    listed = vectors.select("lang", "times", F.explode("vector").alias("e"))
    totals = listed.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("times") * F.col("e.n")).alias("total"))
    sizes = vectors.groupBy("lang").agg(F.sum("times").alias("terms"))
    present = terms.where("term IS NULL").select("lang", F.explode("vector.source").alias("source"))
    groups = small_side(
        present.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
        .withColumn("p0", F.when(F.col("terms") > 0, _share(0, "total", "terms"))).withColumn("gid", F.monotonically_increasing_id()), GROUPS)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    langs = F.broadcast(langs) if langs.count() <= GROUPS else langs

    entries = written(
        vectors.select("lang", "vid", "times", F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("whole"), F.explode("vector").alias("e"))
        .select("lang", "vid", "times", "whole", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
        .join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")), "entries")

    # pairs: what nobody has, what one has alone, what both have
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    none = groups.join(other, "lang").where("gid != other").select("gid", "other", F.expr(f"coalesce(terms * ({_excess('p0', 'q0')}), 0L)").alias("value"))
    alone = entries.groupBy("lang", "gid", "p", "p0").agg(F.sum("times").alias("times")).join(other, "lang").where("gid != other").groupBy("gid", "other").agg(
        F.sum(F.expr(f"times * ({_excess('p', 'q0')} - {_excess('p0', 'q0')})")).alias("to"), F.sum(F.expr(f"times * ({_excess('q0', 'p')} - {_excess('q0', 'p0')})")).alias("back"))
    both = entries.groupBy("vid").agg(F.first("times").alias("times"), F.collect_list(F.struct("gid", "p", "p0")).alias("entries")).select("times", "entries").mapInArrow(_both, "gid long, other long, value long")
    summed = (none.unionByName(alone.select("gid", "other", F.col("to").alias("value"))).unionByName(alone.select(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("value")))
              .unionByName(both).groupBy("gid", "other").agg(F.sum("value").alias("value")))
    named = summed.join(groups.select("gid", "lang", "source"), "gid").join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    order = [F.desc("value"), F.asc("item")]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pair = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))

    # terms: which counts can be among the first, then the terms that have them, dealt further by their hash before the end
    counts = entries.groupBy("lang", "source", "n", "whole", "p", "terms").agg(F.count(F.lit(1)).alias("_")).join(langs, "lang").withColumn("q", _share("whole", "lang_total", "terms"))
    better = counts.where("p > q").select("lang", "source", "n", "whole", F.expr(_excess("p", "q")).alias("value"))
    first = better.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= ranks).drop("_r")
    first = small_side(first, GROUPS)
    shown = (kept.select("lang", F.col("term").alias("item"), F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("whole"), F.explode("vector").alias("e"))
             .select("lang", "item", "whole", F.col("e.source").alias("source"), F.col("e.n").alias("n")).join(first, ["lang", "source", "n", "whole"]))
    dealt = shown.withColumn("_deal", F.pmod(F.xxhash64("item"), F.lit(64)))
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "source", "_deal").orderBy(*order))).where(F.col("_r") <= ranks)
    term = some.select("lang", "source", F.lit("term").alias("part"), "item", "value", place.alias("rank")).where(F.col("rank") <= ranks)
    return pair.unionByName(term)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source of a language: all its other sources by how far it lies from them (part ``pair``), and the 200 terms
    that it has beyond its language's share (part ``term``).

    A language's kept terms are those in 3 of its documents. A group without terms, with null or empty texts only, is a
    source like any other: its shares are even. A language without kept terms has pairs of value 0 and no terms; one with a
    single source has no pairs. Ties go by the item's UTF-8 bytes. An empty table gives an empty result; other columns of
    the table, whatever their names, are not read.
    """
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + v.v)::HUGEINT)::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.whole + 1) // (v.n + v.v)::HUGEINT)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""

QUERIES = {"op11_divergence": op11_divergence}
ORACLES = {"op11_divergence": ORACLE}
