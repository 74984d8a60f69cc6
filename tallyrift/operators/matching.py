"""Matching names, keys and titles against catalogs and against one another; clusters of what was matched."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyrift.functions.scalars import norm, slug
from tallyrift.lineage import Scratch

#: Sizes of a cluster; larger components are flagged, single ones dropped.
SMALLEST, LARGEST = 2, 4
#: Points out of 100 from which a pair of titles is proposed.
PROPOSED = 45.0


def first_entry(catalog: DataFrame, name: str, order: str, key: str = "_key") -> DataFrame:
    """``catalog`` with the slug of each name as ``key``; of entries with one slug the first in ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return catalog.withColumn(key, slug(F.col(name))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_names(rows: DataFrame, name: str, catalog: DataFrame, catalog_name: str, order: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the ``keep`` columns of the catalog entry of their name, rows without one).

    Equal slugs match; names that are equal but for case have equal slugs.
    """
    entries = first_entry(catalog, catalog_name, order).select("_key", *(F.col(c).alias(f"_c_{c}") for c in keep))
    keyed = rows.withColumn("_key", slug(F.col(name)))
    found = keyed.join(entries, "_key").withColumns({c: F.col(f"_c_{c}") for c in keep}).drop("_key", *(f"_c_{c}" for c in keep))
    return found, keyed.join(entries.select("_key"), "_key", "left_anti").drop("_key")


def resolve(rows: DataFrame, name: str, hint: str, catalog: DataFrame, catalog_name: str, region: str, order: str, keep: Sequence[str]) -> DataFrame:
    """``rows`` with the catalog entry of their name, null where there is none or no telling which.

    One entry of a name is it. Of several that whose region is the hint, else the first in ``order`` whose region has the
    hint in it; without either none is, rather than a guess.
    """
    entries = catalog.select(norm(F.col(catalog_name)).alias("_key"), norm(F.col(region).cast("string")).alias("_region"), F.col(order).alias("_order"), F.struct(*keep).alias("_entry"))
    grouped = entries.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_order", "_region", "_entry"))).alias("_all"))
    said = norm(F.col(hint).cast("string"))
    pick = lambda test: F.get(F.filter("_all", lambda e: test(e["_region"])), 0)["_entry"]
    entry = F.when(F.size("_all") == 1, F.get("_all", 0)["_entry"]).otherwise(F.coalesce(pick(lambda r: r == said), pick(lambda r: F.contains(r, said))))
    joined = rows.withColumn("_key", F.when(F.col(name) != "", norm(F.col(name)))).join(grouped, "_key", "left").withColumn("_e", entry)
    return joined.select(*rows.columns, *(F.col(f"_e.{c}").alias(c) for c in keep))


def either_key(rows: DataFrame, key: str, fallback: str, catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``rows`` with the entry of their ``key``, else that of their ``fallback``; both are columns of the catalog too."""
    side = lambda c, tag: catalog.select(F.col(c).alias(f"_{tag}"), F.struct(*keep).alias(f"_{tag}_entry"))
    both = rows.join(side(key, "one"), F.col(key) == F.col("_one"), "left").join(side(fallback, "two"), F.col(fallback) == F.col("_two"), "left")
    return both.withColumn("_e", F.coalesce("_one_entry", "_two_entry")).select(*rows.columns, *(F.col(f"_e.{c}").alias(c) for c in keep))


def enrich(rows: DataFrame, cover: DataFrame, key: str, value: str, expected: int | None = None) -> DataFrame:
    """``rows`` with ``value`` set for the keys of ``cover``; others keep theirs.

    An error where the table isn't met by all, or by ``expected``, of the covering keys, or where a row has another value
    already: nothing is overwritten in silence.
    """
    new = cover.select(F.col(key).alias("_key"), F.col(value).alias("_new"))
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    clash = F.col("_new").isNotNull() & F.col(value).isNotNull() & (F.col(value) != F.col("_new"))
    told = joined.agg(F.count_if(F.col("_key").isNotNull()).alias("met"), F.count_if(clash).alias("clash")).first()
    wanted = cover.count() if expected is None else expected
    if told["met"] != wanted:
        raise ValueError(f"{told['met']} keys are covered, not {wanted}")
    if told["clash"]:
        raise ValueError(f"{told['clash']} rows have another value already")
    return joined.withColumn(value, F.coalesce("_new", value)).select(*rows.columns)


def key_differences(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, fault): keys that are wanted and missing, orphans that nobody wants, and those that are there more than once."""
    missing = want.select(key).distinct().join(have.select(key), key, "left_anti").withColumn("fault", F.lit("missing"))
    orphan = have.select(key).distinct().join(want.select(key), key, "left_anti").withColumn("fault", F.lit("orphan"))
    twice = have.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("duplicate").alias("fault"))
    return missing.unionByName(orphan).unionByName(twice)


def _common(s: str, t: str) -> int:
    """The length of the longest common subsequence; a row of the table is the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(s):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(s)) - 1
    for c in t:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & full
    return len(s) - row.bit_count()


def _likeness(s: str, t: str) -> float:
    return 200.0 * _common(s, t) / (len(s) + len(t)) if s or t else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best likeness among the words in common and either side's words, sorted."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, (both, " ".join(sorted(r))))) for r in (x - y, y - x))
    return max(_likeness(one, two), *((_likeness(both, one), _likeness(both, two)) if both else (0.0,)))


@F.pandas_udf(DoubleType())
def token_set(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``token_set_ratio`` of batches; equal pairs of a batch are scored once."""
    for a, b in pairs:
        known: dict[tuple, float] = {}
        out = []
        for p in zip(a.fillna(""), b.fillna(""), strict=True):
            if p not in known:
                known[p] = token_set_ratio(*p)
            out.append(known[p])
        yield pd.Series(out, dtype="float64")


def scored_pairs(rows: DataFrame, block: Sequence[str], order: str, title: str, least: float = PROPOSED) -> DataFrame:
    """(block, one, other, score, proposed): all pairs of a block in order, with ``token_set_ratio`` of their titles.

    For blocks all of whose pairs are asked for, as the reference asks for those of some chosen ones; the result has a row
    for each. Where only proposed pairs count, ``titles.proposed_pairs`` makes no others.
    """
    side = lambda name: rows.select(*block, F.col(order).alias(name), F.col(title).alias(f"_{name}"))
    pairs = side("one").join(side("other"), list(block)).where("one < other").repartition(*block, "one")
    return pairs.select(*block, "one", "other", token_set("_one", "_other").alias("score")).withColumn("proposed", F.col("score") >= least)


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """(node, root): root is the smallest node of the node's component.

    Every round each node takes the smallest label of its neighbours, and then its label's own; so paths halve, and there
    are about as many rounds as the logarithm of the longest. A round's labels are written, those of the round before deleted.
    """
    pairs = edges.select(F.col(one).alias("a"), F.col(other).alias("b"))
    with Scratch(edges.sparkSession, "components") as scratch:
        both = scratch.keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "both")
        labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
            took = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
            own = took.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.keep(took.join(own, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")), "labels")
            scratch.forget(labels)
            labels = jumped
            if jumped.where("old != root").isEmpty():
                scratch.forget(both)
                return jumped.select("node", "root")


def clusters(edges: DataFrame, one: str, other: str, smallest: int = SMALLEST, largest: int = LARGEST) -> DataFrame:
    """(node, root, size, kind): components of merges; ``cluster`` from ``smallest`` to ``largest`` members, beyond ``flagged``."""
    labels = components(edges, one, other)
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= smallest)
    return labels.join(sizes, "root").select("node", "root", "size", F.when(F.col("size") <= largest, "cluster").otherwise("flagged").alias("kind"))


def whole_blocks(blocks: DataFrame, order: Sequence[str], cost: Column, start: int, most: int) -> DataFrame:
    """Blocks in order while ``start`` and the running sum of their cost stay within ``most``; the first that would pass it
    ends the list. Blocks that cost something are at most as many as ``most``, so the running sum is of the first that
    many blocks only, whatever the table."""
    first = blocks.withColumn("_cost", cost).orderBy(*order).limit(most - start + 1)
    total = F.sum("_cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("_total", total + start).where(F.col("_total") <= most).drop("_cost", "_total")
