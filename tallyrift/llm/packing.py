"""Packing documents into token sequences: best-fit decreasing over a segment tree of remaining capacities.

Documents longer than a sequence are cut into full windows first; what is left of each goes to the open sequence with
the least room that still takes it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, small_side, tidy, written

LENGTH, END = 2048, 1
#: Pieces that are packed together. What a bundle wastes is its few last, half-filled sequences.
BUNDLE = 4000
#: Blank runs that tiktoken's matcher is not given; it fails between 100,000 and 1,000,000.
_BLANK = re.compile(r"\s{10000}")
#: What is known of a piece.
_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


class CapacityTree:
    """Open windows by remaining capacity. Inner nodes count the windows below them."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def open(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the smallest capacity of ``need`` or more: (capacity, window), or None."""
        at = self.base + need
        while not self.count[at]:  # climb to the next subtree on the right that has a window
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.base:
            at *= 2
            at += not self.count[at]
        capacity = at - self.base
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its window, numbered from 0, and its offset there. Ties keep their order."""
    tree, opened = CapacityTree(most), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, opened = (most, opened), opened + 1
        capacity, window[i] = found
        offset[i] = most - capacity
        if capacity > need:
            tree.open(capacity - need, int(window[i]))
    return window, offset


@lru_cache(1)
def _encoder(ranks_path: str, pattern: str, path: str) -> Callable[[str], Sequence[int]]:
    """The ids that the tokenizer of ``path`` gives a text, without a template's.

    tiktoken finds the same ids sooner from the same ranks, but its matcher fails on very long blank runs; such texts go
    to the tokenizer itself. Special tokens in a text are single ids in both.
    """
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    special = {t.content: i for i, t in plain.get_added_tokens_decoder().items()}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)

    def encode(text: str) -> Sequence[int]:
        if _BLANK.search(text):
            return plain.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def tokenizer_files() -> tuple[str, str, str]:
    """The vocabulary's ranks, its splitting pattern, and the tokenizer whose ids count."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: tuple[str, str, str] | None = None, place: Sequence[str] = ()) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of each text's ids with ``end`` behind them.

    A null text is the empty one, whose only id is ``end``. Every piece but a document's last is a full window. Of the
    ids only checksums leave the task: packing needs lengths alone. ``place`` names the columns of a row's place in a mixture, whole
    numbers, which stay; others don't, whatever their names. Repeated rows and null ids are cut each for itself; an empty
    table has no pieces.
    """
    files = vocabulary or tokenizer_files()
    if set(place) & set(_PIECE):
        raise ValueError(f"a place can't be named like one of {_PIECE}")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(*files)
        for rows in batches:
            out: dict[str, list] = {k: [] for k in (*_PIECE, *place)}
            for doc, text, *at_ in zip(rows["doc_id"].array, rows["text"], *(rows[c].array for c in place), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    for k, v in zip(out, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), *at_), strict=True):
                        out[k].append(v)
            whole = {k: pd.array([None if pd.isna(x) else int(x) for x in out[k]], dtype="Int64") for k in ("doc_id", *place)}
            yield pd.DataFrame(out | whole)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).cast("long").alias(c) for c in place)).mapInPandas(pieces, _kind(place))


def _kind(place: Sequence[str], *more: str) -> str:
    return ", ".join(f"{c} long" for c in (*_PIECE, *place, *more))


def pack(pieces: DataFrame, length: int = LENGTH, bundle: int = BUNDLE, place: Sequence[str] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    With ``place``, columns of whole numbers of which the first counts from one end of a mixture to the other, pieces are
    dealt to bundles by ranges of it, of ``bundle`` pieces on average, and sequences are numbered by the first place
    among their pieces; within a bundle lengths decide what shares one. A range with over twice as many pieces, as where
    places are alike, is dealt further by a hash, and so are pieces without a place, behind the others. Without ``place`` all are dealt by a hash of their place in the
    document and their content. Each bundle is packed on its own in one task's memory; so no task grows with the corpus.
    Equal rows are packed each for itself. An empty table gives an empty table.
    """
    first = F.col(place[0]) if place else F.lit(None).cast("long")
    sizes = pieces.agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.max(first).alias("last")).first()
    bundles = max(1, -(-sizes["n"] // bundle))
    spread = F.xxhash64("doc_id", "start", "ids_crc32", *place)
    deal, further = F.pmod(spread, F.lit(bundles)), F.lit(0).cast("long")
    dealt = pieces
    if place:
        width = -(-((sizes["last"] or 0) - (sizes["first"] or 0) + 1) // bundles)
        deal = F.coalesce(F.floor((first - F.lit(sizes["first"] or 0)) / F.lit(width)), deal + bundles)
        many = pieces.groupBy(deal.alias("_many")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * bundle)
        dealt = pieces.withColumn("_bundle", deal).join(small_side(many), F.col("_bundle") == F.col("_many"), "left")
        further = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(spread), F.least(F.ceil(F.col("_n") / bundle), F.lit(1 << 20)))).otherwise(0)
    order = [*place, "start", "doc_id", "ids_crc32"] if place else ["doc_id", "start", "ids_crc32"]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="first")
        window, offset = best_fit_decreasing(rows["length"].to_numpy(np.int64), length)
        if place:
            begin = np.unique(window, return_index=True)[1]
            window = np.argsort(np.argsort(begin))[window]
        return rows.drop(columns=["_bundle", "_further"]).assign(sequence_id=(int(key[0]) << 40) + (int(key[1]) << 20) + window, offset=offset)

    named = dealt.withColumns({"_bundle": deal, "_further": further}).select(*_PIECE, *place, "_bundle", "_further")
    return named.groupBy("_bundle", "_further").applyInPandas(packed, _kind(place, "sequence_id", "offset"))


@tidy
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; see ``cut`` and ``pack``. Of the table doc_id and text are read."""
    return pack(written(cut(documents(spark, sf_dir).select("doc_id", "text")), "pieces"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
