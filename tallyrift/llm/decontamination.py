"""Benchmark passages in training text, found by an FM-index of each shard of the corpus.

A shard's words are numbered and suffix-sorted; the Burrows-Wheeler transform is kept as a wavelet matrix with rank counts,
every 8th text position as a sample. A phrase is searched from its last word backwards, by two ranks a word; its places
are found by walking from a row of the index to the nearest sample. The index knows nothing of the phrases: it is a
table, written once, that any later benchmark can be searched in.

Phrases are packed into batches, and each batch meets each shard: a stated query set against all rows, in blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyrift.llm.common import documents, tidy, written

#: Words of a window; an item with fewer is one window.
WINDOW = 10
#: Bytes of text of a shard of the index; what a text has beyond them goes to the next, WINDOW - 1 of its words twice.
SHARD = 1 << 20
#: Text positions between samples.
EVERY = 8
#: Rows (window, item) of a batch, and places that are located at once.
BATCH, AT_ONCE = 8192, 1 << 18
#: Digits, letters and everything beyond ASCII make words; A-Z become a-z, all else a blank. In UTF-8, byte by byte.
PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Symbols in front of the words: the end of a shard, and what parts texts.
END, GAP = 0, 1

INDEX = "docs array<struct<key: long, doc_id: long, n_words: long>>, pieces array<struct<key: long, start: long, length: long>>, vocabulary binary, first binary, zeros binary, bits binary, ranks binary, samples binary"
FOUND = "key long, spans array<struct<start: long, stop: long>>, items array<long>"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``text``, whose last symbol is its only 0, in order.

    Suffixes are sorted by their first three symbols and then, while some agree, by as many symbols again as they are
    known to agree in. Only suffixes that still agree with another are sorted again.
    """
    n, width = len(text), max(1, int(text.max()).bit_length())
    if 3 * width > 63:
        raise ValueError("a shard has too many different words")
    wide = np.concatenate([text, np.zeros(2, text.dtype)]).astype(np.int64)
    key = (wide[:-2] << 2 * width) | (wide[1:-1] << width) | wide[2:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, sub, key = np.arange(n), order, key[order]
    length = 3
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        rank[sub] = slots[begin][np.cumsum(new) - 1]
        alike = ~(new & np.concatenate([new[1:], [True]]))
        sub, slots = sub[alike], slots[alike]
        if not len(sub):
            return order
        key = (rank[sub] << 32) | rank[sub + length]
        again = np.argsort(key)
        sub, key = sub[again], key[again]
        order[slots] = sub
        length *= 2


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits in words of 64, ones before each word)."""
    room = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
    room[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
    words = room.view("<u8")
    ones = np.bitwise_count(words).astype(np.uint32)
    return words, (np.cumsum(ones) - ones).astype("<u4")


class ShardIndex:
    """The FM-index of one shard's words."""

    def __init__(self, vocabulary: list[bytes], first: np.ndarray, zeros: np.ndarray, bits: np.ndarray, ranks: np.ndarray, samples: np.ndarray):
        self.vocabulary, self.first, self.zeros, self.samples = vocabulary, first, zeros, samples
        self.levels = len(zeros)
        self.bits, self.ranks = bits.reshape(self.levels + 1, -1), ranks.reshape(self.levels + 1, -1)

    @classmethod
    def of(cls, vocabulary: list[bytes], text: np.ndarray) -> ShardIndex:
        """``text``: numbers of words from 2 on in the vocabulary's order, GAP between texts, END behind the last."""
        suffixes = suffix_array(text)
        left, first = text[suffixes - 1], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(vocabulary) + 2))])
        bits, ranks, zeros = [], [], []
        for level in reversed(range((len(vocabulary) + 1).bit_length())):
            bit = (left >> level & 1).astype(bool)
            packed, before = _packed(bit)
            left = np.concatenate([left[~bit], left[bit]])
            bits.append(packed)
            ranks.append(before)
            zeros.append(len(bit) - int(bit.sum()))
        marked = suffixes % EVERY == 0
        packed, before = _packed(marked)  # behind the levels, as one more
        return cls(vocabulary, first.astype(np.int64), np.array(zeros, np.int64), np.concatenate([*bits, packed]), np.concatenate([*ranks, before]), suffixes[marked].astype("<u4"))

    def stored(self) -> dict[str, bytes]:
        return {"vocabulary": b"\n".join(self.vocabulary), "first": self.first.astype("<i8").tobytes(), "zeros": self.zeros.astype("<i8").tobytes(),
                "bits": self.bits.tobytes(), "ranks": self.ranks.tobytes(), "samples": self.samples.tobytes()}

    @classmethod
    def loaded(cls, row: dict) -> ShardIndex:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(row["vocabulary"].split(b"\n") if row["vocabulary"] else [], read("first", "<i8"), read("zeros", "<i8"), read("bits", "<u8"), read("ranks", "<u4"), read("samples", "<u4"))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        under = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word].astype(np.int64) + np.bitwise_count(self.bits[level][word] & under)

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where row i of the first level is in the last, by way of its symbol's bits."""
        for level in range(self.levels):
            bit, ones = (symbols >> (self.levels - 1 - level)) & 1, self._ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return i

    def search(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``steps``: a column for each phrase, from its last word backwards numbers of words here, or -1, and -2 before
        its first. (phrase, from, upto): rows of the suffixes that begin with it."""
        who = np.flatnonzero((steps != -1).all(axis=0))
        symbols = steps[0][who]
        low, high = self.first[symbols], self.first[symbols + 1]
        some = np.unique(steps[steps >= 0])
        base = np.zeros(len(self.first), np.int64)
        base[some] = self.first[some] - self._down(some, np.zeros(len(some), np.int64))
        for k in range(1, len(steps)):
            now = np.flatnonzero(steps[k][who] >= 0)
            if not len(now):
                break
            symbols = steps[k][who[now]]
            both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low[now], high[now]]))
            low[now], high[now] = base[symbols] + both[: len(now)], base[symbols] + both[len(now) :]
            left = low < high
            who, low, high = who[left], low[left], high[left]
        left = low < high
        return who[left], low[left], high[left]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows of the index."""
        out, here, steps = np.empty(len(rows), np.int64), rows, 0
        todo = np.arange(len(rows))
        while len(todo):
            word, bit = here >> 6, (here & 63).astype(np.uint64)
            done = (self.bits[self.levels][word] >> bit & np.uint64(1)).astype(bool)
            out[todo[done]] = self.samples[self._ones(self.levels, here[done])].astype(np.int64) + steps
            todo, here, steps = todo[~done], self._left(here[~done]), steps + 1
        return out

    def _left(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer to the left."""
        symbols, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in range(self.levels):
            bit = (self.bits[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones, before = self._ones(level, i), self._ones(level, start)
            i, start = np.where(bit == 1, self.zeros[level] + ones, i - ones), np.where(bit == 1, self.zeros[level] + before, start - before)
            symbols = symbols << 1 | bit
        return self.first[symbols] + i - start


def _pieces(text: bytes, most: int) -> Iterator[tuple[int, bytes, int]]:
    """(number of its first word, bytes, words that no earlier piece has) of the pieces of a text whose words are parted by
    blanks: one, unless it has over ``most`` bytes; a further piece begins with the last WINDOW - 1 words of the one before."""
    if len(text) <= most:
        yield 0, text, -1
        return
    at, n, kept = 0, 0, []
    while at < len(text):
        end = at + most
        cut = len(text) if end >= len(text) else text.rfind(b" ", at, end)
        if cut <= at:  # a word of that size
            cut = text.find(b" ", end)
            cut = len(text) if cut < 0 else cut
        words = text[at:cut].split()
        yield n - len(kept), b" ".join([*kept, text[at:cut]]), len(words)
        n, kept, at = n + len(words), [*kept, *words][1 - WINDOW :], cut + 1


class _Shard:
    """The texts of a shard as they come."""

    def __init__(self):
        self.docs: list[dict] = []
        self.pieces: list[tuple[int, int, bytes]] = []
        self.bytes = 0

    def add(self, doc: dict, start: int, text: bytes) -> None:
        if not self.docs or self.docs[-1] is not doc:
            self.docs.append(doc)
        self.pieces.append((doc["key"], start, text))
        self.bytes += len(text) + 1

    def row(self) -> dict:
        """The index, and what the texts' words are; those of a text in one piece are counted here."""
        joined = np.frombuffer(b" ".join([*(t for _, _, t in self.pieces), b" "]), np.uint8)
        inside = joined != 32
        begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        sizes = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]])) - begin
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]).dictionary_encode()
        numbers = words.indices.to_numpy().astype(np.int64) + 2
        ends = np.cumsum([len(t) + 1 for _, _, t in self.pieces])
        n = np.diff(np.searchsorted(begin, ends), prepend=0)
        text = np.insert(numbers, np.cumsum(n)[n > 0], GAP)
        text = np.concatenate([text[:-1], [END]])
        by_key = dict(zip((k for k, _, _ in self.pieces), n.tolist(), strict=True))
        docs = [d if d["n_words"] >= 0 else d | {"n_words": by_key[d["key"]]} for d in self.docs]
        pieces = [{"key": k, "start": s, "length": m} for (k, s, _), m in zip(self.pieces, n.tolist(), strict=True) if m]
        return {"docs": docs, "pieces": pieces} | ShardIndex.of(words.dictionary.to_pylist(), text).stored()


def corpus_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The FM-indexes of ``docs`` (doc_id, text), a row for each shard of ``shard`` bytes at most, with the documents in it.

    Every row of ``docs`` is listed once, with a key of its own, so repeated and null ids are told apart; null texts have no
    words. A word longer than a shard makes it longer. A long text's words may lie in several shards, WINDOW - 1 of them in two. Nothing is shuffled. Write the table
    before using it twice: keys hold for one run.
    """
    kind = pa.schema([("docs", pa.list_(pa.struct([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())]))), ("pieces", pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))),
                      *((c, pa.binary()) for c in ("vocabulary", "first", "zeros", "bits", "ranks", "samples"))])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = TaskContext.get().partitionId() << 40, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = {"key": key, "doc_id": doc_id, "n_words": -1}
                for start, part, more in _pieces(text.as_py().translate(PLAIN), shard):
                    if now.bytes and now.bytes + len(part) > shard:
                        yield pa.RecordBatch.from_pylist([now.row()], kind)
                        now = _Shard()
                    if more >= 0:
                        doc["n_words"] = max(0, doc["n_words"]) + more
                    now.add(doc, start, part)
                key += 1
        yield pa.RecordBatch.from_pylist([now.row()], kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(indexed, INDEX)


def phrase_batches(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, steps, items, known): the windows of ``items`` (item_id, text) and the items they are of, in batches.

    words are a batch's different words; steps has a row for each place from a window's last word backwards, with numbers of
    words, -2 before a short window's first. Items without words have no windows. A window that several items have is
    there for each. There are as many batches as the windows need, however many partitions the session has.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().translate(PLAIN).split()
                found = list(dict.fromkeys(b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1)))) if words else []
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.int64())], ["window", "item"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                windows = [w.split(b" ")[::-1] for w in part.column(0).to_pylist()]
                numbers: dict[bytes, int] = {}
                steps = np.full((window, len(windows)), -2, np.int32)
                for i, w in enumerate(windows):
                    steps[: len(w), i] = [numbers.setdefault(x, len(numbers)) for x in w]
                of = part.column(1)
                cells = [b"\n".join(numbers), steps.tobytes(), of.fill_null(0).to_numpy().tobytes(), of.is_valid().to_numpy(zero_copy_only=False).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells], ["words", "steps", "items", "known"])

    rows = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(cut, "window binary, item long").distinct(), "windows")
    return rows.repartition(max(1, -(-rows.count() // BATCH))).mapInArrow(packed, "words binary, steps binary, items binary, known binary")


class _Phrases:
    """A batch of ``phrase_batches``."""

    def __init__(self, row: dict):
        self.of = row["words"], row["steps"]
        self.words = row["words"].split(b"\n")
        self.items, self.known = np.frombuffer(row["items"], np.int64), np.frombuffer(row["known"], bool)
        self.steps = np.frombuffer(row["steps"], np.int32).reshape(-1, len(self.items))
        self.sizes = (self.steps >= 0).sum(axis=0)

    def within(self, vocabulary: list[bytes]) -> np.ndarray:
        """The steps in a shard's numbers, -1 for words that it doesn't have."""
        numbers = {w: i for i, w in enumerate(vocabulary, 2)}
        own = np.array([*(numbers.get(w, -1) for w in self.words), -2], np.int64)
        return own[np.where(self.steps < 0, len(self.words), self.steps)]


def _found(row: dict, phrases: _Phrases) -> Iterator[pa.RecordBatch]:
    """What a batch of phrases finds in a shard: (key, spans, items) of each text with a window."""
    index = ShardIndex.loaded(row)
    which, low, high = index.search(phrases.within(index.vocabulary))
    n = high - low
    upto, total = np.cumsum(n), int(n.sum())
    if not total:
        return
    lengths, keys, begins = (np.array([p[c] for p in row["pieces"]], np.int64) for c in ("length", "key", "start"))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    edges = np.zeros(int(starts[-1]) + 1, np.int64)
    of: set[tuple[int, int]] = set()
    for at in range(0, total, AT_ONCE):
        nth = np.arange(at, min(total, at + AT_ONCE))
        w = np.searchsorted(upto, nth, "right")
        places, w = index.locate(low[w] + nth - (upto[w] - n[w])), which[w]
        np.add.at(edges, places, 1)
        np.add.at(edges, places + phrases.sizes[w], -1)
        known = phrases.known[w]
        pairs = np.unique(np.stack([keys[np.searchsorted(starts, places[known], "right") - 1], phrases.items[w[known]]]), axis=1)
        of.update(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True))
    turn = np.diff(np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    piece = np.searchsorted(starts, begin, "right") - 1
    shift = begins[piece] - starts[piece]
    spans, items = defaultdict(list), defaultdict(list)
    for key, a, b in zip(keys[piece].tolist(), (begin + shift).tolist(), (end + shift).tolist(), strict=True):
        spans[key].append({"start": a, "stop": b})
    for key, item in of:
        items[key].append(item)
    yield pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int64()), pa.array(list(spans.values()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([items[k] for k in spans], pa.list_(pa.int64()))], ["key", "spans", "items"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if phrases is None or phrases.of != (row["words"], row["steps"]):
                phrases = _Phrases(row)
            yield from _found(row, phrases)


@F.pandas_udf(ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())])))
def merged(spans: pd.Series) -> pd.Series:
    """Sorted spans; those that touch or overlap become one."""
    def one(some) -> list[dict]:
        out: list[dict] = []
        for a, b in sorted((int(s["start"]), int(s["stop"])) for s in some):
            if out and a <= out[-1]["stop"]:
                out[-1]["stop"] = max(out[-1]["stop"], b)
            else:
                out.append({"start": a, "stop": b})
        return out

    return spans.map(one)


def removal_spans(index: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, spans, items) of every document of ``index``, a written table of ``corpus_index``.

    Spans are runs of words to be removed, numbered from 0, the end exclusive, without overlap; items are those with a
    window in the text, rows of one item_id being one item. An item without an id has its spans and isn't listed.
    """
    batches = written(phrase_batches(items), "phrases")
    parts = index.select("pieces", "vocabulary", "first", "zeros", "bits", "ranks", "samples").crossJoin(batches).mapInArrow(_searched, FOUND)
    hits = parts.groupBy("key").agg(merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    texts = index.select(F.explode("docs").alias("d")).select("d.*").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    none = lambda like: F.array().cast(like)
    return texts.join(hits, "key", "left").select("key", "doc_id", "n_words", F.coalesce("spans", none("array<struct<start: long, stop: long>>")).alias("spans"), F.coalesce("items", none("array<long>")).alias("items"))


def without(text: str | None, spans: list) -> str:
    """``text`` without the words of ``spans``, each run with what lies between its words."""
    raw = (text or "").encode()
    if not len(spans):
        return text or ""
    places = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : places[s["start"]][0]])
        at = places[s["stop"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


@tidy
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that lie in a window of a benchmark item.

    Null and empty texts and items have no words and no windows. Repeated rows are answered each for itself; ids may be
    null. An empty table of documents gives an empty result, an empty benchmark one without hits. Other columns, whatever
    their names, are not read.
    """
    index = written(corpus_index(documents(spark, sf_dir)), "index")
    spans = removal_spans(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return spans.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)),
h AS (SELECT r, i, n, item_id FROM p JOIN win USING (g, n)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h), unnest(range(i, i + n)) u(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {"op13_decontamination": op13_decontamination}
ORACLES = {"op13_decontamination": ORACLE}
