"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text: documents labelled as good. Its counts are a table, sharded by gram; orders are
joined with their contexts' totals and with the order below (Chen and Goodman). To score, documents are dealt to
blocks; a block's distinct grams are joined with the model and come back to the block, so what is shuffled besides the
text itself is a fraction of it, however large the model is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  pa.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, in_set, small_side, tidy, whole, written

#: Characters of a gram, packed in 16 bits each; characters beyond those count as one.
ORDER = 4
BEGIN, END, ELSE, RARE = 1, 2, 3, 0xFFFF
#: Bytes of text in a block; characters that are looked up at once.
BLOCK, AT_ONCE = 8 << 20, 1 << 20
#: A document is dropped beyond this quantile of its language's trusted documents, with this margin.
QUANTILE, MARGIN = 0.99, 1.15
#: Languages, a number and a name each, that are broadcast at most.
LANGUAGES = 100_000
#: Characters to which a unigram's last share is spread.
ALPHABET = 65_536


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the packed gram that ends at each character and at each text's end, how many of each text).

    The markers' own characters, U+0001 and U+0002, count as U+0003 in a text; U+0000 and all beyond U+FFFE are one symbol.
    """
    pad = chr(BEGIN) * (ORDER - 1)
    texts = [t.replace(chr(BEGIN), chr(ELSE)).replace(chr(END), chr(ELSE)) if chr(BEGIN) in t or chr(END) in t else t for t in texts]
    data = "".join(f"{pad}{t}{chr(END)}" for t in texts).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(data, "<u4")
    c = np.where(c > RARE, RARE, c).astype(np.uint64)
    c[c == 0] = RARE
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = len(c) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | c[i : n + i]
    begin = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    keep = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    return out[keep], sizes


def portions(texts: list[str], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + ORDER
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = [t or "" for t in rows["text"]]
        for a, b in portions(texts):
            keys, counts = np.unique(grams(texts[a:b])[0], return_counts=True)
            yield pd.DataFrame({"key": keys.view(np.int64), "c": counts})


def _context(n: int):
    return F.shiftrightunsigned("key", 16) if n > 1 else F.lit(0).cast("long")


def _suffix(n: int):
    return F.col("key").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; 4 numbers come to the driver."""
    row = counts.agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    n = [float(x or 0) for x in row]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]


@tidy
def train(trusted: DataFrame) -> DataFrame:
    """(key, lp, lg): the log probability of each gram of 1 to ORDER characters, and the log of the share that it gives
    to the order below as a context. Null texts are empty; without rows the model is one of the end alone.
    """
    top = trusted.select(whole().alias("text")).mapInPandas(_counted, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    counts = {ORDER: written(top, "grams")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(_suffix(n + 1).alias("key")).agg(F.count(F.lit(1)).alias("c")), "grams")
    below: DataFrame | None = None
    models = []
    for n in range(1, ORDER + 1):
        d = _discounts(counts[n])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[n].withColumns({"ctx": _context(n), "cut": cut})
        totals = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("spared"))
        rows = rows.join(totals, "ctx").withColumn("own", (F.col("c") - F.col("cut")) / F.col("total"))
        share = F.col("spared") / F.col("total")
        if below is None:
            now = rows.select("key", (F.col("own") + share / ALPHABET).alias("p"))
        else:
            low = below.select(F.col("key").alias("low"), F.col("p").alias("less"))
            now = rows.withColumn("low", _suffix(n)).join(low, "low").select("key", (F.col("own") + share * F.col("less")).alias("p"))
        below = written(now, "probabilities")
        models.append(below.select("key", F.log("p").alias("lp"), F.lit(None).cast("double").alias("lg")))
        models.append(totals.select(F.col("ctx").alias("key"), F.lit(None).cast("double").alias("lp"), F.log(share).alias("lg")))
    model = models[0]
    for m in models[1:]:
        model = model.unionByName(m)
    return written(model.groupBy("key").agg(F.max("lp").alias("lp"), F.max("lg").alias("lg")), "model")


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by block, each block's as one compressed table: texts that travel together compress well."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        sorted_, names = block[order], [c for c in batch.schema.names if c != "block"]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(block) else []
        table = pa.Table.from_batches([batch]).select(names).take(pa.array(order))
        blobs = []
        for at, end in zip(first, [*first[1:], len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.slice(at, end - at).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(sorted_[first], pa.int32()), pa.array(blobs, pa.binary())], ["block", "bundle"])


def _unbundled(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys that a block's grams need, its own and those it may fall back to, each once."""
    found: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, blob in zip(rows["block"], rows["bundle"], strict=True):
            texts = _unbundled(blob).column("text").to_pylist()
            for a, b in portions(texts):
                new = np.unique(grams(texts[a:b])[0])
                found[block] = np.union1d(found[block], new) if block in found else new
    for block, keys in found.items():
        own = [keys]
        for n in range(ORDER, 0, -1):
            own.append(np.unique(keys >> np.uint64(16)))
            keys = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1))
            own.append(keys)
        yield pd.DataFrame({"block": block, "key": np.unique(np.concatenate(own)).view(np.int64)})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_probabilities(gram: np.ndarray, keys: np.ndarray, lp: np.ndarray, lg: np.ndarray) -> np.ndarray:
    """Of the last character of each gram after the others; keys in order."""
    out = np.zeros(len(gram))
    open_ = np.arange(len(gram))
    for n in range(ORDER, 0, -1):
        g = gram[open_]
        at, hit = _find(keys, g)
        hit &= ~np.isnan(lp[at]) if len(keys) else hit
        out[open_[hit]] += lp[at[hit]]
        open_, g = open_[~hit], g[~hit]
        at, hit = _find(keys, g >> np.uint64(16) if n > 1 else np.zeros(len(g), np.uint64))
        some = np.where(hit, lg[at], 0) if len(keys) else np.zeros(len(g))
        out[open_] += np.nan_to_num(some)
        gram = gram & np.uint64((1 << 16 * (n - 1)) - 1)
    out[open_] -= np.log(ALPHABET)
    return out


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) of each row of (doc_id, lang, text), by character; a null or empty text's is that
    of its end. Texts are dealt to blocks of about BLOCK bytes by a hash, so copies of one text are spread by their ids;
    a longer text is a block of its own and is looked up in portions. Repeated rows and null ids each have their row; an
    empty table gives an empty one. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block).mapInArrow(_bundled, "block int, bundle binary").repartition(blocks, "block")
    told = dealt.mapInPandas(_asked, "block int, key long").join(model, "key").select("block", "key", "lp", "lg")

    def scored(bundles: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.assign(key=known["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
        keys, lp, lg = known["key"].to_numpy(np.uint64), known["lp"].to_numpy(float), known["lg"].to_numpy(float)
        parts = []
        for blob in bundles["bundle"]:
            table = _unbundled(blob)
            texts, out = table.column("text").to_pylist(), np.zeros(len(table))
            for a, b in portions(texts):
                gram, sizes = grams(texts[a:b])
                once, back = np.unique(gram, return_inverse=True)
                total = np.add.reduceat(log_probabilities(once, keys, lp, lg)[back], np.cumsum(sizes) - sizes)
                out[a:b] = np.exp(-total / sizes)
            ids = pd.array(table.column("doc_id").to_pylist(), dtype="Int64")
            parts.append(pd.DataFrame({"doc_id": ids, "lang": table.column("lang").to_pylist(), "n_chars": [len(t) for t in texts], "perplexity": out}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["doc_id", "lang", "n_chars", "perplexity"])

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(scored, "doc_id long, lang string, n_chars long, perplexity double")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose label says good quality; none is shuffled while the labels' ids are few, else only they are."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_set(rows, good, "doc_id", "_in").where("_in").drop("_in").join(small_side(good), "doc_id", "left_semi")


def judged(scores: DataFrame, good: DataFrame) -> DataFrame:
    """``scores`` with their language's threshold and ``kept``. A language without trusted documents keeps all of its
    own, as does a null one; the table of thresholds has a row for each language. A perplexity at the threshold is kept.
    """
    trusted = scores.join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    limits = trusted.groupBy("lang").agg((F.percentile_approx("perplexity", QUANTILE, 10_000) * MARGIN).alias("threshold")).withColumnRenamed("lang", "_lang")
    return scores.join(small_side(limits, LANGUAGES), F.col("lang") == F.col("_lang"), "left").drop("_lang").withColumn(
        "kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


@tidy
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether it stays: (doc_id, lang, n_chars, perplexity, threshold, kept).

    A null text is the empty one. Repeated rows and null ids have a row each; a null language, or one without trusted
    documents, has no threshold and keeps its own; a perplexity at the threshold, a tie, is kept. An empty table gives an
    empty result, labels without good documents keep everything. Other columns, whatever their names, are not read.
    """
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = written(perplexities(docs, train(trusted_documents(docs, labels))), "perplexities")
    return judged(scores, labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
