"""Hard negatives of anchors, by product quantisation with residual bounds.

A vector is cut into parts of two numbers; each part is replaced by the nearest of its codebook's points, and the length
of what is lost is stored. A table of the anchor's products with all points gives a score by look-ups; the true score
lies within anchor's length times lost length of it, so a row that can't reach a window is left out with certainty. The others are
scored by their whole-number vectors. Points are whole numbers too, so no bound hangs on rounding.

Rows are packed into blocks and anchors into batches, and each block meets each batch: a stated query set against all rows.
A task keeps the best of each anchor so far, which raises the bar for the blocks that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.llm.common import tidy, written

#: Positives of an anchor, negatives of a positive, and the window's lower end in parts of 100 of the positive's score.
POSITIVES, NEGATIVES, LOWER = 5, 5, 80
#: Rows of a block, anchors of a batch, and anchors that are looked up at once.
BLOCK, BATCH, AT_ONCE = 4096, 1024, 64
#: Rows on which the codebooks are fitted at most, points of a codebook, numbers of a part, rounds.
SAMPLE, POINTS, PART, ROUNDS = 4096, 256, 2, 8
#: Squared length of a vector at most; so a hundred times a score fits 64 bits.
LONGEST = 1 << 54
#: In place of an id that is null: it comes last.
NO_ID = 2**63 - 1
LEAST = -(2**62)


def whole_vectors(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, label, v) of the rows that take part: v is floor(scale * x), rid tells repeated rows apart.

    Rows with a null label or vector, or with a null or non-finite number in it, take no part; null ids do.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    if len(out) and (np.abs(out).max(initial=0) > LONGEST or (out.astype(float) ** 2).sum(axis=1).max() > LONGEST):
        raise ValueError("a vector is so long that scores don't fit 64 bits")
    return out


def codebooks(sample: np.ndarray, points: int = POINTS, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, points, PART): for each part of the vectors its points, whole numbers, by Lloyd's rounds."""
    rng, parts = np.random.default_rng(0), sample.reshape(len(sample), -1, PART).transpose(1, 0, 2).astype(float)
    books = parts[:, rng.permutation(len(sample))[:points]]
    for _ in range(rounds):
        for book, x in zip(books, parts, strict=True):
            near = ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
            n = np.bincount(near, minlength=len(book))
            for k in range(PART):
                book[:, k] = np.where(n > 0, np.bincount(near, x[:, k], len(book)) / np.maximum(n, 1), book[:, k])
    return np.rint(books).astype(np.int64)


def _root_up(squares: np.ndarray) -> np.ndarray:
    """Whole numbers that are no less than the square roots."""
    return np.ceil(np.sqrt(squares.astype(float)) * (1 + 1e-9)).astype(np.int64)


def _encoded(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lost lengths rounded up)."""
    codes, lost = np.empty((len(v), len(books)), np.uint8), np.zeros(len(v), np.int64)
    for m, book in enumerate(books):
        x = v[:, m * PART : (m + 1) * PART]
        codes[:, m] = ((book**2).sum(axis=1) - 2.0 * (x.astype(float) @ book.T)).argmin(axis=1)
        lost += ((x - book[codes[:, m]]) ** 2).sum(axis=1)
    return codes, _root_up(lost)


_BLOCK = "rids binary, ids binary, labels binary, v binary, codes binary, lost binary"


def packed(rows: DataFrame, width: int, books: np.ndarray, most: int) -> DataFrame:
    """``rows`` of ``whole_vectors`` in blocks of at most ``most``, with their codes and lost lengths."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                v = _matrix(part.column("v"), width)
                codes, lost = _encoded(v, books)
                cells = [part.column(c).to_numpy() for c in ("rid", "vec_id", "label")] + [v.astype(np.int32), codes, lost]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], [c.split()[0] for c in _BLOCK.split(", ")])

    return rows.select("rid", "vec_id", "label", "v").mapInArrow(pack, _BLOCK)


class _Rows:
    def __init__(self, row: dict, prefix: str, width: int, parts: int):
        read = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.rids, self.ids, self.labels, self.lost = (read(c, np.int64) for c in ("rids", "ids", "labels", "lost"))
        self.v = read("v", np.int32).reshape(len(self.rids), width).astype(np.int64)
        self.codes = read("codes", np.uint8).reshape(len(self.rids), parts)


class Best:
    """For each query the first ``most`` rows so far, by falling score and rising id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.query, self.score, self.id, self.rid = (np.zeros(0, np.int64) for _ in range(4))
        self.bar = np.full(queries, LEAST)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        q, s, i, r = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.rid, rids)))
        order = np.lexsort((r, i, -s, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = order[nth < self.most]
        self.query, self.score, self.id, self.rid = q[nth < self.most], s[keep], i[keep], r[keep]
        full = nth[nth < self.most] == self.most - 1
        self.bar[self.query[full]] = self.score[full]


def _kth(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th largest of the allowed values, LEAST where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST)
    return -np.partition(np.where(allowed, -values, -LEAST), k - 1, axis=1)[:, k - 1]


def _bounds(anchors: _Rows, some: slice, block: _Rows, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the score of each anchor and row can be, from look-ups."""
    a = anchors.v[some]
    table = np.einsum("amk,mpk->map", a.reshape(len(a), -1, PART), books)
    score = np.zeros((len(a), len(block.rids)), np.int64)
    for m in range(len(books)):
        score += np.take(table[m], block.codes[:, m], axis=1)
    slack = _root_up((a**2).sum(axis=1))[:, None] * block.lost
    return score - slack, score + slack


def _exact(anchors: _Rows, i: np.ndarray, block: _Rows, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = (anchors.v[i[at : at + (1 << 16)]] * block.v[j[at : at + (1 << 16)]]).sum(axis=1)
    return out


def _positives(best: Best, anchors: _Rows, block: _Rows, books: np.ndarray) -> None:
    for at in range(0, len(anchors.rids), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        low, high = _bounds(anchors, some, block, books)
        same = (anchors.labels[some, None] == block.labels) & (anchors.rids[some, None] != block.rids)
        bar = np.maximum(best.bar[some], _kth(low, same, best.most))
        i, j = np.nonzero(same & (high >= bar[:, None]))
        best.add(i + at, _exact(anchors, i + at, block, j), block.ids[j], block.rids[j])


def _negatives(best: Best, anchors: _Rows, of: np.ndarray, ceiling: np.ndarray, lower: int, block: _Rows, books: np.ndarray) -> None:
    """``of`` and ``ceiling``: for each query its anchor's place, rising, and its positive's score."""
    for at in range(0, len(anchors.rids), AT_ONCE):
        low, high = _bounds(anchors, slice(at, at + AT_ONCE), block, books)
        first, last = np.searchsorted(of, (at, at + AT_ONCE))
        for begin in range(first, last, AT_ONCE):
            q = np.arange(begin, min(last, begin + AT_ONCE))
            a, top = of[q], ceiling[q][:, None]
            floor = -(-lower * top // 100)
            other = anchors.labels[a, None] != block.labels
            sure = other & (high[a - at] <= top) & (low[a - at] >= floor)
            bar = np.maximum(np.maximum(best.bar[q], _kth(low[a - at], sure, best.most))[:, None], floor)
            i, j = np.nonzero(other & (high[a - at] >= bar) & (low[a - at] <= top))
            score = _exact(anchors, a[i], block, j)
            fits = (score <= top[i, 0]) & (score >= floor[i, 0])
            best.add(q[i[fits]], score[fits], block.ids[j[fits]], block.rids[j[fits]])


def _met(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    """Each block with each batch, whose columns begin with a_."""
    return blocks.crossJoin(batches.select(*(F.col(c).alias(f"a_{c}") for c in batches.columns)))


@tidy
def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), from ``rows`` of ``whole_vectors``.

    Anchors are the rows with ``anchor``. An anchor's positives are the first other rows of its label, a positive's negatives the first
    of other labels whose score is at least ``lower`` hundredths of the positive's and at most the positive's. Vectors of
    different lengths are filled up with zeros; one whose squared length is over 2^54 is an error. Repeated rows are rows of their own, null ids come last.
    Codebooks are fitted on SAMPLE rows, dealt by a hash; every row is encoded.
    """
    spark, kind = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:  # no rows, or empty vectors only: one number of 0
        width = 1 if width == 0 else None
    if width is None:
        return spark.createDataFrame([], kind)
    width += -width % PART
    few = rows.orderBy(F.xxhash64("rid", "vec_id")).limit(SAMPLE).select("v").toArrow()
    books = codebooks(_matrix(few.column("v").combine_chunks(), width))
    parts = len(books)
    blocks = written(packed(rows, width, books, BLOCK), "blocks")
    chosen = written(rows.where(anchor), "anchors")
    n = max(1, -(-chosen.count() // BATCH))

    def asked(some: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
        """What ``each`` finds, batch of anchors by batch, over all blocks of the task."""
        held: dict[bytes, tuple] = {}
        for batch in some:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["a_rids"] not in held:
                    held[row["a_rids"]] = each(row)
                best, step, _ = held[row["a_rids"]]
                step(best, _Rows(row, "", width, parts))
        for best, _, out in held.values():
            for names, values in out(best):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)

    def first(row: dict):
        anchors = _Rows(row, "a_", width, parts)
        out = lambda b: [(["rid", "anchor_id", "score", "id"], [anchors.rids[b.query], anchors.ids[b.query], b.score, b.id])]
        return Best(len(anchors.rids), positives), lambda b, block: _positives(b, anchors, block, books), out

    best_first = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc("id"))
    batches = written(packed(chosen.repartition(n, "rid"), width, books, BATCH), "batches")
    told = _met(blocks, batches).mapInArrow(lambda some: asked(some, first), "rid long, anchor_id long, score long, id long")
    positive = written(told.withColumn("nth", F.row_number().over(best_first)).where(F.col("nth") <= positives), "positives")

    # the queries of each anchor go to its batch
    scores = positive.groupBy("rid").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    wanted = chosen.join(scores, "rid").select("rid", "vec_id", "label", "v", "scores")

    def pack(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                v, lists = _matrix(part.column("v"), width), part.column("scores")
                codes, lost = _encoded(v, books)
                sizes = np.diff(lists.offsets.to_numpy())
                cells = [part.column(c).to_numpy() for c in ("rid", "vec_id", "label")] + [v.astype(np.int32), codes, lost, np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], [*(c.split()[0] for c in _BLOCK.split(", ")), "of", "ceiling"])

    def second(row: dict):
        anchors, of, ceiling = _Rows(row, "a_", width, parts), np.frombuffer(row["a_of"], np.int64), np.frombuffer(row["a_ceiling"], np.int64)
        out = lambda b: [(["rid", "ceiling", "score", "id", "nrid"], [anchors.rids[of[b.query]], ceiling[b.query], b.score, b.id, b.rid])]
        return Best(len(of), negatives), lambda b, block: _negatives(b, anchors, of, ceiling, lower, block, books), out

    queries = written(wanted.repartition(n, "rid").mapInArrow(pack, f"{_BLOCK}, of binary, ceiling binary"), "queries")
    found = _met(blocks, queries).mapInArrow(lambda some: asked(some, second), "rid long, ceiling long, score long, id long, nrid long").distinct()
    per_score = Window.partitionBy("rid", "ceiling").orderBy(F.desc("score"), F.asc("id"), F.asc("nrid"))
    ranked = found.withColumn("rank", F.row_number().over(per_score)).where(F.col("rank") <= negatives)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pairs = positive.select("rid", "anchor_id", F.col("score").alias("ceiling"), F.col("id").alias("positive_id"))
    return pairs.join(ranked, ["rid", "ceiling"]).select(
        named("anchor_id").alias("anchor_id"), named("positive_id").alias("positive_id"), "rank", named("id").alias("negative_id"), F.col("ceiling").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of ``embeddings`` whose id is divisible by 100, its 5 positives and up to 5 hard negatives of each.

    Where the id is divisible by 7 the label is the next one of ten. A positive with a score below 0 has an empty window and no row; one with
    a score of 0 has negatives with 0. Ties go by the smaller id. An empty table, one without anchors or with one label gives
    an empty result. Other columns, whatever their names, are not read.
    """
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = rows.withColumn("label", F.when((F.col("vec_id") != NO_ID) & (F.col("vec_id") % 7 == 0), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, (F.col("vec_id") != NO_ID) & (F.col("vec_id") % 100 == 0))


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, b.rid AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id, other) <= 5),
n AS (SELECT p.rid, p.anchor_id, p.positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.positive_id ORDER BY s.score DESC, s.id, s.other)::INT AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op12_negatives": op12_negatives}
ORACLES = {"op12_negatives": ORACLE}
