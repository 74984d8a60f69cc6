"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A text is scored by its worst window; windows of WINDOW words start every STRIDE words and overlap, so no phrase falls
between two. A word's input is the sum of a hashed word vector and the mean of its hashed character n-grams' vectors,
so that unseen forms of a known stem are recognised. Training is by gradient descent on a bounded sample of labelled
rows; a text's label is that of its highest-scoring window (multiple-instance learning).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import documents

WINDOW, STRIDE = 48, 36
#: Labelled rows of each class that training takes at most, by a hash of their ids.
SAMPLE = 1000
WORDS, GRAMS, WIDE, HIDDEN = 2**12, 2**14, 16, 12
#: Every FOLDS-th hash value is held out.
FOLDS = 5
#: Distinct words that a worker remembers at most.
REMEMBERED = 250_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of all 3- and 4-grams of bytes of the marked words, first gram of each word)."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = int(sizes.sum())
    three = (data[:n] << np.uint64(16)) | (data[1 : n + 1] << np.uint64(8)) | data[2 : n + 2]
    four = ((three << np.uint64(8)) | data[3 : n + 3]) + np.uint64(1 << 40)
    at = np.arange(n) - np.repeat(starts, sizes)  # place in the word
    left = np.repeat(sizes, sizes) - at
    keep = np.stack([left >= 3, left >= 4], 1)
    grams = np.stack([three, four], 1)
    hashed = (grams * _MULTIPLY) >> np.uint64(50)
    counts = np.add.reduceat(keep.sum(1), starts) if n else np.zeros(0, np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    whole = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % WORDS
    return whole, (hashed[keep] % np.uint64(GRAMS)).astype(np.int64), firsts


def windows_of(n_words: int) -> np.ndarray:
    """Starts of a text's windows; the last one reaches its end. A text without words has one, empty."""
    return np.arange(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _inputs: np.ndarray | None = field(default=None, repr=False)
    _used: int = 0

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        shape = {"words": (WORDS, WIDE), "grams": (GRAMS, WIDE), "scale": (1,)}
        for side in ("f", "b"):
            shape |= {f"x{side}": (WIDE, 3 * HIDDEN), f"h{side}": (HIDDEN, 3 * HIDDEN), f"c{side}": (3 * HIDDEN,)}
        shape |= {"a": (2 * HIDDEN, HIDDEN), "v": (HIDDEN,), "o": (4 * HIDDEN,), "bias": (1,)}
        spread = lambda k, s: 0.1 if k in ("words", "grams") else 0.0 if len(s) == 1 and k != "v" and k != "o" else 0.3
        p = {k: (r.normal(0, 1, s) * spread(k, s)).astype(np.float32) for k, s in shape.items()}
        p["scale"][:] = 1
        p["bias"][:] = -1
        return cls(p)

    def embedded(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        whole, grams, firsts = word_hashes(words)
        counts = np.diff(np.append(firsts, len(grams)))
        out = self.p["words"][whole].copy()
        some = counts > 0
        if some.any():
            out[some] += np.add.reduceat(self.p["grams"][grams], firsts[some]) / np.sqrt(counts[some])[:, None].astype(np.float32)
        return out, (whole, grams, counts)

    # One direction. x: (time, batch, 3H) inputs times weights; mask: (time, batch).
    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        h, w = np.zeros((x.shape[1], HIDDEN), np.float32), self.p[f"h{side}"]
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            u = h @ w
            gates = _sigmoid(x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            step = (1 - z) * mask[t][:, None]
            new = h + step * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def _forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: attention-weighted mean and masked maximum of the states of both directions."""
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._run(xf, mask, "f", kf), self._run(xb, mask, "b", kb)], 2)
        s = np.tanh(h @ self.p["a"])
        e = s @ self.p["v"] + np.where(mask > 0, 0, -30).astype(np.float32)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        mean = np.einsum("tb,tbh->bh", e, h)
        shown = np.where(mask[:, :, None] > 0, h, -1)
        top = shown.argmax(0)
        high = np.take_along_axis(shown, top[None], 0)[0]
        pooled = np.concatenate([mean, high], 1)
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "h": h, "s": s, "e": e, "top": top, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["bias"][0]

    def _gradients(self, emb: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of the logistic loss: by parameter, and by embedded word. ids: (time, batch) into emb."""
        p, g, k = self.p, {}, {}
        x = emb[ids]
        xf, xb = x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"]
        logit = self._forward(xf, xb, mask, k)
        prob = _sigmoid(logit)
        d = ((prob - y) / len(y)).astype(np.float32)
        g["bias"], g["o"] = d.sum(keepdims=True), k["pooled"].T @ d
        dp = d[:, None] * p["o"]
        dmean, dhigh = dp[:, : 2 * HIDDEN], dp[:, 2 * HIDDEN :]
        h, s, e = k["h"], k["s"], k["e"]
        dh = e[:, :, None] * dmean
        de = np.einsum("tbh,bh->tb", h, dmean)
        dl = e * (de - (e * de).sum(0))
        g["v"] = np.einsum("tbh,tb->h", s, dl)
        ds = dl[:, :, None] * p["v"] * (1 - s * s)
        g["a"] = np.einsum("tbh,tbk->hk", h, ds)
        dh = dh + ds @ p["a"].T
        b = np.arange(len(y))[:, None]
        np.add.at(dh, (k["top"], b, np.arange(2 * HIDDEN)), dhigh)
        dx = np.zeros_like(x)
        for side, part, steps in (("f", dh[:, :, :HIDDEN], k["kf"]), ("b", dh[:, :, HIDDEN:], k["kb"])):
            w, carry = p[f"h{side}"], np.zeros((len(y), HIDDEN), np.float32)
            gw, gx = np.zeros_like(w), np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            for t, before, z, r, n, un in reversed(steps):
                dn = part[t] + carry
                m = mask[t][:, None]
                dz = -m * (n - before) * dn * z * (1 - z)
                da = m * (1 - z) * dn * (1 - n * n)
                dr = da * un * r * (1 - r)
                du = np.concatenate([dz, dr, da * r], 1)
                gx[t] = np.concatenate([dz, dr, da], 1)
                gw += before.T @ du
                carry = dn * (1 - m * (1 - z)) + du @ w.T
            g[f"h{side}"], g[f"c{side}"] = gw, gx.sum((0, 1))
            g[f"x{side}"] = np.einsum("tbi,tbj->ij", x, gx)
            dx += gx @ p[f"x{side}"].T
        demb = np.zeros_like(emb)
        np.add.at(demb, ids.ravel(), dx.reshape(-1, WIDE))
        return g, demb, float(-(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-7)).mean())

    def _word_ids(self, words: list[str]) -> np.ndarray:
        """Rows of the remembered inputs (both directions' products with the weights); new words are added."""
        rows = self._rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if self._inputs is None or len(rows) + len(new) > REMEMBERED:
            rows.clear()
            self._inputs, self._used = np.zeros((1024, 6 * HIDDEN), np.float32), 1
            self._inputs[0] = np.concatenate([self.p["cf"], self.p["cb"]])  # no word
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            emb, _ = self.embedded(part)
            got = np.concatenate([emb @ self.p["xf"] + self.p["cf"], emb @ self.p["xb"] + self.p["cb"]], 1)
            if self._used + len(part) > len(self._inputs):
                bigger = np.zeros((max(2 * len(self._inputs), self._used + len(part)), 6 * HIDDEN), np.float32)
                bigger[: self._used] = self._inputs[: self._used]
                self._inputs = bigger
            self._inputs[self._used : self._used + len(part)] = got
            rows.update(zip(part, range(self._used, self._used + len(part)), strict=True))
            self._used += len(part)
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each window, the text it is of), windows in order."""
        split = [t.lower().split() for t in texts]
        sizes = [len(w) for w in split]
        ids = self._word_ids([w for ws in split for w in ws])
        ids = np.append(ids, np.zeros(WINDOW, np.int64))
        ends = np.cumsum(sizes)
        starts = [windows_of(n) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        begin = np.concatenate([s + e - n for s, e, n in zip(starts, ends, sizes, strict=True)]) if texts else np.zeros(0, np.int64)
        long = np.minimum(WINDOW, ends[owner] - begin) if texts else begin
        order = np.argsort(long, kind="stable")
        out = np.empty(len(begin), np.float32)
        for i in range(0, len(order), at_once):
            take = order[i : i + at_once]
            steps = np.arange(max(1, int(long[take].max())))[:, None]
            mask = (steps < long[take]).astype(np.float32)
            x = self._inputs[np.where(mask > 0, ids[begin[take] + np.minimum(steps, WINDOW - 1)], 0)]
            out[take] = self._forward(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask)
        return out, owner

    def by_portion(self, texts: list[str], words_at_once: int = 200_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, logit of each window, the text from there that it is of) for portions of the texts."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) // 5 + 1
            if size >= words_at_once or i + 1 == len(texts):
                yield first, *self.logits(texts[first : i + 1])
                first, size = i + 1, 0

    def worst(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows."""
        out = np.full(len(texts), -np.inf)
        for first, logit, owner in self.by_portion(texts):
            np.maximum.at(out, owner + first, logit)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each text's score, 0 to 1: its worst window's. Equal texts are scored once."""
        once = list(dict.fromkeys(texts))
        known = dict(zip(once, 1 / (1 + np.exp(-self.worst(once) * float(self.p["scale"][0]))), strict=True))
        return np.array([known[t] for t in texts])


def train(texts: list[str], labels: np.ndarray, epochs: int = 7, batch: int = 128, rate: float = 0.008, seed: int = 0) -> Network:
    """Fit a network. Without both classes it stays near its start and gives every text less than 0.5."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        net.p["bias"][:] = -3 if not len(y) or y[0] < 0.5 else 3
        return net
    split = [t.lower().split() for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    words = list(vocabulary)
    hashed = word_hashes(words)
    counts = np.diff(np.append(hashed[2], len(hashed[1])))
    coded = [np.array([vocabulary[w] for w in ws], np.int64) for ws in split]
    del split, vocabulary
    owner, begin = [], []
    for i, ws in enumerate(coded):
        at = windows_of(len(ws))
        owner += [i] * len(at)
        begin += at.tolist()
    owner, begin = np.array(owner), np.array(begin)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        net._inputs = None
        if epoch < 2:  # any window of a text stands for it, at first
            pick = r.permutation(len(owner))[: 6 * len(y)]
        else:
            found = [(logit, owner_ + first) for first, logit, owner_ in net.by_portion(texts)]
            logit, who = (np.concatenate(x) for x in zip(*found, strict=True))
            best = {}
            for w in np.argsort(-logit, kind="stable"):
                best.setdefault(who[w], []).append(w)
            pick = np.array([w for i, ws in best.items() for w in (ws[:1] if y[i] > 0.5 else [*ws[:2], *r.choice(ws, 1)])])
            r.shuffle(pick)
        for at in range(0, len(pick), batch):
            take = pick[at : at + batch]
            seen, back = np.unique(np.concatenate([coded[owner[w]][begin[w] : begin[w] + WINDOW] for w in take]), return_inverse=True)
            ids, mask, place = np.zeros((WINDOW, len(take)), np.int64), np.zeros((WINDOW, len(take)), np.float32), 0
            for j, w in enumerate(take):
                n = len(coded[owner[w]][begin[w] : begin[w] + WINDOW])
                ids[:n, j], mask[:n, j] = back[place : place + n], 1
                place += n
            emb, (whole, grams, _) = net.embedded([words[i] for i in seen]) if len(seen) else (np.zeros((1, WIDE), np.float32), (np.zeros(0, int), np.zeros(0, int), 0))
            g, demb, _ = net._gradients(emb, ids, mask, y[owner[take]])
            if len(seen):
                n = counts[seen]
                gw, gg = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
                np.add.at(gw, whole, demb)
                np.add.at(gg, grams, np.repeat(demb / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), n, 0))
                g |= {"words": gw, "grams": gg}
            step += 1
            for k, d in g.items():
                one, two = m[k]
                one += 0.1 * (d - one)
                two += 0.01 * (d * d - two)
                net.p[k] -= (rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net._inputs = None
    _calibrate(net, texts, y)
    net._rows.clear()
    net._inputs = None
    return net


def _calibrate(net: Network, texts: list[str], y: np.ndarray) -> None:
    """Shift the texts' logits so that 0 parts the training rows with the fewest errors, in the middle of the gap."""
    worst = net.worst(texts)
    order = np.argsort(worst, kind="stable")
    low, high = worst[order], y[order]
    errors = np.concatenate(([0], np.cumsum(high > 0.5))) + np.concatenate((np.cumsum((high < 0.5)[::-1])[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    edge = low[0] - 1 if cut == 0 else low[-1] + 1 if cut == len(low) else (low[cut - 1] + low[cut]) / 2
    net.p["bias"] -= np.float32(edge)


def fold(doc_id: str = "doc_id"):
    """0 to FOLDS - 1 by the crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn from at most ``sample`` labelled rows of each class, none of them in the held-out fold.

    Rows are taken by a hash of their ids, so the choice doesn't depend on their order; 2 x ``sample`` ids at most are
    broadcast and as many texts come to the driver: of an id with several texts the first in order. Rows with null ids,
    labels or texts teach nothing; an id with both labels teaches both.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    usable = usable.where(fold() != 0)
    pick = lambda y: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1)).collect()
    spark = docs.sparkSession
    small = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "doc_id long, y int")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = dict(texts.groupBy("doc_id").agg(F.min("text")).collect())
    rows = sorted({(r["doc_id"], texts[r["doc_id"]], r["y"]) for r in chosen if r["doc_id"] in texts})
    return train([r[1] for r in rows], np.array([r[2] for r in rows]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a network that ``fit`` trains; null texts count as empty ones. Equal texts score alike, so
    repeated rows do; a null id is in the fold of the empty text. An empty table gives an empty one."""
    docs = documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).p)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(model.value)
        for rows in batches:
            yield rows[["doc_id", "held_out"]].assign(score=net.scores([t or "" for t in rows["text"]]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), "text").mapInPandas(
        scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the texts that score ``limit`` or more. Narrow; repeated rows stay repeated, and extra
    columns stay, whatever their names. Null texts score as empty ones; without labels of both kinds no text goes unless
    all labels are toxic. An empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).p)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network(model.value)
        for texts in parts:
            yield pd.Series(net.scores([t or "" for t in texts]))

    return docs.where(score("text") < limit)


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
