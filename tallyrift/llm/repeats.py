"""Removal of repeated byte strings by suffix arrays.

Every string of LENGTH bytes is dealt to the gram with the smallest hash in it (winnowing), so equal strings meet under
one gram wherever they are, and a corpus-wide suffix array falls apart into independent ones. A gram's occurrence with
all strings dealt to it is its context. Contexts that are equal as a whole need no sorting: all their strings repeat.
Where contexts of a gram differ - at the borders of repeated passages - their suffixes are sorted in two stages (Itoh
and Tanaka): directly only those smaller than their successors, the rest induced by a scan of the buckets. Neighbours
with a common prefix of LENGTH bytes are repeats.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, in_set, tidy, whole, written

LENGTH, GRAM = 200, 16
#: Bytes of text whose grams are hashed at once, and of contexts whose suffixes are sorted at once.
AT_ONCE, CHUNK = 1 << 18, 1 << 19
#: Contexts that a task sorts at once.
RUN = 500_000
#: Distinct contexts of a gram beyond which its strings are dealt out one by one, each by its own hash.
HOT = 20_000
#: Strings of such grams in a batch.
STRINGS = 100_000
#: Texts whose repeats are removed at once.
TEXTS = 500

_PLACE = np.uint64((1 << 26) - 1)


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """A hash of the GRAM bytes at each of the first n places; data has GRAM bytes more."""
    one = np.ndarray((n,), "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    one ^= one >> np.uint64(29)
    one += np.ndarray((n,), "<u8", data, 8, (1,))
    one *= np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(32)
    return one


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of x[i : i + w] for each i that has w values, by van Herk's two running minima a block."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    rows = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def contexts(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, gram's hash, context's hash, first start, last start, gram's place) of all contexts, by portions of the texts.

    Texts of more than AT_ONCE bytes are cut into pieces that share length - 1 bytes, so that every string lies in one of
    them. A context may be cut there; its strings are still dealt to the same gram.
    """
    import xxhash

    pieces = [(i, at) for i, t in enumerate(texts) if len(t) >= length for at in range(0, len(t) - length + 1, AT_ONCE)]
    at = 0
    while at < len(pieces):
        size, part, which, skipped = 0, [], [], []
        while at < len(pieces) and size <= AT_ONCE:
            i, skip = pieces[at]
            part.append(texts[i][skip : skip + AT_ONCE + length - 1])
            which.append(i)
            skipped.append(skip)
            size += len(part[-1])
            at += 1
        which, skipped = np.array(which), np.array(skipped)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        data = b"".join(part) + b"\0" * GRAM
        hashes = gram_hashes(data, size)
        low = window_minima((hashes & ~_PLACE) | np.arange(size, dtype=np.uint64), length - GRAM + 1)
        begin = np.cumsum(sizes) - sizes
        valid = np.zeros(size + 1, np.int8)
        valid[begin] += 1
        valid[begin + sizes - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(valid[:size]))
        gram = (low[starts] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        lo, hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        own = np.searchsorted(begin, lo, "right") - 1
        shift = skipped[own] - begin[own]
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        whole = np.fromiter((digest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
        yield which[own], hashes[gram[new]], whole, lo + shift, hi + shift, gram[new] + shift


def two_stage(data: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes; those that agree in them stand together."""
    n = len(data)
    t = np.frombuffer(data, np.uint8)
    # A suffix is smaller than its successor if the first byte that differs from the run it starts with is larger.
    edge = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    rising = np.append(t[edge[:-1]] < t[edge[:-1] + 1], False)
    small = rising[np.searchsorted(edge, np.arange(n))]
    count, falling = np.bincount(t, minlength=256), np.bincount(t[~small], minlength=256)
    begin = np.cumsum(count) - count
    placed = np.full(n, -1, np.int64)
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(t[direct], kind="stable")]
    buckets = np.cumsum(np.bincount(t[direct], minlength=256))
    for c, (a, b) in enumerate(zip([0, *buckets.tolist()], buckets.tolist(), strict=False)):  # prefixes of one first byte at a time are held
        if a < b:
            at = begin[c] + falling[c]
            placed[at : at + b - a] = sorted(direct[a:b].tolist(), key=lambda i: data[i : i + depth])
    order, head, is_small = array("q", placed.tobytes()), begin.tolist(), small.tobytes()
    if n and not is_small[n - 1]:
        c = data[n - 1]
        order[head[c]] = n - 1
        head[c] += 1
    for p in range(n):  # successors of what is induced here stand further left
        i = order[p] - 1
        if i >= 0 and not is_small[i]:
            c = data[i]
            order[head[c]] = i
            head[c] += 1
    return np.array(order, np.int64)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts in it of strings of ``length`` bytes that start anywhere else in the parts."""
    data = b"\xff".join(parts)  # not in UTF-8
    if len(data) < length:
        return [np.zeros(0, np.int64) for _ in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = two_stage(data, length)
    owner = np.searchsorted(begin, order, "right") - 1
    order = order[order + length <= begin[owner] + sizes[owner]]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    alike = np.zeros(len(order) + 1, bool)
    for at in range(0, len(order) - 1, 4096):
        some = order[at : at + 4097]
        alike[at + 1 : at + len(some)] = (rows[some[1:]] == rows[some[:-1]]).all(1)
    hits = np.sort(order[alike[:-1] | alike[1:]])
    owner = np.searchsorted(begin, hits, "right") - 1
    return [hits[owner == i] - begin[i] for i in range(len(parts))] if len(parts) < 50 else np.split(hits - begin[owner], np.searchsorted(owner, np.arange(1, len(parts))))


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The places that strings at ``starts``, in order, cover: (first, end) of each maximal run."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, np.diff(starts) > length))
    return list(zip(starts[new].tolist(), (starts[np.append(new[1:], len(starts)) - 1] + length).tolist(), strict=True))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans (first, end), as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > ends[:-1]))
    return list(zip(spans[new, 0].tolist(), ends[np.append(new[1:], len(spans)) - 1].tolist(), strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


_FOUND = "row long, gram long, context long, lo int, hi int, at int, n int"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts, one row for each that is distinct in a run of RUN of them, n: 1 or 2 for more; with n 0, the spans of those
    that repeat here already. So a passage of a third of all rows leaves as one row a run."""
    kept: list[list[np.ndarray]] = []
    size = 0
    for rows in batches:
        own = rows["row"].to_numpy(np.int64)
        for first, texts in _encoded(rows["text"]):
            for text, gram, context, lo, hi, at in contexts(texts):
                kept.append([own[first + text], _signed(gram), _signed(context), *(x.astype(np.int32) for x in (lo, hi, at))])
                size += len(gram)
                if size >= RUN:
                    yield from _once(kept)
                    size = 0
    if kept:
        yield from _once(kept)


def _encoded(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as bytes), some AT_ONCE bytes at a time."""
    first, part, size = 0, [], 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= AT_ONCE:
            yield first, part
            first, part, size = first + len(part), [], 0
    if part:
        yield first, part


def _once(kept: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
    """The rows of a run of contexts, which is emptied."""
    row, gram, context, lo, hi, place = (np.concatenate(x) for x in zip(*kept, strict=True))
    kept.clear()
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    take = order[first]
    for at in range(0, len(take), 100_000):
        i = take[at : at + 100_000]
        yield pd.DataFrame({"row": row[i], "gram": gram[i], "context": context[i], "lo": lo[i], "hi": hi[i], "at": place[i], "n": np.minimum(n[at : at + 100_000], 2)})
    again = order[np.repeat(n > 1, n)]
    if len(again):
        again = again[np.lexsort((lo[again], row[again]))]
        r, a, b = row[again], lo[again], hi[again] + LENGTH
        cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (a[1:] > b[:-1])))  # contexts of a text follow one another
        last = np.append(cut[1:], len(again)) - 1
        yield pd.DataFrame({"row": r[cut], "gram": 0, "context": 0, "lo": a[cut], "hi": np.maximum.reduceat(b, cut)[: len(last)], "at": 0, "n": 0})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the contexts of each text, of some AT_ONCE bytes in a batch."""
    told = lambda out: pd.DataFrame(out, columns=["row", "gram", "lo", "skip", "n", "bytes"])
    out: list[tuple] = []
    size = 0
    for rows in batches:
        for row, text, *wanted in rows.itertuples(index=False, name=None):
            data = (text or "").encode("utf-8", "surrogatepass")
            for gram, lo, hi, at, n in zip(*(w.tolist() for w in wanted), strict=True):
                out.append((row, gram, lo, at - lo, n, data[lo : hi + LENGTH]))
                size += len(out[-1][-1])
                if size >= AT_ONCE:
                    yield told(out)
                    out, size = [], 0
    yield told(out)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def furthest(strings: list[bytes]) -> list[int]:
    """The longest prefix that each string has in common with another one, from its neighbours in order."""
    order, out = sorted(range(len(strings)), key=strings.__getitem__), [0] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        n = common_prefix(strings[i], strings[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of repeats, from contexts in the order of their grams. No gram is split between suffix arrays.

    The contexts of a gram stand in line at it, and a string that two of them share lies within what each has in common
    with another to its left and to its right: only that part is sorted, once for all contexts that agree in it.
    """
    held: list[tuple] = []
    size = 0

    def flush() -> pd.DataFrame:
        out, parts, owners = [], [], []
        at = 0
        while at < len(held):
            end = at
            while end < len(held) and held[end][1] == held[at][1]:
                end += 1
            group, at = held[at:end], end
            data = [bytes(h[5]) for h in group]
            left = furthest([d[: h[3]][::-1] for d, h in zip(data, group, strict=True)])
            right = furthest([d[h[3] :] for d, h in zip(data, group, strict=True)])
            alike: dict[tuple, list] = {}
            for h, d, a, b in zip(group, data, left, right, strict=True):
                if a + b >= LENGTH:
                    alike.setdefault((a, d[h[3] - a : h[3] + b]), []).append((h[0], h[2] + h[3] - a, h[4]))
            for (_, part), rows in alike.items():
                twice = len(rows) > 1 or rows[0][2] > 1  # n above 1: marked as a whole before
                out += [(row, first, first + len(part)) for row, first, n in rows if twice and n == 1]
                parts.append(part)
                owners.append(None if twice else rows[0])
            if all(o is None for o in owners[len(owners) - len(alike) :]):  # nothing is open
                del parts[len(parts) - len(alike) :], owners[len(owners) - len(alike) :]
        if parts:
            for owner, starts in zip(owners, repeated_starts(parts), strict=True):
                if owner:
                    out += [(owner[0], owner[1] + a, owner[1] + b) for a, b in runs(starts, LENGTH)]
        return pd.DataFrame(out, columns=["row", "lo", "hi"])

    for rows in batches:
        for x in rows.itertuples(index=False, name=None):
            if size >= CHUNK and x[1] != held[-1][1]:
                yield flush()
                held, size = [], 0
            held.append(x)
            size += len(x[5]) + 1
    if held:
        yield flush()


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(hash, row, start, n) of every string in the contexts."""
    import xxhash

    told = lambda out: pd.DataFrame(out, columns=["string", "row", "lo", "n"])
    out: list[tuple] = []
    for rows in batches:
        for row, _, lo, _, n, data in rows.itertuples(index=False, name=None):
            for i in range(len(data) - LENGTH + 1):
                h = xxhash.xxh3_128_digest(data[i : i + LENGTH])
                out.append((h, row, lo + i, n))
                if len(out) == STRINGS:
                    yield told(out)
                    out = []
    yield told(out)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Of (row, text): (row, lo, hi), spans whose union is what repeated strings cover. ``row`` tells texts apart.

    Texts of fewer than LENGTH bytes have none; those of many megabytes are cut for hashing only. Rows with equal ``row``
    and text count as two. Contexts are counted in
    each partition before they are shuffled; the join's other side has a row for each gram, so that Spark splits a hot
    gram's rows; a gram with more than HOT distinct contexts is not sorted in one place, its strings are counted by hash.
    """
    found = written(rows.mapInPandas(_found, _FOUND), "contexts")
    seen = found.where("n > 0")
    grams = seen.groupBy("gram").agg(F.sum("n").alias("total"), F.min("context").alias("one"), F.max("context").alias("other"))
    live = written(seen.join(grams.where("total > 1"), "gram").select(*seen.columns, (F.col("one") == F.col("other")).alias("alone")), "shared")
    mixed = live.where("NOT alone").groupBy("gram", "context").agg(
        F.sum("n").alias("total"), F.min_by(F.struct("row", "lo", "hi", "at"), F.struct("row", "lo")).alias("one"))
    mixed = written(mixed, "mixed")
    many = mixed.where("total > 1").select("gram", "context")
    again = live.where("n = 1")
    whole_spans = again.where("alone").unionByName(again.where("NOT alone").join(many, ["gram", "context"], "left_semi"))
    whole_spans = whole_spans.select("row", "lo", (F.col("hi") + LENGTH).alias("hi"))

    per_gram = mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"))
    wanted = mixed.join(per_gram, "gram").select(
        F.col("one.row").alias("row"), "gram", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), F.col("one.at").alias("at"), F.least("total", F.lit(2)).cast("int").alias("n"), (F.col("contexts") > HOT).alias("hot"))
    wanted = written(wanted, "wanted")
    by_text = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "lo", "hi", "at", "n", "hot")).alias("wanted"))
    part = in_set(rows, wanted, "row", "_in").where("_in").select("row", "text").dropDuplicates(["row"])
    named = part.join(by_text, "row")
    fields = [F.col(f"wanted.{c}").alias(c) for c in ("gram", "lo", "hi", "at", "n")]  # arrays of numbers, not an object for each context
    pieces = lambda hot: named.select("row", "text", F.filter("wanted", lambda w: w["hot"] == hot).alias("wanted")).where(F.size("wanted") > 0).select("row", "text", *fields).mapInPandas(
        _cut, "row long, gram long, lo int, skip int, n int, bytes binary")
    inside = pieces(False).repartition("gram").sortWithinPartitions("gram").mapInPandas(_sorted, "row long, lo int, hi int")
    if wanted.where("hot").isEmpty():
        return found.where("n = 0").select("row", "lo", "hi").unionByName(whole_spans).unionByName(inside)
    strings = written(pieces(True).mapInPandas(_strings, "string binary, row long, lo int, n int"), "strings")
    twice = strings.groupBy("string").agg(F.sum("n").alias("total")).where("total > 1").select("string")
    single = strings.where("n = 1").join(twice, "string", "left_semi").select("row", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return found.where("n = 0").select("row", "lo", "hi").unionByName(whole_spans).unionByName(inside).unionByName(single)


def _row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), whole(text), F.lit(1))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary"


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for doc, text, lo, hi in zip(rows["doc_id"].array, rows["text"], rows["los"], rows["his"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans = merged(np.stack([lo, hi], 1).astype(np.int64))
            edge = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
            out.append((None if pd.isna(doc) else int(doc), len(data), len(data) - len(kept), len(spans), kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"])
        yield frame.assign(doc_id=pd.array(frame["doc_id"], dtype="Int64"))


@tidy
def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text as binary) of each document of (doc_id, text).

    A string's every occurrence goes, the first one too. Null texts are empty. Removal may cut a character in two, so
    what is left is bytes. Texts without repeats are never shuffled. Repeated rows each have their row; rows with null ids
    too; of an empty table there are none. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("row", _row_key())
    spans = written(repeated_spans(rows.select("row", "text")), "spans")
    by_row = spans.groupBy("row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    marked = in_set(rows, spans, "row", "_in")
    joined = marked.where("_in").join(by_row, "row", "left")
    untouched = lambda df: df.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                     F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept_text"))
    joined = joined.select("doc_id", "text", F.coalesce("los", F.array().cast("array<int>")).alias("los"), F.coalesce("his", F.array().cast("array<int>")).alias("his"))
    return untouched(marked.where("NOT _in")).unionByName(joined.mapInPandas(_without_or_all, _KEPT))


def _without_or_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ``_without``, with texts that the bit set let through without reason."""
    for rows in (b[i : i + TEXTS] for b in batches for i in range(0, len(b), TEXTS)):
        full = rows["los"].map(len) > 0
        if full.any():
            yield from _without(iter([rows[full]]))
        if not full.all():
            rest = rows[~full]
            data = [(t or "").encode("utf-8", "surrogatepass") for t in rest["text"]]
            yield pd.DataFrame({"doc_id": rest["doc_id"].astype("Int64"), "n_bytes": [len(d) for d in data], "n_removed": 0, "n_spans": 0, "kept_text": data})


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings, as counts and a digest; see ``without_repeats``."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op8_repeats": op8_repeats}
ORACLES: dict[str, str] = {}
