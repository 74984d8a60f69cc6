import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrift.llm import decontamination as D
from tallyrift.llm import divergence as V
from tallyrift.llm import mixing as M
from tallyrift.llm import negatives as N
from tallyrift.llm import packing as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [V, N, D])
def test_query_and_oracle(spark, module):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    (name, query), = module.QUERIES.items()
    df, want = query(spark, SF), con.sql(module.ORACLES[name])
    key = lambda names, data: sorted(tuple(str(r[names.index(n)]) for n in sorted(names)) for r in data)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(want.columns, want.fetchall())


# divergence

def plain_divergence(rows, least=3, ranks=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for k, s in counts if k == lang)
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, all_ = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(far(p[source][t], p[s][t]) for t in kept)) for s in sources if s != source]
        terms = [(t, far(p[source][t], all_[t])) for t in kept if counts[lang, source][t] and p[source][t] > all_[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, k, v, i) for i, (k, v) in enumerate(items, 1) if part == "pair" or i <= ranks]
    return sorted(out)


def test_divergence_against_a_plain_version(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abñöÄÖZé") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = []
    for _ in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", None, "ü", "z9"])
        lang = rng.choice(["en", "en", "en", "de", None])
        text = rng.choice([None, "", " 1 2 _"]) if rng.random() < 0.1 else rng.choice([" ", "_", "\n", "7"]).join(rng.choices(words, [1 / (i + 1) for i in range(80)], k=rng.randint(1, 60)))
        rows.append((text, lang, source))
    rows += [("only here and here", "xx", "one")] * 3 + [("nothing kept", "yy", "p"), (None, "yy", "q"), (None, "yy", "q")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("n", "vector", "term", "p0")})
    for least, ranks in ((3, 200), (1, 4)):
        assert sorted(map(tuple, V.divergence(docs, least, ranks).collect())) == plain_divergence(rows, least, ranks)
    assert V.divergence(docs.limit(0)).count() == 0


def test_divergence_in_small_portions(spark, monkeypatch):
    """Counts handed on early, words counted one by one, pairs evaluated a few at a time."""
    rows = [("A b c b", "en", s) for s in "pqr" for _ in range(3)] + [("b b d", "en", "q")] * 3
    batch = pa.RecordBatch.from_pylist([{"lang": x, "source": s, "text": (t + " e" * i).encode()} for i, (t, x, s) in enumerate(rows)])
    total = lambda: Counter({k: sum(r["n"] for b in V._counted(iter([batch] * 3)) for r in b.to_pylist() if (r["source"], r["term"]) == k) for k in [("p", b"b"), ("q", b"e"), ("r", None)]})
    want = total()
    monkeypatch.setattr(V, "HELD", 2)
    monkeypatch.setattr(V, "LONG", 1)
    assert total() == want == {("p", b"b"): 18, ("q", b"e"): 3 * (3 + 4 + 5 + 9 + 10 + 11), ("r", None): 0}
    rng = np.random.default_rng(1)
    entries = [[{"gid": int(g), "p": int(p), "p0": int(q)} for g, p, q in zip(rng.permutation(9)[:k], rng.integers(5, 999, k), rng.integers(1, 5, k), strict=True)] for k in (1, 2, 9, 0, 5)]
    both = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(entries, pa.list_(pa.struct([("gid", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())])))], ["times", "entries"])
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for times, some in zip([1, 2, 3, 4, 5], entries, strict=True):
        for x in some:
            for y in some:
                if x is not y:
                    want[x["gid"], y["gid"]] += times * (f(x["p"], y["p"]) - f(x["p"], y["p0"]) - f(x["p0"], y["p"]) + f(x["p0"], y["p0"]))
    for most in (1, 7, 10**6):
        monkeypatch.setattr(V, "PAIRS", most)
        got = Counter()
        for b in V._both(iter([both])):
            for r in b.to_pylist():
                got[r["gid"], r["other"]] += r["value"]
        assert got == want


# hard negatives

def plain_negatives(rows, anchor):
    clean = [(i, y, [int(np.floor(256 * np.float64(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clean = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, v) for i, y, v in clean]
    out, last = [], 10**18
    for k, (i, y, v) in enumerate(clean):
        if i is None or not anchor(i):
            continue
        dot = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), last if j is None else j, n) for n, (j, _, w) in enumerate(clean) if n != k))
        for s, j, _ in [d for d in dot if clean[d[2]][1] == y][:5]:
            window = [(t, o) for t, o, n in dot if clean[n][1] != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, None if j == last else j, r, None if o == last else o, -s, -t) for r, (t, o) in enumerate(window, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_a_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "BLOCK", 37)
    monkeypatch.setattr(N, "BATCH", 5)
    monkeypatch.setattr(N, "AT_ONCE", 3)
    monkeypatch.setattr(N, "SAMPLE", 60)
    rng = np.random.default_rng(seed)
    size = [1, 5, 8][seed]
    vectors = rng.normal(0, 1, (240, size))
    vectors[50:90] = vectors[50]  # equal scores
    rows = [(None if n % 61 == 60 else int(i), int(rng.integers(0, 4)), [float(np.float32(x)) for x in v]) for n, (i, v) in enumerate(zip(rng.permutation(240), vectors, strict=True))]
    rows += [rows[0], rows[50], (500, None, [1.0] * size), (501, 1, None), (502, 1, [None] * size), (503, 1, [float("nan")] * size), (504, 1, [float("inf")] * size), (505, 1, [1.0] * (size + 2)), (506, 2, []), (-14, 3, [-0.5] * size)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("clash") for c in ("rid", "v", "scores")})
    whole = N.whole_vectors(table)
    moved = whole.withColumn("label", F.when((F.col("vec_id") != N.NO_ID) & (F.col("vec_id") % 7 == 0), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = N.hard_negatives(moved, (F.col("vec_id") != N.NO_ID) & (F.col("vec_id") % 10 == 0)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert N.hard_negatives(whole.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.hard_negatives(whole, F.col("vec_id") == -1).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    v = rng.integers(-90, 90, (3000, 64))
    books = N.codebooks(v[:2000])
    codes, lost = N._encoded(v, books)
    cells = {"rids": np.arange(3000), "ids": np.arange(3000), "labels": np.zeros(3000, np.int64), "v": v.astype(np.int32), "codes": codes, "lost": lost}
    block = N._Rows({k: x.tobytes() for k, x in cells.items()}, "", 64, len(books))
    low, high = N._bounds(block, slice(0, 100), block, books)
    true = v[:100] @ v.T
    assert (low <= true).all() and (true <= high).all()
    fifth = -np.sort(-low, axis=1)[:, 4:5]
    assert (high >= fifth).mean() < 0.2


def test_a_vector_too_long_is_an_error(spark):
    rows = N.whole_vectors(spark.createDataFrame([(100, 1, [1e9]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>"))
    with pytest.raises(Exception, match="fit 64 bits"):
        N.hard_negatives(rows, F.col("vec_id") == 100).collect()


# decontamination

def test_index_against_lists():
    rng = random.Random(1)
    for _ in range(200):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 5])
        text = np.array([rng.randint(1, k + 1) for _ in range(n)] + [0])
        assert list(D.suffix_array(text)) == sorted(range(len(text)), key=lambda i: list(text[i:]))
        index = D.ShardIndex.loaded(D.ShardIndex.of([b"w%d" % i for i in range(k)], text).stored())
        phrases = [[rng.randint(2, k + 1) for _ in range(rng.randint(1, 4))] for _ in range(8)]
        steps = np.array([[p[::-1][i] if i < len(p) else -2 for p in phrases] for i in range(4)])
        found = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(*map(list, index.search(steps)), strict=True)}
        for w, p in enumerate(phrases):
            assert found.get(w, []) == [i for i in range(len(text)) if list(text[i : i + len(p)]) == p]


def plain_hits(texts, items):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for doc, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x] - {None}
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(map(str, out))


@pytest.mark.parametrize("shard", [40, 300, D.SHARD])
def test_decontamination_against_a_plain_version(spark, monkeypatch, shard):
    rng = random.Random(shard)
    words = ["the", "A", "b2", "ñandú", "x", "Über", "99", "q", "of", "w" * 60]
    sentence = lambda n: rng.choice([" ", ", ", "_", "\n\n"]).join(rng.choices(words, k=n))
    items = [(i, sentence(rng.choice([12, 15, 25]))) for i in range(12)] + [(20, "the Über zebra"), (21, None), (22, " ."), (None, "x 99 x 99 x"), (23, items_text := sentence(11)), (24, items_text), (25, "zebra")]
    texts = [(i, " ".join([sentence(rng.randint(0, 30)), rng.choice(items)[1] or "", sentence(rng.randint(0, 30))])) for i in range(60)]
    texts += [(None, None), (None, ""), (3, "the über ZEBRA"), (3, "the über ZEBRA"), (100, " ".join(t or "" for _, t in items) * 3), (101, "w" * 500), (102, items[0][1][:-1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "spans", "items", "n_words")})
    monkeypatch.setattr(D, "BATCH", 7)
    monkeypatch.setattr(D, "AT_ONCE", 5)
    index = D.written(D.corpus_index(docs, shard), "index")
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    got = D.removal_spans(index, benchmark).collect()
    for r in got:
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert sorted(str((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], sorted(r["items"]))) for r in got) == plain_hits(texts, items)
    assert D.removal_spans(D.written(D.corpus_index(docs.limit(0), shard), "index"), benchmark).count() == 0
    assert {r.n for r in D.removal_spans(index, benchmark.limit(0)).select(F.size("spans").alias("n")).collect()} == {0}


def test_text_without_spans():
    assert D.without("One, two three; four.", [{"start": 1, "stop": 3}]) == "One, ; four."
    assert D.without(None, []) == "" and D.without("ñ Ñ x", [{"start": 0, "stop": 2}]) == " x"


# packing

def test_best_fit_against_a_scan_of_open_windows():
    rng = random.Random(4)
    for _ in range(60):
        most = rng.choice([1, 2, 10, 63, 64, 2048])
        lengths = np.array([rng.randint(1, most) for _ in range(rng.randint(0, 200))], np.int64)
        window, offset = P.best_fit_decreasing(lengths, most)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            tight = min((r for r in room if r >= lengths[i]), default=None)
            if window[i] == len(room):
                assert tight is None
                room.append(most)
            else:
                assert room[window[i]] == tight
            assert offset[i] == most - room[window[i]]
            room[window[i]] -= int(lengths[i])


@pytest.mark.parametrize("slots", ["NULL", "0", "-doc_id", "if(doc_id % 3 = 0, NULL, doc_id)", "if(doc_id = 5, 9000000000000000, doc_id)"])
def test_packing_reads_no_column_that_it_is_not_told(spark, tmp_path, slots):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({"slot": F.expr(slots).cast("long"), "seat": F.expr(slots).cast("long")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda d: sorted(map(tuple, P.op7_packing(spark, d).collect()))
    assert rows(str(tmp_path)) == rows(SF)
    pieces = P.written(P.cut(odd, place=("slot", "seat")), "pieces")
    got = P.pack(pieces, bundle=20, place=("slot", "seat")).collect()
    assert len(got) == pieces.count() and Counter(len(str(r.ids_crc32)) for r in got)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert max(Counter(r.sequence_id >> 20 for r in got).values()) <= 60
    with pytest.raises(ValueError):
        P.cut(odd, place=("start", "seat"))


# quality

def test_the_markers_own_characters_are_no_markers():
    from tallyrift.llm import quality as Q

    marked, other = (Q.grams([t])[0].tolist() for t in ("a\x02b\x01", "a\x03b\x03"))
    assert marked == other and len(marked) == 5
    ends = [g & 0xFFFF for g in Q.grams(["a\x02", "b"])[0].tolist()]
    assert ends.count(Q.END) == 2 and Q.grams(["a\x02", "b"])[1].tolist() == [3, 2]


# mixing

def windows_kept(rows, blocks, weights):
    """All blocks, once, in order and slot by slot, each within its window by the weights of its phase."""
    done, phase, begin = Counter(), None, 0
    for at, (k, j, slot, p) in enumerate(rows):
        assert slot == at and j == done[k]
        if p != phase:
            phase, begin, before = p, slot, dict(done)
            total = sum(Fraction(weights[x]) for x in blocks if done[x] < blocks[x])
        share, nth = Fraction(weights[k]) / total, j - before.get(k, 0)
        assert nth // share <= slot - begin < -(-(nth + 1) // share)
        done[k] += 1
    assert {k: n for k, n in blocks.items() if n} == dict(done)


def test_stretches_keep_all_windows():
    rng = random.Random(3)
    for _ in range(40):
        weights = {f"s{i}": rng.random() ** rng.choice([1, 4]) + 1e-3 if rng.random() < 0.5 else rng.randint(1, 9) for i in range(rng.randint(1, 12))}
        blocks = {k: rng.randint(0, rng.choice([3, 60, 300])) for k in weights}
        for slots in (1, 7, 50, 10**9):
            windows_kept(M.schedule(blocks, weights, slots), blocks, weights)


def test_one_stretch_is_one_run():
    weights = {"a": 5, "b": 3.5, "c": 2, "d": 0.25}
    one = [(k, j) for k, j, _, phase in M.schedule(dict.fromkeys(weights, 500), weights) if phase == 0]
    done, want = Counter(), []
    for k in M.line(weights):
        want.append((k, done[k]))
        done[k] += 1
        if len(want) == len(one):
            break
    assert one == want


def test_schedule_in_tasks(spark, monkeypatch):
    blocks, weights = {"a": 400, "b": 90, None: 33, "c": 0, "": 1}, {"a": 2.5, "b": 1, None: 0.7, "c": 9, "": 0.01}
    monkeypatch.setattr(M, "SLOTS", 60)
    got = sorted(map(tuple, M._scheduled(spark, blocks, weights).collect()), key=lambda r: r[2])
    assert got == list(M.schedule(blocks, weights, 60))
    windows_kept(got, blocks, weights)
    assert M._scheduled(spark, {}, {}).count() == 0


def test_far_stretches_are_cheap():
    """The state in a schedule of 10**12 slots comes from the slots just before it."""
    weights = {f"s{i}": (i + 1) ** 0.5 for i in range(30)}
    shares = M.Shares(weights)
    done = shares.done_by(10**12)
    assert sum(done.values()) == 10**12 and all(abs(n - Fraction(10**12 * shares.own[k], shares.whole)) < 1 for k, n in done.items())
    ends = list(M.phases(dict.fromkeys(weights, 10**11), weights))
    assert sum(n for _, _, n, _ in ends) == 30 * 10**11


def test_repeats_cut_their_batches_by_bytes(monkeypatch):
    """Contexts leave in batches of some AT_ONCE bytes; before, all of a batch of rows left at once, whatever their size."""
    import numpy as np
    import pandas as pd

    from tallyrift.llm import repeats

    monkeypatch.setattr(repeats, "AT_ONCE", 2000)
    text, numbers = "é" * 3000, np.arange(100, dtype=np.int32)
    rows = pd.DataFrame({"row": [1, 2], "text": [text, None], "gram": [numbers.astype(np.int64), numbers[:0].astype(np.int64)], **{c: [numbers, numbers[:0]] for c in ("lo", "hi", "at", "n")}})
    out = list(repeats._cut(iter([rows])))
    assert len(out) == 11 and max(sum(map(len, b["bytes"])) for b in out) == 2000
    told = pd.concat(out)
    assert told["lo"].tolist() == numbers.tolist() and all(d == text.encode()[i : i + repeats.LENGTH] for i, d in zip(told["lo"], told["bytes"], strict=True))
    data = bytes(np.random.default_rng(7).integers(0, 3, 3000, np.uint8)) + b"\xff" * 40 + b"\0" * 40
    assert repeats.two_stage(data, len(data)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_words_are_hashed_without_a_table_of_them():
    """One table a task held 150,000 words and took longer than the hashes; half a surrogate pair has its hash too."""
    import xxhash

    from tallyrift.llm.fingerprints import Shingles

    one, two = Shingles(1), Shingles(1)
    (a, n), (b, m) = one(["Éa b c", "", " x"]), two(["\ud800 éa", "b c x"])
    assert n.tolist() == [3, 0, 1] and m.tolist() == [2, 3] and a.tolist() == b[1:].tolist() and not hasattr(one, "known")
    assert len(set(b.tolist())) == 5 and xxhash.xxh3_64_intdigest("éa") == xxhash.xxh3_64_intdigest("éa".encode())
