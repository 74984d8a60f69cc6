import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrift.llm import exact_dedup, fingerprints, mixing, ngram_join, packing, pii, quality, registry, repeats, sharding, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(None, None, "en", None, None), (None, "", "en", "a", 0), (1, "", None, "a", 0), (2, "  ", "en", "a", 2), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "One", "en", "b", 3),
       (5, "word " * 3000, "en", "a", 15000), (6, "a b c d e f g h i j " * 30, "en", "a", 600), (7, "a b c d e f g h i j " * 30, "en", "a", 600), (8, "x" * 5000 + "ñ", "es", "a", 5001), (9, "mail a@b.co and 4111 1111 1111 1111", "en", "a", 30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.collected()[1]))
def test_query_and_oracle(spark, name):
    queries, oracles = registry.collected()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = queries[name](spark, SF), con.sql(oracles[name])
    key = lambda names, data: sorted(tuple(str(r[names.index(n)]) for n in sorted(names)) for r in data)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(want.columns, want.fetchall())


def test_odd_rows_and_empty_tables(spark, odd, none):
    n = len(ODD)
    for docs, rows in ((odd, n), (none, 0)):
        docs = docs.withColumn("block", F.lit("clash"))
        assert mixing.mix(docs).count() == rows
        assert mixing.in_order(docs).columns == docs.columns
        assert pii.personal_data(docs).count() == rows
        assert fingerprints.fingerprints(docs).count() == rows
        assert ngram_join.similar_documents(docs, 4, 85, 100).count() == rows
        assert packing.pack(packing.cut(docs)).count() >= rows
        assert repeats.without_repeats(docs).count() == rows
        assert sharding.assign_shards(docs, "doc_id", [1.0] * 3).count() == rows
        assert quality.perplexities(docs, quality.train(docs)).count() == rows
        assert ngram_join.drop_similar(docs).columns == docs.columns
    kept = exact_dedup.drop_exact_copies(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "4", "5", "7", "8", "9"])
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_pfair_stays_within_a_block():
    for weights in ({"a": 0.9, "b": 0.1}, {"a": 4, **{f"s{i}": 1 for i in range(6)}}, {f"s{i}": i + 1 for i in range(17)}, {"a": 1}):
        slots = mixing.whole_slots(weights, 240)
        line, got = mixing.period_of(slots), dict.fromkeys(slots, 0)
        for t, k in enumerate(line, 1):
            got[k] += 1
            assert all(abs(got[x] - t * slots[x] / len(line)) < 1 for x in slots)


def test_mixture_is_a_permutation_of_places(spark):
    rows = mixing.op1_mixing(spark, SF).collect()
    assert len({(r.slot, r.seat) for r in rows}) == len(rows)
    blocks = {(r.source, r.block): r.slot for r in rows}
    assert len(set(blocks.values())) == len(blocks) == max(blocks.values()) + 1


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = exact_dedup.CuckooIndex(2), {}
    rng = random.Random(3)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(800)]
    for _ in range(4000):
        k = rng.choice(keys)
        if k in live:
            if rng.random() < 0.4:
                assert index.delete(k) and not index.delete(k)
                del live[k]
        else:
            index.insert(k, len(live))
            live[k] = True
        assert (index.find(k) is not None) == (k in live)
    assert index.size == len(live) == len(list(index.entries()))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in docs.items()}
    rows = packing.op7_packing(spark, SF).collect()
    filled = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(filled)) > 0.97


def test_best_fit_takes_the_tightest_window():
    window, offset = packing.best_fit_decreasing(np.array([6, 7, 3, 4, 2]), 10)
    assert window.tolist() == [1, 0, 0, 1, 2] and offset.tolist() == [0, 0, 7, 6, 0]


def test_two_stage_against_sorting():
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
        assert repeats.two_stage(data, 100).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    seen: dict = {}
    for _, b in docs:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = {}
    for d, b in docs:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = 1
        kept = bytes(x for x, c in zip(b, cover, strict=False) if not c)
        want[d] = (len(b), len(b) - len(kept), int((np.diff(np.append(0, cover)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in repeats.op8_repeats(spark, SF).collect()} == want


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 40)
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, SF).collect()}
    for (d, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        new = fingerprints.edited(text, following)
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (text.lower().split(), new.lower().split()))
        assert abs(got[d].near_edited - len(a & b) / len(a | b)) < 0.2
    assert len({r.fingerprint for r in got.values()}) <= len({t for _, t in docs})


def test_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:99], "x"]), " ".join(f"v{i}" for i in range(100)), " ".join(base), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in fingerprints.near_copies(rows).collect()) == [(0, 0), (1, 0), (2, 2), (3, 0), (4, 4)]


def test_joins_across_blocks_and_deals(spark, monkeypatch):
    """A chain in which only neighbours are linked, with small blocks and deals."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "FOLLOWERS", 2)
    chain = [(i, " ".join(f"t{j}" for j in range(i * 8, i * 8 + 150))) for i in range(12)]
    rows = spark.createDataFrame([*chain, (50, " ".join(f"z{j}" for j in range(150)))], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(rows, 4, 85, 100).collect()}
    assert got == {**{i: 0 for i in range(12)}, 50: 50}


def test_divide_skip_against_counting():
    rng = random.Random(5)
    for _ in range(100):
        lists = {g: sorted(rng.sample(range(30), rng.randint(1, 25))) for g in range(20)}
        query, least = rng.sample(range(20), 12), rng.randint(1, 9)
        count: dict = {}
        for g in query:
            if len(lists[g]) > 1:
                for x in lists[g]:
                    count[x] = count.get(x, 0) + 1
        got = ngram_join.divide_skip(lists, query, least)
        assert {x for x, n in count.items() if n >= least} == set(got) and all(least <= n <= count[x] for x, n in got.items())


def test_model_sums_to_one(spark):
    rows = spark.createDataFrame([("abab",), ("abba",), ("aa",)], "text string")
    model = sorted((r.key & (2**64 - 1), r.lp, r.lg) for r in quality.train(rows).collect())
    keys, lp, lg = np.array([m[0] for m in model], np.uint64), *(np.array([np.nan if m[i] is None else m[i] for m in model], float) for i in (1, 2))
    for context in ("", "ab", "zz"):
        head = quality.grams([context])[0][-1] >> np.uint64(16)
        all_ = (head << np.uint64(16)) | np.arange(quality.ALPHABET, dtype=np.uint64)
        assert abs(np.exp(quality.log_probabilities(all_, keys, lp, lg)).sum() - 1) < 1e-6


def test_weighted_rendezvous(spark):
    rows = sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "k"), "k", [1.0, 3.0], grown="g", added_weight=1.0)
    got = rows.groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 20_000, 1) for r in got} == {0: 0.2, 1: 0.8} or abs(next(r["count"] for r in got if r["shard"] == 1) - 15_000) < 400
    assert rows.where("g != shard AND g != 2").count() == 0


def test_gradients():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    emb, ids, mask, y = rng.normal(0, 1, (6, toxicity.WIDE)), rng.integers(0, 6, (5, 3)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0
    g, demb, _ = net._gradients(emb, ids, mask, y)
    loss = lambda: net._gradients(emb, ids, mask, y)[2]
    for k in ("xf", "hf", "hb", "cb", "a", "v", "o"):
        at = tuple(0 for _ in net.p[k].shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-2
        up = loss()
        net.p[k][at] = was - 1e-2
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-2 * max(1, abs(g[k][at])) + 1e-3


def test_toxicity_held_out(spark):
    rows = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = rows.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("toxic")).cast("int")).toPandas()
    assert got.iloc[:, 0].mean() >= 0.9


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and set(rows.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_packing_follows_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "ab"[i % 2]) for i in range(640)] + [(None, None, None)] * 2, "doc_id long, text string, source string")
    slots = {}
    for heavy in "ab":
        rows = corpus_pipeline.packing_stage(spark, mixing.placed(docs, {"a": 1, "b": 1} | {heavy: 15}), SF).collect()
        first = sorted(rows, key=lambda r: r.sequence_id)[:200]
        assert sum(r.doc_id is not None and "ab"[r.doc_id % 2] == heavy for r in first) > 150
        slots[heavy] = {r.doc_id: (r.slot, r.seat, r.sequence_id) for r in rows}
    assert len(slots["a"]) == 641 and slots["a"] != slots["b"]
    pieces = spark.createDataFrame([(i, 0, 1500, 0, 1500, i // 16, i % 16) for i in range(300)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long, seat long")
    rows = packing.pack(pieces.repartition(3), bundle=50, place=("slot", "seat")).orderBy("sequence_id").collect()
    assert [r.doc_id for r in rows] == list(range(300)) and len({r.sequence_id >> 40 for r in rows}) > 3
    assert {"slot", "seat"} <= set(corpus_pipeline.mixing_stage(spark, docs, SF).columns)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers
    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(*packing.tokenizer_files())
    assert list(encode("one<|endoftext|>two")) == [505, 50256, 11545]
    end = "<|endoftext|>"
    for text in ("", end, f" {end} {end}{end}x", "<|endoftext", f"a \n{end}\n\nb's  c", "x \u3000\x1c\x85 y", *(f"a{c * n} b{c * n}" for c in (" ", "\n", " \n") for n in (9_999, 10_000, 1_000_000))):
        assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids


def test_mixture_keeps_to_exact_weights(spark):
    from fractions import Fraction
    for weights in ({f"s{i:02}": 1 for i in range(20)}, {"a": 0.9998, "b": 0.0002}, {f"s{i}": (i + 1) ** 0.5 for i in range(17)}):
        exact = {k: Fraction(w) for k, w in weights.items()}
        share = {k: w / sum(exact.values()) for k, w in exact.items()}
        got = dict.fromkeys(weights, 0)
        for t, (k, _, slot, phase) in enumerate(mixing.schedule(dict.fromkeys(weights, 10**9), weights), 1):
            got[k] += 1
            assert slot == t - 1 and phase == 0 and abs(got[k] - t * share[k]) < 1
            if t % 500 == 0:
                assert all(abs(got[x] - t * share[x]) < 1 for x in got)
            if t == 12_000:
                break
    docs = spark.createDataFrame([(i, "a" if i < 3000 else None) for i in range(3010)], "doc_id long, source string")
    rows = mixing.mix(docs, {"a": 2999, None: 1}, block=1).collect()
    nulls = sorted(r.slot for r in rows if r.source is None)
    assert len(rows) == 3010 == len({r.slot for r in rows}) and nulls[0] < 3000 <= nulls[1]


def test_near_copies_link_past_the_leader(spark):
    """In a chain, and with null and repeated ids, classes are the components of all pairs above 0.8."""
    rng = random.Random(2)
    texts = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(300)]
        for _ in range(40):
            new = list(base)
            for i in rng.sample(range(300), rng.randint(0, 11)):
                new[i] = f"x{rng.random()}"
            texts.append(" ".join(new))
    texts += [" ".join(f"t{j}" for j in range(i * 8, i * 8 + 150)) for i in range(10)]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(grams):
            for j in range(i):
                if root[i] != root[j] and len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    rows = spark.createDataFrame([*enumerate(texts), (500, texts[0]), (500, "other"), (None, texts[50]), (None, None)], "doc_id long, text string")
    got = fingerprints.fingerprints(rows).select("doc_id", "class_id", "n_chars").collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None and r.doc_id < 500} == dict(enumerate(root))
    assert sorted((r.n_chars, r.class_id) for r in got if r.doc_id == 500) == sorted([(5, 500), (len(texts[0]), root[0])])
    assert {r.n_chars: r.class_id for r in got if r.doc_id is None} == {len(texts[50]): root[50], 0: None}


def test_drop_similar_decides_by_row(spark):
    text = lambda k, last="": " ".join(f"{k}{i}" for i in range(100)) + f" {last}"
    docs = [(1, text("a")), (None, text("a", "x")), (None, text("b")), (None, None), (None, text("c")), (None, text("c")), (None, text("c", "y")),
            (7, text("d")), (7, text("e")), (6, text("d", "z")), (9, text("f")), (9, text("f")), (9, text("f", "v"))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), (r.text or "-")[0]) for r in ngram_join.drop_similar(rows).collect())
    assert got == sorted([("1", "a"), ("None", "b"), ("None", "-"), ("None", "c"), ("7", "e"), ("6", "d"), ("9", "f")])
