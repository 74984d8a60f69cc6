"""The operators without an oracle against plain versions, and rows of odd kinds."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice
from math import ceil, exp, floor, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrift.llm import exact_dedup, fingerprints, mixing, ngram_join, packing, pii, quality, repeats, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_id _source _h _nth _i _t _digest _place _spans _block _n _first _at _word _bit _bits _best slot seat row key class_id grams".split()
ODD = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, None, "en", None, 0), (2, "  \n", "en", "a", 2), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3),
       (4, "One", "de", "b", 3), (5, "word " * 3000, "en", "a", 15000), (6, "a b c d e f g h i j " * 30, "en", "a", 600), (7, "a b c d e f g h i j " * 30, "en", "a", 600), (8, "x" * 5000 + "ñ", "es", "a", 5001)]


def slots_by_hand(weights, n):
    """The source of each slot: of the released blocks the one that PD2 puts first, all windows written out."""
    total = sum(Fraction(w) for w in weights.values())
    share = {k: Fraction(w) / total for k, w in weights.items()}
    window = lambda k, j: (floor(j / share[k]), ceil((j + 1) / share[k]))

    def group(k, j):
        """Where the cascade of windows of two slots that begins with block j ends."""
        while True:
            (_, due), (begin, end) = window(k, j), window(k, j + 1)
            if begin == due:
                return due
            if end - begin == 3:
                return end - 1
            j += 1

    done, out = dict.fromkeys(weights, 0), []
    for slot in range(n):
        ready = []
        for k, j in done.items():
            (begin, due), following = window(k, j), window(k, j + 1)[0]
            if begin <= slot:
                overlaps = following < due
                cascade = group(k, j) if overlaps and Fraction(1, 2) <= share[k] < 1 else due
                ready.append((due, not overlaps, -cascade, str(k), k))
        k = min(ready)[-1]
        out.append(k)
        done[k] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 1}, {"a": 8, "b": 5, "c": 2}, {"a": 11, "b": 3, "c": 1, "d": 1}, {f"s{i}": i + 1 for i in range(9)}, {"a": 2, "b": 2, "c": 1}])
def test_schedule_against_one_by_hand(weights):
    assert list(islice(mixing.line(weights), 400)) == slots_by_hand(weights, 400)


def perplexities_by_hand(trusted, texts, order=quality.ORDER, alphabet=quality.ALPHABET):
    pad = lambda t: "\x01" * (order - 1) + "".join("￿" if ord(c) > 0xFFFF or c == "\0" else c for c in t) + "\x02"
    counts = {order: Counter(p[i : i + order] for p in map(pad, trusted) for i in range(len(p) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, totals = {}, {}
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = [min(i, max(0.05, i - (i + 1) * y * of[i + 1] / of[i])) if of[i] else 0.5 * i for i in (1, 2, 3)]
        cut[n] = d
        totals[n] = defaultdict(lambda: [0, 0.0])
        for g, m in c.items():
            totals[n][g[:-1]][0] += m
            totals[n][g[:-1]][1] += d[min(m, 3) - 1]

    def p(gram):
        n = len(gram)
        below = p(gram[1:]) if n > 1 else 1 / alphabet
        if gram[:-1] not in totals[n]:
            return below
        total, spared = totals[n][gram[:-1]]
        m = counts[n][gram]
        return (m - cut[n][min(m, 3) - 1] if m else 0) / total + spared / total * below

    return [exp(-sum(log(p(x[i : i + order])) for i in range(len(x) - order + 1)) / (len(t) + 1)) for t, x in ((t, pad(t)) for t in texts)]


def test_perplexities_against_a_plain_model(spark):
    rng = random.Random(4)
    words = ["the", "and", "straße", "año", "sea", "sees", "𝄞note", "a", "is"]
    some = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60)]
    trusted, texts = some[:25], [*some, "", "zzz qqq", "x" * 3000, None, some[0]]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    model = quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(rows, model).collect()}
    want = perplexities_by_hand(trusted, [t or "" for t in texts])
    assert len(got) == len(want) and all(abs(got[i] / w - 1) < 1e-9 for i, w in enumerate(want))


def test_thresholds_by_language(spark):
    scores = spark.createDataFrame([(1, "en", 2.0), (2, "en", 2.0), (3, "en", 2.3), (4, "en", 2.31), (5, "de", 99.0), (6, None, 50.0), (None, "en", 9.0)], "doc_id long, lang string, perplexity double")
    good = spark.createDataFrame([(1,), (2,), (2,), (77,)], "doc_id long")
    got = {(r.doc_id, r.kept) for r in quality.judged(scores, good).collect()}
    assert got == {(1, True), (2, True), (3, True), (4, False), (5, True), (6, True), (None, False)}  # 2.0 x MARGIN is 2.3
    assert quality.judged(scores.limit(0), good).count() == 0 and quality.judged(scores, good.limit(0)).where("kept").count() == 7


def test_personal_data_in_long_texts(spark):
    n = 5000
    texts = ["12 x " * n, "+123456789012 y " * n, "my ip 10.0.0.2" + "." * 50 + " recipient 10.0.0.1 ipsum", "hotel 123-45-6789", "ssn 123-45-6789", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("_found_ip", F.lit("clash"))
    got = {r.doc_id: [(s.s, s.e, s.kind, s.points) for s in r.spans] for r in pii.personal_data(rows).collect()}
    assert got[0] == [] and got[1] == [(16 * i, 16 * i + 13, "phone", 60) for i in range(n)]
    assert got[2] == [(6, 14, "ip", 90), (75, 83, "ip", 60)] and got[3] == [] and got[4] == [(4, 15, "ssn", 60)] and got[5] == got[6] == []
    clean = {r.doc_id: r.text for r in pii.redact(rows).where("doc_id > 1").collect()}
    assert clean == {2: "my ip [ip]" + "." * 50 + " recipient [ip] ipsum", 3: texts[3], 4: "ssn [ssn]", 5: None, 6: ""}


def test_running_totals(spark):
    rng = random.Random(1)
    arrays = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 9000)]
    rows = spark.createDataFrame([(i, x, x) for i, x in enumerate(arrays)], "i int, s array<int>, m array<int>")
    sums = {r.i: r.s for r in pii.running(rows, ["s"], lambda a, b: a + b).collect()}
    tops = {r.i: r.m for r in pii.running(rows, ["m"], F.greatest).collect()}
    for i, x in enumerate(arrays):
        assert sums[i] == np.cumsum(x).tolist() and tops[i] == (np.maximum.accumulate(x).tolist() if x else [])


def test_long_texts_are_cut_only_for_hashing(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("ab \n") for _ in range(5000)).encode()
    strings = defaultdict(set)
    monkeypatch.setattr(repeats, "AT_ONCE", 700)
    for texts in ([text], [text[1000:3000], b"short", text]):
        seen = Counter()
        for own, gram, _, lo, hi, at in repeats.contexts(texts):
            for t, g, a, b, p in zip(own.tolist(), gram.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                assert a <= p <= b + repeats.LENGTH - repeats.GRAM
                for i in range(a, b + 1):
                    seen[t, i] += 1
                    strings[texts[t][i : i + repeats.LENGTH]].add(g)
        assert seen == {(t, i): 1 for t, x in enumerate(texts) for i in range(len(x) - repeats.LENGTH + 1)}
    assert all(len(g) == 1 for g in strings.values())


def test_contexts_in_short_runs(monkeypatch):
    """What a run tells adds up to the same, however short the runs are."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(6)]
    texts = ["".join(rng.choices(passages, k=4)) + str(i) for i in range(40)]
    batches = [pd.DataFrame({"row": range(i, i + 10), "text": texts[i : i + 10]}) for i in range(0, 40, 10)]

    def told(run):
        monkeypatch.setattr(repeats, "RUN", run)
        rows = pd.concat(list(repeats._found(iter(batches))))
        spans = {(r.row, x) for r in rows[rows.n == 0].itertuples() for x in range(r.lo, r.hi)}
        seen = rows[rows.n > 0].groupby(["gram", "context"]).n.sum().clip(upper=2)
        return seen.to_dict(), spans, len(rows)

    whole, short = told(10**9), told(30)
    assert whole[0] == short[0] and short[1] <= whole[1] and short[2] > whole[2]


def test_repeats_in_a_text_of_70_mb(spark):
    long_ = F.expr("array_join(transform(sequence(1, 1100000), i -> sha2(cast(i as string), 256)), '')")
    passage = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(long_, F.lit(passage), F.lit("!")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(2, f"? {passage} ?"), (None, None)], "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.without_repeats(rows).drop("kept_text").collect()}
    assert got == {1: (64 * 1_100_000 + 301, 300, 1), 2: (304, 300, 1), None: (0, 0, 0)}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs, docs.limit(0)


def test_clashing_names_and_odd_rows(spark, tables):
    """Values, not only counts: what a clash, a null or a repeated row must not change."""
    docs, none = tables
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda df, *cols: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    for op, cols in ((exact_dedup.drop_exact_copies, ("doc_id", "text")), (ngram_join.drop_similar, ("doc_id", "text")), (mixing.placed, ("doc_id", "text", "source", "slot", "seat"))):
        told = op(docs).persist()
        assert [c for c in told.columns if c not in ("slot", "seat")] == [c for c in docs.columns if c not in ("slot", "seat")]
        assert op is ngram_join.drop_similar or key(told, *cols) == key(op(plain), *cols) and op(none).count() == 0
        assert told.where("_id != 'clash' OR grams != 'clash'").count() == 0
        if op is ngram_join.drop_similar:
            assert key(told, "doc_id") == sorted(map(str, [(None,), (None,), (1,), (2,), (3,), (5,), (6,), (8,)]))
    shards = sharding.assign_shards(docs, "doc_id", [1.0, 2.0], "_best", "grown", 0.0)
    assert shards.where("_best != grown").count() == 0 and shards.count() == len(ODD)
    assert key(sharding.slots(docs, "lang", F.lit(0), ["doc_id"], 1, "place"), "lang", "place") == key(sharding.slots(plain, "lang", F.lit(0), ["doc_id"], 1, "place"), "lang", "place")
    groups = {r.n_chars: r.class_id for r in fingerprints.fingerprints(docs).select("n_chars", "class_id").where("doc_id IN (5, 6, 7)").collect()}
    assert groups == {15000: 5, 600: 6}
    assert sorted(str(r.class_id) for r in fingerprints.near_copies(docs).collect()) == sorted(map(str, [None, None, 1, 2, 3, 3, 3, 5, 6, 6, 8]))
    pieces = packing.cut(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in pieces if r.doc_id in (1, 3, 5)} == {1: 1, 3: 4, 5: next(r.m for r in pieces if r.doc_id == 5)}
    order = mixing.in_order(docs, {"a": 3, "b": 1, None: 1})
    assert order.columns == docs.columns and order.where("slot = 'clash' AND seat = 'clash'").count() == len(ODD)
    places = [(r.slot, r.seat) for r in mixing.placed(docs).select("slot", "seat").collect()]
    assert len(set(places)) == len(places) == len(ODD)


def test_toxic_rows_of_odd_kinds(spark, tables):
    docs, none = tables
    bad, good = "you stupid filthy worm go away ", "the river runs past the old mill "
    rng = random.Random(3)
    some = [(100 + i, " ".join(rng.sample((bad if i % 2 else good).split(), 5) + rng.sample("on a day with some rain and wind".split(), 4)), "en", "a", 0) for i in range(160)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(some, SCHEMA)).withColumn("score", F.lit("clash")).withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, (i - 100) % 2) for i, *_ in some] + [(None, 1), (3, None), (4, 7), (100, 1), (9999, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and kept.where("score != 'clash'").count() == 0
    left = Counter(r.doc_id for r in kept.collect())
    right = sum((left[i] == 0) == bool((i - 100) % 2) for i, *_ in some)
    assert right >= 0.95 * len(some) and left[3] in (0, 2)  # equal rows share their fate
    assert toxicity.drop_toxic(rows.limit(0), labels).count() == 0 and toxicity.drop_toxic(rows.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(rows, labels.limit(0)).count() == rows.count()
    long_ = " ".join([good * 2000, bad * 5, good * 2000])
    net = toxicity.fit(rows, labels)
    clean, dirty, empty = net.scores([good * 4000, long_, ""])
    assert clean < 0.5 <= dirty and 0 <= empty <= 1


def plain_logit(p, words):
    """A window's logit by the formulas, one word and one unit at a time."""
    size, wide = toxicity.HIDDEN, toxicity.WIDE
    squash = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for w in words:
        whole, grams, _ = toxicity.word_hashes([w])
        inputs.append([float(p["words"][whole[0]][d]) + (sum(float(p["grams"][g][d]) for g in grams) / math.sqrt(len(grams)) if len(grams) else 0.0) for d in range(wide)])
    states = [[] for _ in words]
    for side, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        w, u, c = (p[k + side].tolist() for k in "xhc")
        h = [0.0] * size
        for t in order:
            x = [c[j] + sum(inputs[t][d] * w[d][j] for d in range(wide)) for j in range(3 * size)]
            y = [sum(h[i] * u[i][j] for i in range(size)) for j in range(3 * size)]
            z = [squash(x[j] + y[j]) for j in range(size)]
            r = [squash(x[size + j] + y[size + j]) for j in range(size)]
            n = [math.tanh(x[2 * size + j] + r[j] * y[2 * size + j]) for j in range(size)]
            h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
            states[t] += h
    a, v = p["a"].tolist(), p["v"].tolist()
    energy = [sum(math.tanh(sum(s[i] * a[i][j] for i in range(2 * size))) * v[j] for j in range(size)) for s in states]
    weight = [math.exp(e) for e in energy]
    mean = [sum(w * s[i] for w, s in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * size)]
    top = [max(s[i] for s in states) for i in range(2 * size)]
    return sum(x * float(o) for x, o in zip([*mean, *top], p["o"], strict=True)) + float(p["bias"][0])


def test_score_against_a_plain_network():
    net = toxicity.Network.fresh(5)
    for k in ("cf", "cb", "scale"):
        net.p[k] += np.random.default_rng(1).normal(0, 0.2, net.p[k].shape).astype(np.float32)
    texts = ["a few plain words", "other Words, and more of them " * 12, "ñandú", "one"]
    for text, score in zip(texts, net.scores(texts), strict=True):
        words = text.lower().split()
        windows = [words[i : i + toxicity.WINDOW] for i in toxicity.windows_of(len(words)).tolist()]
        assert windows[-1] == words[len(words) - len(windows[-1]) :]
        worst = max(plain_logit(net.p, w) for w in windows)
        assert abs(score - 1 / (1 + math.exp(-worst * float(net.p["scale"][0])))) < 1e-4


def write(spark, rows, labels, path):
    rows.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        base = rng.choices(words, k=80)
        docs += [" ".join(base), " ".join(base).upper(), " ".join([*base[:79], "end"]), " ".join(rng.choices(words, k=rng.choice([3, 40, 5000])))]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(docs)] + [(None, None, None, None, None), (500, "", "en", "s0", 0), (501, None, "en", None, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = corpus_pipeline.run(spark, write(spark, spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit(1)), labels, tmp_path)).collect()

    groups = {}
    for d, t, *_ in rows:
        k = (t or "").lower()
        groups[k] = d if k not in groups or groups[k] is None or d is not None and d > groups[k] else groups[k]
    left = [(d, t) for d, t, *_ in rows if groups[(t or "").lower()] == d]
    grams = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if (x := (t or "").lower().split()) else set() for _, t in left]
    root = list(range(len(left)))
    for i, a in enumerate(grams):
        for j in range(i):
            if a and root[i] != root[j] and len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    want = sorted(min(d for (d, _), r in zip(left, root, strict=True) if r == k) for k in set(root))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sorted(pieces) == want
    for parts in pieces.values():
        assert sum(n for _, n, _ in parts) == parts[0][2] and sorted(s for s, *_ in parts) == [2048 * i for i in range(len(parts))]
    order = {r.doc_id: (r.slot, r.seat) for r in got}
    assert len(set(order.values())) == len(order)
    source = {d: s for d, _, _, s, _ in rows}
    sizes = Counter(source[d] for d in order)
    slots = defaultdict(set)
    for d, (slot, _) in order.items():
        slots[slot].add(source[d])
    line = mixing.schedule({k: -(-n // mixing.BLOCK) for k, n in sizes.items()}, {k: n**0.5 for k, n in sizes.items()})
    assert {slot: {k} for k, _, slot, _ in line} == dict(slots)


def test_pipeline_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.run(spark, write(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)).count() == 0


def test_nothing_is_left_behind(spark, monkeypatch, tmp_path):
    """Operators leave only what their result reads, and nothing after an error."""
    from tallyrift.llm import common
    monkeypatch.setattr(common, "LOCAL_FOLDER", str(tmp_path))
    rows = spark.createDataFrame([(i, f"a b c d e f g h {i % 3}") for i in range(20)], "doc_id long, text string")
    out = ngram_join.drop_similar(rows)
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert out.count() == 3 and left <= {"told"}

    @common.tidy
    def fails():
        common.written(rows, "lost")
        raise ValueError
    with pytest.raises(ValueError):
        fails()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("lost")]


def test_exact_groups_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 3)
    texts = [f"t{i % 7}" for i in range(40)]
    rows = exact_dedup.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    groups = exact_dedup.copy_groups(rows)
    assert groups.rdd.getNumPartitions() == 14
    assert sorted((r.keep_id, r.group_size) for r in groups.collect()) == sorted((max(i for i, t in enumerate(texts) if t == k), texts.count(k)) for k in set(texts))
