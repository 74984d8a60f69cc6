import os
import random
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from tallyrift import lineage
from tallyrift.operators import matching as M
from tallyrift.operators import titles as T


def plain_greedy(rows, least=0.82):
    kept, out = {}, []
    for block, order, title in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "")):
        title = title or ""
        had = kept.setdefault(block, [])

        def near(k):
            m = SequenceMatcher(None, title, k)
            return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

        if not any(near(k) for k in had):
            had.append(title)
            out.append((block, order, title))
    return Counter(out)


def changed(rng, title, most=12):
    chars = list(title)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(chars) + 1)
        chars[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ñ", "a "])
    return "".join(chars)


@pytest.mark.parametrize(("first", "tile"), [(9, 4), (30, 7), (2048, 2048)])
def test_greedy_rounds_against_plain_loops(spark, first, tile):
    rng = random.Random(first)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(25)]
    rows = [(rng.choice([1, 1, 1, 2, None]), i if rng.random() < 0.97 else None, changed(rng, rng.choice(base)) if rng.random() < 0.95 else None) for i in range(400)]
    rows += rows[:20]
    table = spark.createDataFrame(rows, "b int, o long, t string")
    got = Counter((r.b, r.o, r.t or "") for r in T.greedy_titles(table, ["b"], "o", "t", first=first, tile=tile).collect())
    assert got == plain_greedy(rows)


def test_greedy_on_a_block_of_20000(spark):
    """One block, several rounds, tiles of a thousand; a third of the titles are copies of one, the last to come."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(50)) for _ in range(120)]
    rows = [(7, i, changed(rng, rng.choice(base[:-1] if i < 13_000 else base[-1:]), 2)) for i in range(20_000)]
    table = spark.createDataFrame(rows, "b int, o long, t string").repartition(8)
    got = T.greedy_titles(table, ["b"], "o", "t", first=64, tile=1000)
    assert Counter(map(tuple, got.collect())) == plain_greedy(rows)


def test_greedy_of_nothing_and_extra_columns(spark):
    table = spark.createDataFrame([(1, 2, "b c", "x"), (1, 1, "b c", "y")], "b int, o int, _title string, _block string")
    assert [tuple(r) for r in T.greedy_titles(table, ["b"], "o", "_title").collect()] == [(1, 1, "b c", "y")]
    assert T.greedy_titles(table.limit(0), ["b"], "o", "_title").count() == 0


def some_titles(seed):
    rng = random.Random(seed)
    words = ["the", "a", "robo", "centro", "x" * 30, "Ñuñoa", "7", "fire", "b", "incendio", "zzzz", "qqqq", "wwwwwwww"]
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 7))), " ".join(rng.choices(words, k=rng.randint(1, 7)))])) for i in range(120)]


@pytest.mark.parametrize("part", [7, 40, 512])
@pytest.mark.parametrize("least", [45.0, 80.0, 100.0])
def test_proposed_pairs_against_all_pairs(spark, part, least):
    rows = some_titles(part)
    table = spark.createDataFrame(rows, "b int, o long, t string")
    want = {(b, i, j, M.token_set_ratio(x or "", y or "")) for (b, i, x), (c, j, y) in combinations(rows, 2) if b == c}
    want = {p for p in want if p[3] >= least}
    got = T.proposed_pairs(table, ["b"], "o", "t", least, part).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    work = {r.b: (r.pairs, r.scored, r.proposed) for r in T.pair_work(table, ["b"], "o", "t", least, part).collect()}
    sizes = Counter(r[0] for r in rows)
    assert {b: w[0] for b, w in work.items()} == {b: n * (n - 1) // 2 for b, n in sizes.items()}
    assert sum(w[2] for w in work.values()) == len(want) and all(w[2] <= w[1] <= w[0] for w in work.values())
    if least == 80.0:
        assert sum(w[1] for w in work.values()) < 0.6 * sum(w[0] for w in work.values())


def test_proposed_pairs_of_odd_rows(spark):
    table = spark.createDataFrame([(1, 1, "a b"), (1, 1, "a b"), (1, None, "a b"), (1, 2, "a b")], "b int, o int, t string")
    assert sorted(tuple(r) for r in T.proposed_pairs(table, ["b"], "o", "t").collect()) == [(1, 1, 2, 100.0)] * 2
    assert T.proposed_pairs(table.limit(0), ["b"], "o", "t").count() == 0


def test_scratch_deletes_what_nothing_reads(spark):
    with lineage.Scratch(spark, "test") as scratch:
        one, two = scratch.keep(spark.range(3), "one"), scratch.keep(spark.range(4), "two")
        scratch.forget(one)
    assert two.count() == 4 and not os.path.exists(one.kept_at)
    with pytest.raises(ZeroDivisionError), lineage.Scratch(spark, "test") as scratch:
        scratch.keep(spark.range(3), "one")
        raise ZeroDivisionError
    assert not os.path.exists(scratch.folder)
