import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyrift.operators.ordering import at_places, numbered


def hot(spark, n, empty):
    """Half of the rows are 0, some have no value."""
    rng = random.Random(n)
    rows = [(i, None if rng.random() < empty else 0.0 if rng.random() < 0.5 else round(rng.uniform(-5, 5), 2), "ab"[i % 2]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, v double, g string").repartition(4)


@pytest.mark.parametrize("empty", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("tie", ["k", None])
def test_places_with_a_value_that_half_of_the_rows_have(spark, empty, tie):
    rows, df = hot(spark, 3000, empty)
    for down in (False, True):
        got, n = numbered(df, "p", "v", tie, ["g"], down, ranges=64, size=50)
        assert n == sum(v is not None for _, v, _ in rows)
        order = lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if down else r[1])
        want = {}
        for g in "ab":
            mine = sorted((r for r in rows if r[2] == g), key=lambda r: (order(r), r[0]))
            for i, r in enumerate(mine, 1):
                want[r[0]] = i if tie or i == 1 or order(r) != order(mine[i - 2]) else want[mine[i - 2][0]]
        assert {r.k: r.p for r in got.collect()} == want


@pytest.mark.parametrize("empty", [0.0, 0.4])
def test_no_part_is_much_larger_than_its_size(spark, empty):
    rows, df = hot(spark, 20_000, empty)
    got, _ = numbered(df, "p", "v", "k", (), False, ranges=256, size=500)
    window = [p for p in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition" in p and "_part" in p and "row_number" in p]
    assert window and "_tied" in window[0]
    parts = Counter((r._part, r._tied) for r in dealt(df, 500).collect())
    assert max(parts.values()) <= 1000


def dealt(df, size):
    """The parts that ``numbered`` deals to, seen before it drops them."""
    seen = []
    drop = type(df).drop

    def kept(self, *names):
        if "_part" in names:
            seen.append(self)
        return drop(self, *names)

    type(df).drop = kept
    try:
        numbered(df, "p", "v", "k", (), False, ranges=256, size=size)
    finally:
        type(df).drop = drop
    return seen[-1].select("_part", "_tied")


def test_values_at_places(spark):
    rows, df = hot(spark, 5000, 0.2)
    values = sorted(v for _, v, _ in rows if v is not None)
    n = len(values)
    places = [1, 2, n // 3, n // 2, n // 2 + 1, n - 1, n]
    assert list(at_places(df, "v", lambda m: places, ranges=64, size=20).first()) == [values[p - 1] for p in places]
    assert list(at_places(df, "k", lambda m: [m, 1]).first()) == [4999, 0]
    assert list(at_places(df.where("v IS NULL"), "v", lambda m: [1, m]).first()) == [None, None]
