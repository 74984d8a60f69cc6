import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.operators import events as E
from tallyrift.operators import matching as M
from tallyrift.operators import stats as S
from tallyrift.operators import titles
from tallyrift.plans import registry as Q
from tallyrift.sources import readers as R
from tallyrift.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    def cell(v):
        return "null" if v is None or v != v else f"{round(float(v), 6):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.ORACLES | jobs.ORACLES))
def test_query_and_oracle(spark, con, name):
    df = (Q.QUERIES | jobs.QUERIES)[name](spark, SF)
    want = con.sql((Q.ORACLES | jobs.ORACLES)[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_trend_at_five_percent_is_stable(spark):
    t = spark.createDataFrame([(u, y, r, False) for u, last in ((1, 105.0), (2, 105.1), (3, 94.0)) for y, r in ((1, 100.0), (2, 1.0), (3, 1.0), (4, last))] + [(4, 1, 1.0, False)], "cut int, year int, rate double, partial boolean")
    assert dict(S.three_step_trend(t).collect()) == {1: "stable", 2: "up", 3: "down", 4: "stable"}


def test_weighted_mean_counts_null_as_zero_with_weight(spark):
    t = spark.createDataFrame([(1, 10.0, 1.0, False), (1, None, 1.0, True), (1, 99.0, 0.0, False)], "k int, rate double, pop double, partial boolean")
    assert S.weighted_mean(t, ["k"]).collect()[0][1:] == (5.0, True)


def test_quantile_cut_collapses_to_three(spark):
    t = spark.createDataFrame([(1.0,)] * 5, "score double")
    assert {r.level for r in S.band_quantile_cut(t).collect()} == {3}


def test_scalars(spark):
    t = spark.createDataFrame([("  Ñuñoa's  Casa! ", "1.154,3537", "https://a.b/c?utm_x=1&q=2&UTM_y=3", "=1+1")], "a string, n string, u string, c string")
    got = t.select(X.slug(F.col("a")), X.locale_number(F.col("n")), X.canonical_url(F.col("u")), X.csv_guard(F.col("c")), X.locale_number(F.lit("S/I")), X.iso_date(F.lit("2026-7-1"))).first()
    assert tuple(got) == ("nunoas-casa", 1154.3537, "https://a.b/c?q=2", "'=1+1", None, None)


def test_stat_table():
    html = "<table><tr><td>x</td></tr></table><table><tr><td>Note</td></tr><tr><th>Unit</th><th>2020</th><th>2021</th></tr><tr class='k'><td>A</td><td>1,5</td><td>-</td></tr><tr><td>Label</td></tr></table>"
    assert list(R.stat_rows(html)) == [("A", "k", "2020", "1,5"), ("A", "k", "2021", "-")]


def test_token_url(spark):
    import base64
    t = base64.urlsafe_b64encode(b"\x08\x13https://a.b/c\x00").decode()
    assert spark.range(1).select(R.token_url(F.lit(t))).first()[0] == "https://a.b/c"


def test_token_set_ratio():
    assert M.token_set_ratio("a b c", "c b a") == 100.0
    assert M.token_set_ratio("", "a") == 0.0
    assert 0 < M.token_set_ratio("abc def", "abd xyz") < 100


def test_greedy_keeps_first_of_similar_titles(spark):
    t = spark.createDataFrame([(1, 1, "robbery at the bank"), (1, 2, "robbery at the bank!"), (1, 3, "storm"), (2, 1, "robbery at the bank")], "b int, o int, t string")
    assert sorted((r.b, r.o) for r in titles.greedy_titles(t, ["b"], "o", "t").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_nearest_takes_the_smaller_unit_on_a_tie(spark):
    t = spark.createDataFrame([(u, 1, 7.0) for u in (1, 2, 5)] + [(u, 1, 8.0) for u in (9, 8, 3)] + [(u, 2, v) for u, v in ((20, 0.1), (21, 0.3), (22, 0.2))] + [(30, 3, 8.1)], "u int, g int, v double")
    one = {r.u: r.other for r in E.nearest(t, "u", "g", "v", 1).collect()}
    assert one == {1: 2, 2: 1, 5: 1, 3: 8, 8: 3, 9: 3, 20: 22, 21: 22, 22: 20}
    three = [r.other for r in E.nearest(t, "u", "g", "v", 3).where("u = 5").orderBy("place").collect()]
    assert three == [1, 2, 3]
    assert {r.u: r.other for r in E.nearest(t, "u", "g", "v", 1, least=2).collect()} == one | {30: 3}


def test_dedup_greedy_compares_whole_titles(spark, tmp_path):
    same = "the same eighty characters at the head of both turns of this conversation, and on "
    turns = [(1, i, "user", same + c * 200) for i, c in enumerate("qz")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert Q.QUERIES["dedup_greedy"](spark, str(tmp_path)).count() == 2


def test_totals_do_not_depend_on_the_order_of_their_families(spark):
    """Sums of doubles in another order differ in their last bit: 17 or 18 where a point of a sparkline lies on a half."""
    from itertools import permutations
    t = spark.createDataFrame([(k, r) for k, rates in enumerate([*permutations([0.1, 0.2, 0.3]), (None, None)]) for r in rates], "cut int, rate double").coalesce(1)
    got = dict(S.total_rate(t, ["cut"]).collect())
    assert set(got.values()) == {0.1 + 0.2 + 0.3, 0.0} and got[6] == 0.0
