import pytest
from pyspark.sql import functions as F

from tallyrift.operators import checks as C


def test_a_rule_for_each_outcome(spark):
    a = spark.createDataFrame([(i, i % 3, None if i == 5 else float(i)) for i in range(60)], "k long, g long, v double")
    b = spark.createDataFrame([("x",)], "s string")
    rule = lambda n, on, broken, **more: C.Rule(n, f"rule {n}", on, broken, F.col("k" if on == "a" else "s"), **more)
    rules = [rule(1, "a", F.col("k") > 60), rule(2, "a", F.col("v") >= 30), rule(3, "a", F.col("k") < 2, severity="DOCUMENTED", note="known"), rule(4, "a", F.lit(True), applies=F.col("g") == 9),
             rule(5, "a", F.col("v") < 0, applies=F.col("g") == 2), rule(6, "b", F.col("s") == "x"), rule(7, "empty", F.lit(True))]
    got = {r.n: r for r in C.report({"a": a, "b": b, "empty": b.limit(0)}, rules, most=4).collect()}
    assert [(n, got[n].status, got[n].checked, got[n].broken) for n in sorted(got)] == [(1, "PASS", 60, 0), (2, "FAIL", 60, 31), (3, "DOCUMENTED", 60, 2), (4, "DOCUMENTED", 0, 0), (5, "FAIL", 20, 1), (6, "FAIL", 1, 1), (7, "DOCUMENTED", 0, 0)]
    assert got[2].evidence == ["30", "31", "32", "33"] and got[5].evidence == ["5"] and got[3].note == "known" and got[1].evidence == []
    with pytest.raises(ValueError, match="nowhere"):
        C.report({"a": a}, [rule(1, "nowhere", F.lit(True))])


def test_all_ten_rules_fail_on_something_but_those_that_hold(spark):
    from tallyrift.plans.publishing import quality_report
    status = {r.n: (r.status, r.broken > 0) for r in quality_report(spark, "/root/testdata/sf0.01").collect()}
    assert len(status) == 10 and {status[n] for n in (2, 3, 7, 9, 10)} == {("FAIL", True)} and status[6] == ("FAIL", True) and status[5] == ("PASS", False) and status[4] == ("DOCUMENTED", True)


def test_values_expected_and_found(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r.k: (r.expected, r.n) for r in C.expected_found(rows, "k", ["a", "c", "c"]).collect()}
    assert got == {"a": (True, 2), "b": (False, 1), "c": (True, 0)}
    assert [tuple(r) for r in C.expected_found(rows.limit(0), "k", ["c"]).collect()] == [("c", True, 0)]


def test_an_archive_alone_is_not_the_union(spark):
    table = lambda rows: spark.createDataFrame(rows, "id string, month string")
    current, archive = table([("x", "2019-01"), ("y", "2019-01"), ("y", "2019-01"), ("z", None)]), table([("y", "2019-01"), ("w", "2018-12")])
    published = spark.createDataFrame([("2019-01", 1), ("2018-11", 4), (None, 3)], "month string, n long")
    got = {r.month: (r.published, r.counted) for r in C.recounted(published, "n", [current, archive], "id", "month").collect()}
    assert got == {"2019-01": (1, 2), "2018-12": (None, 1), "2018-11": (4, None)}
    rule = C.Rule(1, "months", "m", F.col("published") != F.col("counted"), F.col("month"))
    row = C.report({"m": C.recounted(published, "n", [current, archive], "id", "month")}, [rule]).first()
    assert (row.status, row.broken, row.evidence) == ("FAIL", 3, ["2018-11", "2018-12", "2019-01"])


def test_facet_rules_on_the_tables(spark):
    from tallyrift.plans.pages import facet_report
    got = {r.n: (r.status, r.evidence) for r in facet_report(spark, "/root/testdata/sf0.01").collect()}
    assert {n for n, (status, _) in got.items() if status == "FAIL"} >= {2, 3, 4, 5, 6, 8} and got[1][0] == got[7][0] == "PASS" and got[4][1] == "error" and got[5][1] == "refund"
