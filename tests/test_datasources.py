import json

import pytest
from pyspark.sql import functions as F

from tallyrift.sources import datasources as D
from tallyrift.streaming import jobs


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_filter_asks_for_fewer_requests(pushing, tmp_path):
    def ask(request):
        (tmp_path / "-".join(str(request[c]) for c in D.REQUEST)).write_text("asked")
        return f"<p>{request['family']}/{request['year']}</p>"

    def asked():
        names = sorted(p.name for p in tmp_path.iterdir())
        for n in names:
            (tmp_path / n).unlink()
        return names

    D.statistics(pushing, ask)
    source = lambda: pushing.read.format("statistics").option("families", "1,2,3").option("years", "2023,2024").load()
    assert source().count() == 6 and len(asked()) == 6
    one = source().where("family = 2 AND year IN (2024, 2025)")
    assert one.rdd.getNumPartitions() == 1
    assert [tuple(r) for r in one.collect()] == [(2, 2024, 2, "<p>2/2024</p>")] and asked() == ["2-2024-2"]
    some = source().where("family > 1 AND html LIKE '%2023%' AND measure = 2")
    assert sorted(r.family for r in some.collect()) == [2, 3]
    asked()
    assert source().where("family = 9").count() == 0 and asked() == []


def test_a_ledger_as_a_stream_goes_on_where_it_was(spark, tmp_path):
    file = f"{tmp_path}/ledger.jsonl"

    def lines(first, upto):
        with open(file) as f:
            return f.read().splitlines()[first:upto]

    def length():
        with open(file) as f:
            return len(f.read().splitlines())

    def add(*texts):
        with open(file, "a") as f:
            f.writelines(t + "\n" for t in texts)

    D.ledger(spark, length, lines, many=3)
    add(*(json.dumps({"id": i, "status": "fetched"}) for i in range(7)), "no json", json.dumps({"status": "no id"}), "[1]")
    run = lambda: jobs.committed(spark.readStream.format("ledger").load(), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.line, r.key) for r in run().collect()) == [(i, str(i)) for i in range(7)]
    add(json.dumps({"id": 3, "status": "again"}), json.dumps({"id": "x"}))
    got = run()
    assert sorted((r.line, r.key) for r in got.collect())[7:] == [(10, "3"), (11, "x")]
    assert got.where("key = '3'").select(F.get_json_object("json", "$.status").alias("s")).orderBy("line").collect()[-1].s == "again"
