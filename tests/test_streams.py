import os
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrift.sources.committed import Committed
from tallyrift.streaming import jobs


def landed(spark, rows, kind, path):
    """A file for each lot of rows, in their order."""
    for i, lot in enumerate(rows):
        spark.createDataFrame(lot, kind).coalesce(1).write.parquet(f"{path}/{i}.parquet")
        for f in os.listdir(f"{path}/{i}.parquet"):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{i}.parquet/{f}", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def at(day, hour=12):
    return f"{date(2024, 1, 1) + timedelta(days=day)} {hour:02}:00:00"


def test_a_key_is_remembered_for_sixty_days_and_not_for_sixty_one(spark, tmp_path):
    lots = [[("a", at(0)), ("b", at(0)), ("a", at(0, 13)), ("old", at(1)), ("older", at(1)), (None, at(0))], [("c", at(30)), ("a", at(30)), (None, at(30))], [("a", at(60)), ("d", at(60))], [("b", at(61)), ("b", at(62)), ("e", at(61))], [("c", at(91)), ("b", at(121)), ("a", at(95)), (None, at(95))], [("b", at(122))]]
    stream = landed(spark, lots, "url string, ts string", f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = spark.createDataFrame([("old", "2023-11-03"), ("older", "2023-11-02"), ("older", "2023-10-01")], "url string, date string")
    new = jobs.unseen(stream, "url", "ts", seen, late="5 days")
    out = jobs.committed(new, f"{tmp_path}/out", f"{tmp_path}/state")
    days = sorted((str(r.url), (r.ts.date() - date(2024, 1, 1)).days) for r in out.collect())
    assert days == sorted([("a", 0), ("b", 0), ("older", 1), ("None", 0), ("c", 30), ("d", 60), ("b", 61), ("e", 61), ("c", 91), ("a", 95), ("None", 95), ("b", 122)])


@pytest.mark.parametrize("lots", [1, 3, 7])
def test_unseen_against_a_ledger_in_memory(spark, tmp_path, lots):
    rng = random.Random(lots)
    rows = sorted(((rng.choice("abcdef"), at(rng.randint(0, 60), rng.randint(0, 23))) for _ in range(150)), key=lambda r: r[1])
    cut = [rows[i * len(rows) // lots : (i + 1) * len(rows) // lots] for i in range(lots)]
    stream = landed(spark, cut, "url string, ts string", f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.committed(jobs.unseen(stream, "url", "ts", days=4, late="1 days"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    first, want = {}, []
    for k, t in rows:
        d = date.fromisoformat(t[:10])
        if k not in first or d > first[k] + timedelta(days=4):
            first[k] = d
            want.append((k, d))
    assert sorted((r.url, r.ts.date()) for r in out) == sorted(want)


class Killed(Exception):
    pass


def test_a_batch_killed_between_partitions_counts_once(spark, tmp_path, monkeypatch):
    lots = [[(1, "2024-01-05"), (2, "2023-11-05")], [(2, "2024-01-05"), (3, "2024-01-06"), (4, "2023-10-06")], [(5, "2024-01-07")]]
    kind, into, state = "id long, date string", f"{tmp_path}/out", f"{tmp_path}/state"
    stream = lambda: landed_once(spark, lots, kind, f"{tmp_path}/in")
    add, dead = Committed._add, []

    def dies(self, version):
        """Once, after the data of the second batch are written and before they are named."""
        if version["version"] == 1 and not dead:
            dead.append(len(self.read().collect()))
            raise Killed
        return add(self, version)

    monkeypatch.setattr(Committed, "_add", dies)
    with pytest.raises(Exception, match="Killed"):
        jobs.rolling_window(stream(), "id", "date", "2024-01-10", into, state)
    table = Committed(spark, into)
    assert dead == [2] and table.read().count() == 2 and len(os.listdir(f"{into}/data")) == 2
    jobs.rolling_window(stream(), "id", "date", "2024-01-10", into, state)
    want = Counter({(1, "current"): 1, (2, "2023-11"): 1, (3, "current"): 1, (4, "2023-10"): 1, (5, "current"): 1})
    assert Counter((r.id, r.slot) for r in table.read().collect()) == want
    table.clean()
    assert Counter((r.id, r.slot) for r in table.read().collect()) == want and len(os.listdir(f"{into}/data")) == 3
    table.compact()
    table.clean()
    assert Counter((r.id, r.slot) for r in table.read().collect()) == want and len(os.listdir(f"{into}/data")) == 1


def landed_once(spark, lots, kind, path):
    return landed(spark, lots if not os.path.exists(path) else [], kind, path)


def test_commits(spark, tmp_path):
    rows = lambda *n: spark.createDataFrame([(i, f"v{i}") for i in n], "k long, v string")
    keys = lambda: sorted(r.k for r in table.read().collect())
    table = Committed(spark, f"{tmp_path}/t")
    assert not table.exists()
    with pytest.raises(ValueError):
        table.read()
    assert table.append(rows(1, 2), "w", 0) and not table.append(rows(9), "w", 0) and table.append(rows(3), "other", 0) and keys() == [1, 2, 3]
    assert table.append_first_seen(rows(3, 4, 4), "k") and keys() == [1, 2, 3, 4]
    before = table.read()
    assert table.overwrite(rows(), "w", 1) and keys() == [] and table.state()["writers"] == {"w": 1, "other": 0}
    assert sorted(r.k for r in before.collect()) == [1, 2, 3, 4]
    assert table.upsert(rows(5, 6), ["k"]) and table.upsert(rows(6).withColumn("v", F.lit("now")), ["k"])
    assert sorted(map(tuple, table.read().collect())) == [(5, "v5"), (6, "now")]
    # another writer is sooner: the change is made for the table that it left
    mine, asked = Committed(spark, f"{tmp_path}/t"), []

    def make(old):
        asked.append(sorted(r.k for r in old.collect()))
        if len(asked) == 1:
            assert table.append(rows(7))
        return rows(8)

    assert mine.change(make, False) and asked == [[5, 6], [5, 6, 7]] and keys() == [5, 6, 7, 8]


def test_daily_counts_of_late_rows(spark, tmp_path):
    lots = [[("x", at(0)), ("x", at(1))], [("x", at(0, 3)), ("y", at(9))], [("x", at(1, 4))]]
    stream = landed(spark, lots, "k string, ts string", f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.daily_counts(stream, "ts", "k", f"{tmp_path}/out", f"{tmp_path}/state")
    assert {(r.day, r.k): r.n for r in out.collect()} == {("2024-01-01", "x"): 2, ("2024-01-02", "x"): 2, ("2024-01-10", "y"): 1}
