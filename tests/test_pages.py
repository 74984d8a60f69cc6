import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.plans.registry import ORACLES, QUERIES
from tallyrift.sources import writers


def test_labels_of_odd_days(spark):
    t = spark.createDataFrame([("2024-08-05", "2024-08"), ("2023-12-31", "2023-12"), ("soon", "2024"), ("2024-13-01", "2024-13"), (None, None)], "d string, m string")
    got = [tuple(r) for r in t.select(X.month_label(F.col("m")), X.month_label(F.col("m"), "es"), X.day_label(F.col("d")), X.day_label(F.col("d"), F.lit(2024))).collect()]
    assert got == [("August 2024", "agosto de 2024", "Aug 5", "Aug 5"), ("December 2023", "diciembre de 2023", "Dec 31", "Dec 31, 2023"), ("2024", "2024", "soon", "soon"), ("2024-13", "2024-13", "2024-13-01", "2024-13-01"), (None,) * 4]


def test_state_snapshots_keep_other_days(spark, tmp_path):
    state = lambda n: spark.createDataFrame([(n, "é")], "n int, t string")
    for n, day in ((1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")):
        writers.state_snapshot(state(n), str(tmp_path), day)
    read = lambda name: json.loads((tmp_path / name).read_text(encoding="utf-8"))
    assert read("corpus-state.json") == {"n": 3, "t": "é"} and read("corpus-state-history/2024-01-01.json")["n"] == 1 and read("corpus-state-history/2024-01-02.json")["n"] == 3
    assert sorted(f for f in os.listdir(tmp_path / "corpus-state-history") if not f.startswith(".")) == ["2024-01-01.json", "2024-01-02.json"]
    with pytest.raises(ValueError):
        writers.state_snapshot(state(1).unionByName(state(2)), str(tmp_path), "2024-01-03")


@pytest.mark.parametrize("name, want", [("catalog_probe", [(104, 2), (107, 1)]), ("catalog_probe_words", [(102, 3), (103, 1), (105, 1)])])
def test_probes_find_what_their_sql_finds(spark, tmp_path, name, want):
    """A quoted text of the SQL escapes nothing, so catalog_probe's pattern has backslashes as characters; words are those of ASCII."""
    html = ["<b>102</b> 103", r"\b104\b \b107\b", r"102 \b104\b106\b", "é102 105ñ x101 101_ 1010", None, ""]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLES[name]).fetchall()) == want
