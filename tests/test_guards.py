import ipaddress

import pytest
from pyspark.sql import functions as F

from tallyrift.functions import scalars as X
from tallyrift.sources import fetching, readers, writers

UNSAFE = """http://[0:0:0:0:0:0:0:1]/ http://[0::1]/ http://[::1]:80/x http://[::]/ http://[::ffff:7f00:1]/ http://[::ffff:a00:1]/ http://[::ffff:10.0.0.1]/ http://[0:0:0:0:0:ffff:192.168.1.1]/ http://[::127.0.0.1]/
http://[fe80::1]/ http://[fe80::1%25eth0]/ http://[febf:1:2:3:4:5:6:7]/ http://[fc00::]/ http://[FD12::3]/ http://[ff02::1]/ http://[2001:db8::1]/ http://[2001::1]/ http://[2002:7f00:1::]/ http://[64:ff9b::7f00:1]/ http://[100::1]/ http://[4000::1]/
http://[1::2::3]/ http://[1:2:3]/ http://[12345::]/ http://[::ffff:300.0.0.1]/ http://[2606:4700::1 http://[]/ http://2130706433/ http://0x7f000001/ http://0x7f.1/ http://127.1/ http://0177.0.0.1/ http://127.0.0.01/ http://127.0.0.1./ http://127.0.0.1:8080/
http://localhost/ http://LOCALHOST:3000/ http://a.localhost/ http://10.1.2.3/ http://172.31.0.1/ http://192.168.0.1/ http://169.254.169.254/x http://0.0.0.0/ http://255.255.255.255/ http://224.0.0.1/ http://256.1.1.1/ http://1.2.3.4.5:x/ ftp://a.cl/ http://u@a.cl/ http://u:p@8.8.8.8/ http:///x javascript:alert(1)""".split()
SAFE = "http://a.cl/ https://a.cl:443/x?y=1 http://8.8.8.8/ http://172.32.0.1/ http://[2606:4700:4700::1111]/ http://[2606:4700:4700:0:0:0:0:1111]:8443/ http://[::ffff:8.8.8.8]/ http://[::ffff:808:808]/ http://[2a00:1450::1]/ http://1.2.3.4.cl/ http://localhost.cl/".split()


def test_fetch_guard_on_all_forms(spark):
    got = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in UNSAFE + SAFE], "u string").select("u", X.safe_to_fetch(F.col("u")).alias("ok")).collect()}
    assert [u for u in UNSAFE if got[u]] == [] and [u for u in SAFE if not got[u]] == []


def test_ipv6_groups_are_those_of_the_library(spark):
    texts = "::|::1|1::|2001:db8::7|1:2:3:4:5:6:7:8|1:2:3:4:5:6:7::|::2:3:4:5:6:7:8|::ffff:1.2.3.4|64:ff9b::10.20.30.40|1:2:3:4:5:6:1.2.3.4|1:2:3:4:5:6:7|1::2::3|::12345|1:2:3:4:5:6:7:8:9|1:2:3:4::5:6:7:8|g::|:1|1:|1.2.3.4|::1.2.3|::1.2.3.256|".split("|")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.ipv6_groups(F.col("t")).alias("g")).collect():
        try:
            raw = ipaddress.IPv6Address(r.t).packed
            assert r.g == [raw[i] << 8 | raw[i + 1] for i in range(0, 16, 2)], r
        except ValueError:
            assert r.g is None, r


def test_safe_address_asks_for_all_addresses():
    known = {"a.cl": ["8.8.8.8"], "two.cl": ["8.8.8.8", "10.0.0.1"], "six.cl": ["2606:4700::1"], "map.cl": ["::ffff:127.0.0.1"], "link.cl": ["fe80::1%eth0"], "none.cl": [], "127.1": ["127.0.0.1"]}
    ask = lambda h: known[h] if h in known else [str(ipaddress.ip_address(h))]
    assert [u for u in ("a.cl", "two.cl", "six.cl", "map.cl", "link.cl", "none.cl", "127.1", "other.cl", "8.8.4.4", "[::1]") if fetching.safe_address(f"http://{u}/x", ask)] == ["a.cl", "six.cl", "8.8.4.4"]
    assert not fetching.safe_address("ftp://a.cl", ask) and not fetching.safe_address("http://u@a.cl", ask) and not fetching.safe_address("http://[bad", ask)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_the_whole_file_says_its_encoding(spark, tmp_path, encoding):
    """The first accent comes long after what a reader would look at first."""
    path = f"{tmp_path}/t.csv"
    with open(path, "w", encoding=encoding) as f:
        f.write("Comuna;Poblacion\n" + "".join(f"Plain {i};{i}\n" for i in range(20_000)) + "Ñuñoa;7\n")
    rows = readers.delimited(spark, path, {"name": ["comuna"], "n": ["poblacion"]})
    assert [r.n for r in rows.where("name = 'Ñuñoa'").collect()] == ["7"] and rows.count() == 20_001


def test_a_move_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    writers.whole(spark.range(3), path)
    calls, real = [], writers._renamed

    def second_fails(fs, one, other):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no")
        real(fs, one, other)

    monkeypatch.setattr(writers, "_renamed", second_fails)
    with pytest.raises(OSError, match="no"):
        writers.whole(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(writers, "_renamed", real)
    fs, at = writers._file_system(spark, f"{tmp_path}/missing")
    with pytest.raises(Exception):
        writers.moved(spark, f"{tmp_path}/missing", path)
    assert spark.read.parquet(path).count() == 3
