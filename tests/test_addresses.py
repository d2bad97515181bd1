"""IPv6 addresses in any spelling against the standard library."""

import ipaddress

from pyspark.sql import functions as F

from foliospark.sources import markup

TEXTS = [
    "::1", "0:0::1", "::0001", "0:0:0:0:0:0:0:1", "::", "::2", "1::", "fc00::", "FDff:1::2", "fe80::1%eth0", "febf::9", "fec0::1", "fbff::1", "2001:db8::1", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::1", "", "1.2.3.4", "example.org", ":1", "1:", "::1.2.3.4",
]


def test_spellings(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for r in df.select("t", markup.address6(F.col("t")).alias("a"), markup.blocked6(F.col("t")).alias("b")).collect():
        try:
            ip = ipaddress.IPv6Address(r.t.split("%")[0]) if r.t else None
        except ValueError:
            ip = None
        assert r.a == (f"{int(ip):032x}" if ip is not None else None), r.t
        assert r.b == (ip is not None and any(ip in ipaddress.ip_network(f"{n}/{k}") for n, k in markup.BLOCKED_V6)), r.t


def test_urls(spark):
    rows = [("http://[0:0::1]/", "address"), ("https://[::0001]:8443/x", "address"), ("https://[2001:db8::1]/x", None), ("https://face:80/x", None)]
    got = spark.createDataFrame(rows, "u string, w string").select("u", "w", markup.refusal(F.col("u")).alias("g")).collect()
    assert all(r.g == r.w for r in got), got


def test_parts_of_a_url_are_worked_out_once(spark):
    """The expression has each part of a URL once, not once for each network and digit."""
    plan = spark.range(1).select(markup.refusal(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") + plan.count("split(") <= 20 < plan.count("lambda") + 20


def test_refusal_beside_a_generator(spark):
    """A select that also explodes a list gives the same: fields of structs inside lambdas keep their names there."""
    rows = [("http://[::1]/", ["a", "b"], "address"), ("http://10.0.0.1/", ["a"], "address"), ("https://[2001:db8::1]/x", ["a"], None)]
    got = spark.createDataFrame(rows, "u string, l array<string>, w string").select("w", markup.refusal(F.col("u")).alias("g"), F.explode("l").alias("e")).collect()
    assert len(got) == 4 and all(r.g == r.w for r in got), got
