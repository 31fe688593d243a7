import pytest
from pyspark.sql import functions as F

from logtide.functions import scalars as S
from logtide.operators import analytics as A
from logtide.operators.detections import DETECTIONS


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "route", "category"),
    [
        ("/", "/", "home"),
        (None, "/", "home"),
        ("https://h.example/Products/123?x=1", "/products/*", "product"),
        ("/a/./b/../c", "/a/c", "other"),
        ("/%2e%2e/%2e%2e/etc/passwd", "/etc/passwd", "other"),
        ("/api/550e8400-e29b-41d4-a716-446655440000/x", "/api/*/x", "api"),
        ("//checkout/AB-12x", "/checkout/*", "checkout"),
        ("/a%2Fb", "/a/b", "other"),
        ("/x%zz", "/x%zz", "other"),
    ],
)
def test_routes(spark, url, route, category):
    df = spark.createDataFrame([(url,)], "url string")
    row = S.normalize_routes(df).first()
    assert (row["route"], row["category"]) == (route, category)


def test_mask_ip(spark):
    rows = [("10.1.2.3", "10.1.2.xxx"), ("10.1.2.xxx", "10.1.2.xxx"), ("300.1.2.3", "[redacted]"), ("", ""), (None, None), ("2001:db8:aa:bb::1", "2001:db8:aa::"), ("a:b", "[redacted]")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "ip string")
    assert [r["masked"] for r in S.mask_ip_column(df).collect()] == [b for _, b in rows]


def test_filter_spec_null_wildcard_missing(spark):
    df = spark.createDataFrame([("a%b", 1.4), ("axb", 2.0), (None, 3.0)], "v string, ttl double")
    keep = lambda spec: sorted(str(r["v"]) for r in S.filter_spec(df, spec).collect())
    assert keep({"v": {"mode": "include", "values": ["A%*"]}}) == ["a%b"]
    assert keep({"v": {"mode": "exclude", "values": ["axb"]}}) == ["None", "a%b"]
    assert keep({"v": {"mode": "include", "values": [None]}}) == ["None"]
    assert keep({"gone": {"mode": "include", "values": ["x"]}}) == []
    assert keep({"gone": {"mode": "exclude", "values": ["x"]}}) == ["None", "a%b", "axb"]
    assert keep({"ttl": {"mode": "include", "values": ["1"]}}) == ["a%b"]


def test_zero_fill(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 01:00:00' AS bucket, 5L AS n")
    assert [r["n"] for r in S.zero_fill(df, "2024-01-01 00:00:00", "2024-01-01 03:00:00").orderBy("bucket").collect()] == [0, 5, 0, 0]


def test_cidr_join(spark):
    logs = spark.createDataFrame([("10.0.0.5",), ("10.1.0.5",), ("9.9.9.9",)], "ip string")
    feeds = spark.createDataFrame([("wide", "10.0.0.0/15"), ("one", "9.9.9.9/32")], "feed string, cidr string")
    assert {r["ip"]: r["feed"] for r in S.cidr_join(logs, feeds).collect()} == {"10.0.0.5": "wide", "10.1.0.5": "wide", "9.9.9.9": "one"}


def test_auc_and_ties(spark):
    df = spark.createDataFrame([(10, False), (20, False), (20, True), (30, True)], "score int, bad boolean")
    assert A.roc_auc(df).first()["auc"] == 0.875
    assert A.roc_auc(df.filter("bad")).first()["auc"] == 0.5


def test_error_spike_boundaries(spark):
    """At the floor a URL is reported; just below it is not."""

    def rows(url, bad, n):
        return [(url, 500 if k < bad else 200, True, False) for k in range(n)]

    df = spark.createDataFrame(rows("/hit", 1, 20) + rows("/miss", 1, 21) + rows("/few", 2, 2), "url string, status int, is_w boolean, is_b boolean")
    assert [r["label"] for r in DETECTIONS["error_spikes"].frame(df).collect()] == ["/hit"]


def test_downsample_keeps_extremes(spark):
    df = spark.createDataFrame([("s", i, float((i * 7) % 101)) for i in range(300)], "s string, t int, v double")
    out = A.downsample(df, "s", "t", "v", 20).collect()
    assert len(out) <= 20 and {0, 299} <= {r["t"] for r in out} and max(r["v"] for r in out) == 100.0


def test_combined_score(spark):
    assert one(spark, A.combined_score(F.col("a"), F.col("b"), F.col("d")), a=50, b=40, d=1.5) == 70


def test_addresses_and_ranges_match_ipaddress(spark):
    import ipaddress
    import random

    from pyspark.sql import functions as F

    from logtide.functions.scalars import cidr_join, ip_hex

    rng = random.Random(6)
    ips = [".".join(str(rng.choice([0, 9, 10, 127, 128, 255])) for _ in range(4)) for _ in range(60)]
    ips += [str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), 0x20010DB8 << 96 | rng.getrandbits(20), rng.getrandbits(16)]))) for _ in range(60)]
    ips += ["::", "::1", "1::", "::ffff:1.2.3.4", "2001:DB8::A", "256.1.1.1", "1.2.3", "", None, "x", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1::2::3", "12345::", ":1::2", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7"]

    def parsed(text):
        try:
            at = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"{at.version}{int(at):0{8 if at.version == 4 else 32}x}"

    frame = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.h for r in frame.select("ip", ip_hex(F.col("ip")).alias("h")).collect()}
    assert {i: got[i] for i in ips} == {i: parsed(i) for i in ips}
    cidrs = [f"{i}/{rng.randrange(0, 33 if '.' in i and ':' not in i else 129)}" for i in ips if parsed(i)] + ["10.0.0.0", "10.0.0.0/99", "junk/8", "::/0", "0.0.0.0/0"]
    feeds = spark.createDataFrame([(f"f{k % 9}", c) for k, c in enumerate(cidrs)], "feed string, cidr string")
    joined = {r.ip: r.feeds for r in cidr_join(frame, feeds).collect()}
    nets = []
    for k, c in enumerate(cidrs):
        try:
            nets.append((f"f{k % 9}", ipaddress.ip_network(c, strict=False)))
        except ValueError:
            pass
    for i in ips:
        at = ipaddress.ip_address(i) if parsed(i) else None
        want = sorted({f for f, n in nets if at is not None and at.version == n.version and at in n})
        assert (joined[i] or []) == want, i
