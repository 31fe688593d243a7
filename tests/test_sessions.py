"""Sessions cut by hour and stitched, against the plain rule, with one client that has half of all rows."""

import datetime
import random

from pyspark.sql import functions as F

from logtide.operators.analytics import with_sessions


def plain(rows, gap):
    out, last = {}, {}
    for ts, rid, ip in sorted(rows, key=lambda r: (str(r[2]), r[0], r[1])):
        before, no = last.get(ip, (None, 0))
        no += before is None or (ts - before).total_seconds() > gap
        last[ip] = (ts, no)
        out[rid] = no
    return out


def test_hot_client_is_cut_by_hours(spark):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=rng.randrange(3 * 86400)), f"r{k}", "hot" if k % 2 else rng.choice(["a", "b", None, "c"])) for k in range(3000)]
    rows += [(start + datetime.timedelta(hours=5), "t1", "edge"), (start + datetime.timedelta(hours=5, minutes=30), "t2", "edge"), (start + datetime.timedelta(hours=6, seconds=1), "t3", "edge"), (start + datetime.timedelta(hours=6, seconds=1), "t4", "edge")]
    logs = spark.createDataFrame(rows, "timestamp timestamp_ntz, rid string, ip string")
    for gap in (60, 1800, 7200):
        got = {r.rid: r.session_no for r in with_sessions(logs, ["ip"], gap).collect()}
        assert got == plain(rows, gap)
    groups = logs.groupBy("ip", F.date_trunc("hour", "timestamp")).count().agg(F.max("count")).first()[0]
    assert groups < len(rows) / 20
    plan = with_sessions(logs, ["ip"])._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(ip" in plan and ", __hour" in plan
