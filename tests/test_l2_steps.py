"""Route-transition scores of requests against a fitted matrix."""

import datetime
import math

from logtide.operators import analytics as A
from logtide.plans import registry

from .oracle import assert_same, connect


def test_steps_with_anchor_and_unseen_routes(spark):
    start = datetime.datetime(2024, 1, 1)
    edges = spark.createDataFrame([("a", "b", 98), ("a", "c", 2), ("b", "a", 50)], "prev string, curr string, n long")
    urls = {"s1": "abc", "s2": "aa", "s3": "xa", "s4": "xac", "s5": "xyb"}
    rows = [(ip, "u", start + datetime.timedelta(seconds=k), f"{ip}{k}", url) for ip, way in urls.items() for k, url in enumerate(way)]
    logs = spark.createDataFrame(rows, "ip string, ua string, timestamp timestamp, rid string, url string")
    got = {r["rid"]: r for r in A.l2_step_scores(logs, edges).collect()}
    p = lambda n, total: (n + 0.5) / (total + 1.5)
    want = {
        "s10": 1.0, "s11": p(98, 100), "s12": max(p(0, 50), 0.7 * p(2, 100)), "s20": 1.0, "s21": p(0, 100), "s30": 1.0, "s31": 1e-12,
        "s40": 1.0, "s41": 1e-12, "s42": p(2, 100), "s50": 1.0, "s51": 1e-12, "s52": 1e-12,
    }
    assert got.keys() == want.keys()
    for rid, prob in want.items():
        assert abs(got[rid]["prob"] - prob) < 1e-8 and got[rid]["score"] == max(0, min(100, round(-math.log10(prob) * 100 / 6))), rid
    assert got["s31"]["score"] == 100 and got["s12"]["prob"] > p(0, 50)
    assert {r["score"] for r in A.l2_step_scores(logs, edges.limit(0)).collect()} == {0}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(registry.queries()["l2_step_score"](spark, sf), connect(sf), registry.oracles()["l2_step_score"])
