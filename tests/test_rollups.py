"""Rollups: sketches, merges of all kinds of measures, coverage, and reads that prune."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import rollups as R

SMALL = R.Rollup(
    {"hour": R.HOUR, "k": "k"}, {"n": "1L", "total": "coalesce(v, 0)"}, {"low": "v"}, {"high": "v"}, {"v": "v", "w": "w"}, {"ids": "id"},
    quantiles={"p50": ("v", 0.5, 1.0), "p95": ("v", 0.95, 1.0), "w99": ("w", 0.99, 1.0)},
)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng, start = random.Random(8), datetime.datetime(2024, 1, 1)
    made = [(start + datetime.timedelta(seconds=rng.randrange(4 * 86400)), rng.choice("ab") if k % 50 else None, rng.choice([0, -3, None, rng.randrange(1, 10**6)]), rng.random() * 100, k % 37) for k in range(4000)]
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(made, "timestamp timestamp_ntz, k string, v long, w double, id int").write.parquet(path)
    return spark.read.parquet(path)


def quantile(values, p):
    cells = sorted(0.0 if v <= 0 else 1.02 ** math.ceil(math.log(v) / math.log(1.02)) * 2 / 2.02 for v in values)
    return round(cells[math.ceil(len(cells) * p) - 1], 6) if cells else None


def test_days_from_hours_equal_days_from_rows(rows):
    got = {(r.day, r.k): r for r in SMALL.read(SMALL.days(SMALL.build(rows))).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault((str(r.timestamp.date()), r.k), []).append(r)
    assert set(got) == set(groups)
    for key, some in groups.items():
        v, r = [x.v for x in some if x.v is not None], got[key]
        assert (r.n, r.total, r.low, r.high) == (len(some), sum(v), min(v), max(v))
        assert (r.p50, r.p95) == pytest.approx((quantile(v, 0.5), quantile(v, 0.95))) and r.w99 == pytest.approx(quantile([x.w for x in some], 0.99))
        assert r.ids == len({x.id for x in some})


def test_merge_to_fewer_keys_and_empty(rows):
    one = SMALL.read(SMALL.merge(SMALL.build(rows), ["k"])).filter("k = 'a'").first()
    v = [r.v for r in rows.filter("k = 'a'").collect() if r.v is not None]
    assert (one.n, one.p95) == (rows.filter("k = 'a'").count(), pytest.approx(quantile(v, 0.95)))
    empty = SMALL.build(rows.limit(0))
    assert SMALL.days(empty).count() == 0
    nothing = SMALL.read(SMALL.build(rows.filter("v IS NULL"))).filter("k IS NOT NULL").first()
    assert nothing.p50 is None and nothing.n > 0 and nothing.w99 is not None


def test_quantile_error_is_bounded():
    assert all(abs(quantile([v], 0.5) / v - 1) <= 0.02 / 2.02 + 1e-6 for v in (1e-6, 0.3, 1, 7, 12345, 9e15))


def test_gaps_are_absent_open_or_short_hours(spark):
    stored = spark.createDataFrame([(f"2024-01-01 0{h}:00:00", 10) for h in range(5)], "hour string, rows long")
    covered = spark.createDataFrame([("2024-01-01 00:00:00", 10, True), ("2024-01-01 01:00:00", 9, True), ("2024-01-01 02:00:00", 10, False), ("2024-01-01 04:00:00", 12, True)], "hour string, rows long, complete boolean")
    assert sorted(r.hour[11:13] for r in R.gaps(stored, covered).collect()) == ["01", "02", "03"]
    assert R.hour_ranges(["2024-01-01 02:00:00", "2023-12-31 23:00:00", "2024-01-01 00:00:00", "2024-01-01 02:00:00"]) == [("2023-12-31 23:00:00", "2024-01-01 01:00:00"), ("2024-01-01 02:00:00", "2024-01-01 03:00:00")]


def test_live_hours_are_pushed_to_the_scan(rows):
    hours = ["2024-01-02 05:00:00", "2024-01-03 07:00:00", "2024-01-03 08:00:00"]
    some = R.rows_of_hours(rows, hours)
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1]
    assert pushed.startswith("Or(") and "timestamp,2024-01-02T05:00" in pushed
    assert some.count() == rows.filter(F.expr(R.HOUR).isin(hours)).count() > 0
    many = [str(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=2 * h)) for h in range(120)]
    assert R.rows_of_hours(rows, many).count() == rows.filter("hour(timestamp) % 2 = 0").count()
    assert R.rows_of_hours(rows, []).count() == 0


def test_rebuilt_hours_must_add_up(spark, rows, tmp):
    plain = R.Rollup({"hour": R.HOUR}, {"requests": "1L"})
    hours = [r.hour for r in R.hour_counts(rows).collect()]
    R.rebuild_hours(plain, rows, tmp + "/table", tmp + "/aside", hours, "requests")
    R.rebuild_hours(plain, rows.unionByName(rows), tmp + "/table", tmp + "/aside", hours[:1], "requests")
    got = {r.hour: r.requests for r in spark.read.parquet(tmp + "/table").collect()}
    want = {r.hour: r.rows for r in R.hour_counts(rows).collect()}
    assert got == want | {hours[0]: 2 * want[hours[0]]}
    holes = R.Rollup({"hour": R.HOUR}, {"requests": "1L"}, where="v IS NOT NULL")
    with pytest.raises(ValueError, match="stay as they are"):
        R.rebuild_hours(holes, rows, tmp + "/table", tmp + "/aside", hours[:1], "requests")
