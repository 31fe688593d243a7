"""What holds however large the input is: objects of a bounded size, addresses of large user numbers, ties, alerts."""

import collections
import datetime
import pathlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logtide.operators import rollups as R
from logtide.operators import shared_scans as C
from logtide.plans import ingest_queries as Q
from logtide.plans import registry
from logtide.sources import ingest as I
from logtide.sources.request_log import request_log

from .oracle import assert_same, connect


def write_events(folder, n, first_user=0, ties=1):
    start, kinds = datetime.datetime(2024, 1, 1), ["click", "view", "purchase", "signup", "error"]
    table = pa.table({
        "event_id": list(range(n)), "ts": [start + datetime.timedelta(seconds=int((i // ties) * ties * 30 * 86400 / n)) for i in range(n)],
        "user_id": [first_user + i * 7 % 60 for i in range(n)], "event_type": [kinds[i * 3 % 5] for i in range(n)], "value": [i % 97 + 0.25 for i in range(n)], "props": ["{}"] * n,
    })
    pq.write_table(table, f"{folder}/events.parquet")
    return str(folder)


def test_more_lines_make_more_objects(spark, tmp, monkeypatch):
    monkeypatch.setattr(Q, "_OBJECT_ROWS", 100)
    path = Q.write_raw(spark, write_events(tmp, 4000))
    files = spark.read.text(path).groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(list(pathlib.Path(path).rglob("*.gz"))) >= 40
    assert max(r["count"] for r in files) <= 200 and sum(r["count"] for r in files) == 4100
    assert set(collections.Counter(r["f"].split("part=")[1][0] for r in files)) == set("0123")


@pytest.mark.parametrize("name", ["ingest_outcomes", "quarantine_summary", "replace_by_source", "corrupt_container", "stream_ingest", "stream_alerts", "compact_files"])
def test_many_objects_give_the_same(spark, tmp, monkeypatch, name):
    monkeypatch.setattr(Q, "_OBJECT_ROWS", 100)
    sf_dir = write_events(tmp, 2000)
    assert_same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracles()[name])


def test_dedup_keeps_its_state_on_disk(spark, tmp):
    """The state has every request id: it lies in RocksDB, whose memory is bounded, and the session's own store stays as it was."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before, sf_dir = spark.conf.get(store), write_events(tmp, 2000)
    result = registry.queries()["stream_dedup"](spark, sf_dir)
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "logtide" / spark.sparkContext.applicationId
    ledger = max(root.glob("dedup-ledger-*"), key=lambda p: p.stat().st_mtime)
    assert list(ledger.glob("state/0/*/*.zip")) and spark.conf.get(store) == before
    assert_same(result, connect(sf_dir), registry.oracles()["stream_dedup"])


def test_changed_objects_are_decoded_one_at_a_time(spark, tmp):
    """Objects are changed and decoded in one worker: the second is not made before the lines of the first are given."""
    made = []

    def change(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made.append(path)
                yield pa.record_batch([pa.array([path]), pa.array([b"a\nb\n"], pa.binary())], ["path", "content"])

    objects = pa.record_batch([pa.array(["x", "y"]), pa.array([b"", b""], pa.binary())], ["path", "content"])
    lines = I.decode_batches(change(iter([objects])))
    assert next(lines).column("raw").to_pylist() == ["a", "b"] and made == ["x"]
    frame = spark.createDataFrame([("x", b""), ("y", b"")], "path string, content binary").coalesce(1)
    read = I.decode_objects(frame, change)
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, read.select("raw", "_source_file").collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_objects_are_dealt_to_tasks_by_their_size(spark, tmp, monkeypatch):
    """A scan would put all these objects into few tasks: none reads more than the bytes of a task and one object."""
    monkeypatch.setattr(I, "_TASK_BYTES", 100)
    for k in range(60):
        pathlib.Path(tmp, f"{k:02d}.log").write_bytes(b"x" * 29 + b"\n")
    pathlib.Path(tmp, "empty.log").write_bytes(b"")
    tasks = I.read_objects(spark, tmp).groupBy(F.spark_partition_id()).agg(F.countDistinct("_source_file").alias("n"), F.count("*").alias("lines")).collect()
    assert len(tasks) == 18 and max(r["n"] for r in tasks) <= 4 and sum(r["lines"] for r in tasks) == 60
    assert I.read_objects(spark, tmp + "/empty.log").count() == 0


def test_alerts_are_not_gathered_by_coalesce(spark, tmp, monkeypatch):
    def gathered(self, n):
        raise AssertionError("all partitions of the batch in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", gathered)
    sf_dir = write_events(tmp, 2000)
    assert_same(registry.queries()["stream_alerts"](spark, sf_dir), connect(sf_dir), registry.oracles()["stream_alerts"])


def test_bots_of_large_user_numbers(spark, tmp):
    sf_dir = write_events(tmp, 3000, 70_000)
    assert_same(registry.queries()["wellknown_bots"](spark, sf_dir), connect(sf_dir), registry.oracles()["wellknown_bots"])


def test_an_average_at_a_tie_follows_from_no_order(spark):
    """4.516 / 320 = 0.0141125: sums whose last bits differ give one average."""
    for total in (4.516, 4.515999999999996, 4.516000000000004):
        table = spark.createDataFrame([("h", 320, total, 320, 1, {1: 320})], "hour string, requests long, ploss_sum double, ploss_cnt long, retrans long, rtt map<int,long>")
        assert R.ROLLUPS["network_summary"].read(table).first()["avg_ploss"] == 0.014113


@pytest.mark.parametrize("name", ["stream_sessions", "stream_session_score", "stream_capped_sessions"])
def test_streams_with_requests_of_one_time(spark, tmp, name):
    """Five requests at a time: sessions follow from times, not from the order of rows, so peers count as one in the SQL too."""
    sf_dir = write_events(tmp, 2000, ties=5)
    sql = registry.oracles()[name]
    for order in ("ORDER BY timestamp ROWS", "ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM l"):
        sql = sql.replace(order, order.replace("ROWS", "RANGE"))
    got = registry.queries()[name](spark, sf_dir)
    cols = [c for c in got.columns if c not in ("seq", "l1")]
    want = connect(sf_dir).execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    assert collections.Counter(map(tuple, got.select(*cols).collect())) == collections.Counter(want)


def test_sessions_end_after_a_day(spark, tmp):
    """A client that never pauses for long: a session ends before the request that would make it longer than 24 hours, and
    requests are scored in order of time.  Three requests at a time."""
    sf_dir = write_events(tmp, 6000, ties=3)
    table = pq.read_table(f"{sf_dir}/events.parquet")
    pq.write_table(table.set_column(2, "user_id", pa.array([7] * len(table))), f"{sf_dir}/events.parquet")
    rows = connect(sf_dir).execute(f"{Q._RAW_SQL} SELECT ip, epoch_us(timestamp), status, resp_bytes FROM good ORDER BY ALL").fetchall()
    end, text = max(r[1] for r in rows) - 3600 * 10**6, lambda us: f"{datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=us // 10**6)}"
    sessions, scores, last_ip = [], collections.Counter(), None
    for ip, at, status, size in rows:
        if at >= end:
            continue
        if ip != last_ip or at - sessions[-1][2] > 1800 * 10**6 or at - sessions[-1][1] > 86400 * 10**6:
            sessions.append([ip, at, at, 0, 0, 0])
            last_ip, gaps = ip, []
        else:
            gaps.append((at - sessions[-1][2]) / 1e6)
        session = sessions[-1]
        session[2:] = [at, session[3] + 1, session[4] + (400 <= status < 500), session[5] + size]
        mean = sum(gaps) / max(1, len(gaps))
        var = sum(g * g for g in gaps) / max(1, len(gaps)) - mean * mean
        scores[ip, text(at), session[3], 0 if session[3] <= 3 else 50 if mean < 0.2 else 40 if mean <= 3 and var < 0.05 else 0] += 1
    ended = [(s[0], text(s[1]), text(s[2]), *s[3:]) for s in sessions if s[2] + 1800 * 10**6 < end]
    assert sum(s[2] - s[1] > 85000 * 10**6 for s in sessions) >= 20
    queries = registry.queries()
    assert collections.Counter(map(tuple, queries["stream_capped_sessions"](spark, sf_dir).collect())) == collections.Counter(ended)
    assert collections.Counter(map(tuple, queries["stream_session_score"](spark, sf_dir).collect())) == scores


def test_compaction_has_more_tasks_for_more_rows(spark, tmp):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS timestamp, id FROM range(1000)")
    I.compact_files(rows, tmp + "/compact", 1, rows_per_file=100)
    assert len({p.name.split("-")[1] for p in pathlib.Path(tmp, "compact").glob("part-*")}) >= 8
    assert spark.read.parquet(tmp + "/compact").count() == 1000


def test_minute_facts_have_more_tasks_for_more_rows(spark, tmp, monkeypatch):
    monkeypatch.setattr(C, "_FACT_ROWS", 100)
    sf_dir = write_events(tmp, 2000)
    facts = C.minute_facts(request_log(spark, sf_dir), "performance")
    dealt = facts.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
    assert len(dealt) == 20 and max(r["n"] for r in dealt) <= 200 and sum(r["n"] for r in dealt) == 2000
    for name in ("rollup_minute_facts_minutes", "rollup_minute_facts"):
        assert_same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracles()[name])
