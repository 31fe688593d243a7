import gzip
import json

from pyspark.sql import functions as F

from logtide.sources import ingest as I
from logtide.streaming import jobs as J


def write_lines(folder, n=20):
    rows = [json.dumps({"timestamp": f"2024-01-01T00:{k // 2:02d}:{k % 2 * 10:02d}Z", "ip": f"10.0.0.{k % 3}", "status": 500 if k % 5 == 0 else 200, "resp_bytes": k, "cache": "HIT", "url": "/a", "rid": f"r{k % 15}"}) for k in range(n)]
    with gzip.open(f"{folder}/a.json.gz", "wt") as f:
        f.write("\n".join(rows))
    with open(f"{folder}/b.json", "w") as f:
        f.write('{"timestamp": "2024-01-01T00:00:00Z", "status": 404}\n{broken\n{"status": 200}\n')
    return rows


def test_quarantine_and_outcomes(spark, tmp):
    write_lines(tmp)
    good, bad = I.quarantine_split(I.read_ndjson(spark, tmp))
    assert good.count() == 21
    assert sorted(r["category"] for r in bad.collect()) == ["invalid_json", "missing_timestamp"]
    out = {r["_source_file"].rsplit("/", 1)[1]: (r["valid"], r["malformed"], r["outcome"]) for r in I.ingest_outcomes(good, bad).collect()}
    assert out == {"a.json.gz": (20, 0, "successful"), "b.json": (1, 2, "partial")}


def test_replace_and_dedup(spark):
    a = spark.createDataFrame([("f1", "r1", 1), ("f1", None, 2), ("f2", "r1", 3)], "_source_file string, rid string, timestamp int")
    again = I.replace_by_source(a, a.filter("_source_file = 'f1'"))
    assert sorted(map(str, again.select(*a.columns).collect())) == sorted(map(str, a.collect()))
    assert sorted((r["rid"], r["timestamp"]) for r in I.dedup_rid(a).filter("rid is not null").collect()) == [("r1", 1)]
    assert I.dedup_rid(a).count() == 2


def test_publication_and_codes(spark):
    facts = spark.createDataFrame([("b1", 1), ("b2", 2)], "batch_id string, x int")
    pubs = spark.createDataFrame([("b1", 1, "pending"), ("b1", 2, "visible"), ("b2", 1, "visible"), ("b2", 2, "pending")], "batch_id string, version int, state string")
    assert [r["batch_id"] for r in I.publication_fence(facts, pubs).collect()] == ["b1"]
    row = I.decode_codes(spark.createDataFrame([("B", "zz", 1.6)], "c_speed string, p_type string, ttl double")).first()
    assert (row["c_speed"], row["p_type"], row["ttl"]) == ("broadband", "zz", 2)


def test_facts_and_rum(spark):
    raw = spark.createDataFrame([('{"st":"200","cmcd_br":"5","x":"y","bad":"q"}',)], "raw string")
    row = I.facts_from_json(raw, {"status": "int"}, {"st": "status"}).first()
    assert row["status"] == 200 and row["cmcd"] == {"cmcd_br": "5"} and row["custom_fields"] == {"x": "y", "bad": "q"}
    payload = {
        "meta": {"browser": {"name": "Firefox", "mobile": True}, "page": {"url": "https://x.example/p/q?z=1"}},
        "measurements": [{"type": "web-vitals", "values": {"LCP": 1.5, "delta": 9}, "context": {"rating": "good"}}, {"type": "other", "values": {"n": 1}}],
        "events": [{"name": "tap"}, {"name": "faro.performance.navigation", "attributes": {"ttfb": "12.5", "kind": "reload"}}, {}],
        "logs": [{"level": "warn"}, {}],
        "exceptions": [{"value": "m", "stacktrace": {"frames": [{"filename": "f", "lineno": 1, "colno": 2}]}}, {}],
    }
    vitals, errors = I.rum_extract(spark.createDataFrame([(json.dumps(payload), "c"), ("{}", "d"), ("no json", "e"), (None, "f")], "raw string, cid string"))
    got = sorted((r["cid"], r["metric_name"], r["metric_value"], r["metric_rating"]) for r in vitals.collect())
    assert got[:6] == [("c", "LCP", 1.5, "good"), ("c", "event_tap", 1.0, ""), ("c", "kind", None, ""), ("c", "log", 1.0, "info"), ("c", "log", 1.0, "warn"), ("c", "ttfb", 12.5, "")]
    assert [(r[0], r[1]) for r in got[6:]] == [("d", "pageview"), ("e", "pageview"), ("f", "pageview")]
    assert {(r["pathname"], r["browser"], r["os"], r["device"]) for r in vitals.filter("cid = 'c'").collect()} == {("/p/q", "Firefox", "macOS", "Mobile")}
    assert sorted((r["error_message"], r["error_file"], r["error_line"], r["error_col"]) for r in errors.collect()) == [("Unknown error", "unknown.js", 0, 0), ("m", "f", 1, 2)]
    params = I.rum_query_params(spark.createDataFrame([("/b?m=LCP&v=1.5&m=CLS&v=x",)], "url string")).collect()
    assert [(r["metric_name"], r["metric_value"]) for r in params] == [("LCP", 1.5), ("CLS", None)]


def test_write_facts_partitions(spark, tmp):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id) AS timestamp, id FROM range(5)")
    I.write_facts(I.lake_union_buffer(df, df.limit(0)), f"{tmp}/t", "overwrite")
    back = spark.read.parquet(f"{tmp}/t")
    assert back.count() == 5 and back.select("timestamp_hour").distinct().count() == 5


def test_streams_equal_batch(spark, tmp):
    import os

    os.makedirs(f"{tmp}/in")
    write_lines(f"{tmp}/in", 40)
    J.stream_ingest(J.stream_raw(spark, f"{tmp}/in"), f"{tmp}/good", f"{tmp}/bad", f"{tmp}/cp1").awaitTermination()
    good = spark.read.parquet(f"{tmp}/good").drop("batch")
    assert good.count() == 41 and spark.read.parquet(f"{tmp}/bad").count() == 2
    source = lambda: spark.readStream.schema(good.schema).parquet(f"{tmp}/good/*")
    deduped = J.run_available(J.stream_dedup(source().filter("rid is not null"), "1 day"), "dd", f"{tmp}/cp2")
    assert deduped.count() == 15
    minute = J.run_available(J.stream_minute_rollup(source(), "0 seconds"), "mm", f"{tmp}/cp3", "complete")
    batch = good.groupBy(F.date_trunc("minute", "timestamp").alias("minute")).count()
    assert {(r["minute"], r["requests"]) for r in minute.collect()} == {(r["minute"], r["count"]) for r in batch.collect()}
    sessions = J.run_available(J.stream_sessions(source().filter("ip is not null"), "30 minutes", "0 seconds"), "ss", f"{tmp}/cp4", "complete")
    assert sessions.count() == 3
    values = source().select(F.lit("m").alias("name"), F.col("timestamp").alias("at"), F.col("status").cast("double").alias("value"))
    alerts = J.run_available(J.stream_alerts(values, 499.0, 600), "aa", f"{tmp}/cp5")
    assert 1 <= alerts.count() <= 3
    scored = J.run_available(J.stream_session_score(source().filter("ip is not null").withColumnRenamed("ip", "edge_sid")), "sc", f"{tmp}/cp6")
    # Requests are scored once the watermark has passed them, ten minutes behind the newest.
    known = good.filter("ip is not null")
    passed = known.crossJoin(known.agg((F.max("timestamp") - F.expr("INTERVAL 10 MINUTES")).alias("mark"))).filter("timestamp < mark").groupBy("ip").count()
    assert {r["ip"]: r["count"] for r in passed.collect()} == {r["sid"]: r["count"] for r in scored.groupBy("sid").count().collect()}
    capped = J.run_available(J.stream_capped_sessions(source().filter("ip is not null"), 1800, 300, "0 seconds"), "cs", f"{tmp}/cp7").collect()
    assert capped and all((r.last_ts - r.first_ts).total_seconds() <= 300 for r in capped)


def test_objects_are_told_by_their_first_bytes_and_break_whole(spark, tmp):
    import gzip
    import pathlib

    import zstandard

    text = "".join(f'{{"timestamp":"2024-01-01T00:00:00Z","rid":"r{k}"}}\n' for k in range(9000))
    packed, squeezed = gzip.compress(text.encode()), zstandard.ZstdCompressor().compress(text.encode())
    files = {
        "a.gz": packed, "b.json": packed, "c.gz": squeezed, "d.zst": squeezed + squeezed, "e.log": text.encode(), "f.log": b"", "cut.gz": packed[: len(packed) // 2], "cut.zst": squeezed[:-9],
        "tail.gz": packed + b"junk", "bad.gz": b"no gzip at all", "bad.zst": b"no zstd", "odd.log": b"caf\xe9\r\nend",
    }
    for name, data in files.items():
        pathlib.Path(tmp, name).write_bytes(data)
    objects = I.read_objects(spark, tmp).cache()
    good = {pathlib.Path(r._source_file).name: (r.codec, r["count"]) for r in objects.filter("error IS NULL").groupBy("_source_file", "codec").count().collect()}
    assert good == {"a.gz": ("gzip", 9000), "b.json": ("gzip", 9000), "c.gz": ("zstd", 9000), "d.zst": ("zstd", 18000), "e.log": ("plain", 9000), "odd.log": ("plain", 2)}
    broken = {pathlib.Path(r._source_file).name: r.codec for r in I.corrupt_container(objects).collect()}
    assert broken == {"cut.gz": "gzip", "cut.zst": "zstd", "tail.gz": "gzip", "bad.gz": "gzip", "bad.zst": "zstd"}
    assert I.read_ndjson(spark, tmp).filter("rid = 'r7'").count() == 6


def test_rows_with_maps_are_written_and_deduplicated(spark, tmp):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS timestamp, 'a' AS k, map('x', CAST(id % 2 AS STRING)) AS cmcd FROM range(4)")
    assert I.dedup_natural(rows, ["k"]).collect()[0].cmcd == {"x": "0"}
    I.write_facts(rows, tmp + "/facts", rows_per_file=2)
    assert spark.read.parquet(tmp + "/facts").count() == 4
