"""Structured Streaming forms of the ingest, rollup, session, alert and scoring jobs.

Each function takes a streaming (or batch) DataFrame with an event-time column ``timestamp`` and returns one, so
that the same code is checked on a batch; ``run_available`` drives a query over what is there and stops.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.reads import HOUR
from ..operators.rollups import Rollup, rebuild_hours
from ..plans.shipping import ship_package
from ..sources.ingest import BASE_SCHEMA, quarantine_split


def stream_raw(spark: SparkSession, path: str, schema: StructType = BASE_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """New objects under ``path`` as they come; the checkpoint is the ledger of what was read."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    lines = lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_source_file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.withColumn("j", F.from_json("raw", full, options)).select("raw", "_source_file", "j.*")


def stream_ingest(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Good and bad rows of each batch to their tables; a batch that is written again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = quarantine_split(batch.persist())
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def state_on_disk(spark: SparkSession, memory_mb: int = 500) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB on the executors' disks, with some ``memory_mb`` in an
    executor for all of its partitions.  Spark's default store holds every key, in two versions, in the executors' heap."""
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.maxMemoryUsageMB": str(memory_mb),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_dedup(rows: DataFrame, delay: str = "1 hour", keys: tuple[str, ...] = ("rid",)) -> DataFrame:
    """First row of each key; the state is one row a key until the watermark has passed it (see :func:`state_on_disk`)."""
    return rows.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_minute_rollup(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests, errors, hits and bytes per minute."""
    out = rows.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 minute")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status").between(400, 499)).alias("err4"), F.count_if(F.col("status") >= 500).alias("err5"),
        F.count_if(F.col("cache").isin("HIT", "HIT-STALE")).alias("hits"), F.sum("resp_bytes").alias("bytes"),
    )
    return out.select(F.col("window.start").alias("minute"), "requests", "err4", "err5", "hits", "bytes")


def stream_sliding_error_rate(rows: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    out = rows.withWatermark("timestamp", delay).groupBy(F.window("timestamp", length, slide)).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
    return out.select(F.col("window.end").alias("at"), "requests", (F.col("errors") * 100.0 / F.col("requests")).alias("error_rate"))


def stream_realtime_tick(rows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """One row a second with ratios."""
    out = rows.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 second")).agg(F.count("*").alias("requests"), F.count_if(F.col("cache").startswith("HIT")).alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"))
    return out.select(F.col("window.start").alias("second"), "requests", (F.col("hits") / F.col("requests")).alias("hit_ratio"), (F.col("errors") / F.col("requests")).alias("error_ratio"))


def stream_sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by Spark's own windows; without a limit to their length (see :func:`stream_capped_sessions`)."""
    out = rows.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap), "ip").agg(F.count("*").alias("requests"), F.count_if(F.col("status").between(400, 499)).alias("err4"), F.sum("resp_bytes").alias("bytes"))
    return out.select("ip", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("expires"), "requests", "err4", "bytes")


def _passed(state: Any, batches: Iterator[pd.DataFrame], held: list[tuple], width: int) -> tuple[list[tuple], list[tuple], int]:
    """(rows that the watermark has passed in order of time, rows that must wait, the watermark), of the first
    ``width`` columns; times, of which the first column is one, are in microseconds.

    Rows of a key come in any order, over several Arrow chunks and batches.  Those that the watermark has passed can have
    no earlier ones still to come; the others wait in the state.
    """
    mark = state.getCurrentWatermarkMs() * 1000
    rows = held + [(row[0].value // 1000, *row[1:width]) for pdf in batches for row in pdf.itertuples(index=False, name=None)]
    rows.sort()
    ready = sum(row[0] < mark for row in rows)
    return rows[:ready], rows[ready:], mark


def stream_capped_sessions(rows: DataFrame, idle_s: int = 1800, longest_s: int = 86400, delay: str = "1 hour") -> DataFrame:
    """Sessions of each address: one ends after more than ``idle_s`` without a request, or before the request that would make
    it longer than ``longest_s``.  A session is given once the watermark is ``idle_s`` past its last request."""

    idle, longest = idle_s * 1_000_000, longest_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        at, err, size, first, last, n, errs, total = state.get if state.exists else ([], [], [], None, None, 0, 0, 0)
        ready, waiting, mark = _passed(state, iter(()) if state.hasTimedOut else batches, list(zip(at, err, size)), 3)
        out = []
        for t, bad, b in ready:
            if last is not None and (t - last > idle or t - first > longest):
                out.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n, errs, total))
                first, last, n, errs, total = None, None, 0, 0, 0
            first = t if first is None else first
            last, n, errs, total = t, n + 1, errs + int(bad), total + int(b)
        if last is not None and last + idle < mark:
            out.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n, errs, total))
            last = None
        if last is None and not waiting:
            state.remove()
        else:
            state.update((*([list(c) for c in zip(*waiting)] or [[], [], []]), first, last, n, errs, total))
            _expire(state, (waiting[0][0] if waiting else last + idle) / 1e6)
        if out:
            yield pd.DataFrame(out, columns=["ip", "first_ts", "last_ts", "requests", "err4", "bytes"])

    ship_package(rows.sparkSession)
    kept = rows.select("ip", "timestamp", F.when(F.col("status").between(400, 499), 1).otherwise(0).alias("bad"), F.coalesce("resp_bytes", F.lit(0)).cast("long").alias("size"))
    kept = kept.withWatermark("timestamp", delay).select("timestamp", "bad", "size", "ip")
    held = "at array<long>, err array<long>, size array<long>, first long, last long, n long, errs long, total long"
    given = "ip string, first_ts timestamp, last_ts timestamp, requests long, err4 long, bytes long"
    return kept.groupBy("ip").applyInPandasWithState(step, given, held, "append", "EventTimeTimeout")


def stream_rebuild(rows: DataFrame, rollup: Rollup, facts_path: str, table_path: str, staging_path: str, checkpoint: str, count: str = "requests") -> StreamingQuery:
    """Rows to the facts of their hours, and every hour that a batch touches, however old, built anew in the stored rollup.

    Facts lie by hour and batch, so that a batch that is written again replaces what it wrote before; the touched hours are
    the only ones that are read and rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumns({"fact_hour": F.expr(HOUR), "batch": F.lit(number)}).persist()
        try:
            hours = [r["fact_hour"] for r in fresh.select("fact_hour").distinct().collect()]
            if not hours:
                return
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fact_hour", "batch").parquet(facts_path)
            stored = spark.read.schema(StructType([*batch.schema.fields]).add("fact_hour", "string").add("batch", "integer")).parquet(facts_path)
            facts = stored.filter(F.col("fact_hour").isin(hours)).drop("fact_hour", "batch")
            rebuild_hours(rollup, facts, table_path, staging_path, hours, count)
        finally:
            fresh.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_top(rows: DataFrame, n: int, view: str, checkpoint: str, where: str = "true") -> StreamingQuery:
    """Keep the newest ``n`` rows as the table ``view``; used for live errors and telemetry tickers."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(where)
        if spark.catalog.tableExists(view):
            rows = rows.unionByName(spark.table(view))
        # At most n rows, so that the view's plan does not grow with the batches.
        spark.createDataFrame(rows.orderBy(F.desc("timestamp")).limit(n).collect(), rows.schema).createOrReplaceTempView(view)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _expire(state: Any, at: float) -> None:
    """Drop the state once the watermark has passed ``at`` (seconds)."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def stream_alerts(values: DataFrame, threshold: float, cooldown_s: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Alerts from (name, at, value) with a cooldown per name: state is the time of the last one, dropped once the
    watermark is past its cooldown."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        found = []
        # All chunks of the key together, in order of time.
        for at, value in sorted(pair for pdf in batches for pair in zip(pdf["at"], pdf["value"])):
            if value > threshold and (last is None or at.timestamp() - last >= cooldown_s):
                last = at.timestamp()
                found.append((key[0], at, value))
        if last is not None:
            state.update((last,))
            _expire(state, last + cooldown_s)
        if found:
            yield pd.DataFrame(found, columns=["name", "at", "value"])

    return values.withWatermark("at", delay).groupBy("name").applyInPandasWithState(step, "name string, at timestamp, value double", "last double", "append", "EventTimeTimeout")


def stream_error_alerts(rows: DataFrame, name: str, threshold: float, path: str, checkpoint: str, length: str = "5 minutes", cooldown_s: int = 3600, delay: str = "10 minutes") -> StreamingQuery:
    """Alerts (name, at, value) on the share of server errors of each ``name`` in windows of ``length``, into the table ``path``.

    A window is judged once, when the watermark has closed it; rows that come later are dropped.  (Spark allows no
    grouped state behind an aggregate.)  The cooldown's state is the table of alerts itself: a batch reads what the earlier ones
    wrote, and one that is run again replaces its own folder.
    """
    share = rows.withWatermark("timestamp", delay).groupBy(F.window("timestamp", length), F.col(name).alias("name")).agg((F.count_if(F.col("status") >= 500) * 100.0 / F.count("*")).cast("double").alias("value"))
    closed = share.select("name", F.col("window.end").alias("at"), "value")
    schema = StructType([*closed.schema.fields]).add("batch", "long")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        over = batch.filter(F.col("value") > threshold).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("over"))
        sent = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path).filter(F.col("batch") < number)
        last = sent.groupBy("name").agg(F.max("at").alias("last"))
        # Windows of one name in one batch, one after the other.
        start = F.struct(F.col("last").alias("last"), F.array().cast("array<struct<at:timestamp,value:double>>").alias("kept"))

        def next_window(done: Column, x: Column) -> Column:
            due = done["last"].isNull() | (F.unix_timestamp(x["at"]) - F.unix_timestamp(done["last"]) >= cooldown_s)
            return F.when(due, F.struct(x["at"].alias("last"), F.concat(done["kept"], F.array(x)).alias("kept"))).otherwise(done)

        kept = over.join(last, "name", "left").select("name", F.explode(F.aggregate("over", start, next_window)["kept"]).alias("x"))
        kept.select("name", "x.at", "x.value", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return closed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_session_score(rows: DataFrame, idle_s: int = 1800, longest_s: int = 86400, delay: str = "10 minutes") -> DataFrame:
    """Dwell-time rules on running statistics per session: count, mean and mean square of the gaps, first and last
    time.  A session ends after ``idle_s`` without a request or ``longest_s`` in all; requests are scored in order of time
    as the watermark passes them, and the state goes when it is ``idle_s`` past the last one."""

    idle, longest = idle_s * 1_000_000, longest_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, n, s1, s2, first, last = state.get if state.exists else ([], 0, 0.0, 0.0, None, None)
        ready, waiting, mark = _passed(state, iter(()) if state.hasTimedOut else batches, [(t,) for t in held], 1)
        out = []
        for (at,) in ready:
            if last is not None and (at - last > idle or at - first > longest):
                n, s1, s2, first, last = 0, 0.0, 0.0, None, None
            first = at if first is None else first
            if last is not None:
                gap = (at - last) / 1e6
                s1, s2 = s1 + gap, s2 + gap * gap
            n, last = n + 1, at
            mean = s1 / max(1, n - 1)
            var = s2 / max(1, n - 1) - mean * mean
            score = 0 if n <= 3 else 50 * (mean < 0.2) + 40 * (var < 0.05 and 0.2 <= mean <= 3)
            out.append((key[0], pd.Timestamp(at, unit="us"), n, int(score)))
        if not waiting and (last is None or last + idle < mark):
            state.remove()
        else:
            state.update(([t for (t,) in waiting], n, s1, s2, first, last))
            _expire(state, (waiting[0][0] if waiting else last + idle) / 1e6)
        if out:
            yield pd.DataFrame(out, columns=["sid", "at", "seq", "l1"])

    ship_package(rows.sparkSession)
    held = "held array<long>, n long, s1 double, s2 double, first long, last long"
    return rows.withWatermark("timestamp", delay).select("timestamp", "edge_sid").groupBy("edge_sid").applyInPandasWithState(step, "sid string, at timestamp, seq long, l1 int", held, "append", "EventTimeTimeout")


def run_available(out: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is available into a memory table and return it."""
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.table(name)
