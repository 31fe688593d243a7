"""Network reports: cells of places or providers over time, leaderboards with a health score, and a summary.

A cell report counts its cells first, keeps the ``k`` fullest (a fixed number of rows, broadcast) and joins them back
null-safe, so that percentiles are only computed for rows of cells that are shown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RTT_OK = "tcp_rtt IS NOT NULL AND tcp_rtt > 0"


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def health(loss: Column, error_pct: Column, congestion_us: Column | None = None, jitter_us: Column | None = None) -> Column:
    """100 for a flawless path; loss weighs 40, congestion 30, jitter 20 and errors 10, each up to its ceiling."""
    part = lambda c, top, w: F.lit(0.0) if c is None else w * F.least(F.coalesce(c, F.lit(0.0)) / top, F.lit(1.0))
    lost = part(loss, 0.05, 40) + part(congestion_us, 100_000.0, 30) + part(jitter_us, 50_000.0, 20) + part(error_pct, 10.0, 10)
    return F.round(100.0 - lost, 4)


def top_cells(rows: DataFrame, keys: Mapping[str, Column], k: int, measures: Sequence[Column]) -> DataFrame:
    """The ``k`` cells with the most rows, their number and share of server errors, and ``measures`` of their rows."""
    keyed = rows.withColumns({f"__{n}": c for n, c in keys.items()})
    names = list(keys)
    cells = keyed.groupBy(*[F.col(f"__{n}").alias(n) for n in names]).agg(F.count("*").alias("reqs"), F.count_if(F.col("status") >= 500).alias("errors"))
    cells = cells.orderBy(F.desc("reqs"), *[F.asc_nulls_last(n) for n in names]).limit(k)
    cells = cells.select(*[F.col(n).alias(f"c_{n}") for n in names], "reqs", "errors")
    same = [F.col(f"__{n}").eqNullSafe(F.col(f"c_{n}")) for n in names]
    found = keyed.join(F.broadcast(cells), same).groupBy(*[F.col(f"c_{n}").alias(n) for n in names], "reqs", "errors").agg(*measures)
    return found.withColumn("error_pct", F.round(F.col("errors") * 100.0 / F.col("reqs"), 4).cast("double")).drop("errors")


def bucket_start(seconds: int) -> Column:
    """Start of the bucket of ``seconds`` in which a row lies."""
    s = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds))).cast("timestamp_ntz").cast("string")


def _path_measures() -> list[Column]:
    return [
        r6(F.expr("percentile(CASE WHEN cache LIKE '%HIT%' AND elapsed > 0 THEN resp_bytes * 1000000.0D / elapsed END, 0.5)")).alias("throughput_bps"),
        r6(F.expr("percentile(tcp_rtt, 0.5)")).alias("rtt_med_us"),
        r6(F.expr("percentile(rtt_min, 0.5)")).alias("rtt_baseline_us"),
        r6(F.expr("percentile(tcp_rtt - rtt_min, 0.5)")).alias("rtt_congestion_us"),
        r6(F.avg("ploss")).alias("avg_ploss"),
        r6(F.expr("percentile(rtt_var, 0.5)")).alias("rtt_jitter_us"),
    ]


def _path_health() -> Column:
    return health(F.col("avg_ploss"), F.col("error_pct"), F.col("rtt_congestion_us"), F.col("rtt_jitter_us"))


def network_heatmap(logs: DataFrame, seconds: int = 3600, k: int = 500) -> DataFrame:
    """Provider by time: throughput, round trips, loss, jitter, errors and health of the ``k`` fullest cells."""
    rows = logs.filter(f"{RTT_OK} AND asn IS NOT NULL")
    return top_cells(rows, {"asn": F.col("asn"), "bucket": bucket_start(seconds)}, k, _path_measures()).withColumn("health", _path_health())


def network_map(logs: DataFrame, seconds: int = 86400, k: int = 5000) -> DataFrame:
    """Place by time: median round trip, loss, errors and health of the ``k`` fullest cells."""
    rows = logs.filter(f"{RTT_OK} AND country IS NOT NULL AND country <> ''")
    keys = {c: F.col(c) for c in ("country", "city", "lat", "lon", "metro")} | {"bucket": bucket_start(seconds)}
    out = top_cells(rows, keys, k, [r6(F.expr("percentile(tcp_rtt, 0.5)")).alias("rtt_med_us"), r6(F.avg("ploss")).alias("avg_ploss")])
    return out.withColumn("health", health(F.col("avg_ploss"), F.col("error_pct")))


def metro_leaderboard(logs: DataFrame, k: int = 100) -> DataFrame:
    """The fullest places; those of one metro are one entry, named by its fullest place, with health weighted by
    requests."""
    rows = logs.filter(f"{RTT_OK} AND country IS NOT NULL AND country <> ''")
    cells = top_cells(rows, {c: F.col(c) for c in ("country", "city", "region", "metro")}, k, [r6(F.expr("percentile(tcp_rtt, 0.5)")).alias("rtt_med_us"), r6(F.avg("ploss")).alias("avg_ploss")])
    cells = cells.withColumn("health", health(F.col("avg_ploss"), F.col("error_pct")))
    lead = F.struct((-F.col("reqs")).alias("rank"), "country", "city", "region")
    one = cells.groupBy("metro").agg(F.min(lead).alias("lead"), F.sum("reqs").alias("total_reqs"), F.round(F.sum(F.col("health") * F.col("reqs")) / F.sum("reqs"), 1).alias("health_score"), F.count("*").alias("places"))
    return one.select("metro", *[F.col(f"lead.{c}").alias(c) for c in ("country", "city", "region")], "total_reqs", "health_score", "places")


def asn_leaderboard(logs: DataFrame, seconds: int = 900, k: int = 50) -> DataFrame:
    """The ``k`` busiest providers: health now, over the last hour and over the first quarter of their buckets, trend
    (five points up or down against the last hour), p95 and p99 round trip and the mix of connection speeds."""
    rows = logs.filter(f"{RTT_OK} AND asn IS NOT NULL")
    top = rows.groupBy("asn").agg(F.count("*").alias("total_reqs")).orderBy(F.desc("total_reqs"), "asn").limit(k)
    few = rows.join(F.broadcast(top), "asn")  # k rows
    cells = few.groupBy("asn", bucket_start(seconds).alias("bucket")).agg(*_path_measures(), F.round(F.count_if(F.col("status") >= 500) * 100.0 / F.count("*"), 4).cast("double").alias("error_pct"))
    cells = cells.withColumn("health", _path_health())
    by = Window.partitionBy("asn")
    cells = cells.withColumns({"first": F.row_number().over(by.orderBy("bucket")), "last": F.row_number().over(by.orderBy(F.desc("bucket"))), "n": F.count("*").over(by)})
    hour, quarter = F.lit(max(1, 3600 // seconds)), F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    scores = cells.groupBy("asn").agg(
        F.max_by("health", "bucket").alias("health_now"),
        F.round(F.avg(F.when(F.col("last") <= hour, F.col("health"))), 1).alias("health_hour"),
        F.round(F.avg(F.when(F.col("first") <= quarter, F.col("health"))), 1).alias("health_early"),
        F.round(F.avg("rtt_med_us") / 1000.0, 1).alias("rtt_ms"),
    )
    change = F.col("health_now") - F.col("health_hour")
    scores = scores.withColumn("trend", F.when(change < -5, "degrading").when(change > 5, "improving").otherwise("stable"))
    tail = few.groupBy("asn", "total_reqs").agg(r6(F.expr("percentile(tcp_rtt, 0.95)")).alias("p95_us"), r6(F.expr("percentile(tcp_rtt, 0.99)")).alias("p99_us"))
    speeds = few.filter("c_speed <> ''").groupBy("asn", "c_speed").agg(F.count("*").alias("n"))
    # At most a handful of speed classes a provider.
    part = F.concat("c_speed", F.lit("="), F.format_string("%.3f", F.round(F.col("n") / F.sum("n").over(by), 3)))
    mix = speeds.select("asn", part.alias("part")).groupBy("asn").agg(F.array_join(F.sort_array(F.collect_list("part")), ",").alias("speed_mix"))
    return tail.join(scores, "asn").join(mix, "asn", "left")


def network_summary(logs: DataFrame, seconds: int = 900, k: int = 50) -> DataFrame:
    """One row: mean health of the providers, mean round trip, requests, the worst provider with over one percent of
    the requests and the worst place of the newest day."""
    rows = logs.filter(RTT_OK)
    total = rows.agg(F.count("*").alias("total_reqs"))
    board = asn_leaderboard(logs, seconds, k)
    mean = board.agg(F.round(F.avg("health_now"), 1).alias("global_health"), F.round(F.avg("rtt_ms"), 1).alias("avg_rtt_ms"))
    big = board.crossJoin(F.broadcast(total.withColumnRenamed("total_reqs", "every"))).filter("total_reqs > every * 0.01")
    worst = big.agg(F.min(F.struct("health_now", "asn")).alias("w")).select(F.col("w.asn").alias("worst_asn"), F.col("w.health_now").alias("worst_asn_health"))
    cells = network_map(logs)
    last = cells.groupBy("bucket").agg(F.min(F.struct("health", "country", "city")).alias("w")).orderBy(F.desc("bucket")).limit(1)
    place = last.select(F.concat_ws(", ", "w.city", "w.country").alias("worst_place"), F.col("w.health").alias("worst_place_health"))
    # Four tables of one row each.
    return total.crossJoin(mean).crossJoin(worst).crossJoin(place)
