"""Further operators: proxies, cache detail, session detail, availability, cooldowns, and rollup upkeep."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km, io_cost
from .reads import HOUR


def proxy_analysis(logs: DataFrame, pops: DataFrame) -> DataFrame:
    """Flagged clients: impossible distance for the round trip, or a round trip that a tunnel would give.

    Distances are computed on the distinct (pop, lat, lon) and joined back null-safe.
    """
    places = logs.filter("lat IS NOT NULL AND lon IS NOT NULL").select("pop", "lat", "lon").distinct().join(F.broadcast(pops), "pop")
    places = places.select(F.col("pop").alias("p"), F.col("lat").alias("la"), F.col("lon").alias("lo"), haversine_km(F.col("lat"), F.col("lon"), F.col("pop_lat"), F.col("pop_lon")).alias("km"))
    on = F.col("pop").eqNullSafe(F.col("p")) & F.col("lat").eqNullSafe(F.col("la")) & F.col("lon").eqNullSafe(F.col("lo"))
    rows = logs.filter("ip IS NOT NULL AND ip <> '' AND rtt_min IS NOT NULL").join(places, on, "left")
    far = F.coalesce(F.col("km") > F.col("rtt_min") / 1000.0 * 100 + 150, F.lit(False))
    ratio = F.when(F.col("tcp_rtt") > 0, F.col("rtt_min") / F.col("tcp_rtt"))
    risk = F.when(far | F.coalesce(ratio < 0.1, F.lit(False)), "High").when(ratio < 0.2, "Medium").otherwise("Low")
    return rows.withColumn("impossible", far).withColumn("risk", risk).filter("risk <> 'Low'").groupBy("risk").agg(F.count("*").alias("requests"), F.countDistinct("ip").alias("ips"), F.count_if("impossible").alias("impossible"))


def cache_collapse_detail(logs: DataFrame, url: str) -> DataFrame:
    """Hourly requests, hits and the hits that the baseline rate would give, for one URL."""
    rows = logs.filter((F.col("url") == url) & F.expr("startswith(cache, 'HIT') OR startswith(cache, 'MISS')"))
    hit = F.col("cache").startswith("HIT")
    base = rows.filter("is_b").agg((F.count_if(hit) / F.count("*")).alias("rate"))
    hours = rows.groupBy(F.expr(HOUR).alias("hour")).agg(F.count("*").alias("cacheable"), F.count_if(hit).alias("hits"))
    return hours.crossJoin(F.broadcast(base)).select("hour", "cacheable", "hits", F.round(F.col("cacheable") * F.col("rate"), 4).alias("expected_hits"))


def session_detail(logs_with_sessions: DataFrame, key: Mapping[str, str], session_no: int, cap: int = 500) -> DataFrame:
    """The first ``cap`` requests of one session."""
    rows = logs_with_sessions.filter(F.col("session_no") == session_no)
    for name, value in key.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy("timestamp", "rid").limit(cap)


def top_k_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def events_per_session_cap(rows: DataFrame, n: int, key: str = "edge_sid") -> DataFrame:
    return top_k_per_group(rows, [key], ["timestamp", "rid"], n).drop("rank")


def share_of_total(counts: DataFrame, value: str = "count") -> DataFrame:
    """Add pct, the share of all; the total is one row."""
    total = counts.agg(F.sum(value).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.col(value) * 100.0 / F.col("__all"), 4).cast("double")).drop("__all")


def rank_two_ways(rows: DataFrame, first: str, second: str, k: int, ties: Sequence[str]) -> DataFrame:
    """Rows among the ``k`` greatest by either column, of a small aggregate: two top-k lists, joined."""
    lists = [rows.orderBy(F.desc_nulls_last(c), *ties).limit(k).select(*ties) for c in (first, second)]
    return rows.join(lists[0].union(lists[1]).distinct(), list(ties), "left_semi")


def loss_runs(hours: DataFrame, lossy: str, order: str = "n") -> DataFrame:
    """(start, length) of runs of consecutive ``order`` numbers where ``lossy`` holds."""
    rows = hours.filter(lossy).withColumn("i", F.col(order) - F.row_number().over(Window.orderBy(order)))
    return rows.groupBy("i").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("i")


def gap_regularity(gaps: DataFrame, key: str) -> DataFrame:
    """Coefficient of variation of gaps with the rounding of whole seconds taken out."""
    out = gaps.groupBy(key).agg(F.avg("gap").alias("mean"), F.var_samp("gap").alias("var"))
    return out.withColumn("cv", F.expr("sqrt(greatest(var - 1.0D / 12.0D, 0)) / nullif(mean, 0)"))


def detection_availability(columns: Iterable[str], required: Mapping[str, Sequence[str]]) -> dict[str, bool]:
    """Which detections a schema supports."""
    have = set(columns)
    return {name: set(fields) <= have for name, fields in required.items()}


def alert_cooldown(alerts: DataFrame, seconds: int = 3600, stale_s: int | None = None, now: str | None = None) -> DataFrame:
    """Alerts (name, at) that come at least ``seconds`` after the last one sent of their name; with ``stale_s`` none
    that is older than that at ``now``.

    Times count in whole seconds and once each, so that a name's array grows with the time span and not with the
    number of alerts; only its running choice is sequential.
    """
    if stale_s is not None:
        alerts = alerts.filter(F.unix_timestamp("at") >= F.unix_timestamp(F.lit(now).cast("timestamp")) - stale_s)
    times = alerts.select("name", F.unix_timestamp("at").alias("t")).distinct()
    ordered = times.groupBy("name").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    kept = F.aggregate("ts", F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= seconds), F.concat(acc, F.array(t))).otherwise(acc))
    return ordered.select("name", F.explode(kept).alias("s")).select("name", F.timestamp_seconds("s").alias("at"))


def insufficient_baseline(logs: DataFrame, window_start: str, baseline_hours: float) -> DataFrame:
    """One row: whether the history before the window is shorter than the baseline."""
    have = (F.unix_timestamp(F.lit(window_start).cast("timestamp")) - F.unix_timestamp(F.min("timestamp").cast("timestamp"))) / 3600.0
    return logs.agg(F.round(have, 4).alias("hours")).withColumn("insufficient", F.col("hours") < baseline_hours)


def weighted_percentiles(hourly: DataFrame, keys: Sequence[str], value: str, weight: str = "weight") -> DataFrame:
    """Weighted mean of hourly percentiles: an approximation, kept for comparison with the mergeable sketch."""
    return hourly.groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias(value), F.sum(weight).alias(weight))


# Free image requests of a month, and price steps (upper bound of the month's requests, price per 10,000).
IO_FREE = 100_000
IO_STEPS = ((10_000_000, 0.50), (50_000_000, 0.15), (150_000_000, 0.07), (500_000_000, 0.03), (1_000_000_000, 0.02), (5_000_000_000, 0.015), (None, 0.01))


def io_tiers(spark: SparkSession, free: int = IO_FREE, steps: Sequence[tuple[int | None, float]] = IO_STEPS) -> DataFrame:
    """The price list as (lo, hi, price of one request)."""
    lows = [free, *[top for top, _ in steps[:-1]]]
    return spark.createDataFrame([(lo, top, price / 10_000) for lo, (top, price) in zip(lows, steps)], "lo long, hi long, price double")


def io_usage(logs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Image transforms by month: their share of the month's requests and their cost at marginal prices."""
    month = F.date_format("timestamp", "yyyy-MM").alias("month")
    months = logs.groupBy(month).agg(F.count("*").alias("requests"), F.count("io_output_format").alias("transforms"), F.coalesce(F.sum(F.col("io_input_bytes") - F.col("io_output_bytes")), F.lit(0)).alias("saved_bytes"))
    months = months.withColumn("traffic_pct", F.round(F.col("transforms") * 100.0 / F.col("requests"), 4).cast("double"))
    priced = io_cost(months.select("month", "transforms"), tiers).select("month", "cost")
    return months.join(priced, "month", "left").withColumn("cost", F.round(F.coalesce("cost", F.lit(0.0)), 6))
