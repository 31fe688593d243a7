"""Registered queries of the rollups: hours from rows, days merged from hours, reads by coverage, and what they must equal.

The comparison SQL is written out by itself.  A quantile of a logarithmic histogram is the discrete quantile of the
values' centroids, which any engine can state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollups as R
from ..operators.analytics import rollup_ip_spread
from ..operators.reads import HOUR
from ..sources.request_log import CTES, rum_vitals
from .read_sql import H, M, OL, _CONN, _HEADER, _ORIGIN, _TTL, _TUNNEL, D, big, n

Frame = Callable[[DataFrame], DataFrame]


def g(value: str, p: float, per: float = 1000.0) -> str:
    """Quantile of the histogram of ``value``."""
    cell = f"CASE WHEN {value} > 0 THEN power(1.02::DOUBLE, ceil(ln({value}) / ln(1.02::DOUBLE))) * 2 / 2.02 WHEN {value} <= 0 THEN 0 END"
    return f"round(quantile_disc({cell}, {p}) / {per}, 6)"


_LATENCIES = f"{g(OL, 0.5)} AS p50_ms, {g(OL, 0.95)} AS p95_ms, {g(OL, 0.99)} AS p99_ms"
_LOSS = "round(sum(coalesce(ploss, 0)), 3) AS ploss_sum, count(ploss) AS ploss_cnt, round(avg(ploss), 6) AS avg_ploss"
_HIT3, _BOTH = "(cache = 'HIT' OR cache = 'HIT-STALE' OR cache = 'HIT-CLUSTER')", "ttfb IS NOT NULL AND elapsed IS NOT NULL"
_FIRST, _LAST = "coalesce(ottfb / 1000.0::DOUBLE, 0)", "coalesce(ottlb / 1000.0::DOUBLE, 0)"


def _sum(value: str, cond: str) -> str:
    return f"round(sum(CASE WHEN {cond} THEN {value} ELSE 0 END), 3)"


_OVERVIEW = ", ".join([
    "count(*) AS requests", f"{n(_HIT3)} AS hit_requests", f"{n("cache = 'MISS'")} AS miss_requests", f"{n("cache = 'PASS'")} AS pass_requests", f"{n("cache = 'SYNTH'")} AS synth_requests",
    f"{n("cache = 'MISS' OR cache = 'PASS' OR cache = 'SYNTH' OR cache = 'ERROR'")} AS origin_requests", f"{big(f'CASE WHEN {_HIT3} THEN resp_bytes END')} AS bandwidth_saved_bytes", f"{big('resp_bytes')} AS total_bandwidth_bytes",
    f"{n(f'edge = false AND {_HIT3}')} AS shield_hit_requests", f"{n('edge = false')} AS shield_total_requests", f"{n("length(waf_sig) > 0 AND waf_resp = 406")} AS threats_blocked",
    f"{big(f'CASE WHEN {_HIT3} THEN elapsed END')} AS hit_elapsed_sum", f"count(CASE WHEN {_HIT3} THEN elapsed END) AS hit_elapsed_count", f"{big("CASE WHEN cache = 'MISS' THEN elapsed END")} AS miss_elapsed_sum", "count(CASE WHEN cache = 'MISS' THEN elapsed END) AS miss_elapsed_count",
    f"{_sum('ttfb', _HIT3)} AS hit_ttfb_sum", f"count(CASE WHEN {_HIT3} THEN ttfb END) AS hit_ttfb_count", f"{_sum('ttfb', "cache = 'MISS'")} AS miss_ttfb_sum", "count(CASE WHEN cache = 'MISS' THEN ttfb END) AS miss_ttfb_count",
    f"{n(_BOTH)} AS waterfall_count", f"{_sum(f'greatest(0, ttfb * 1000 - {_FIRST})', _BOTH)} AS edge_processing_sum", f"{_sum(_FIRST, _BOTH)} AS origin_wait_sum",
    f"{_sum(f'greatest(0, {_LAST} - {_FIRST})', _BOTH)} AS origin_download_sum", f"{_sum(f'greatest(0, elapsed / 1000.0::DOUBLE - greatest({_LAST}, ttfb * 1000))', _BOTH)} AS client_download_sum",
    "count(io_output_bytes) AS image_requests", f"{big('CASE WHEN io_input_bytes > io_output_bytes THEN io_input_bytes - io_output_bytes END')} AS image_saved_bytes",
])

#: Bucket of the rollup, its other keys, its measures, its rows.
_SQL: dict[str, tuple[str, str, str, str]] = {
    "time_series": (M, "", f"count(*) AS requests, {n('status >= 400 AND status < 500')} AS err4, {n('status >= 500')} AS err5, {n("cache = 'HIT' OR cache = 'HIT-STALE'")} AS hits, count(cache) AS cache_total, {big('resp_bytes')} AS bytes, round(sum(coalesce(ttfb, 0)), 3) AS ttfb_sum, count(ttfb) AS ttfb_cnt", "true"),
    "overview": (H, "", _OVERVIEW, "true"),
    "sessions": (H, "ip, ja4", f"CAST(min(timestamp) AS VARCHAR) AS first_ts, CAST(max(timestamp) AS VARCHAR) AS last_ts, count(*) AS reqs, {n('status >= 400 AND status < 500')} AS err4, {n('status >= 500')} AS err5, {big('resp_bytes')} AS bytes", "true"),
    "origin_summary": (H, "", f"count(*) AS weight, {n('ost >= 500')} AS err5, {_LATENCIES}", _ORIGIN),
    "origin_pop": (H, "pop", f"count(*) AS weight, {_LATENCIES}", _ORIGIN),
    "origin_ip": (H, "oip", f"count(*) AS weight, {n('ost >= 500')} AS err5, {_LATENCIES}", _ORIGIN),
    "origin_path": (H, "edge", f"count(*) AS weight, {_LATENCIES}", _ORIGIN),
    "origin_latency_ts": (M, "", f"count(*) AS weight, {_LATENCIES}", _ORIGIN),
    "slow_urls": (H, "url", f"count(*) AS weight, {_LATENCIES}", _ORIGIN),
    "perf_latency": (H, "url", f"count(*) AS weight, {g('elapsed', 0.5)} AS p50, {g('elapsed', 0.95)} AS p95, {g('elapsed', 0.99)} AS p99", "elapsed IS NOT NULL"),
    "ttl_dist": (H, f"{_TTL} AS bucket", "count(*) AS count, min(ttl) AS min_ttl", "ttl IS NOT NULL"),
    "pop_health": (H, "pop", f"count(*) AS requests, {n('status >= 400')} AS errors, {n("cache = 'HIT' OR cache = 'HIT-STALE'")} AS hits, {big('resp_bytes')} AS bytes, {g('tcp_rtt', 0.5, 1)} AS p50_rtt_us, {g('(ttfb * 1000.0::DOUBLE)', 0.95, 1)} AS p95_ttfb_ms", "true"),
    "network_quality": (H, "country", f"count(*) AS weight, {g('tcp_rtt', 0.5)} AS rtt_ms", "tcp_rtt > 0"),
    "network_rtt": (H, "asn", f"count(*) AS weight, {g('tcp_rtt', 0.95, 1)} AS p95_us, {g('tcp_rtt', 0.99, 1)} AS p99_us", "tcp_rtt > 0"),
    "network_summary": (H, "", f"count(*) AS requests, {_LOSS}, {big('retrans')} AS retrans, {g('tcp_rtt', 0.5, 1)} AS rtt_med_us", "tcp_rtt > 0"),
    "network_speed": (H, "asn, c_speed", "count(*) AS cnt", "length(c_speed) > 0"),
    "network_geo": (H, "country, city, metro", f"count(*) AS reqs, {g('tcp_rtt', 0.5, 1)} AS rtt_med_us", "tcp_rtt > 0"),
    "network_heatmap": (H, "asn", f"count(*) AS reqs, {_LOSS}, {n('status >= 500')} AS err5, {g('tcp_rtt', 0.5, 1)} AS rtt_med_us, {g('rtt_var', 0.5, 1)} AS jitter", "tcp_rtt > 0"),
    "req_size": (H, f"{_HEADER} AS bucket", "count(*) AS count, min(req_header_bytes) AS min_val", "true"),
    "conn_reuse": (H, f"{_CONN} AS bucket", "count(*) AS count, max(conn_requests) AS max_val", "conn_requests > 0"),
    "top_ips": (H, "ip", "count(*) AS reqs, max(req_header_bytes) AS max_header", "true"),
    "coverage": (H, "", f"count(*) AS total_rows, {n('length(ja3) > 0')} AS ja3_rows, {n('length(ja4) > 0')} AS ja4_rows", "true"),
    "proxy_flagged": (H, "ip", "count(*) AS count, min(rtt_min) AS min_rtt", _TUNNEL),
    "bot_eff": (H, "ua", f"count(*) AS cnt, {big('resp_bytes')} AS bytes", "length(ua) > 0"),
}


def _sql(name: str, day: bool) -> str:
    bucket, keys, measures, where = _SQL[name]
    at = f"{D} AS day" if day else f"{bucket} AS {'minute' if bucket == M else 'hour'}"
    return f"{CTES} SELECT {at}, {keys + ', ' if keys else ''}{measures} FROM logs WHERE {where} GROUP BY ALL"


#: Ranges of one query that reads by coverage: the rollup lacks two closed hours, has one short, and none that is open.
_START, _END, _OPEN = "2024-01-05 00:00:00", "2024-01-26 00:00:00", "2024-01-25 06:00:00"
_LOST, _SHORT = ("2024-01-10 03:00:00", "2024-01-18 22:00:00"), "2024-01-12 07:00:00"


def _torn(logs: DataFrame) -> DataFrame:
    """The rows that the stored rollup was built from."""
    hour = F.expr(HOUR)
    return logs.filter(~hour.isin(*_LOST) & (hour < _OPEN) & ~((hour == _SHORT) & (F.col("event_id") % 3 == 0)))


def _covered(name: str) -> Frame:
    rollup = R.ROLLUPS[name]

    def run(logs: DataFrame) -> DataFrame:
        table, covered = rollup.build(_torn(logs)), R.coverage_of(_torn(logs), _OPEN)
        return rollup.read(R.read_rollup_plus_live(rollup, table, covered, logs, _START, _END))

    return run


def _healed(logs: DataFrame) -> DataFrame:
    rollup = R.ROLLUPS["network_heatmap"]
    table, _ = R.rollup_heal(rollup, rollup.build(_torn(logs)), R.coverage_of(_torn(logs), _OPEN), logs, _OPEN)
    return rollup.read(table)


def _partial(logs: DataFrame) -> DataFrame:
    rollup, cut = R.ROLLUPS["pop_health"], "2024-01-20 10:30:00"
    return rollup.read(R.partial_hour_merge(rollup, rollup.build(logs.filter(f"timestamp <= TIMESTAMP_NTZ '{cut}'")), logs, cut))


def _repaired(logs: DataFrame, report: bool) -> DataFrame:
    rollup = R.ROLLUPS["perf_latency"]
    table, told = R.rollup_repair_day(rollup, rollup.build(logs.filter("event_id % 7 <> 0 OR timestamp < TIMESTAMP_NTZ '2024-01-15' OR timestamp >= TIMESTAMP_NTZ '2024-01-16'")), logs, "2024-01-15", "weight")
    return told if report else rollup.read(table)


#: Vitals by hour, metric and one dimension at a time.
RUM_DIMS = ("browser", "os", "device", "pathname", "country", "city", "pop")
RUM = R.Rollup(
    {"hour": HOUR, "dim": "dim", "value": "value", "metric_name": "metric_name"}, {"rows": "1L", "value_sum": "metric_value", "good": R.one_if("metric_rating = 'good'")},
    sketches={"metric": "metric_value"}, quantiles={"p75": ("metric", 0.75, 1.0)},
)


def _rum(logs: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("Unknown")).alias("value")) for d in RUM_DIMS])
    rows = rum_vitals(logs).select("*", F.explode(pairs).alias("x")).select("timestamp", "metric_name", "metric_value", "metric_rating", "x.dim", "x.value")
    return RUM.read(RUM.days(RUM.build(rows)))


_RUM_SQL = CTES + " " + " UNION ALL ".join(
    f"SELECT {D} AS day, '{d}' AS dim, coalesce(CAST({d} AS VARCHAR), 'Unknown') AS value, metric_name, count(*) AS rows, round(sum(metric_value), 3) AS value_sum, {n("metric_rating = 'good'")} AS good, {g('metric_value', 0.75, 1)} AS p75 FROM vitals GROUP BY 1, 3, 4"
    for d in ("browser", "os", "device", "pathname", "country", "city", "pop")
)


def entries() -> dict[str, tuple[Frame, str]]:
    out: dict[str, tuple[Frame, str]] = {}
    for name in _SQL:
        rollup = R.ROLLUPS[name]
        out[f"rollup_{name}"] = (lambda x, r=rollup: r.read(r.build(x))), _sql(name, False)
        out[f"rollup_{name}_day"] = (lambda x, r=rollup: r.read(r.days(r.build(x)))), _sql(name, True)
    inside = f"timestamp >= TIMESTAMP '{_START}' AND timestamp < TIMESTAMP '{_END}'"
    for name, query in (("overview", "read_rollup_plus_live"), ("pop_health", "read_rollup_plus_live_pop"), ("origin_latency_ts", "read_rollup_plus_live_minutes")):
        bucket, keys, measures, where = _SQL[name]
        out[query] = _covered(name), f"{CTES} SELECT {bucket} AS {'minute' if bucket == M else 'hour'}, {keys + ', ' if keys else ''}{measures} FROM logs WHERE {where} AND {inside} GROUP BY ALL"
    out["rollup_heal"] = _healed, f"{_sql('network_heatmap', False)} HAVING min(timestamp) < TIMESTAMP '{_OPEN}'"
    out["partial_hour_merge"] = _partial, _sql("pop_health", False)
    out["rollup_repair_day"] = (lambda x: _repaired(x, False)), _sql("perf_latency", False)
    out["rollup_repair_day_report"] = (
        lambda x: _repaired(x, True),
        f"{CTES} SELECT {H} AS hour, count(*) FILTER (event_id % 7 <> 0) AS was, count(*) AS now, count(*) FILTER (event_id % 7 <> 0) <> count(*) AS differs FROM logs WHERE elapsed IS NOT NULL AND CAST(timestamp AS DATE) = DATE '2024-01-15' GROUP BY 1",
    )
    out["rollup_rum_vitals_day"] = _rum, _RUM_SQL
    out["rollup_ip_spread"] = (
        lambda x: rollup_ip_spread(x, "country", 25).select("hour", "value", "observed", "sampled", "capped", "rows", "last_hash"),
        f"""{CTES}, p AS (SELECT {H} AS hour, country AS value, ip, count(*) AS k, md5(ip) AS m FROM logs WHERE country IS NOT NULL AND ip IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hour, value ORDER BY m, ip) AS place FROM p)
SELECT hour, value, count(*) AS observed, least(count(*), 25) AS sampled, count(*) > 25 AS capped, CAST(sum(k) AS BIGINT) AS rows, max(CASE WHEN place <= 25 THEN m END) AS last_hash FROM r GROUP BY 1, 2""",
    )
    return out

