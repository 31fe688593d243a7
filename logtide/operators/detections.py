"""Window-against-baseline detections.

``logs`` carries ``is_w`` (row in the window) and ``is_b`` (row in the baseline).  Each detection is a
:class:`Report` whose thresholds are parameters; all return label, current_val, baseline_val, unit, severity and
their measures.  What a detection shows and when it is critical, a warning or mere information is in :data:`CARDS`.
"""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import CRAWLER
from ..plans.report import Report, count_if, distinct, mean, quantile, total
from ..sources.request_log import BASELINE_HOURS, WINDOW_HOURS

# URL fragments, user-agent tokens and file endings that the detections look for.
PROBE_PATHS = (
    "admin", ".env", ".git", "wp-", "phpmyadmin", "config", "backup", "shell", "passwd", "xmlrpc", "actuator",
    "console", "cgi-bin", ".php", ".asp", "../../", "swagger", "api-docs", "graphql", "debug",
)
BOT_TOKENS = (
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot", "applebot", "uptimerobot", "pingdom",
    "statuscake", "datadoghq", "newrelic", "ahrefsbot", "semrushbot", "gptbot", "claudebot", "ccbot",
    "facebookexternalhit", "bot", "crawler", "spider", "monitor",
)
AUTH_PATHS = (
    "login", "signin", "sign-in", "log-in", "auth", "oauth", "openid", "token", "sso", "saml", "session", "account",
    "password", "passwd", "passwrd", "credential", "wp-login", "xmlrpc", "mfa", "otp", "2fa", "verify",
)
COMPRESSIBLE = (".js", ".css", ".html", ".json", ".svg", ".xml", ".txt")


def any_of(words: tuple[str, ...]) -> str:
    """Case-insensitive pattern that finds any of ``words``."""
    return "(?i)" + "|".join(w.replace(".", "[.]") for w in words)


PROBE, AUTH, BOT, COMPRESS = any_of(PROBE_PATHS), any_of(AUTH_PATHS), any_of(BOT_TOKENS), any_of(COMPRESSIBLE)
_IMAGE = (
    "(label ILIKE '%.jpg%' OR label ILIKE '%.jpeg%' OR label ILIKE '%.png%' OR label ILIKE '%.gif%') AND label NOT ILIKE '%auto=webp%' "
    "AND label NOT ILIKE '%format=auto%' AND label NOT ILIKE '%format=webp%' AND label NOT ILIKE '%format=avif%'"
)
#: Columns of the log that detections use.
LOG_COLUMNS = (
    "timestamp", "url", "status", "cache", "elapsed", "city", "region", "country", "ttl", "hits", "age", "ost", "oretries", "oip", "ua", "asn", "referer", "method", "p_type", "c_type", "c_speed",
    "pop", "server_region", "metro", "tcp_rtt", "resp_bytes", "transport", "resp_header_content_encoding", "oconnect_ms", "ottfb", "ploss", "rtt_var", "retrans", "delivery_rate", "ip", "ja4",
    "tls_ciphers_sha", "req_header_bytes", "conn_requests", "cookie_session", "waf_sig", "rid", "prid", "edge", "lat", "lon",
)
MOBILE = "(ua ILIKE '%Mobi%' OR ua ILIKE '%Android%' OR ua ILIKE '%iPhone%')"
_SCALE = {"window_hours": WINDOW_HOURS, "baseline_hours": BASELINE_HOURS}
_SCALED = "coalesce({b}, 0) / greatest({{baseline_hours}}, 1.0) * {{window_hours}}"


def _scaled(b: str) -> str:
    """The baseline count, scaled to the length of the window."""
    return _SCALED.format(b=b)


_CARD = ("label", "current_val", "baseline_val", "unit", "severity")


class Card(NamedTuple):
    """What a detection shows of a label, and its severity: critical, else warning, else info."""

    current: str
    baseline: str
    unit: str
    critical: str = "false"
    warning: str = "true"

    def columns(self) -> dict[str, str]:
        return {
            "current_val": f"round(CAST({self.current} AS DOUBLE), 4)",
            "baseline_val": f"round(CAST({self.baseline} AS DOUBLE), 4)",
            "unit": f"'{self.unit}'",
            "severity": f"CASE WHEN {self.critical} THEN 'critical' WHEN {self.warning} THEN 'warning' ELSE 'info' END",
        }


_RATES, _SHARES, _SLOWER = ("w_rate * 100", "coalesce(b_rate, 0) * 100"), ("w_share * 100", "coalesce(b_share, 0) * 100"), ("w_p", "coalesce(b_p, 0)")
#: The phase that got slower by more is shown.
_CONNECT = "(w_conn >= b_conn * 2 AND w_conn - b_conn >= 50 AND (NOT (w_read >= b_read * 2 AND w_read - b_read >= 100) OR w_conn - b_conn >= w_read - b_read))"
_REGULARITY = "bround(100 * (0.625D * (1 - least(cv_corr, 1.0D)) + 0.375D * modal_frac))"
_MBPS = "round({} * 8 / 1e6, 1)"

# Units and severity thresholds.
CARDS: dict[str, Card] = {
    "error_spikes": Card(*_RATES, "% 5xx", "w_rate >= 0.5"),
    "city_error_spikes": Card(*_RATES, "% error", "w_rate >= 0.5"),
    "cache_collapse": Card(*_RATES, "% HIT", "w_rate <= 0.10 AND b_rate >= 0.60"),
    "cacheability_regression": Card(*_RATES, "% PASS", "w_rate >= 0.80 AND b_rate <= 0.10"),
    "cache_ttl_mismatch": Card("avg_hits", "NULL", "avg hits"),
    "origin_error_rate": Card("round(w_cnt * 100.0 / w_total, 1)", "NULL", "%", "w_5xx * 100.0 / w_total > 5"),
    "origin_retries": Card("avg_retries", "NULL", "avg retries"),
    "origin_ip_failure": Card("error_pct", "round(median_rate, 1)", "% errors", "error_pct > 20"),
    "cache_hit_cliff": Card("round(w_rate * 100, 1)", "round(b_rate * 100, 1)", "% HIT", "round(b_rate * 100, 1) - round(w_rate * 100, 1) >= 30"),
    "new_country_traffic": Card("w_cnt", "0", "requests", warning="w_cnt >= 10"),
    "city_surges": Card("w_cnt", _scaled("b_cnt"), "requests", warning="spike_ratio >= 10"),
    "new_city_traffic": Card("w_cnt", "0", "requests", warning="w_cnt >= 50"),
    "ua_monoculture": Card(*_SHARES, "% of traffic", "w_share * 100 >= 50"),
    "asn_concentration": Card(*_SHARES, "% of traffic", "w_share * 100 >= 50"),
    "referer_monoculture": Card(*_SHARES, "% of traffic", "w_share * 100 >= 50"),
    "method_drift": Card(*_SHARES, "% of traffic", "w_share * 100 >= 25"),
    "new_asn_traffic": Card("w_cnt", "0", "requests", warning="w_cnt >= 100"),
    "asn_hosting_shift": Card("round(w_rate * 100, 1)", "round(coalesce(b_rate, 0) * 100, 1)", "% hosting", "round(w_rate * 100, 1) >= 60"),
    "connection_type_mix": Card(*_SHARES, "% of typed traffic"),
    "latency_regression": Card(*_SLOWER, "ms (P95)", "w_p >= 5000"),
    "pop_latency_regression": Card(*_SLOWER, "ms (P95)", "w_p >= 5000"),
    "city_latency_regressions": Card(*_SLOWER, "ms (P95)", "w_p >= 5000"),
    "region_latency": Card(*_SLOWER, "ms (P95)", "w_p >= 5000"),
    "asn_metro_performance": Card(*_SLOWER, "ms RTT", "w_p >= b_p + 100"),
    "tail_latency": Card("p99_ms", "p50_ms", "ms (P99 vs P50)", "ratio > 10"),
    "image_optimization_opportunities": Card(
        "avg_kb", "NULL", "KB avg", "total_bytes > 10 * 1024 * 1024 OR avg_kb > 1024", "total_bytes > 2 * 1024 * 1024 OR mobile_ratio > 0.5"
    ),
    "origin_latency_spike": Card("p95_ms", "round(b_p95, 1)", "ms P95", "p95_ms > b_p95 * 5"),
    "shield_path_degradation": Card("w_p50", "b_p50", "ms P50", "ratio >= 3"),
    "network_asn_health": Card("round(coalesce(w_ploss, 0) * 100, 2)", "round(coalesce(b_ploss, 0) * 100, 2)", "% packet loss", "w_ploss >= 0.05"),
    "metro_delivery_degradation": Card(
        _MBPS.format("w_med"), _MBPS.format("b_med"), "Mbps (median)", f"{_MBPS.format('b_med')} > 0 AND {_MBPS.format('w_med')} <= {_MBPS.format('b_med')} * 0.25"
    ),
    "http3_fallback": Card("round(w_rate * 100, 1)", "round(b_rate * 100, 1)", "% QUIC", "round(b_rate * 100, 1) - round(w_rate * 100, 1) >= 40"),
    "payload_compression_regression": Card(*_RATES, "% uncompressed", "w_rate >= 0.90"),
    "timeout_split": Card(
        f"round(CASE WHEN {_CONNECT} THEN w_conn ELSE w_read END, 1)", f"round(CASE WHEN {_CONNECT} THEN b_conn ELSE b_read END, 1)", "ms (P95)",
        f"CASE WHEN {_CONNECT} THEN round(b_conn, 1) > 0 AND round(w_conn, 1) >= round(b_conn, 1) * 3 ELSE round(b_read, 1) > 0 AND round(w_read, 1) >= round(b_read, 1) * 3 END",
    ),
    "botnet_grouping": Card("w_ips", "b_ips", "distinct IPs", "w_ips >= 50"),
    "cipher_spread": Card("w_ips", f"round({_scaled('b_ips')}, 1)", "distinct IPs", "w_ips >= 50"),
    "new_probe_urls": Card("w_cnt", "NULL", "requests", "w_cnt >= 5"),
    "waf_signal_spikes": Card("w_cnt", _scaled("b_cnt"), "hits", "spike_ratio >= 10"),
    "proxy_surge": Card("round(w_cnt * 100.0 / greatest(w_all, 1), 1)", "NULL", "% of traffic"),
    "request_size_anomaly": Card("max_val", "floor(round(b_p95, 6))", "bytes (max header)", "max_val > 64000"),
    "connection_abuse": Card("max_val", "floor(round(b_p95, 6))", "reqs/conn (max)", "max_val > 500"),
    "impossible_distance": Card("round(max_dist_km, 0)", "round(min_allowed_km, 0)", "km", "worst_excess_km > 5000"),
    "repeated_patterns": Card("avg_interval", "stddev", "s interval", f"{_REGULARITY} >= 90 AND n_events >= 30", f"{_REGULARITY} >= 70"),
    "repeated_patterns_fp": Card("avg_interval", "stddev", "s interval", f"{_REGULARITY} >= 90 AND n_events >= 30", f"{_REGULARITY} >= 70"),
    "low_and_slow": Card("distinct_paths", "NULL", "sensitive paths", "distinct_paths >= 10"),
    "credential_enumeration": Card("w_denied", "b_denied", "denied (401/403)", "w_denied >= 100"),
    "content_discovery": Card("w_404", "b_404", "404s", "w_404 >= 100"),
    "session_harvesting": Card("w_sessions", "b_sessions", "distinct sessions", "w_sessions >= 100"),
    "stale_browser_version": Card("w_reqs", "w_ips", "requests", "surge_ratio >= 5"),
    "orphaned_deep_crawl": Card("w_reqs", "b_reqs", "requests", "w_reqs / greatest(w_distinct_urls, 1.0) >= 20"),
    "residential_fingerprint_dispersion": Card("w_asns", "b_ips", "ASNs", "asn_ratio >= 3"),
    "crawler_disparity": Card(
        "crawls_per_referral", "baseline_crawls_per_referral", "crawls/referral",
        "crawls_per_referral >= 5000 OR w_bytes >= 500000000 OR (bandwidth_share_pct >= 10 AND w_referrals = 0)",
    ),
}


def _shown(name: str, found: DataFrame, window_hours: float = WINDOW_HOURS, baseline_hours: float = BASELINE_HOURS) -> DataFrame:
    """``found`` (label and measures) with what its card shows in front."""
    fill = lambda e: e.replace("{window_hours}", str(window_hours)).replace("{baseline_hours}", str(baseline_hours))
    rest = [c for c in found.columns if c != "label"]
    return found.select("label", *[F.expr(fill(e)).alias(n) for n, e in CARDS[name].columns().items()], *rest)


def _detection(keys: str, measures: dict, **rest) -> Report:
    """A report by ``label``; its card is added by name."""
    params = {**_SCALE, **rest.pop("params", {})}
    columns = [*_CARD, *measures]
    return Report(keys={"label": keys}, measures=measures, params=params, columns=columns, **rest)


def _rate(hit: str, base: str = "true") -> dict[str, str]:
    w, b = (f"count(*) FILTER (WHERE is_{s} AND {base} AND {hit}) * 1.0 / nullif(count(*) FILTER (WHERE is_{s} AND {base}), 0)" for s in "wb")
    return {"w_rate": f"CAST({w} AS DOUBLE)", "b_rate": f"CAST({b} AS DOUBLE)", "w_total": count_if(f"is_w AND {base}"), "b_total": count_if(f"is_b AND {base}")}


def _counts(column: str = "label") -> dict[str, str]:
    return {"w_cnt": count_if("is_w"), "b_cnt": count_if("is_b")}


def new_values(column: str, least: int, limit: int = 20, where: str = "") -> Report:
    """Values that the baseline never saw."""
    return _detection(
        f"CAST({column} AS STRING)", _counts(),
        where=where or f"{column} IS NOT NULL", having="w_cnt >= {least} AND b_cnt = 0", order=["-w_cnt"], limit=limit, params={"least": least},
    )


def share_of_traffic(column: str, floor: float, where: str = "true", factor: float = 3, plus: float = 0.10, least: int = 0, limit: int = 10, having: str = "true") -> Report:
    """Values whose share of the window reaches ``floor`` and ``factor`` times their baseline share plus ``plus``."""
    totals = {"w_total": "CAST(coalesce(sum(w_cnt), 0) AS BIGINT)", "b_total": "CAST(coalesce(sum(b_cnt), 0) AS BIGINT)"}
    shares = {"w_share": "CAST(w_cnt * 1.0 / nullif(w_total, 0) AS DOUBLE)", "b_share": "CAST(b_cnt * 1.0 / nullif(b_total, 0) AS DOUBLE)"}
    r = _detection(
        f"CAST({column} AS STRING)", _counts(), totals=totals, derived=shares,
        having=f"w_total > 0 AND ({where}) AND ({having}) AND w_cnt >= {{least}} AND w_share >= {{floor}} AND (b_total = 0 OR w_share >= b_share * {{factor}} + {{plus}})",
        order=["-w_cnt"], limit=limit, params={"floor": floor, "factor": factor, "plus": plus, "least": least},
    )
    return replace(r, columns=[*_CARD, "w_cnt", "b_cnt", "w_total", "b_total"])


def p95_regression(column: str, min_w: int, min_b: int, ratio: float, plus_ms: float, where: str = "true", value: str = "elapsed", p: float = 0.95) -> Report:
    measures = {
        "w_p": f"{quantile(value, p, 'is_w')} / 1000.0", "b_p": f"{quantile(value, p, 'is_b')} / 1000.0", "w_total": count_if("is_w"), "b_total": count_if("is_b"),
    }
    return _detection(
        f"CAST({column} AS STRING)", measures, where=f"({where}) AND {value} IS NOT NULL",
        derived={"ratio": "w_p / nullif(b_p, 0)"}, order=["-ratio"], limit=15,
        having="w_total >= {min_w} AND b_total >= {min_b} AND w_p >= b_p * {ratio} AND w_p - b_p >= {plus_ms}",
        params={"min_w": min_w, "min_b": min_b, "ratio": ratio, "plus_ms": plus_ms},
    )


def ip_spread(column: str, least: int = 5, factor: float = 3) -> Report:
    """Fingerprints seen from many more addresses than before."""
    measures = {"w_ips": distinct("ip", "is_w"), "w_reqs": count_if("is_w"), "b_ips": distinct("ip", "is_b")}
    return _detection(
        column, measures, where=f"{column} IS NOT NULL AND {column} <> ''",
        derived={"ip_ratio": f"w_ips * 1.0 / greatest({_scaled('b_ips')}, 1)"}, order=["-ip_ratio"], limit=10,
        having=f"w_ips >= {{least}} AND w_ips > {_scaled('b_ips')} * {{factor}}", params={"least": least, "factor": factor},
    )


def ip_maximum(column: str, least_rows: int, least_max: int = 0) -> Report:
    """Addresses whose largest value exceeds three times their own baseline p95, in one conditional aggregate."""
    measures = {
        "max_val": f"max({column}) FILTER (WHERE is_w)", "avg_val": mean(column, "is_w"), "w_total": count_if("is_w"), "b_p95": quantile(column, 0.95, "is_b"),
    }
    return _detection(
        "ip", measures, where=f"{column} > 0", order=["-max_val"], limit=15,
        having="w_total >= {least_rows} AND max_val >= {least_max} AND max_val > b_p95 * {factor}",
        params={"least_rows": least_rows, "least_max": least_max, "factor": 3},
    )


_CITY = "city IS NOT NULL AND city <> ''"
_HIT, _CACHEABLE = "startswith(cache, 'HIT')", "(startswith(cache, 'HIT') OR startswith(cache, 'MISS'))"
_UNCOMPRESSED = "NOT regexp_like(lower(coalesce(resp_header_content_encoding, '')), 'gzip|br|zstd|deflate')"

_REPORTS: dict[str, Report] = {
    # Errors, cache and origin.
    "error_spikes": _detection(
        "url", {**_rate("status >= 500"), "w_errors": count_if("is_w AND status >= 500")},
        derived={"rise": "w_rate - coalesce(b_rate, 0)"}, order=["-rise"], limit=15, params={"least": 3, "floor": 0.05, "few": 10, "factor": 2, "plus": 0.05},
        having="w_total >= {least} AND w_rate >= {floor} AND (b_total < {few} OR w_rate >= b_rate * {factor} + {plus})",
    ),
    "city_error_spikes": _detection(
        "concat_ws(', ', city, region, country)", {**_rate("status >= 400"), "w_errors": count_if("is_w AND status >= 400")},
        where=_CITY, derived={"rise": "w_rate - coalesce(b_rate, 0)"}, order=["-rise"], limit=15, params={"least": 10, "floor": 0.10, "few": 50, "factor": 3, "plus": 0.05},
        having="w_total >= {least} AND w_rate >= {floor} AND (b_total < {few} OR w_rate >= b_rate * {factor} + {plus})",
    ),
    "cache_collapse": _detection(
        "url", _rate(_HIT, _CACHEABLE), derived={"drop_by": "coalesce(b_rate, 0) - w_rate"}, order=["-drop_by"], limit=15,
        having="w_total >= 5 AND b_total >= 20 AND b_rate >= {b_floor} AND w_rate <= b_rate - {points} AND w_rate <= b_rate * {factor}", params={"b_floor": 0.40, "points": 0.20, "factor": 0.6},
    ),
    "cacheability_regression": _detection(
        "url", _rate("startswith(cache, 'PASS')"), derived={"rise": "w_rate - coalesce(b_rate, 0)"}, order=["-rise"], limit=15,
        having="w_total >= {min_w} AND b_total >= {min_b} AND b_rate <= {b_top} AND w_rate >= {w_floor} AND w_rate >= b_rate + {points}",
        params={"min_w": 10, "min_b": 50, "b_top": 0.20, "w_floor": 0.50, "points": 0.30},
    ),
    "cache_ttl_mismatch": _detection(
        "url", {"avg_ttl": "round(avg(ttl), 0)", "avg_hits": "round(avg(hits), 1)", "avg_age": "round(avg(age), 0)", "sample_count": "count(*)", "raw_hits": "avg(hits)", "raw_ttl": "avg(ttl)"}, where="is_w AND ttl IS NOT NULL AND ttl > 0 AND hits IS NOT NULL AND age IS NOT NULL",
        having="sample_count >= 10 AND raw_hits < {hits} AND raw_ttl > {ttl}", order=["-raw_ttl"], limit=20, params={"hits": 2, "ttl": 60},
    ),
    "origin_error_rate": replace(
        _detection(
            "CAST(ost AS STRING)", {"w_cnt": count_if("is_w"), "b_cnt": count_if("is_b"), "bad": "max(CASE WHEN ost >= 500 THEN 1 ELSE 0 END)"},
            where="ost IS NOT NULL",
            totals={"w_total": "CAST(sum(w_cnt) AS BIGINT)", "b_total": "CAST(sum(b_cnt) AS BIGINT)", "w_5xx": "CAST(sum(w_cnt * bad) AS BIGINT)", "b_5xx": "CAST(sum(b_cnt * bad) AS BIGINT)"},
            having="bad = 1 AND w_cnt > 0 AND w_5xx * 100.0 / nullif(w_total, 0) >= {floor} AND w_5xx * 100.0 / nullif(w_total, 0) > b_5xx * 100.0 / nullif(b_total, 0) * {factor}", params={"floor": 1.0, "factor": 2},
        ),
        columns=[*_CARD, "w_cnt", "w_total", "b_total", "w_5xx", "b_5xx"],
    ),
    "origin_retries": _detection(
        "url", {"requests": "count(*)", "avg_retries": "round(avg(oretries), 2)", "max_retries": "max(oretries)"},
        where="is_w AND oretries > 0", having="requests >= {least}", order=["-avg_retries"], limit=10, params={"least": 5},
    ),
    "origin_ip_failure": replace(
        _detection(
            "oip", {"requests": "count(*)", "error_pct": f"round({count_if('ost >= 500')} * 100.0 / nullif(count(*), 0), 1)"},
            where="is_w AND oip IS NOT NULL AND oip <> '' AND ost IS NOT NULL",
            totals={"median_rate": "percentile(CAST(error_pct AS DOUBLE), 0.5) FILTER (WHERE requests >= 10)"}, having="requests >= 10 AND error_pct > median_rate * {factor} AND error_pct > {floor}", params={"factor": 3, "floor": 5},
        ),
        columns=[*_CARD, "requests"],
    ),
    "cache_hit_cliff": _detection(
        "'service'", _rate(_HIT, _CACHEABLE), params={"b_floor": 0.40, "points": 0.15},
        having="w_total >= 100 AND b_total >= 200 AND b_rate >= {b_floor} AND w_rate <= b_rate - {points}",
    ),
    # Traffic.
    "new_country_traffic": new_values("country", 3),
    "city_surges": _detection(
        "concat_ws(', ', city, region, country)", _counts(), where=_CITY, derived={"spike_ratio": f"w_cnt * 1.0 / greatest({_scaled('b_cnt')}, 1.0)"},
        having=f"w_cnt >= {{least}} AND w_cnt > {_scaled('b_cnt')} * {{factor}}", order=["-spike_ratio"], limit=15, params={"least": 20, "factor": 3},
    ),
    "new_city_traffic": replace(new_values("city", 5), keys={"label": "concat_ws(', ', city, region, country)"}, where=_CITY),
    "ua_monoculture": share_of_traffic("ua", 0.25),
    "asn_concentration": share_of_traffic("asn", 0.20, "label IS NOT NULL"),
    "referer_monoculture": share_of_traffic("referer", 0.20, "label IS NOT NULL AND label <> ''"),
    "method_drift": share_of_traffic("method", 0.10, "label IS NOT NULL AND label <> '' AND upper(label) NOT IN ('GET', 'HEAD', 'OPTIONS')", 2, 0.05, 20),
    "new_asn_traffic": new_values("asn", 20),
    "asn_hosting_shift": _detection(
        "CAST(asn AS STRING)", {**_rate("p_type = 'hosting'"), "w_hosting": count_if("is_w AND p_type = 'hosting'")},
        where="asn IS NOT NULL AND p_type IS NOT NULL AND p_type <> ''", order=["-w_hosting"], limit=15, params={"least": 50, "floor": 0.3, "factor": 3, "plus": 0.10},
        having="w_total >= {least} AND w_rate >= {floor} AND (b_total = 0 OR w_rate >= b_rate * {factor} + {plus})",
    ),
    "connection_type_mix": replace(share_of_traffic("concat_ws('/', c_type, c_speed)", 0.15, "true", 2, 0.05, 20, 15), where="c_type IS NOT NULL AND c_type <> ''"),
    # Performance.
    "latency_regression": p95_regression("url", 5, 20, 2.0, 200),
    "pop_latency_regression": p95_regression("pop", 20, 50, 1.5, 100, "pop IS NOT NULL AND pop <> ''"),
    "city_latency_regressions": p95_regression("concat_ws(', ', city, region, country)", 10, 50, 3.0, 500, _CITY),
    "region_latency": p95_regression("server_region", 20, 50, 1.5, 100, "server_region <> ''"),
    "asn_metro_performance": p95_regression("concat_ws('/', CAST(asn AS STRING), CAST(metro AS STRING))", 20, 50, 1.5, 20, "asn IS NOT NULL AND metro IS NOT NULL AND tcp_rtt > 0 AND country = 'US'", "tcp_rtt", 0.5),
    "tail_latency": _detection(
        "url", {"p99_ms": f"round({quantile('elapsed', 0.99)} / 1000.0, 0)", "p50_ms": f"round({quantile('elapsed', 0.5)} / 1000.0, 0)", "ratio": f"round({quantile('elapsed', 0.99)} / nullif({quantile('elapsed', 0.5)}, 0), 1)", "total": "count(*)"}, where="is_w AND elapsed IS NOT NULL", having="total >= {least} AND ratio > {ratio_floor}", order=["-ratio"], limit=15, params={"least": 20, "ratio_floor": 5},
    ),
    "image_optimization_opportunities": _detection(
        "url", {"request_count": "count(*)", "total_bytes": total("resp_bytes"), "avg_kb": "round(avg(resp_bytes) / 1024, 1)", "mobile_ratio": f"round(avg(CASE WHEN {MOBILE} THEN 1.0 ELSE 0.0 END), 4)"}, where="is_w AND status = 200", key_where=_IMAGE, having="total_bytes > {floor}", order=["-total_bytes"], limit=15, params={"floor": 1024 * 512},
    ),
    "http3_fallback": _detection(
        "'service'", _rate("transport = 'quic'"), where="transport IS NOT NULL AND transport <> ''",
        having="w_total >= 100 AND b_total >= 100 AND b_rate >= {b_floor} AND w_rate <= b_rate - {points}", params={"b_floor": 0.30, "points": 0.20},
    ),
    "payload_compression_regression": _detection(
        "url", _rate(_UNCOMPRESSED), where="status = 200 AND resp_bytes >= 1024", key_where=f"regexp_like(label, '{COMPRESS}')",
        derived={"rise": "w_rate - coalesce(b_rate, 0)"}, order=["-rise"], limit=15, having="w_total >= {min_w} AND b_total >= {min_b} AND b_rate <= 0.20 AND w_rate >= 0.50 AND w_rate >= b_rate + 0.30", params={"min_w": 10, "min_b": 50},
    ),
    "timeout_split": _detection(
        "'service'",
        {"w_conn": quantile("oconnect_ms", 0.95, "is_w"), "b_conn": quantile("oconnect_ms", 0.95, "is_b"), "w_read": quantile("greatest(ottfb / 1000.0 - oconnect_ms, 0)", 0.95, "is_w"), "b_read": quantile("greatest(ottfb / 1000.0 - oconnect_ms, 0)", 0.95, "is_b"), "w_total": count_if("is_w"), "b_total": count_if("is_b")}, where="oconnect_ms IS NOT NULL AND ottfb IS NOT NULL",
        having="w_total >= 50 AND b_total >= 100 AND ((w_conn >= b_conn * 2 AND w_conn - b_conn >= {connect_ms}) OR (w_read >= b_read * 2 AND w_read - b_read >= {read_ms}))", params={"connect_ms": 50, "read_ms": 100},
    ),
    "network_asn_health": _detection(
        "CAST(asn AS STRING)",
        {f"{s}_{n}": e.format(s=s) for n, e in {"ploss": "round(avg(ploss) FILTER (WHERE is_{s}), 6)", "jitter": "percentile(rtt_var, 0.95) FILTER (WHERE is_{s})", "retrans": "avg(retrans) FILTER (WHERE is_{s})", "total": "count(*) FILTER (WHERE is_{s})"}.items() for s in "wb"}, where="asn IS NOT NULL", order=["-w_ploss", "-w_jitter"], limit=15, params={"min_w": 50, "min_b": 100},
        having="w_total >= {min_w} AND b_total >= {min_b} AND ((coalesce(w_ploss, 0) >= 0.02 AND coalesce(w_ploss, 0) >= coalesce(b_ploss, 0) * 2 + 0.005) OR (w_jitter >= b_jitter * 2 AND w_jitter - b_jitter >= 20000) OR coalesce(w_retrans, 0) >= coalesce(b_retrans, 0) * 2 + 0.5)",
    ),
    "metro_delivery_degradation": _detection(
        "CAST(metro AS STRING)", {"w_med": quantile("delivery_rate", 0.5, "is_w"), "b_med": quantile("delivery_rate", 0.5, "is_b"), "w_total": count_if("is_w"), "b_total": count_if("is_b")},
        where="metro IS NOT NULL AND delivery_rate > 0", derived={"drop_by": "b_med - w_med"}, order=["-drop_by"], limit=15, having="w_total >= 20 AND b_total >= 50 AND w_med > 0 AND b_med > 0 AND w_med <= b_med * {factor}", params={"factor": 0.5},
    ),
    # Security.
    "botnet_grouping": ip_spread("ja4"),
    "cipher_spread": ip_spread("tls_ciphers_sha"),
    "new_probe_urls": _detection(
        "url", {**_counts(), "w_error_pct": f"CAST({count_if('is_w AND status >= 400')} * 100.0 / nullif({count_if('is_w')}, 0) AS DOUBLE)"},
        where="url IS NOT NULL", key_where=f"regexp_like(label, '{PROBE}')", having="w_cnt > 0 AND b_cnt = 0", order=["-w_cnt"], limit=25,
    ),
    "request_size_anomaly": ip_maximum("req_header_bytes", 3),
    "connection_abuse": ip_maximum("conn_requests", 5, 50),
    "low_and_slow": _detection(
        "ip", {"hits": "count(*)", "distinct_paths": distinct("url"), "span_s": "max(sec) - min(sec)"},
        where=f"ip IS NOT NULL AND ip <> '' AND url IS NOT NULL AND regexp_like(url, '{PROBE}')", derived={"rps": "round(hits * 1.0 / nullif(span_s, 0), 5)"},
        having="hits >= {hits_floor} AND distinct_paths >= {paths_floor} AND span_s >= 600 AND hits * 1.0 / nullif(span_s, 0) < 0.2", order=["-distinct_paths", "-span_s"], limit=15,
        params={"hits_floor": 5, "paths_floor": 3},
    ),
    "credential_enumeration": _detection(
        "ip", {"w_denied": count_if("is_w AND status IN (401, 403)"), "w_attempts": count_if("is_w"), "w_paths": distinct("url", "is_w"), "b_denied": count_if("is_b AND status IN (401, 403)")},
        where=f"ip IS NOT NULL AND ip <> '' AND url IS NOT NULL AND regexp_like(url, '{AUTH}')", order=["-w_denied"], limit=15, params={"least": 20, "share": 0.5, "plus": 5},
        having=f"w_denied >= {{least}} AND w_denied * 1.0 / nullif(w_attempts, 0) >= {{share}} AND w_denied > {_scaled('b_denied')} * 3 + {{plus}}",
    ),
    "content_discovery": _detection(
        "ip", {"w_404": count_if("is_w AND status = 404"), "w_total": count_if("is_w"), "w_distinct_404": distinct("url", "is_w AND status = 404"), "b_404": count_if("is_b AND status = 404")},
        where="ip IS NOT NULL AND ip <> '' AND url IS NOT NULL", order=["-w_404"], limit=15, params={"least": 20, "share": 0.7, "urls": 15},
        having="w_404 >= {least} AND w_404 * 1.0 / nullif(w_total, 0) >= {share} AND w_distinct_404 >= {urls}",
    ),
    "session_harvesting": _detection(
        "ip", {"w_sessions": distinct("cookie_session", "is_w"), "w_reqs": count_if("is_w"), "b_sessions": distinct("cookie_session", "is_b")},
        where="ip IS NOT NULL AND ip <> '' AND cookie_session IS NOT NULL AND cookie_session <> ''", having="w_sessions >= {least} AND w_sessions > coalesce(b_sessions, 0) * 2 + 10", order=["-w_sessions"], limit=15, params={"least": 20},
    ),
    "stale_browser_version": _detection(
        "concat('Chrome ', regexp_extract(ua, 'Chrome/([0-9]+)[.]', 1))", {"w_reqs": count_if("is_w"), "w_ips": distinct("ip", "is_w"), "b_reqs": count_if("is_b")},
        where="ua IS NOT NULL AND contains(lower(ua), 'chrome') AND NOT contains(lower(ua), 'bot') AND NOT contains(lower(ua), 'crawler') AND NOT contains(lower(ua), 'spider') AND CAST(nullif(regexp_extract(ua, 'Chrome/([0-9]+)[.]', 1), '') AS INT) < {newest}",
        derived={"surge_ratio": f"w_reqs * 1.0 / greatest({_scaled('b_reqs')}, 1.0)"}, having=f"w_reqs >= {{least}} AND w_reqs > {_scaled('b_reqs')} * {{factor}}", order=["-surge_ratio"], limit=10, params={"newest": 131, "least": 500, "factor": 2.5},
    ),
    "orphaned_deep_crawl": _detection(
        "ip", {"w_reqs": count_if("is_w"), "w_distinct_urls": distinct("url", "is_w"), "b_reqs": count_if("is_b")},
        where="url LIKE '/%/%/%' AND url NOT LIKE '%.%' AND (referer IS NULL OR referer = '' OR referer = '-')", having="w_reqs >= {least} AND w_distinct_urls >= {urls}", order=["-w_reqs"], limit=15, params={"least": 50, "urls": 10},
    ),
    "residential_fingerprint_dispersion": _detection(
        "ja4", {"w_ips": distinct("ip", "is_w"), "w_asns": distinct("asn", "is_w"), "w_requests": count_if("is_w"), "b_ips": distinct("ip", "is_b"), "b_asns": distinct("asn", "is_b")},
        where="ja4 IS NOT NULL AND ja4 <> '' AND (p_type IS NULL OR p_type <> 'hosting')", derived={"asn_ratio": "w_asns * 1.0 / greatest(coalesce(b_asns, 0), 1.0)"}, having="w_ips >= {ips} AND w_asns >= {asns}", order=["-asn_ratio"], limit=10, params={"ips": 30, "asns": 5},
    ),
    "proxy_surge": replace(
        _detection(
            "p_type", _counts(), where="p_type IS NOT NULL", params={"floor": 5, "factor": 2, "plus": 5},
            totals={"w_all": "CAST(sum(w_cnt) AS BIGINT)", "b_all": "CAST(sum(b_cnt) AS BIGINT)", "w_proxy": "CAST(coalesce(sum(w_cnt) FILTER (WHERE label <> ''), 0) AS BIGINT)", "b_proxy": "CAST(coalesce(sum(b_cnt) FILTER (WHERE label <> ''), 0) AS BIGINT)"},
            having="label <> '' AND w_proxy * 100.0 / nullif(w_all, 0) >= {floor} AND w_proxy * 100.0 / nullif(w_all, 0) >= b_proxy * 100.0 / nullif(b_all, 0) * {factor} + {plus}",
        ),
        columns=[*_CARD, "w_cnt", "b_cnt", "w_all", "b_all"],
    ),
}


DETECTIONS = {name: replace(r, derived={**r.derived, **CARDS[name].columns()}) for name, r in _REPORTS.items()}


def detect(name: str, logs: DataFrame, **thresholds: object) -> DataFrame:
    """One of :data:`DETECTIONS` over ``logs``; ``window_hours``, ``baseline_hours`` and thresholds may be given."""
    if name == "low_and_slow":
        logs = logs.withColumn("sec", F.expr("CAST(round(unix_micros(CAST(timestamp AS TIMESTAMP)) / 1e6) AS BIGINT)"))
    return DETECTIONS[name].frame(logs, **thresholds)


def waf_signal_spikes(logs: DataFrame, window_hours: float = WINDOW_HOURS, baseline_hours: float = BASELINE_HOURS) -> DataFrame:
    """Signals of the comma-separated ``waf_sig`` that more than double; combinations are counted before they are split."""
    combos = logs.filter("waf_sig IS NOT NULL AND waf_sig <> ''").groupBy("waf_sig").agg(F.count_if("is_w").alias("w"), F.count_if("is_b").alias("b"))
    return waf_signals(combos, window_hours, baseline_hours)


def waf_signals(combos: DataFrame, window_hours: float, baseline_hours: float) -> DataFrame:
    """:func:`waf_signal_spikes` from counted combinations (waf_sig, w, b)."""
    signals = combos.select(F.explode(F.split("waf_sig", ",")).alias("s"), "w", "b").select(F.trim("s").alias("label"), "w", "b")
    out = signals.filter("label <> '' AND label <> 'BOT-ANALYSIS'").groupBy("label").agg(F.sum("w").alias("w_cnt"), F.sum("b").alias("b_cnt"))
    scaled = F.col("b_cnt") / F.lit(float(baseline_hours)) * F.lit(float(window_hours))
    out = out.filter((F.col("w_cnt") >= 3) & (F.col("w_cnt") > scaled * 2 + 2))
    out = out.withColumn("spike_ratio", F.round(F.col("w_cnt") / F.greatest(scaled, F.lit(0.5)), 4)).orderBy(F.desc("spike_ratio"), "label").limit(15)
    return _shown("waf_signal_spikes", out, window_hours, baseline_hours)


#: Slowest p95 of the origin by URL, and of all of it.
ORIGIN_P95_URL = {"requests": "count(*)", "p95_ms": "round(percentile(ottfb, 0.95) / 1000.0, 1)"}
ORIGIN_P95 = {"w_p95": f"{quantile('ottfb', 0.95, 'is_w')} / 1000.0", "b_p95": f"{quantile('ottfb', 0.95, 'is_b')} / 1000.0"}


def origin_latency_spike(logs: DataFrame) -> DataFrame:
    """The slowest URLs, where the overall origin p95 has more than doubled."""
    rows = logs.filter("ottfb IS NOT NULL")
    overall = rows.agg(*[F.expr(e).alias(n) for n, e in ORIGIN_P95.items()])
    urls = rows.filter("is_w").groupBy(F.col("url").alias("label")).agg(*[F.expr(e).alias(n) for n, e in ORIGIN_P95_URL.items()])
    return slow_origin_urls(urls, overall)


def slow_origin_urls(urls: DataFrame, overall: DataFrame) -> DataFrame:
    """:func:`origin_latency_spike` from its two aggregates."""
    out = urls.filter("requests >= 10").crossJoin(F.broadcast(overall.filter("w_p95 > b_p95 * 2")))
    return _shown("origin_latency_spike", out.orderBy(F.desc("p95_ms"), "label").limit(10))


def shield_path_degradation(logs: DataFrame) -> DataFrame:
    """Routes from edge to shield whose median transit grew by half; without a shield leg the route goes to the origin."""
    rows = logs.filter("ottfb IS NOT NULL")
    edge = rows.filter("edge").select("rid", F.col("pop").alias("edge_pop"), F.col("ottfb").alias("e"), "is_w", "is_b")
    shield = rows.filter("NOT edge AND prid IS NOT NULL AND prid <> ''").select(F.col("prid").alias("rid"), F.col("pop").alias("s_pop"), F.col("ottfb").alias("s"))
    both = edge.join(shield, "rid", "left").withColumn("transit", (F.col("e") - F.coalesce("s", F.lit(0))) / 1000.0)
    out = both.groupBy("edge_pop", F.coalesce("s_pop", F.lit("Direct to Origin")).alias("shield_pop")).agg(
        F.expr("percentile(transit, 0.5) FILTER (WHERE is_w)").alias("w_p50"), F.expr("percentile(transit, 0.5) FILTER (WHERE is_b)").alias("b_p50"), F.count_if("is_w").alias("w_cnt")
    )
    out = out.filter("w_cnt >= 5 AND w_p50 > b_p50 * 1.5").withColumn("ratio", F.expr("w_p50 / nullif(b_p50, 0)"))
    out = out.orderBy(F.desc_nulls_last("ratio"), "edge_pop", "shield_pop").limit(20)
    return _shown("shield_path_degradation", out.withColumn("label", F.concat_ws(" → ", "edge_pop", "shield_pop"))).drop("ratio")


_FAR = "2 * 6371 * asin(sqrt(power(sin(radians(lat - pop_lat) / 2), 2) + cos(radians(lat)) * cos(radians(pop_lat)) * power(sin(radians(lon - pop_lon) / 2), 2)))"
DISTANCE, REACH = f"round({_FAR}, 1)", "round(CAST(tcp_rtt AS DOUBLE) / 2.0 / 1e6 * 200000 * 2, 1)"
TOO_FAR = "is_w AND lat IS NOT NULL AND lon IS NOT NULL AND tcp_rtt > 0 AND ja4 IS NOT NULL AND ja4 <> '' AND distance_km > max_km"
EXCESS = {"hits": "count(*)", "worst_excess_km": "round(max(distance_km - max_km), 1)", "max_dist_km": "max(distance_km)", "min_allowed_km": "min(max_km)"}


def impossible_distance(logs: DataFrame, pops: DataFrame) -> DataFrame:
    """Fingerprints seen further from the POP than light in fibre could have come in the measured round trip.

    ``pops`` (pop, pop_lat, pop_lon) is a fixed table of a few hundred sites.
    """
    rows = logs.join(F.broadcast(pops), "pop").withColumn("distance_km", F.expr(DISTANCE)).withColumn("max_km", F.expr(REACH))
    return far_clients(rows.filter(TOO_FAR).groupBy(F.col("ja4").alias("label")).agg(*[F.expr(e).alias(n) for n, e in EXCESS.items()]))


def far_clients(found: DataFrame) -> DataFrame:
    """:func:`impossible_distance` from its aggregate by fingerprint."""
    return _shown("impossible_distance", found.filter("hits >= 2").orderBy(F.desc("worst_excess_km"), "label").limit(15))


SECOND = "CAST(round(unix_micros(CAST(timestamp AS TIMESTAMP)) / 1e6) AS BIGINT)"


def client_seconds(logs: DataFrame, *columns: str) -> DataFrame:
    """Requests of the window by second and ``columns``, without those of known bots; agents are matched once counted."""
    cells = logs.filter("is_w").groupBy(*columns, "ua", F.expr(SECOND).alias("sec")).agg(F.count("*").alias("n"))
    return cells.filter(~F.coalesce(F.col("ua").rlike(BOT), F.lit(False)))


def repeated_patterns(logs: DataFrame, key: str = "ip", spread: str = "ua", min_gaps: int = 12) -> DataFrame:
    """Clients that come at regular intervals, known bots left out."""
    kept = client_seconds(logs.filter(f"{key} IS NOT NULL AND {key} <> ''"), *dict.fromkeys(c for c in (key, spread) if c != "ua"))
    return regular_clients(kept, key, spread, min_gaps)


def regular_clients(cells: DataFrame, key: str, spread: str, min_gaps: int = 12) -> DataFrame:
    """:func:`repeated_patterns` from :func:`client_seconds`."""
    kept = cells.filter(f"{key} IS NOT NULL AND {key} <> ''").select(F.col(key).alias("label"), F.col(spread).alias("d"), "sec", "n")
    meta = kept.groupBy("label").agg(F.countDistinct("d").alias("n_spread"), F.sum("n").alias("n_events"), (F.max("sec") - F.min("sec")).alias("span_s"))
    meta = meta.filter(f"n_events >= {min_gaps + 1} AND n_events * 1.0 / nullif(span_s, 0) < 2.0")
    seconds = kept.select("label", "sec").distinct()
    gaps = seconds.withColumn("gap", F.col("sec") - F.lag("sec").over(Window.partitionBy("label").orderBy("sec"))).filter("gap IS NOT NULL")
    sizes = gaps.groupBy("label", "gap").agg(F.count("*").alias("k"))
    # The smallest of the most frequent gaps.
    agg = sizes.groupBy("label").agg(
        F.sum("k").alias("n_gaps"), F.min(F.struct((-F.col("k")).alias("k"), "gap"))["gap"].alias("mode_gap"),
        F.sum(F.col("k") * F.col("gap")).alias("s1"), F.sum(F.col("k") * F.col("gap") * F.col("gap").cast("double")).alias("s2"),
    )
    agg = agg.filter(f"n_gaps >= {min_gaps}").withColumn("mean_gap", F.col("s1") / F.col("n_gaps"))
    agg = agg.withColumn("var_gap", (F.col("s2") - F.col("s1") * F.col("mean_gap")) / (F.col("n_gaps") - 1))
    modal = sizes.join(agg, "label").groupBy("label", "n_gaps", "mode_gap", "mean_gap", "var_gap").agg((F.sum(F.expr("CASE WHEN abs(gap - mode_gap) <= 1 THEN k ELSE 0 END")) / F.first("n_gaps")).alias("modal_frac"))
    out = modal.join(meta, "label").withColumn("cv", F.expr("sqrt(greatest(var_gap - 1.0D / 12.0D, 0)) / nullif(mean_gap, 0)"))
    out = out.filter("(mean_gap >= 5 AND cv < 0.3 AND modal_frac >= 0.6) OR (mean_gap >= 1 AND mean_gap < 5 AND modal_frac >= 0.85)")
    out = out.select(
        "label", "n_gaps", "n_events", F.round("mean_gap", 2).alias("avg_interval"), F.round(F.sqrt(F.greatest("var_gap", F.lit(0.0))), 2).alias("stddev"), F.round("cv", 3).alias("cv_corr"),
        F.round("modal_frac", 3).alias("modal_frac"), "n_spread", "span_s", "mode_gap",
    ).orderBy(F.desc("modal_frac"), F.desc("n_gaps"), "label").limit(15)
    return _shown("repeated_patterns", out)


def crawler_disparity(logs: DataFrame, min_crawls: int = 50) -> DataFrame:
    """Crawlers that take far more than the visitors they refer: crawls, referrals and bytes per referral.

    Crawlers are found on counted user agents; visitors are distinct (site, address) pairs of agents that are none.
    """
    uas = logs.groupBy("ua").agg(F.count_if("is_w").alias("w"), F.count_if("is_b").alias("b"), *[F.expr(f"coalesce(sum(resp_bytes) FILTER (WHERE is_{k}), 0)").alias(f"{k}b") for k in "wb"])
    return crawlers_and_visitors(uas, visitors(logs), min_crawls)


def visitors(logs: DataFrame) -> DataFrame:
    """Distinct (ref, ip, is_w) of agents that are no crawlers: the site, or the fetcher, that an address came from."""
    low = F.lower("ua")
    ref_dom = F.regexp_extract(F.lower("referer"), r"https?://(www\.)*([^/.:;\s]+)", 2)
    fetcher = F.regexp_extract(low, "([a-z0-9]+)-(user|externalfetcher)", 1)
    # Agents and referring pages are matched once counted.
    met = logs.filter("ip IS NOT NULL AND ua IS NOT NULL").select("ip", "ua", "referer", "is_w").distinct()
    people = met.filter(F.regexp_extract(low, CRAWLER, 1) == "")
    visits = people.select("ip", "is_w", F.coalesce(F.nullif(fetcher, F.lit("")), F.nullif(ref_dom, F.lit(""))).alias("ref"))
    return visits.filter("ref IS NOT NULL").select("ref", "ip", "is_w").distinct()


def crawlers_and_visitors(uas: DataFrame, seen: DataFrame, min_crawls: int = 50) -> DataFrame:
    """:func:`crawler_disparity` from counted agents (ua, w, b, wb, bb) and :func:`visitors`."""
    # Fixed value: the endings that are cut from a crawler's name to get its stem.
    suffix = "(-searchbot|-assistbot|-externalagent|-extended|-user|searchbot|assistbot|externalagent|extended|crawler|spider|slurp|archiver|scraper|preview|other|bot).*$"
    site = uas.agg(F.greatest(F.sum("wb"), F.lit(1)).alias("site_bytes"))
    low = F.lower("ua")
    info = uas.filter("ua IS NOT NULL").select("ua", "w", "b", "wb", "bb", F.regexp_extract(low, CRAWLER, 1).alias("tok"), F.regexp_extract(low, r"https?://(www\.)*([^/.:;\s)]+)", 2).alias("dom"))
    stem = F.expr("nullif(x, '')").alias("stem")
    crawlers = info.filter("tok <> ''").withColumn("x", F.regexp_replace("tok", suffix, "")).select("*", stem).groupBy(F.coalesce("stem", "tok").alias("bot_stem")).agg(
        F.expr("min(tok) FILTER (WHERE w > 0)").alias("label"), F.expr("max(dom) FILTER (WHERE w > 0)").alias("dom"), F.sum("w").alias("w_crawls"), F.sum("wb").alias("w_bytes"), F.sum("b").alias("b_crawls"), F.sum("bb").alias("b_bytes")
    ).filter(F.col("w_crawls") >= min_crawls)
    refs = seen.select("ref").distinct()
    bare = lambda c: F.regexp_replace(c, "[aeiou]", "")
    # Families and sites meet by equal keys: the name, the name without vowels, the domain, and, as one may contain the
    # other, each part of the longer name as long as the shorter (names have some ten letters, so some fifty parts).
    key = lambda kind, c, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), c.alias("key")))
    long = lambda c: F.length(c) >= 3
    parts = lambda c: F.flatten(F.transform(F.sequence(F.lit(3), F.greatest(F.length(c), F.lit(3))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.struct(F.lit("part").alias("kind"), F.substring(c, i, n).alias("key")))))
    stem_keys = [key("same", F.col("bot_stem"), F.lit(True)), key("bare", bare("bot_stem"), long(bare("bot_stem"))), key("same", F.col("dom"), F.col("dom") != ""), key("part", F.col("bot_stem"), long("bot_stem")), key("whole", F.col("bot_stem"), long("bot_stem"))]
    ref_keys = [key("same", F.col("ref"), F.lit(True)), key("bare", bare("ref"), F.lit(True)), key("whole", F.col("ref"), long("ref"))]
    within = lambda c, kind: F.when(long(c), F.transform(parts(F.col(c)), lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("key")))).otherwise(F.array())
    # A site's parts meet whole stems, a stem's parts meet whole sites.
    stems = crawlers.select("bot_stem", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*stem_keys)), within("bot_stem", "whole")))).alias("k"))
    sites = refs.select("ref", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*ref_keys)), within("ref", "part")))).alias("k"))
    met = stems.join(sites, "k").filter(F.col("k.kind").isin("same", "bare") | (F.contains("ref", "bot_stem") | F.contains("bot_stem", "ref")))
    pairs = met.select("bot_stem", "ref").distinct()
    referred = seen.join(pairs, "ref").groupBy("bot_stem").agg(*[F.expr(f"count(DISTINCT ip) FILTER (WHERE {c})").alias(f"{k}_referrals") for k, c in (("w", "is_w"), ("b", "NOT is_w"))])
    out = crawlers.join(referred, "bot_stem", "left").crossJoin(F.broadcast(site)).withColumns({f"{k}_referrals": F.coalesce(f"{k}_referrals", F.lit(0)) for k in "wb"})
    out = out.withColumn("crawls_per_referral", F.expr("round(w_crawls / greatest(w_referrals, 1), 4)")).withColumn("bytes_per_referral", F.expr("round(w_bytes / greatest(w_referrals, 1), 4)"))
    out = out.withColumn("baseline_crawls_per_referral", F.expr("round(b_crawls / greatest(b_referrals, 1), 4)")).withColumn("baseline_bytes_per_referral", F.expr("round(b_bytes / greatest(b_referrals, 1), 4)"))
    out = out.filter("w_referrals = 0 OR crawls_per_referral >= 100 OR bytes_per_referral >= 1048576").withColumn("bandwidth_share_pct", F.expr("round(w_bytes * 100.0 / site_bytes, 2)"))
    out = out.select("label", "w_crawls", "w_referrals", "w_bytes", "crawls_per_referral", "baseline_crawls_per_referral", "bytes_per_referral", "baseline_bytes_per_referral", F.col("bandwidth_share_pct").cast("double").alias("bandwidth_share_pct")).orderBy(F.desc("crawls_per_referral"), F.desc("w_bytes"), "label").limit(10)
    return _shown("crawler_disparity", out)
