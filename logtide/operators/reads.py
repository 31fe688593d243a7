"""The read library: dashboard, origin, network, performance, security, assets, value, streaming, RUM and scoring
reports over the request log, each a :class:`Report`."""

from __future__ import annotations

from ..plans.report import Report, count_if, distinct, mean, quantile, total

#: The four definitions of a cache hit; an operator names the one it uses and never mixes them.
HIT = {
    "hit_exact3": "cache IN ('HIT', 'HIT-STALE', 'HIT-CLUSTER')",
    "hit_prefix_ci": "cache ILIKE 'HIT%'",
    "hit_exact2": "cache IN ('HIT', 'HIT-STALE')",
    "hit_prefix": "startswith(cache, 'HIT')",
}
ORIGIN_LATENCY = "coalesce(ottfb, ttfb * 1000000)"
HOUR = "CAST(date_trunc('hour', timestamp) AS STRING)"
MINUTE = "CAST(date_trunc('minute', timestamp) AS STRING)"
DAY = "CAST(CAST(timestamp AS DATE) AS STRING)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def pct(condition: str, of: str = "true", digits: int = 4) -> str:
    return f"round(CAST({count_if(f'({condition}) AND ({of})')} * 100.0 / nullif({count_if(of)}, 0) AS DOUBLE), {digits})"


def ms(column: str, p: float, condition: str | None = None) -> str:
    tail = f" FILTER (WHERE {condition})" if condition else ""
    return r6(f"percentile({column}, {p}){tail} / 1000.0")


def metrics(prefix_hit: str = HIT["hit_prefix_ci"], statuses: tuple[int, ...] = (404,)) -> dict[str, str]:
    """The named metrics, as aggregate expressions."""
    codes = ", ".join(map(str, statuses))
    return {
        "requests": "count(*)",
        "errors_5xx": count_if("status >= 500"),
        "rate_5xx": pct("status >= 500"),
        "errors_4xx": count_if("status BETWEEN 400 AND 499"),
        "rate_4xx": pct("status BETWEEN 400 AND 499"),
        "latency_p95": ms("elapsed", 0.95),
        "hit_rate": pct(prefix_hit),
        "throughput": total("resp_bytes"),
        "ttfb_p95": ms("ottfb", 0.95),
        "req_size": r6("avg(req_bytes + req_header_bytes)"),
        "specific_status": count_if(f"status IN ({codes})"),
        "specific_status_rate": pct(f"status IN ({codes})"),
    }


def _buckets(column: str, edges: list[tuple[object, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} <= {top} THEN '{name}'" for top, name in edges) + f" ELSE '{last}' END"


# Upper edges and names of the histogram buckets.
HEADER_EDGES = [
    (256, "0-256B"), (512, "256-512B"), (768, "512-768B"), (1024, "768B-1KB"), (1536, "1-1.5KB"), (2048, "1.5-2KB"), (3072, "2-3KB"), (4096, "3-4KB"),
    (6144, "4-6KB"), (8192, "6-8KB"), (12288, "8-12KB"), (16384, "12-16KB"), (24576, "16-24KB"), (32768, "24-32KB"),
]
TTL_EDGES = [(0, "0"), (60, "1-60s"), (300, "1-5m"), (3600, "5m-1h"), (86400, "1h-1d")]
DURATION_EDGES = [(30, "<30s"), (120, "30s-2m"), (300, "2-5m"), (600, "5-10m"), (1800, "10-30m"), (3600, "30m-1h")]

_LAT_OK = f"{ORIGIN_LATENCY} IS NOT NULL"
_LATENCY3 = {"p50_ms": ms(ORIGIN_LATENCY, 0.5), "p95_ms": ms(ORIGIN_LATENCY, 0.95), "p99_ms": ms(ORIGIN_LATENCY, 0.99)}
_RTT_OK = "tcp_rtt IS NOT NULL AND tcp_rtt > 0"
# File endings of the asset types, and of texts that compress.
ASSETS = {
    "Images": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico"),
    "Documents": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "zip", "tar", "gz", "tgz", "rar", "7z"),
    "JavaScript/CSS": ("js", "mjs", "css"),
    "Fonts": ("woff", "woff2", "ttf", "otf", "eot"),
    "Video": ("m3u8", "ts", "mp4", "m4s", "webm"),
}
COMPRESSIBLE = ("js", "mjs", "css", "svg", "html", "json")


def endings(names: tuple[str, ...], url: str = "url") -> str:
    """Whether what stands behind the last dot of a URL is one of ``names``."""
    return f"(contains({url}, '.') AND lower(substring_index({url}, '.', -1)) IN ({', '.join(map(repr, names))}))"


def asset_class(url: str = "url") -> str:
    return "CASE " + " ".join(f"WHEN {endings(names, url)} THEN '{kind}'" for kind, names in ASSETS.items()) + " ELSE 'API/Dynamic' END"


_ASSET = asset_class()
_COMPRESSED, _COMPRESSIBLE = "lower(resp_header_content_encoding) IN ('gzip', 'br', 'deflate')", endings(COMPRESSIBLE)
_ENCODING = "CASE WHEN contains(coalesce(resp_header_content_encoding, ''), 'br') THEN 'br' WHEN contains(coalesce(resp_header_content_encoding, ''), 'gzip') THEN 'gzip' WHEN coalesce(resp_header_content_encoding, '') = '' THEN 'uncompressed' ELSE 'other' END"
_PROTO = "CASE WHEN proto IN ('HTTP/1.0', 'HTTP/1.1') THEN 'HTTP/1' WHEN proto IN ('HTTP/2', 'HTTP/2.0', 'h2') THEN 'HTTP/2' WHEN proto IN ('HTTP/3', 'HTTP/3.0', 'h3') THEN 'HTTP/3' ELSE 'Other' END"
_TUNNEL = "(tcp_rtt > 0 AND CAST(rtt_min AS DOUBLE) / tcp_rtt < 0.1)"

READS: dict[str, Report] = {
    # Dashboard.
    "dashboard_count": Report(measures={"total": "count(*)"}),
    "field_totals": Report(measures={c: f"count({c})" for c in ("ip", "url", "country", "ua", "referer", "asn", "io_input_bytes", "edge_score")}),
    "time_series": Report(keys={"bucket": HOUR}, measures=metrics()),
    "map_by_country": Report(keys={"country": "country"}, measures={"count": "count(*)"}, where="country IS NOT NULL AND country <> ''"),
    "source_extent": Report(measures={"count": "count(*)", "min_ts": "CAST(min(timestamp) AS STRING)", "max_ts": "CAST(max(timestamp) AS STRING)"}),
    "calendar": Report(keys={"day": DAY}, measures={"count": "count(*)"}),
    "conn_requests_hist": Report(
        keys={"bucket": "CASE WHEN conn_requests = 1 THEN '1' WHEN conn_requests <= 5 THEN '2-5' WHEN conn_requests <= 20 THEN '6-20' ELSE '21+' END"},
        measures={"count": "count(*)", "min_val": "min(conn_requests)"}, where="conn_requests > 0", order=["min_val"], limit=10,
    ),
    "log_activity": Report(keys={"bucket": HOUR}, measures={"rows": "count(*)", "bytes": total("resp_bytes"), "req_bytes_total": total("req_bytes")}),
    # Origin.
    "origin_summary": Report(
        measures={
            "requests": "count(*)", "total_misses": count_if("startswith(cache, 'MISS')"), "total_passes": count_if("startswith(cache, 'PASS')"),
            "ottfb_p50_ms": ms(ORIGIN_LATENCY, 0.5), "ottfb_p75_ms": ms(ORIGIN_LATENCY, 0.75), "ottfb_p95_ms": ms(ORIGIN_LATENCY, 0.95), "ottfb_p99_ms": ms(ORIGIN_LATENCY, 0.99),
            "ottlb_p50_ms": ms("ottlb", 0.5), "ottlb_p95_ms": ms("ottlb", 0.95), "cdn_overhead_p50_ms": ms(f"(elapsed - {ORIGIN_LATENCY})", 0.5), "origin_error_rate": pct("ost >= 500", "ost IS NOT NULL"), "obytes_p50": r6("percentile(obytes, 0.5)"),
        },
        where=_LAT_OK,
    ),
    "origin_timeseries": Report(keys={"bucket": HOUR, "edge": "edge"}, measures={"miss_count": "count(*)", "value": ms(ORIGIN_LATENCY, 0.95)}, where=_LAT_OK),
    "origin_slow_urls": Report(keys={"url": "url"}, measures={"requests": "count(*)", **_LATENCY3}, where=f"{_LAT_OK} AND url IS NOT NULL", having="requests >= {least}", order=["-p95_ms"], limit=20, params={"least": 5}),
    "origin_status_codes": Report(
        keys={"status": "CASE WHEN ost BETWEEN 100 AND 599 THEN ost ELSE -1 END"}, measures={"count": "count(*)"}, where="ost IS NOT NULL",
        totals={"all_rows": "CAST(sum(count) AS BIGINT)"}, derived={"pct": "round(CAST(count * 100.0 / all_rows AS DOUBLE), 4)"}, columns=["status", "count", "pct"],
    ),
    "origin_path_breakdown": Report(keys={"edge": "edge"}, measures={"requests": "count(*)", "p50_ms": _LATENCY3["p50_ms"], "p95_ms": _LATENCY3["p95_ms"]}, where=_LAT_OK),
    "origin_pop_latency": Report(
        keys={"pop": "pop"}, measures={"requests": "count(*)", "p50_ms": _LATENCY3["p50_ms"], "p95_ms": _LATENCY3["p95_ms"]}, where=f"{_LAT_OK} AND pop IS NOT NULL AND pop <> ''",
        totals={"median_p95": "percentile(p95_ms, 0.5)"}, derived={"elevated": "p95_ms > 2 * median_p95"}, order=["-p95_ms"], limit=50,
    ),
    "origin_ip_health": Report(
        keys={"oip": "oip"}, measures={"requests": "count(*)", "p50_ms": _LATENCY3["p50_ms"], "p95_ms": _LATENCY3["p95_ms"], "error_pct": pct("ost >= 500", digits=1)},
        where="oip IS NOT NULL AND oip <> '' AND ost IS NOT NULL", having="requests >= 10", order=["-error_pct"], limit=50,
    ),
    "origin_drilldown": Report(
        keys={"dim_key": "coalesce(CAST({dimension} AS STRING), 'unknown')"}, measures={"requests": "count(*)", **_LATENCY3, "error_rate": pct("ost >= 500", digits=2), "bytes": total("obytes")},
        where=f"{_LAT_OK} AND {{dimension}} IS NOT NULL", order=["-requests"], limit=50, params={"dimension": "server_region"},
    ),
    # Network.
    "network_quality": Report(keys={"label": "CAST({group} AS STRING)"}, measures={"reqs": "count(*)", "rtt_ms": ms("tcp_rtt", 0.5)}, where=f"{_RTT_OK} AND {{group}} IS NOT NULL", order=["-reqs"], limit=25, params={"group": "country"}),
    "quality_countries": Report(keys={"country": "country"}, measures={"reqs": "count(*)"}, where="country IS NOT NULL AND country <> ''", columns=["country"]),
    "transport_metrics": Report(
        keys={"protocol": _PROTO}, measures={"requests": "count(*)", **{f"rtt_p{p}_ms": ms("tcp_rtt", p / 100) for p in (50, 90, 95, 99)}, "avg_retrans": r6("avg(retrans)"), "avg_loss": r6("avg(ploss)"), "delivery_mbps": r6("percentile(delivery_rate, 0.5) * 8 / 1000000.0")},
    ),
    "pop_health": Report(
        keys={"pop": "pop"},
        measures={"requests": "count(*)", "errors": count_if("status >= 400 OR status = 0"), "error_rate": pct("status >= 400 OR status = 0", digits=2), "p50_rtt_us": r6("percentile(tcp_rtt, 0.5)"), "p95_ttfb_ms": r6("percentile(ttfb, 0.95) * 1000.0"), "cache_hit_rate": pct(HIT["hit_exact2"], digits=2), "bandwidth_bytes": total("resp_bytes")},
        where="pop IS NOT NULL AND pop <> ''",
    ),
    # Performance.
    "perf_top_urls": Report(keys={"url": "url"}, measures={"reqs": "count(*)", "avg_ms": r6("avg(elapsed) / 1000.0"), "p50": ms("elapsed", 0.5), "p95": ms("elapsed", 0.95), "p99": ms("elapsed", 0.99)}, where="url IS NOT NULL AND elapsed IS NOT NULL", having="reqs > {least}", order=["-p95"], limit=20, params={"least": 5}),
    "perf_top_asns": Report(keys={"asn": "asn"}, measures={"reqs": "count(*)", "avg_ms": r6("avg(elapsed) / 1000.0"), "p50": ms("elapsed", 0.5), "p95": ms("elapsed", 0.95), "p99": ms("elapsed", 0.99)}, where="asn IS NOT NULL AND elapsed IS NOT NULL", having="reqs > {least}", order=["-p95"], limit=20, params={"least": 10}),
    "ttl_dist": Report(keys={"bucket": _buckets("ttl", TTL_EDGES, ">1d")}, measures={"count": "count(*)", "min_ttl": "min(ttl)"}, where="ttl IS NOT NULL", order=["min_ttl"], limit=20),
    "latency_waterfall": Report(
        measures={
            "edge_processing": r6("avg(greatest(0.0, ttfb * 1000.0 - ottfb / 1000.0))"), "origin_wait": r6("avg(ottfb / 1000.0)"), "origin_download": r6("avg(greatest(0.0, ottlb / 1000.0 - ottfb / 1000.0))"),
            "client_download": r6("avg(greatest(0.0, elapsed / 1000.0 - greatest(ottlb / 1000.0, ttfb * 1000.0)))"),
        },
    ),
    # Security.
    "fingerprint_top_n": Report(keys={"fingerprint": "{column}"}, measures={"ip_count": distinct("ip"), "req_count": "count(*)"}, where="{column} IS NOT NULL AND {column} <> ''", order=["-req_count"], limit=20, params={"column": "ja4"}),
    "fingerprint_coverage": Report(measures={"total_rows": "count(*)", "ja3_rows": count_if("ja3 IS NOT NULL AND ja3 <> ''"), "ja4_rows": count_if("ja4 IS NOT NULL AND ja4 <> ''")}),
    "req_header_sizes": Report(keys={"bucket": _buckets("req_header_bytes", HEADER_EDGES, ">32KB")}, measures={"count": "count(*)", "min_val": "min(req_header_bytes)"}, where="req_header_bytes IS NOT NULL", order=["min_val"], limit=20),
    "top_ips_by_header": Report(keys={"ip": "ip"}, measures={"max_header": "max(req_header_bytes)"}, where="ip IS NOT NULL AND req_header_bytes IS NOT NULL", order=["-max_header"], limit=10),
    "conn_reuse": Report(
        keys={"bucket": "CASE WHEN conn_requests = 1 THEN '1 (None)' WHEN conn_requests <= 5 THEN '2-5' WHEN conn_requests <= 20 THEN '6-20' WHEN conn_requests <= 100 THEN '21-100' ELSE '>100' END"},
        measures={"count": "count(*)", "min_val": "min(conn_requests)"}, where="conn_requests IS NOT NULL AND conn_requests > 0", order=["min_val"], limit=10,
    ),
    "ipv6_adoption_ts": Report(keys={"bucket": HOUR}, measures={"ipv6_pct": pct("is_ipv6")}),
    "proxy_type_dist": Report(keys={"p_type": "p_type"}, measures={"count": "count(*)"}, where="p_type IS NOT NULL AND p_type <> ''"),
    "top_uas": Report(keys={"ua": "ua"}, measures={"cnt": "count(*)"}, where="ua IS NOT NULL", order=["-cnt"], limit=50),
    "proxy_connection_quality": Report(
        keys={"type": f"CASE WHEN rtt_min IS NULL OR tcp_rtt IS NULL THEN 'Direct Connection' WHEN {_TUNNEL} THEN 'Active Tunnel / Proxy' WHEN tcp_rtt > 0 AND CAST(rtt_min AS DOUBLE) / tcp_rtt < 0.7 THEN 'WiFi / Mobile' ELSE 'Direct Connection' END"},
        measures={"count": "count(*)"},
    ),
    "proxy_isps": Report(keys={"asn": "asn"}, measures={"count": "count(*)"}, where=_TUNNEL, order=["-count"], limit=10),
    "threat_intel": Report(
        keys={"tls_fingerprint": "ja3"}, measures={"requests": "count(*)", "top_country": "mode(country, true)", "matched_waf_rules_count": count_if("waf_sig <> ''"), "bot_percentage": pct("regexp_like(ua, '(?i)bot')", digits=2), "is_anonymized_proxy": "max(CASE WHEN p_type IS NOT NULL AND p_type <> '' THEN 1 ELSE 0 END)"},
        where="ja3 IS NOT NULL AND ja3 <> ''", order=["-requests"], limit=50,
    ),
    # Assets and value.
    "assets_summary": Report(keys={"asset_type": _ASSET}, measures={"requests": "count(*)", "bytes": total("resp_bytes"), "hit_ratio": pct(HIT["hit_prefix_ci"]), "compression_rate": pct(_COMPRESSED), "compressible_requests": count_if(_COMPRESSIBLE), "compressible_rate": pct(_COMPRESSED, _COMPRESSIBLE)}, where="url IS NOT NULL"),
    "assets_cache_matrix": Report(keys={"asset_type": _ASSET, "cache": "cache"}, measures={"requests": "count(*)", "bytes": total("resp_bytes")}, where="url IS NOT NULL"),
    "assets_encoding_matrix": Report(keys={"asset_type": _ASSET, "encoding": _ENCODING}, measures={"requests": "count(*)", "bytes": total("resp_bytes")}, where="url IS NOT NULL"),
    "large_uncompressed": Report(keys={"url": "url"}, measures={"requests": "count(*)", "bytes": total("resp_bytes")}, where=f"{_ENCODING} = 'uncompressed' AND status = 200 AND resp_bytes >= {{floor}}", order=["-bytes"], limit=20, params={"floor": 1024}),
    "low_ttl_assets": Report(keys={"url": "url"}, measures={"requests": "count(*)", "avg_ttl": r6("avg(ttl)")}, where="ttl IS NOT NULL AND ttl < {ttl}", order=["-requests"], limit=20, params={"ttl": 60}),
    "edge_ratio": Report(measures={"edge_pct": pct("edge")}),
    "waf_flag_7d": Report(measures={"waf_pct": pct("waf_sig IS NOT NULL AND waf_sig <> ''"), "flagged": count_if("waf_sig IS NOT NULL AND waf_sig <> ''")}, where="is_w"),
    "value_overview": Report(
        keys={"bucket": DAY},
        measures={"requests": "count(*)", "hits": count_if(HIT["hit_prefix"]), "misses": count_if("startswith(cache, 'MISS')"), "passes": count_if("startswith(cache, 'PASS')"), "bytes": total("resp_bytes"), "saved_bytes": total("resp_bytes", HIT["hit_prefix"]), "shield": count_if("NOT edge"), "threats": count_if("waf_sig IS NOT NULL AND waf_sig <> '' AND NOT startswith(waf_sig, 'VERIFIED')")},
    ),
    "value_caching": Report(keys={"bucket": DAY}, measures={"hit_ratio": pct(HIT["hit_prefix"], "startswith(cache, 'HIT') OR startswith(cache, 'MISS')"), "saved_bytes": total("resp_bytes", HIT["hit_prefix"]), "origin_bytes": total("resp_bytes", "NOT startswith(cache, 'HIT')")}),
    "value_performance": Report(keys={"bucket": DAY}, measures={"hit_ms": r6(f"avg(elapsed) FILTER (WHERE {HIT['hit_prefix']}) / 1000.0"), "miss_ms": r6("avg(elapsed) FILTER (WHERE startswith(cache, 'MISS')) / 1000.0")}),
    "value_security": Report(keys={"bucket": DAY}, measures={"flagged": count_if("waf_sig <> ''"), "blocked": count_if("waf_resp = 406"), "passed": count_if("waf_resp = 200")}),
    "value_network": Report(keys={"bucket": DAY}, measures={"http1": count_if(f"{_PROTO} = 'HTTP/1'"), "http2": count_if(f"{_PROTO} = 'HTTP/2'"), "http3": count_if(f"{_PROTO} = 'HTTP/3'"), "tls13": count_if("tls = 'TLSv1.3'"), "ipv6": count_if("is_ipv6")}),
    "value_bots": Report(keys={"token": "lower(regexp_extract(ua, '([A-Za-z0-9_-]*[Bb]ot)', 1))"}, measures={"requests": "count(*)", "verified": count_if("waf_sig LIKE '%VERIFIED-BOT%'")}, where="ua LIKE '%bot%' OR ua LIKE '%Bot%'", order=["-requests"], limit=10),
    "value_images": Report(keys={"bucket": DAY}, measures={"requests": "count(*)", "bytes": total("resp_bytes"), "io_saved": total("io_input_bytes - io_output_bytes", "io_input_bytes IS NOT NULL")}, where=f"{_ASSET} = 'Images'"),
    "image_compression": Report(keys={"bucket": DAY}, measures={"input_bytes": total("io_input_bytes"), "output_bytes": total("io_output_bytes"), "ratio": r6("sum(io_output_bytes) * 1.0 / nullif(sum(io_input_bytes), 0)")}, where="io_input_bytes > 0 AND io_output_bytes IS NOT NULL"),
    "image_formats": Report(keys={"io_input_format": "io_input_format", "io_output_format": "io_output_format"}, measures={"requests": "count(*)", "saved_bytes": total("io_input_bytes - io_output_bytes"), "ratio": r6("sum(io_output_bytes) * 1.0 / nullif(sum(io_input_bytes), 0)")}, where="io_input_bytes > 0 AND io_output_bytes IS NOT NULL"),
    "io_stats_summary": Report(keys={"day": DAY, "format": "io_output_format"}, measures={"transforms": "count(*)", "bytes": total("io_output_bytes")}, where="io_output_format IS NOT NULL", totals={"every": "sum(transforms)"}, derived={"pct": "round(CAST(transforms * 100.0 / every AS DOUBLE), 4)"}, columns=["day", "format", "transforms", "bytes", "pct"]),
    # Video.
    "cmcd_object_types": Report(keys={"cmcd_ot": "cmcd_ot"}, measures={"request_count": "count(*)"}, where="cmcd_ot IS NOT NULL AND cmcd_ot <> ''"),
    "cmcd_formats": Report(keys={"cmcd_sf": "cmcd_sf"}, measures={"session_count": distinct("cmcd_sid")}, where="cmcd_sf IS NOT NULL AND cmcd_sf <> ''"),
    # Browser telemetry.
    "rum_vitals": Report(
        keys={"metric_name": "metric_name"}, measures={"p75": r6("percentile(metric_value, 0.75)"), "total_count": "count(*)", **{f"{n}_count": count_if(f"metric_rating = '{v}'") for n, v in (("good", "good"), ("ni", "needs_improvement"), ("poor", "poor"))}}, source="vitals",
    ),
    "rum_exceptions": Report(keys={c: c for c in ("error_message", "error_file", "error_line", "error_col")}, measures={"count": "count(*)"}, order=["-count"], limit=3, source="errors"),
    # Scoring.
    "score_distribution": Report(keys={"hour": HOUR, "bucket": "CASE WHEN edge_score < 25 THEN '0-25' WHEN edge_score < 50 THEN '25-50' WHEN edge_score < 75 THEN '50-75' ELSE '75-100' END"}, measures={"count": "count(*)"}, where="edge_score IS NOT NULL"),
    "cookie_compliance": Report(keys={"hour": HOUR, "compliance": "edge_cookie_compliance"}, measures={"count": "count(*)"}, where="edge_cookie_compliance IS NOT NULL AND edge_cookie_compliance <> ''"),
    "score_latency_ts": Report(
        keys={"hour": HOUR}, measures={"scored_count": count_if("edge_score IS NOT NULL"), "fail_open_count": count_if("edge_score_reason ILIKE '%compute-unavailable%'"), "total_count": "count(*)", **{f"rtt_p{p}_us": r6(quantile("edge_score_rtt_us", p / 100)) for p in (50, 95, 99)}, **{f"exec_p{p}_us": r6(quantile("edge_score_exec_us", p / 100)) for p in (50, 95)}},
        where="edge OR edge_score IS NOT NULL",
    ),
    "session_l2_max": Report(keys={"edge_sid": "edge_sid"}, measures={"l2_max": "max(edge_score_l2)"}, where="edge_score_l2 IS NOT NULL AND edge_sid <> ''"),
    # Usage and accounting.
    "usage_bandwidth": Report(keys={"bucket": DAY}, measures={"requests": "count(*)", "bytes": total("resp_bytes + req_bytes")}),
    "usage_rum_breakdown": Report(keys={"bucket": DAY}, measures={"beacons": distinct("req_id"), "rows": "count(*)"}, derived={"operations": "ceil(beacons / 1000.0)"}, columns=["bucket", "beacons", "rows"], source="vitals"),
    # Shared scans: one aggregate serves many detections.
    "coalesced_city": Report(
        keys={"city": "city", "region": "region", "country": "country"},
        measures={"w_cnt": count_if("is_w"), "b_cnt": count_if("is_b"), "w_errors": count_if("is_w AND status >= 400"), "b_errors": count_if("is_b AND status >= 400"), "w_p95": ms("elapsed", 0.95, "is_w"), "b_p95": ms("elapsed", 0.95, "is_b"), "w_lat_total": count_if("is_w AND elapsed IS NOT NULL"), "b_lat_total": count_if("is_b AND elapsed IS NOT NULL")},
        where="city IS NOT NULL AND city <> ''", having="w_cnt >= 5",
    ),
    "coalesced_url": Report(
        keys={"url": "url"},
        measures={
            f"{s}_{n}": count_if(f"is_{s} AND {c}")
            for s in "wb"
            for n, c in {"total": "true", "5xx": "status >= 500", "hits": "startswith(cache, 'HIT')", "miss": "startswith(cache, 'MISS')", "pass": "startswith(cache, 'PASS')", "lat_total": "elapsed IS NOT NULL"}.items()
        }
        | {"w_p95": ms("elapsed", 0.95, "is_w"), "b_p95": ms("elapsed", 0.95, "is_b"), "w_p99": ms("elapsed", 0.99, "is_w"), "w_p50": ms("elapsed", 0.5, "is_w"), "oret_w_cnt": count_if("is_w AND oretries > 0"), "oret_w_max": "max(oretries) FILTER (WHERE is_w)"},
        where="url IS NOT NULL", having="w_total >= 3",
    ),
    "coalesced_ip_security": Report(
        keys={"ip": "ip"},
        measures={"w_total": count_if("is_w"), "w_404": count_if("is_w AND status = 404"), "w_distinct_404": distinct("url", "is_w AND status = 404"), "b_404": count_if("is_b AND status = 404"), "w_denied": count_if("is_w AND status IN (401, 403)"), "b_denied": count_if("is_b AND status IN (401, 403)")},
        where="ip IS NOT NULL AND ip <> ''", having="w_total > 0",
    ),
    "coalesced_ip_extended": Report(
        keys={"ip": "ip"},
        measures={"w_total": count_if("is_w"), "max_header": "max(req_header_bytes) FILTER (WHERE is_w)", "b_p95_header": r6("percentile(req_header_bytes, 0.95) FILTER (WHERE is_b)"), "max_conn": "max(conn_requests) FILTER (WHERE is_w)", "b_p95_conn": r6("percentile(conn_requests, 0.95) FILTER (WHERE is_b AND conn_requests > 0)"), "w_sessions": distinct("cookie_session", "is_w"), "b_sessions": distinct("cookie_session", "is_b")},
        where="ip IS NOT NULL AND ip <> ''", having="w_total > 0",
    ),
    "coalesced_asn": Report(
        keys={"asn": "asn"},
        measures={"w_cnt": count_if("is_w"), "b_cnt": count_if("is_b"), "w_hosting": count_if("is_w AND p_type = 'hosting'"), "b_hosting": count_if("is_b AND p_type = 'hosting'"), "w_ploss": r6("avg(ploss) FILTER (WHERE is_w)"), "b_ploss": r6("avg(ploss) FILTER (WHERE is_b)"), "w_jitter": r6("percentile(rtt_var, 0.95) FILTER (WHERE is_w)"), "b_jitter": r6("percentile(rtt_var, 0.95) FILTER (WHERE is_b)")},
        where="asn IS NOT NULL",
    ),
    "coalesced_scalar": Report(
        measures={f"{s}_{n}": count_if(f"is_{s} AND {c}") for s in "wb" for n, c in {"total": "true", "hits": "startswith(cache, 'HIT')", "miss": "startswith(cache, 'MISS')", "quic": "transport = 'quic'", "ost_5xx": "ost >= 500"}.items()}
        | {"w_conn": r6("percentile(oconnect_ms, 0.95) FILTER (WHERE is_w)"), "b_conn": r6("percentile(oconnect_ms, 0.95) FILTER (WHERE is_b)")},
    ),
    # Rollups: hourly tables, one row per key.
    "rollup_proxy_quality": Report(keys={"hour": HOUR, "tunnel": _TUNNEL}, measures={"count": "count(*)", "ips": distinct("ip")}),
    "rollup_wellknown_bots": Report(keys={"hour": HOUR, "bot": "lower(regexp_extract(ua, '([A-Za-z0-9_-]*[Bb]ot)', 1))"}, measures={"requests": "count(*)", "ips": distinct("ip")}, where="ua LIKE '%bot%' OR ua LIKE '%Bot%'"),
    "bench_country_rollup": Report(keys={"country": "country"}, measures={"requests": "count(*)", "errors": count_if("status >= 500"), "avg_ottfb": r6("avg(ottfb)"), "p95_bytes": r6("percentile(resp_bytes, 0.95)")}),
}
