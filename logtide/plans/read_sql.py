"""The SQL that the reports of the read library are compared with, written out for another engine.

Nothing here is derived from the reports: each statement is stated by itself over the tables ``logs``, ``vitals`` and
``errors``, in the dialect of the comparing engine, so that a wrong definition on one side shows.
"""

from __future__ import annotations

H = "CAST(date_trunc('hour', timestamp) AS VARCHAR)"
M = "CAST(date_trunc('minute', timestamp) AS VARCHAR)"
D = "CAST(CAST(timestamp AS DATE) AS VARCHAR)"
#: Origin latency in microseconds; older rows only have the first byte in seconds.
OL = "CASE WHEN ottfb IS NOT NULL THEN ottfb ELSE ttfb * 1000000 END"
#: Round-trip times count where they were measured.
RTT = "tcp_rtt > 0"


def n(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


def share(cond: str, of: str = "true", digits: int = 4) -> str:
    return f"round({n(f'({cond}) AND ({of})')} * 100.0 / nullif({n(of)}, 0), {digits})"


def q(col: str, p: float, per: float = 1000, cond: str = "true") -> str:
    return f"round(quantile_cont(CASE WHEN {cond} THEN {col} END, {p}) / {float(per)}, 6)"


def big(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS BIGINT)"


_METRICS = f"""count(*) AS requests, {n('status >= 500')} AS errors_5xx, {share('status >= 500')} AS rate_5xx, {n('status >= 400 AND status < 500')} AS errors_4xx,
  {share('status >= 400 AND status < 500')} AS rate_4xx, {q('elapsed', 0.95)} AS latency_p95, {share("upper(cache) LIKE 'HIT%'")} AS hit_rate, {big('resp_bytes')} AS throughput,
  {q('ottfb', 0.95)} AS ttfb_p95, round(avg(req_bytes + req_header_bytes), 6) AS req_size, {n('status = 404')} AS specific_status, {share('status = 404')} AS specific_status_rate"""
_L3 = f"{q(OL, 0.5)} AS p50_ms, {q(OL, 0.95)} AS p95_ms, {q(OL, 0.99)} AS p99_ms"
_L2 = f"{q(OL, 0.5)} AS p50_ms, {q(OL, 0.95)} AS p95_ms"
_ORIGIN = "(ottfb IS NOT NULL OR ttfb IS NOT NULL)"
_EXT = "regexp_extract(lower(url), '[.]([^.]*)$', 1)"
_ASSET = f"""CASE WHEN {_EXT} IN ('ico', 'webp', 'svg', 'gif', 'jpeg', 'jpg', 'png') THEN 'Images' WHEN {_EXT} IN ('7z', 'rar', 'tgz', 'gz', 'tar', 'zip', 'csv', 'txt', 'pptx', 'ppt', 'xlsx', 'xls', 'docx', 'doc', 'pdf') THEN 'Documents'
  WHEN {_EXT} IN ('css', 'mjs', 'js') THEN 'JavaScript/CSS' WHEN {_EXT} IN ('eot', 'otf', 'ttf', 'woff2', 'woff') THEN 'Fonts' WHEN {_EXT} IN ('webm', 'm4s', 'mp4', 'ts', 'm3u8') THEN 'Video' ELSE 'API/Dynamic' END"""
_PACKED, _TEXTS = "resp_header_content_encoding IN ('gzip', 'br', 'deflate', 'GZIP', 'BR', 'DEFLATE')", f"{_EXT} IN ('json', 'html', 'svg', 'css', 'mjs', 'js')"
_ENC = """CASE WHEN resp_header_content_encoding IS NULL OR resp_header_content_encoding = '' THEN 'uncompressed' WHEN resp_header_content_encoding LIKE '%br%' THEN 'br'
  WHEN resp_header_content_encoding LIKE '%gzip%' THEN 'gzip' ELSE 'other' END"""
_PROTO = "CASE proto WHEN 'HTTP/1.0' THEN 'HTTP/1' WHEN 'HTTP/1.1' THEN 'HTTP/1' WHEN 'HTTP/2' THEN 'HTTP/2' WHEN 'HTTP/2.0' THEN 'HTTP/2' WHEN 'h2' THEN 'HTTP/2' WHEN 'HTTP/3' THEN 'HTTP/3' WHEN 'HTTP/3.0' THEN 'HTTP/3' WHEN 'h3' THEN 'HTTP/3' ELSE 'Other' END"
_TUNNEL = "(tcp_rtt > 0 AND rtt_min / tcp_rtt < 0.1)"
_HEADER = """CASE WHEN req_header_bytes <= 256 THEN '0-256B' WHEN req_header_bytes <= 512 THEN '256-512B' WHEN req_header_bytes <= 768 THEN '512-768B' WHEN req_header_bytes <= 1024 THEN '768B-1KB'
  WHEN req_header_bytes <= 1536 THEN '1-1.5KB' WHEN req_header_bytes <= 2048 THEN '1.5-2KB' WHEN req_header_bytes <= 3072 THEN '2-3KB' WHEN req_header_bytes <= 4096 THEN '3-4KB'
  WHEN req_header_bytes <= 6144 THEN '4-6KB' WHEN req_header_bytes <= 8192 THEN '6-8KB' WHEN req_header_bytes <= 12288 THEN '8-12KB' WHEN req_header_bytes <= 16384 THEN '12-16KB'
  WHEN req_header_bytes <= 24576 THEN '16-24KB' WHEN req_header_bytes <= 32768 THEN '24-32KB' ELSE '>32KB' END"""
_TTL = "CASE WHEN ttl <= 0 THEN '0' WHEN ttl <= 60 THEN '1-60s' WHEN ttl <= 300 THEN '1-5m' WHEN ttl <= 3600 THEN '5m-1h' WHEN ttl <= 86400 THEN '1h-1d' ELSE '>1d' END"
_CONN = "CASE WHEN conn_requests < 2 THEN '1' WHEN conn_requests < 6 THEN '2-5' WHEN conn_requests < 21 THEN '6-20' ELSE '21+' END"
_BOT_NAME = "lower(regexp_extract(ua, '([A-Za-z0-9_-]*[Bb]ot)', 1))"
_BOT = "regexp_matches(ua, '[Bb]ot')"
_HIT, _MISS, _PASS = "cache LIKE 'HIT%'", "cache LIKE 'MISS%'", "cache LIKE 'PASS%'"
_GEO = "country IS NOT NULL AND country <> ''"


def quality(label: str) -> str:
    return f"SELECT CAST({label} AS VARCHAR) AS label, count(*) AS reqs, {q('tcp_rtt', 0.5)} AS rtt_ms FROM logs WHERE {RTT} AND {label} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"


def fingerprints(column: str) -> str:
    return f"SELECT {column} AS fingerprint, count(DISTINCT ip) AS ip_count, count(*) AS req_count FROM logs WHERE {column} <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20"


def _slow(columns: str, key: str, least: int) -> str:
    return f"SELECT {columns}, count(*) AS reqs, round(avg(elapsed) / 1000.0, 6) AS avg_ms, {q('elapsed', 0.5)} AS p50, {q('elapsed', 0.95)} AS p95, {q('elapsed', 0.99)} AS p99 FROM logs WHERE {key} IS NOT NULL AND elapsed IS NOT NULL GROUP BY 1 HAVING count(*) > {least} ORDER BY p95 DESC NULLS LAST, 1 LIMIT 20"


SQL: dict[str, str] = {
    "dashboard_count": "SELECT count(*) AS total FROM logs",
    "field_totals": "SELECT " + ", ".join(f"count({c}) AS {c}" for c in ("ip", "url", "country", "ua", "referer", "asn", "io_input_bytes", "edge_score")) + " FROM logs",
    "time_series": f"SELECT {H} AS bucket, {_METRICS} FROM logs GROUP BY 1",
    "map_by_country": f"SELECT country, count(*) AS count FROM logs WHERE {_GEO} GROUP BY 1",
    "source_extent": "SELECT count(*) AS count, CAST(min(timestamp) AS VARCHAR) AS min_ts, CAST(max(timestamp) AS VARCHAR) AS max_ts FROM logs",
    "calendar": f"SELECT {D} AS day, count(*) AS count FROM logs GROUP BY 1",
    "conn_requests_hist": f"SELECT {_CONN} AS bucket, count(*) AS count, min(conn_requests) AS min_val FROM logs WHERE conn_requests >= 1 GROUP BY 1",
    "log_activity": f"SELECT {H} AS bucket, count(*) AS rows, {big('resp_bytes')} AS bytes, {big('req_bytes')} AS req_bytes_total FROM logs GROUP BY 1",
    "origin_summary": f"""SELECT count(*) AS requests, {n(_MISS)} AS total_misses, {n(_PASS)} AS total_passes, {q(OL, 0.5)} AS ottfb_p50_ms, {q(OL, 0.75)} AS ottfb_p75_ms, {q(OL, 0.95)} AS ottfb_p95_ms,
  {q(OL, 0.99)} AS ottfb_p99_ms, {q('ottlb', 0.5)} AS ottlb_p50_ms, {q('ottlb', 0.95)} AS ottlb_p95_ms, {q(f'elapsed - {OL}', 0.5)} AS cdn_overhead_p50_ms,
  {share('ost >= 500', 'ost IS NOT NULL')} AS origin_error_rate, {q('obytes', 0.5, 1)} AS obytes_p50 FROM logs WHERE {_ORIGIN}""",
    "origin_timeseries": f"SELECT {H} AS bucket, edge, count(*) AS miss_count, {q(OL, 0.95)} AS value FROM logs WHERE {_ORIGIN} GROUP BY 1, 2",
    "origin_slow_urls": f"SELECT url, count(*) AS requests, {_L3} FROM logs WHERE {_ORIGIN} AND url IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY p95_ms DESC NULLS LAST, url LIMIT 20",
    "origin_status_codes": "SELECT CASE WHEN ost >= 100 AND ost < 600 THEN ost ELSE -1 END AS status, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM logs WHERE ost IS NOT NULL GROUP BY 1",
    "origin_path_breakdown": f"SELECT edge, count(*) AS requests, {_L2} FROM logs WHERE {_ORIGIN} GROUP BY 1",
    "origin_pop_latency": f"p AS (SELECT pop, count(*) AS requests, {_L2} FROM logs WHERE {_ORIGIN} AND pop <> '' GROUP BY 1) SELECT p.*, (SELECT median(p95_ms) FROM p) AS median_p95, p95_ms > 2 * (SELECT median(p95_ms) FROM p) AS elevated FROM p ORDER BY p95_ms DESC, pop LIMIT 50",
    "origin_ip_health": f"SELECT oip, count(*) AS requests, {_L2}, {share('ost >= 500', digits=1)} AS error_pct FROM logs WHERE oip <> '' AND ost IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 ORDER BY error_pct DESC, oip LIMIT 50",
    "origin_drilldown": f"SELECT server_region AS dim_key, count(*) AS requests, {_L3}, {share('ost >= 500', digits=2)} AS error_rate, {big('obytes')} AS bytes FROM logs WHERE {_ORIGIN} AND server_region IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "network_quality": quality("country"),
    "network_quality_asn": quality("asn"),
    "network_quality_region": quality("region"),
    "network_quality_pop": quality("pop"),
    "quality_countries": f"SELECT DISTINCT country FROM logs WHERE {_GEO}",
    "transport_metrics": f"SELECT {_PROTO} AS protocol, count(*) AS requests, {q('tcp_rtt', 0.5)} AS rtt_p50_ms, {q('tcp_rtt', 0.9)} AS rtt_p90_ms, {q('tcp_rtt', 0.95)} AS rtt_p95_ms, {q('tcp_rtt', 0.99)} AS rtt_p99_ms, round(avg(retrans), 6) AS avg_retrans, round(avg(ploss), 6) AS avg_loss, round(median(delivery_rate) * 8 / 1000000.0, 6) AS delivery_mbps FROM logs GROUP BY 1",
    "pop_health": f"SELECT pop, count(*) AS requests, {n('status = 0 OR status >= 400')} AS errors, {share('status = 0 OR status >= 400', digits=2)} AS error_rate, {q('tcp_rtt', 0.5, 1)} AS p50_rtt_us, round(quantile_cont(ttfb, 0.95) * 1000.0, 6) AS p95_ttfb_ms, {share("cache = 'HIT' OR cache = 'HIT-STALE'", digits=2)} AS cache_hit_rate, {big('resp_bytes')} AS bandwidth_bytes FROM logs WHERE pop <> '' GROUP BY 1",
    "perf_top_urls": _slow("url", "url", 5),
    "perf_top_asns": _slow("asn", "asn", 10),
    "ttl_dist": f"SELECT {_TTL} AS bucket, count(*) AS count, min(ttl) AS min_ttl FROM logs WHERE ttl IS NOT NULL GROUP BY 1",
    "latency_waterfall": """SELECT round(avg(CASE WHEN ttfb * 1000.0 > ottfb / 1000.0 THEN ttfb * 1000.0 - ottfb / 1000.0 ELSE 0.0 END), 6) AS edge_processing, round(avg(ottfb / 1000.0), 6) AS origin_wait,
  round(avg(CASE WHEN ottlb > ottfb THEN ottlb / 1000.0 - ottfb / 1000.0 ELSE 0.0 END), 6) AS origin_download,
  round(avg(greatest(0.0, elapsed / 1000.0 - CASE WHEN ottlb / 1000.0 > ttfb * 1000.0 THEN ottlb / 1000.0 ELSE ttfb * 1000.0 END)), 6) AS client_download FROM logs""",
    "fingerprint_top_n": fingerprints("ja4"),
    "fingerprint_top_n_ja3": fingerprints("ja3"),
    "fingerprint_coverage": "SELECT count(*) AS total_rows, sum(length(ja3) > 0)::BIGINT AS ja3_rows, sum(length(ja4) > 0)::BIGINT AS ja4_rows FROM logs",
    "req_header_sizes": f"SELECT {_HEADER} AS bucket, count(*) AS count, min(req_header_bytes) AS min_val FROM logs WHERE req_header_bytes IS NOT NULL GROUP BY 1",
    "top_ips_by_header": "SELECT ip, max(req_header_bytes) AS max_header FROM logs WHERE ip IS NOT NULL AND req_header_bytes IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "conn_reuse": "SELECT CASE WHEN conn_requests < 2 THEN '1 (None)' WHEN conn_requests < 6 THEN '2-5' WHEN conn_requests < 21 THEN '6-20' WHEN conn_requests < 101 THEN '21-100' ELSE '>100' END AS bucket, count(*) AS count, min(conn_requests) AS min_val FROM logs WHERE conn_requests > 0 GROUP BY 1",
    "ipv6_adoption_ts": f"SELECT {H} AS bucket, {share('is_ipv6')} AS ipv6_pct FROM logs GROUP BY 1",
    "proxy_type_dist": "SELECT p_type, count(*) AS count FROM logs WHERE length(p_type) > 0 GROUP BY 1",
    "top_uas": "SELECT ua, count(*) AS cnt FROM logs WHERE ua IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "proxy_connection_quality": f"SELECT CASE WHEN {_TUNNEL} THEN 'Active Tunnel / Proxy' WHEN tcp_rtt > 0 AND rtt_min / tcp_rtt < 0.7 THEN 'WiFi / Mobile' ELSE 'Direct Connection' END AS type, count(*) AS count FROM logs GROUP BY 1",
    "proxy_isps": f"SELECT asn, count(*) AS count FROM logs WHERE {_TUNNEL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "assets_summary": f"SELECT {_ASSET} AS asset_type, count(*) AS requests, {big('resp_bytes')} AS bytes, {share(_HIT)} AS hit_ratio, {share(_PACKED)} AS compression_rate, {n(_TEXTS)} AS compressible_requests, {share(_PACKED, _TEXTS)} AS compressible_rate FROM logs WHERE url IS NOT NULL GROUP BY 1",
    "assets_cache_matrix": f"SELECT {_ASSET} AS asset_type, cache, count(*) AS requests, {big('resp_bytes')} AS bytes FROM logs WHERE url IS NOT NULL GROUP BY 1, 2",
    "assets_encoding_matrix": f"SELECT {_ASSET} AS asset_type, {_ENC} AS encoding, count(*) AS requests, {big('resp_bytes')} AS bytes FROM logs WHERE url IS NOT NULL GROUP BY 1, 2",
    "large_uncompressed": f"SELECT url, count(*) AS requests, {big('resp_bytes')} AS bytes FROM logs WHERE resp_header_content_encoding = '' AND status = 200 AND resp_bytes >= 1024 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "low_ttl_assets": "SELECT url, count(*) AS requests, round(avg(ttl), 6) AS avg_ttl FROM logs WHERE ttl < 60 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "edge_ratio": f"SELECT {share('edge')} AS edge_pct FROM logs",
    "waf_flag_7d": f"SELECT {share("waf_sig <> ''")} AS waf_pct, {n("waf_sig <> ''")} AS flagged FROM logs WHERE is_w",
    "value_overview": f"SELECT {D} AS bucket, count(*) AS requests, {n(_HIT)} AS hits, {n(_MISS)} AS misses, {n(_PASS)} AS passes, {big('resp_bytes')} AS bytes, {big(f'CASE WHEN {_HIT} THEN resp_bytes END')} AS saved_bytes, {n('edge = false')} AS shield, {n("waf_sig <> '' AND waf_sig NOT LIKE 'VERIFIED%'")} AS threats FROM logs GROUP BY 1",
    "value_caching": f"SELECT {D} AS bucket, round({n(_HIT)} * 100.0 / nullif({n(_HIT)} + {n(_MISS)}, 0), 4) AS hit_ratio, {big(f'CASE WHEN {_HIT} THEN resp_bytes END')} AS saved_bytes, {big(f'CASE WHEN NOT {_HIT} THEN resp_bytes END')} AS origin_bytes FROM logs GROUP BY 1",
    "value_performance": f"SELECT {D} AS bucket, round(avg(CASE WHEN {_HIT} THEN elapsed END) / 1000.0, 6) AS hit_ms, round(avg(CASE WHEN {_MISS} THEN elapsed END) / 1000.0, 6) AS miss_ms FROM logs GROUP BY 1",
    "value_security": f"SELECT {D} AS bucket, {n("waf_sig <> ''")} AS flagged, {n('waf_resp = 406')} AS blocked, {n('waf_resp = 200')} AS passed FROM logs GROUP BY 1",
    "value_network": f"SELECT {D} AS bucket, {n("proto LIKE 'HTTP/1%'")} AS http1, {n("proto LIKE 'HTTP/2%'")} AS http2, {n("proto LIKE 'HTTP/3%'")} AS http3, {n("tls = 'TLSv1.3'")} AS tls13, {n('is_ipv6')} AS ipv6 FROM logs GROUP BY 1",
    "value_bots": f"SELECT {_BOT_NAME} AS token, count(*) AS requests, {n("waf_sig LIKE '%VERIFIED-BOT%'")} AS verified FROM logs WHERE {_BOT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "value_images": f"SELECT {D} AS bucket, count(*) AS requests, {big('resp_bytes')} AS bytes, {big('io_input_bytes - io_output_bytes')} AS io_saved FROM logs WHERE {_ASSET} = 'Images' GROUP BY 1",
    "image_compression": f"SELECT {D} AS bucket, {big('io_input_bytes')} AS input_bytes, {big('io_output_bytes')} AS output_bytes, round(sum(io_output_bytes) * 1.0 / sum(io_input_bytes), 6) AS ratio FROM logs WHERE io_input_bytes > 0 AND io_output_bytes IS NOT NULL GROUP BY 1",
    "image_formats": f"SELECT io_input_format, io_output_format, count(*) AS requests, {big('io_input_bytes - io_output_bytes')} AS saved_bytes, round(sum(io_output_bytes) * 1.0 / sum(io_input_bytes), 6) AS ratio FROM logs WHERE io_input_bytes > 0 AND io_output_bytes IS NOT NULL GROUP BY 1, 2",
    "cmcd_object_types": "SELECT cmcd_ot, count(*) AS request_count FROM logs WHERE cmcd_ot <> '' GROUP BY 1",
    "cmcd_formats": "SELECT cmcd_sf, count(DISTINCT cmcd_sid) AS session_count FROM logs WHERE cmcd_sf <> '' GROUP BY 1",
    "rum_vitals": f"SELECT metric_name, {q('metric_value', 0.75, 1)} AS p75, count(*) AS total_count, {n("metric_rating = 'good'")} AS good_count, {n("metric_rating = 'needs_improvement'")} AS ni_count, {n("metric_rating = 'poor'")} AS poor_count FROM vitals GROUP BY 1",
    "rum_exceptions": "SELECT error_message, error_file, error_line, error_col, count(*) AS count FROM errors GROUP BY ALL ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 3",
    "score_distribution": f"SELECT {H} AS hour, CASE WHEN edge_score >= 75 THEN '75-100' WHEN edge_score >= 50 THEN '50-75' WHEN edge_score >= 25 THEN '25-50' ELSE '0-25' END AS bucket, count(*) AS count FROM logs WHERE edge_score IS NOT NULL GROUP BY 1, 2",
    "cookie_compliance": f"SELECT {H} AS hour, edge_cookie_compliance AS compliance, count(*) AS count FROM logs WHERE edge_cookie_compliance <> '' GROUP BY 1, 2",
    "score_latency_ts": f"SELECT {H} AS hour, count(edge_score) AS scored_count, {n("lower(edge_score_reason) LIKE '%compute-unavailable%'")} AS fail_open_count, count(*) AS total_count, " + ", ".join(f"{q('edge_score_rtt_us', p / 100, 1)} AS rtt_p{p}_us" for p in (50, 95, 99)) + ", " + ", ".join(f"{q('edge_score_exec_us', p / 100, 1)} AS exec_p{p}_us" for p in (50, 95)) + " FROM logs WHERE edge OR edge_score IS NOT NULL GROUP BY 1",
    "session_l2_max": "SELECT edge_sid, max(edge_score_l2) AS l2_max FROM logs WHERE edge_score_l2 IS NOT NULL AND length(edge_sid) > 0 GROUP BY 1",
    "usage_bandwidth": f"SELECT {D} AS bucket, count(*) AS requests, CAST(sum(resp_bytes) + sum(req_bytes) AS BIGINT) AS bytes FROM logs GROUP BY 1",
    "usage_rum_breakdown": f"SELECT {D} AS bucket, count(DISTINCT req_id) AS beacons, count(*) AS rows FROM vitals GROUP BY 1",
    "coalesced_city": f"""SELECT city, region, country, {n('is_w')} AS w_cnt, {n('is_b')} AS b_cnt, {n('is_w AND status >= 400')} AS w_errors, {n('is_b AND status >= 400')} AS b_errors, {q('elapsed', 0.95, cond='is_w')} AS w_p95, {q('elapsed', 0.95, cond='is_b')} AS b_p95,
  count(CASE WHEN is_w THEN elapsed END) AS w_lat_total, count(CASE WHEN is_b THEN elapsed END) AS b_lat_total FROM logs WHERE city <> '' GROUP BY 1, 2, 3 HAVING {n('is_w')} >= 5""",
    "coalesced_url": "SELECT url, " + ", ".join(f"{n(f'is_{s} AND {c}')} AS {s}_{x}" for s in "wb" for x, c in (("total", "true"), ("5xx", "status >= 500"), ("hits", _HIT), ("miss", _MISS), ("pass", _PASS), ("lat_total", "elapsed IS NOT NULL")))
    + f", {q('elapsed', 0.95, cond='is_w')} AS w_p95, {q('elapsed', 0.95, cond='is_b')} AS b_p95, {q('elapsed', 0.99, cond='is_w')} AS w_p99, {q('elapsed', 0.5, cond='is_w')} AS w_p50, {n('is_w AND oretries > 0')} AS oret_w_cnt, max(CASE WHEN is_w THEN oretries END) AS oret_w_max FROM logs WHERE url IS NOT NULL GROUP BY 1 HAVING {n('is_w')} >= 3",
    "coalesced_ip_security": f"SELECT ip, {n('is_w')} AS w_total, {n('is_w AND status = 404')} AS w_404, count(DISTINCT CASE WHEN is_w AND status = 404 THEN url END) AS w_distinct_404, {n('is_b AND status = 404')} AS b_404, {n('is_w AND (status = 401 OR status = 403)')} AS w_denied, {n('is_b AND (status = 401 OR status = 403)')} AS b_denied FROM logs WHERE ip <> '' GROUP BY 1 HAVING {n('is_w')} > 0",
    "coalesced_ip_extended": f"SELECT ip, {n('is_w')} AS w_total, max(CASE WHEN is_w THEN req_header_bytes END) AS max_header, {q('req_header_bytes', 0.95, 1, 'is_b')} AS b_p95_header, max(CASE WHEN is_w THEN conn_requests END) AS max_conn, {q('conn_requests', 0.95, 1, 'is_b AND conn_requests > 0')} AS b_p95_conn, count(DISTINCT CASE WHEN is_w THEN cookie_session END) AS w_sessions, count(DISTINCT CASE WHEN is_b THEN cookie_session END) AS b_sessions FROM logs WHERE ip <> '' GROUP BY 1 HAVING {n('is_w')} > 0",
    "coalesced_asn": f"SELECT asn, {n('is_w')} AS w_cnt, {n('is_b')} AS b_cnt, {n("is_w AND p_type = 'hosting'")} AS w_hosting, {n("is_b AND p_type = 'hosting'")} AS b_hosting, round(avg(CASE WHEN is_w THEN ploss END), 6) AS w_ploss, round(avg(CASE WHEN is_b THEN ploss END), 6) AS b_ploss, {q('rtt_var', 0.95, 1, 'is_w')} AS w_jitter, {q('rtt_var', 0.95, 1, 'is_b')} AS b_jitter FROM logs WHERE asn IS NOT NULL GROUP BY 1",
    "coalesced_scalar": "SELECT " + ", ".join(f"{n(f'is_{s} AND {c}')} AS {s}_{x}" for s in "wb" for x, c in (("total", "true"), ("hits", _HIT), ("miss", _MISS), ("quic", "transport = 'quic'"), ("ost_5xx", "ost >= 500"))) + f", {q('oconnect_ms', 0.95, 1, 'is_w')} AS w_conn, {q('oconnect_ms', 0.95, 1, 'is_b')} AS b_conn FROM logs",
    "rollup_proxy_quality": f"SELECT {H} AS hour, {_TUNNEL} AS tunnel, count(*) AS count, count(DISTINCT ip) AS ips FROM logs GROUP BY 1, 2",
    "rollup_wellknown_bots": f"SELECT {H} AS hour, {_BOT_NAME} AS bot, count(*) AS requests, count(DISTINCT ip) AS ips FROM logs WHERE {_BOT} GROUP BY 1, 2",
    "bench_country_rollup": f"SELECT country, count(*) AS requests, {n('status >= 500')} AS errors, round(avg(ottfb), 6) AS avg_ottfb, {q('resp_bytes', 0.95, 1)} AS p95_bytes FROM logs GROUP BY 1",
}
