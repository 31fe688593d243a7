"""Registered queries of the network reports, shared scans, bot tables, minute facts and browser rollup, with SQL
written out for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import network as N
from ..operators import shared_scans as C
from ..operators.reads import HOUR, READS
from ..operators.rollups import ROLLUPS
from ..sources.request_log import CTES, rum_errors, rum_vitals
from .read_sql import D, H, M, n, share

Frame = Callable[[DataFrame], DataFrame]

_HEALTH = "round(100.0 - (40 * least({loss} / 0.05, 1) + 30 * least({congestion} / 100000.0, 1) + 20 * least({jitter} / 50000.0, 1) + 10 * least({errors} / 10.0, 1)), 4)"
_PATH_HEALTH = _HEALTH.format(loss="coalesce(avg_ploss, 0)", congestion="coalesce(rtt_congestion_us, 0)", jitter="coalesce(rtt_jitter_us, 0)", errors="error_pct")
_PLACE_HEALTH = "round(100.0 - (40 * least(coalesce(avg_ploss, 0) / 0.05, 1) + 10 * least(error_pct / 10.0, 1)), 4)"
_PATH = """round(median(CASE WHEN cache LIKE '%HIT%' AND elapsed > 0 THEN resp_bytes * 1000000.0 / elapsed END), 6) AS throughput_bps, round(median(tcp_rtt), 6) AS rtt_med_us, round(median(rtt_min), 6) AS rtt_baseline_us,
  round(median(tcp_rtt - rtt_min), 6) AS rtt_congestion_us, round(avg(ploss), 6) AS avg_ploss, round(median(rtt_var), 6) AS rtt_jitter_us"""
_ERR = "round(count(CASE WHEN status >= 500 THEN 1 END) * 100.0 / count(*), 4) AS error_pct"
_PLACE = f"round(median(tcp_rtt), 6) AS rtt_med_us, round(avg(ploss), 6) AS avg_ploss, {_ERR}, count(*) AS reqs"
_QUARTER_HOUR = "CAST(time_bucket(INTERVAL 15 MINUTES, timestamp) AS VARCHAR)"
_BOARD = f"""bt AS (SELECT asn, count(*) AS total_reqs FROM logs WHERE tcp_rtt > 0 AND asn IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), bf AS (SELECT logs.* FROM logs JOIN bt USING (asn) WHERE tcp_rtt > 0),
bc AS (SELECT asn, {_QUARTER_HOUR} AS bucket, {_PATH}, {_ERR} FROM bf GROUP BY 1, 2), bh AS (SELECT *, {_PATH_HEALTH} AS health, row_number() OVER (PARTITION BY asn ORDER BY bucket) AS first, row_number() OVER (PARTITION BY asn ORDER BY bucket DESC) AS last, count(*) OVER (PARTITION BY asn) AS n FROM bc),
bs AS (SELECT asn, max(CASE WHEN last = 1 THEN health END) AS health_now, round(avg(CASE WHEN last <= 4 THEN health END), 1) AS health_hour, round(avg(CASE WHEN first <= greatest(1, n // 4) THEN health END), 1) AS health_early, round(avg(rtt_med_us) / 1000.0, 1) AS rtt_ms FROM bh GROUP BY 1),
bx AS (SELECT asn, string_agg(part, ',' ORDER BY part) AS speed_mix FROM (SELECT asn, concat(c_speed, '=', printf('%.3f', round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY asn), 3))) AS part FROM bf WHERE c_speed <> '' GROUP BY asn, c_speed) GROUP BY 1),
board AS (SELECT asn, total_reqs, (SELECT round(quantile_cont(tcp_rtt, 0.95), 6) FROM bf WHERE bf.asn = bt.asn) AS p95_us, (SELECT round(quantile_cont(tcp_rtt, 0.99), 6) FROM bf WHERE bf.asn = bt.asn) AS p99_us, health_now, health_hour, health_early, rtt_ms,
  CASE WHEN health_now - health_hour < -5 THEN 'degrading' WHEN health_now - health_hour > 5 THEN 'improving' ELSE 'stable' END AS trend, speed_mix FROM bt JOIN bs USING (asn) LEFT JOIN bx USING (asn))"""
_MAP = f"m AS (SELECT country, city, lat, lon, metro, {D} || ' 00:00:00' AS bucket, {_PLACE} FROM logs WHERE tcp_rtt > 0 AND country <> '' GROUP BY ALL ORDER BY reqs DESC, country, city, lat, lon, metro, bucket LIMIT 5000)"
_BOTS = "b AS (SELECT DISTINCT waf_req_id, concat('bot', event_id % 50 % 5) AS bot_name, concat('known', event_id % 50 % 3) AS wellknown_bot_name, CASE WHEN event_id % 50 < 25 THEN 'search' ELSE 'ai' END AS category FROM logs)"


def _bots(logs: DataFrame) -> DataFrame:
    code = F.col("event_id") % 50
    return logs.select(
        "waf_req_id", F.concat(F.lit("bot"), code % 5).alias("bot_name"), F.concat(F.lit("known"), code % 3).alias("wellknown_bot_name"), F.when(code < 25, "search").otherwise("ai").alias("category")
    ).distinct()


#: Dimensions, measure and flag of the minute facts, written out for the comparison.
_FACTS = {
    "origin": (("pop", "edge"), "ottfb", "ost > 499"),
    "performance": (("url",), "elapsed", "status > 499"),
    "network": (("asn", "country"), "tcp_rtt", "ploss > 0.01"),
    "security": (("ja4",), "req_header_bytes", "length(waf_sig) > 0"),
    "cmcd": (("cmcd_cid",), "cmcd_mtp", "cmcd_bs"),
    "request": (("method", "status"), "resp_bytes", "status > 399"),
}
_RUM_DIMS = ("metric_name", "metric_rating", "browser", "os", "device", "pathname", "country", "city", "pop")
_RUM_ERROR_DIMS = ("error_message", "error_file", "pathname")
_DIMS = (("country",), ("p_type",), ("method",), ("c_type", "c_speed"), ("ost",), ("oip",), ("referer",), ("ua",))


def _facts_sql(family: str, minutes: bool = False) -> str:
    dims, measure, flag = _FACTS[family]
    named = [f"{M} AS minute"] * minutes + [f"coalesce(CAST({d} AS VARCHAR), '') AS {d}" for d in dims]
    by = ", ".join(["minute"] * minutes + list(dims))
    return f"""{CTES}, s AS (SELECT {', '.join(named)}, CASE WHEN {measure} > 0 THEN CAST(ceil(ln({measure}) / ln(1.02::DOUBLE)) AS INTEGER) END AS c, count(*) AS k, count(CASE WHEN {flag} THEN 1 END) AS f, sum({measure}) AS t FROM logs GROUP BY ALL),
r AS (SELECT *, sum(k) OVER (PARTITION BY {by} ORDER BY c) AS upto, sum(k) OVER (PARTITION BY {by}) AS every FROM s WHERE c IS NOT NULL), v AS (SELECT {by}, min(c) AS c FROM r WHERE upto >= every * 0.95 GROUP BY ALL),
a AS (SELECT {by}, CAST(sum(k) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS flagged, round(CAST(sum(t) AS DOUBLE), 3) AS total FROM s GROUP BY ALL)
SELECT a.*, round(power(1.02::DOUBLE, v.c) * 2 / 2.02, 6) AS value FROM a LEFT JOIN v USING ({by})"""


def _minute_facts(logs: DataFrame) -> DataFrame:
    """All families by minute, as they are stored."""
    parts, tasks = [], C.fact_tasks(logs)
    for family, (dims, _, _) in C.FACTS.items():
        rows = C.merge_facts(C.minute_facts(logs, family, tasks=tasks), ["minute", *dims], 0.95)
        parts.append(rows.select(F.lit(family).alias("family"), "minute", F.concat_ws("/", *dims).alias("key"), "n", "flagged", "total", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _all_facts(logs: DataFrame) -> DataFrame:
    """All families, one row for each and dimension."""
    parts, tasks = [], C.fact_tasks(logs)
    for family, (dims, _, _) in C.FACTS.items():
        merged = C.merge_facts(C.minute_facts(logs, family, tasks=tasks), list(dims), 0.95)
        parts.append(merged.select(F.lit(family).alias("family"), F.concat_ws("/", *dims).alias("key"), "n", "flagged", "total", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rum_sql() -> str:
    parts = [f"SELECT {H} AS hour, '{d}' AS dim, coalesce(CAST({d} AS VARCHAR), 'Unknown') AS value, count(DISTINCT req_id) AS beacons, count(*) AS rows, round(sum(metric_value), 4) AS value_sum, 'vital' AS kind FROM vitals GROUP BY 1, 3" for d in _RUM_DIMS]
    parts += [f"SELECT {H}, '{d}', coalesce(CAST({d} AS VARCHAR), 'Unknown'), count(DISTINCT req_id), count(*), 0.0, 'error' FROM errors GROUP BY 1, 3" for d in _RUM_ERROR_DIMS]
    return f"{CTES} " + " UNION ALL ".join(parts)


def _dims_sql() -> str:
    value = lambda d: " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in d)
    both = ", ".join(f"{n(f'is_{s} AND {c}')} AS {s}_{x}" for x, c in (("cnt", "true"), ("ost_known", "ost IS NOT NULL"), ("ost_5xx", "ost >= 500")) for s in "wb")
    return f"{CTES} " + " UNION ALL ".join(f"SELECT '{'+'.join(d)}' AS dim, {value(d)} AS value, {both} FROM logs GROUP BY 2" for d in _DIMS)


def _geo_sql() -> str:
    q = lambda c, p, cond: f"quantile_cont(CASE WHEN {cond} THEN {c} END, {p})"
    measures = f"""round({q('elapsed', 0.95, 'is_w')} / 1000.0, 6) AS w_p95, round({q('elapsed', 0.95, 'is_b')} / 1000.0, 6) AS b_p95, {n('is_w AND elapsed IS NOT NULL')} AS w_lat_total, {n('is_b AND elapsed IS NOT NULL')} AS b_lat_total,
  round({q('ottfb', 0.95, 'is_w AND elapsed IS NOT NULL')} / 1000.0, 0) AS w_ottfb_p95, {q('delivery_rate', 0.5, 'is_w AND delivery_rate > 0')} AS w_rate, {q('delivery_rate', 0.5, 'is_b AND delivery_rate > 0')} AS b_rate, {n('is_w AND delivery_rate > 0')} AS w_rate_total, {n('is_b AND delivery_rate > 0')} AS b_rate_total"""
    return f"{CTES} " + " UNION ALL ".join(f"SELECT '{c}' AS dim, CAST({c} AS VARCHAR) AS value, {measures} FROM logs WHERE {c} IS NOT NULL GROUP BY 2" for c in ("pop", "server_region", "metro"))


def _fp_sql() -> str:
    d = lambda c, cond: f"count(DISTINCT CASE WHEN {cond} THEN {c} END)"
    home = "p_type IS DISTINCT FROM 'hosting'"
    measures = f"{d('ip', 'is_w')} AS w_ips, {d('ip', 'is_b')} AS b_ips, {n('is_w')} AS w_reqs, {d('ip', f'is_w AND {home}')} AS w_home_ips, {d('asn', f'is_w AND {home}')} AS w_home_asns, {d('asn', f'is_b AND {home}')} AS b_home_asns"
    return f"{CTES} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {c} AS value, {measures} FROM logs WHERE {c} <> '' GROUP BY 2" for kind, c in (("fp", "ja4"), ("cipher", "tls_ciphers_sha")))


def _url_sql() -> str:
    small = "NOT regexp_matches(lower(coalesce(resp_header_content_encoding, '')), 'gzip|br|zstd|deflate')"
    sized = "status = 200 AND resp_bytes >= 1024"
    ttl = "is_w AND ttl > 0 AND hits IS NOT NULL AND age IS NOT NULL"
    from .detection_sql import PROBE, TEXT_FILE

    both = ", ".join(f"{n(f'is_{s} AND {c}')} AS {s}_{x}" for x, c in (("total", "true"), ("err", "status >= 400"), ("sized", sized), ("uncompressed", f"{sized} AND {small}")) for s in "wb")
    return f"""{CTES} SELECT url, {both}, {n('is_w AND status = 200')} AS w_ok, CAST(coalesce(sum(CASE WHEN is_w AND status = 200 THEN resp_bytes END), 0) AS BIGINT) AS w_ok_bytes, {n("is_w AND status = 200 AND ua ILIKE '%mobile%'")} AS w_mobile,
  {n(ttl)} AS ttl_cnt, round(avg(CASE WHEN {ttl} THEN ttl END), 6) AS avg_ttl, round(avg(CASE WHEN {ttl} THEN hits END), 6) AS avg_hits, round(avg(CASE WHEN {ttl} THEN age END), 6) AS avg_age, {n('is_w AND oretries > 0')} AS retry_cnt, max(CASE WHEN is_w THEN oretries END) AS retry_max,
  regexp_matches(lower(url), '{PROBE}') AS is_probe, regexp_matches(lower(url), '{TEXT_FILE}') AS is_text, regexp_matches(lower(url), '[.](jpg|jpeg|png|gif)') AS is_image FROM logs WHERE url IS NOT NULL GROUP BY url"""


_FAR = "2 * 6371 * asin(sqrt(power(sin(radians(lat - pop_lat) / 2), 2) + cos(radians(lat)) * cos(radians(pop_lat)) * power(sin(radians(lon - pop_lon) / 2), 2)))"
_CRAWLER = "(bot|crawler|spider|slurp|archiver|scraper|externalagent|extended|headless)"


def entries(pops: Callable, pops_sql: str) -> dict[str, tuple[Frame, str | None]]:
    out: dict[str, tuple[Frame, str | None]] = {}
    out["network_heatmap"] = N.network_heatmap, f"{CTES}, c AS (SELECT asn, {H} AS bucket, {_PATH}, {_ERR}, count(*) AS reqs FROM logs WHERE tcp_rtt > 0 AND asn IS NOT NULL GROUP BY 1, 2 ORDER BY reqs DESC, asn, bucket LIMIT 500) SELECT *, {_PATH_HEALTH} AS health FROM c"
    out["network_map"] = N.network_map, f"{CTES}, {_MAP} SELECT *, {_PLACE_HEALTH} AS health FROM m"
    out["metro_leaderboard"] = N.metro_leaderboard, f"""{CTES}, c AS (SELECT country, city, region, metro, {_PLACE} FROM logs WHERE tcp_rtt > 0 AND country <> '' GROUP BY 1, 2, 3, 4 ORDER BY reqs DESC, country, city, region, metro LIMIT 100), h AS (SELECT *, {_PLACE_HEALTH} AS health FROM c),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY metro ORDER BY reqs DESC, country, city, region) = 1), s AS (SELECT metro, CAST(sum(reqs) AS BIGINT) AS total_reqs, round(sum(health * reqs) / sum(reqs), 1) AS health_score, count(*) AS places FROM h GROUP BY 1)
SELECT metro, country, city, region, total_reqs, health_score, places FROM f JOIN s USING (metro)"""
    out["asn_leaderboard"] = N.asn_leaderboard, f"{CTES}, {_BOARD} SELECT * FROM board"
    out["network_summary"] = N.network_summary, f"""{CTES}, {_BOARD}, {_MAP}, t AS (SELECT count(*) AS total_reqs FROM logs WHERE tcp_rtt > 0), p AS (SELECT *, {_PLACE_HEALTH} AS health FROM m WHERE bucket = (SELECT max(bucket) FROM m) ORDER BY health, country, city LIMIT 1),
w AS (SELECT asn, health_now FROM board, t WHERE board.total_reqs > t.total_reqs * 0.01 ORDER BY health_now, asn LIMIT 1)
SELECT (SELECT total_reqs FROM t) AS total_reqs, (SELECT round(avg(health_now), 1) FROM board) AS global_health, (SELECT round(avg(rtt_ms), 1) FROM board) AS avg_rtt_ms, (SELECT asn FROM w) AS worst_asn, (SELECT health_now FROM w) AS worst_asn_health, (SELECT city || ', ' || country FROM p) AS worst_place, (SELECT health FROM p) AS worst_place_health"""
    out["threat_intel"] = lambda x: READS["threat_intel"].frame(x), f"""{CTES}, f AS (SELECT ja3, count(*) AS requests, {n("waf_sig <> ''")} AS matched_waf_rules_count, {share("ua ILIKE '%bot%'", digits=2)} AS bot_percentage, max(CASE WHEN p_type <> '' THEN 1 ELSE 0 END) AS is_anonymized_proxy FROM logs WHERE ja3 <> '' GROUP BY 1),
c AS (SELECT ja3, country AS top_country FROM logs WHERE ja3 <> '' AND country IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ja3 ORDER BY count(*) DESC, country) = 1)
SELECT ja3 AS tls_fingerprint, requests, top_country, matched_waf_rules_count, bot_percentage, is_anonymized_proxy FROM f LEFT JOIN c USING (ja3) ORDER BY requests DESC, ja3 LIMIT 50"""
    out["ngwaf_verified_bots"] = lambda x: A.waf_bots(x, _bots(x), ["bot_name", "wellknown_bot_name", "category"]), f"{CTES}, {_BOTS} SELECT bot_name, wellknown_bot_name, category, count(*) AS cnt FROM logs JOIN b USING (waf_req_id) GROUP BY 1, 2, 3"
    out["ngwaf_bots_ts"] = lambda x: A.waf_bots(x, _bots(x), [F.expr(HOUR).alias("bucket"), "bot_name"]), f"{CTES}, {_BOTS} SELECT {H} AS bucket, bot_name, count(*) AS cnt FROM logs JOIN b USING (waf_req_id) GROUP BY 1, 2"
    out["rollup_ngwaf_bots"] = lambda x: A.waf_bots(x, _bots(x), [F.expr(HOUR).alias("hour"), "bot_name", "category"]), f"{CTES}, {_BOTS} SELECT {H} AS hour, bot_name, category, count(*) AS cnt FROM logs JOIN b USING (waf_req_id) GROUP BY 1, 2, 3"
    out["rollup_ngwaf_bots_ts"] = lambda x: A.waf_bots(x, _bots(x), [F.expr("CAST(date_trunc('minute', timestamp) AS STRING)").alias("minute"), "bot_name"]), f"{CTES}, {_BOTS} SELECT {M} AS minute, bot_name, count(*) AS cnt FROM logs JOIN b USING (waf_req_id) GROUP BY 1, 2"
    out["coalesced_url_extended"] = C.url_extended, _url_sql()
    out["coalesced_fp"] = C.fingerprints, _fp_sql()
    out["coalesced_geo_latency"] = C.geo_latency, _geo_sql()
    out["coalesced_dim"] = C.dimensions, _dims_sql()
    for family in C.FACTS:
        out[f"rollup_minute_facts_{family}"] = lambda x, f=family: C.merge_facts(C.minute_facts(x, f), list(C.FACTS[f][0]), 0.95), _facts_sql(family)
    families = lambda minutes: " UNION ALL ".join(f"SELECT '{f}' AS family, {'minute, ' * minutes}concat_ws('/', {', '.join(_FACTS[f][0])}) AS key, n, flagged, total, value FROM ({_facts_sql(f, minutes)})" for f in _FACTS)
    out["rollup_minute_facts"] = _all_facts, families(False)
    out["rollup_minute_facts_minutes"] = _minute_facts, families(True)
    minutes = ROLLUPS["time_series"]
    sums = ["requests", "err4", "err5", "hits", "bytes"]
    start, end = "2024-01-10 03:17:21", "2024-01-12 22:41:09"
    out["exact_window"] = (
        lambda x: C.exact_window(minutes.build(x), x, start, end, sums, minutes.build),
        f"{CTES} SELECT count(*) AS requests, {n('status >= 400 AND status < 500')} AS err4, {n('status >= 500')} AS err5, {n("cache = 'HIT' OR cache = 'HIT-STALE'")} AS hits, CAST(coalesce(sum(resp_bytes), 0) AS BIGINT) AS bytes FROM logs WHERE timestamp BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'",
    )
    out["rollup_rum"] = lambda x: C.rollup_rum(rum_vitals(x), rum_errors(x)), _rum_sql()
    rate = "count(*) FILTER (WHERE status >= 500) * 100.0D / count(*)"
    out["alert_preview"] = (
        lambda x: C.alert_preview(x, rate),
        f"""{CTES}, e AS (SELECT date_trunc('hour', max(timestamp) - INTERVAL 168 HOURS) AS s FROM logs), h AS (SELECT date_trunc('hour', timestamp) AS hr, {n('status >= 500')} * 100.0::DOUBLE / count(*) AS value FROM logs GROUP BY 1),
b AS (SELECT hour(hr) AS hh, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS days FROM h, e WHERE hr < s GROUP BY 1)
SELECT CAST(hr AS VARCHAR) AS hour, round(value, 6) AS value, round(mean, 6) AS mean, days, round((value - mean) / (CASE WHEN coalesce(sd, 0) = 0 THEN 0.0001 ELSE sd END), 6) AS zscore FROM h LEFT JOIN b ON hour(hr) = hh, e WHERE hr >= s""",
    )
    out["proxy_clients"] = (
        lambda x: C.flagged_clients(x, pops(x.sparkSession)),
        f"""{CTES}, d AS (SELECT *, {_FAR} AS km FROM logs LEFT JOIN {pops_sql} USING (pop) WHERE ip <> '' AND rtt_min IS NOT NULL), g AS (SELECT *, coalesce(km > rtt_min / 1000.0 * 100 + 150, false) AS impossible, rtt_min / tcp_rtt AS ratio FROM d),
r AS (SELECT *, CASE WHEN impossible OR (tcp_rtt > 0 AND ratio < 0.1) THEN 3 WHEN tcp_rtt > 0 AND ratio < 0.2 THEN 2 ELSE 1 END AS place FROM g)
SELECT rid, ip, asn, pop, round(rtt_min / 1000.0, 2) AS rtt_min_ms, round(tcp_rtt / 1000.0, 2) AS tcp_rtt_ms, round(km, 1) AS distance_km, impossible, CASE place WHEN 3 THEN 'High' ELSE 'Medium' END AS risk, country, city FROM r WHERE place > 1 ORDER BY place DESC, km DESC NULLS LAST, rid LIMIT 100""",
    )
    out["bot_efficiency"] = (
        C.bot_efficiency,
        f"""{CTES}, u AS (SELECT ua, count(*) AS c, sum(resp_bytes) AS vol FROM logs WHERE ua <> '' GROUP BY 1), b AS (SELECT regexp_extract(lower(ua), '([a-z0-9]+?)[-]?{_CRAWLER}', 1) AS stem, CAST(sum(c) AS BIGINT) AS crawls, CAST(sum(vol) AS BIGINT) AS crawl_bytes FROM u WHERE regexp_matches(lower(ua), '{_CRAWLER}') GROUP BY 1),
p AS (SELECT CASE WHEN ua LIKE '%ChatGPT-User%' THEN 'chatgpt' ELSE regexp_extract(referer, '//(www[.])?([^/.]+)', 2) END AS stem, count(DISTINCT ip) AS referred FROM logs WHERE ip <> '' AND (referer <> '' OR ua LIKE '%-User%') AND NOT regexp_matches(lower(ua), '{_CRAWLER}') GROUP BY 1)
SELECT stem, crawls, crawl_bytes, coalesce(referred, 0) AS referred, round(crawl_bytes / greatest(coalesce(referred, 0), 1), 4) AS bytes_per_referral, round(crawl_bytes * 100.0 / (SELECT sum(resp_bytes) FROM logs), 4) AS share_pct FROM b LEFT JOIN p USING (stem)""",
    )
    out["cmcd_timeseries"] = (
        C.cmcd_timeseries,
        f"""{CTES}, r AS (SELECT *, date_trunc('hour', timestamp) AS hr FROM logs WHERE cmcd_sid IS NOT NULL), h AS (SELECT hr, count(DISTINCT cmcd_sid) AS viewers, round({n('cmcd_bs')} * 100.0 / count(*), 4) AS rebuffer_pct, round(avg(cmcd_bl), 6) AS avg_buffer, round(avg(cmcd_br), 6) AS avg_bitrate, median(cmcd_mtp) AS throughput, {n('cmcd_su')} AS startups FROM r GROUP BY 1),
f AS (SELECT hr, count(*) AS new_sessions FROM (SELECT cmcd_sid, min(hr) AS hr FROM r GROUP BY 1) GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(hr) FROM r), (SELECT max(hr) FROM r), INTERVAL 1 HOUR)) AS hr)
SELECT CAST(s.hr AS VARCHAR) AS bucket, coalesce(viewers, 0) AS viewers, coalesce(rebuffer_pct, 0) AS rebuffer_pct, coalesce(avg_buffer, 0) AS avg_buffer, coalesce(avg_bitrate, 0) AS avg_bitrate, coalesce(throughput, 0) AS throughput, coalesce(startups, 0) AS startups, coalesce(new_sessions, 0) AS new_sessions FROM s LEFT JOIN h USING (hr) LEFT JOIN f USING (hr)""",
    )
    out["io_stats_summary"] = lambda x: READS["io_stats_summary"].frame(x), f"{CTES} SELECT {D} AS day, io_output_format AS format, count(*) AS transforms, CAST(sum(io_output_bytes) AS BIGINT) AS bytes, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM logs WHERE io_output_format IS NOT NULL GROUP BY 1, 2"
    return out


