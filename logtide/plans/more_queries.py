"""Registered queries of the column functions, of rollup upkeep and of the remaining operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import analytics as A
from ..operators import bots as B
from ..operators import detections as D
from ..operators import more as M
from ..operators.reads import HOUR
from ..sources.request_log import CTES, rum_vitals
from .read_sql import SQL

Frame = Callable[[DataFrame], DataFrame]


def entries(pops: Callable, pops_sql: str) -> dict[str, tuple[Frame, str | None]]:
    n_rows = lambda: F.count("*").alias("n")
    out: dict[str, tuple[Frame, str | None]] = {}
    by = lambda make: lambda x: x.groupBy(make().alias("value")).agg(n_rows())
    grouped = lambda sql: f"{CTES} SELECT {sql} AS value, count(*) AS n FROM logs GROUP BY 1"
    ending = "split_part(split_part(lower(url), '?', 1), '.', -1)"
    # Real endings are rare in the log: each stands behind the URL of some rows.
    odd = ["a.PNG", "b.tar.gz", "c.mjs?v=1", "d.x/e.js", "f.otf", "g.m4s", "h.html", "i", "j.", "k.ico", "l.csv", "m.webm"]
    ended = lambda: F.concat("url", F.get(F.array(*[F.lit(x) for x in odd]), (F.col("event_id") % 12).cast("int")))
    kinds = ["Images", "Documents", "API/Dynamic", "JavaScript/CSS", "Fonts", "Video", "API/Dynamic", None, "API/Dynamic", "Images", "Documents", "Video"]
    # Row 8 (``i``) keeps the ending that its URL has: an image's or a script's ending with an i behind it is none.
    told = "[" + ", ".join(f"'{k or 'API/Dynamic'}'" for k in kinds) + "][event_id % 12 + 1]"
    out["asset_type"] = by(lambda: X.asset_type(ended())), grouped(told)
    out["encoding_norm"] = by(lambda: X.encoding_norm(F.col("resp_header_content_encoding"))), grouped("CASE WHEN resp_header_content_encoding = 'gzip' THEN 'gzip' ELSE 'uncompressed' END")
    out["proto_label"] = by(lambda: X.proto_label(F.col("proto"))), grouped("left(proto, 6)")
    out["proto_flags"] = (lambda x: x.select(*X.proto_flags(F.col("proto"))).agg(*[F.sum(f"is_http{v}").alias(f"http{v}") for v in (1, 2, 3)])), f"{CTES} SELECT count(*) FILTER (proto = 'HTTP/1.1') AS http1, count(*) FILTER (proto = 'HTTP/2') AS http2, count(*) FILTER (proto = 'HTTP/3') AS http3 FROM logs"
    out["size_histogram"] = X.size_histogram, f"{CTES} {SQL['req_header_sizes']}"
    out["conn_histogram"] = X.conn_histogram, f"{CTES} {SQL['conn_requests_hist']}"
    out["ttl_histogram"] = (lambda x: X.ttl_histogram(x).withColumnRenamed("min_val", "min_ttl")), f"{CTES} {SQL['ttl_dist']}"
    out["duration_histogram"] = (lambda x: X.duration_histogram(x.groupBy("cmcd_sid").agg((F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))).alias("us")).withColumn("dur", F.col("us") / 1e6)).select("bucket", "count")), f"{CTES}, d AS (SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS d FROM logs GROUP BY cmcd_sid) SELECT CASE WHEN d <= 30 THEN '<30s' WHEN d <= 120 THEN '30s-2m' WHEN d <= 300 THEN '2-5m' WHEN d <= 600 THEN '5-10m' WHEN d <= 1800 THEN '10-30m' WHEN d <= 3600 THEN '30m-1h' ELSE '>1h' END AS bucket, count(*) AS count FROM d GROUP BY 1"
    out["ua_crawler_token"] = by(lambda: X.ua_crawler_token(F.col("ua"))), grouped("CASE WHEN ua LIKE 'Googlebot%' THEN 'googlebot' WHEN ua LIKE 'GPTBot%' THEN 'gptbot' WHEN ua LIKE 'python%' THEN 'python-requests' ELSE '' END")
    out["ua_chrome_major"] = by(lambda: X.ua_chrome_major(F.col("ua"))), grouped("TRY_CAST(nullif(regexp_extract(ua, 'Chrome/([0-9]+)\\.', 1), '') AS INTEGER)")
    out["referer_domain"] = by(lambda: X.referer_domain(F.col("referer"))), grouped("CASE WHEN referer LIKE '%google%' THEN 'google' WHEN referer LIKE '%news%' THEN 'news' END")
    out["fetcher_stem"] = by(lambda: X.fetcher_stem(F.col("ua"))), grouped("CASE WHEN ua LIKE '%ChatGPT-User%' THEN 'chatgpt' END")
    out["url_flags"] = (lambda x: X.url_flags(x, {"is_probe": D.PROBE, "is_auth": D.AUTH, "is_comp": D.COMPRESS}).groupBy("is_probe", "is_auth", "is_comp").agg(n_rows())), f"{CTES} SELECT regexp_matches(url, '{D.PROBE}') AS is_probe, regexp_matches(url, '{D.AUTH}') AS is_auth, regexp_matches(url, '{D.COMPRESS}') AS is_comp, count(*) AS n FROM logs GROUP BY 1, 2, 3"
    out["city_label"] = by(lambda: X.city_label()), grouped("concat_ws(', ', city, region, country)")
    out["origin_latency_us"] = (lambda x: x.select(X.origin_latency_us().alias("v")).agg(F.sum("v").cast("long").alias("total"), F.count("v").alias("n"))), f"{CTES} SELECT CAST(sum(coalesce(ottfb, ttfb * 1000000)) AS BIGINT) AS total, count(*) AS n FROM logs"
    out["metric_expr"] = (lambda x: x.groupBy("pop").agg(*[X.metric_expr(m, (503,)) for m in ("rate_5xx", "hit_rate", "latency_p95", "specific_status")])), f"{CTES} SELECT pop, round(CAST(count(*) FILTER (status >= 500) * 100.0 / count(*) AS DOUBLE), 4) AS rate_5xx, round(CAST(count(*) FILTER (cache ILIKE 'HIT%') * 100.0 / count(*) AS DOUBLE), 4) AS hit_rate, round(quantile_cont(elapsed, 0.95) / 1000.0, 6) AS latency_p95, count(*) FILTER (status = 503) AS specific_status FROM logs GROUP BY 1"
    out["network_health_score"] = (lambda x: x.groupBy("asn").agg(F.avg("ploss").alias("l"), F.expr("percentile(tcp_rtt - rtt_min, 0.5)").alias("c"), F.expr("percentile(rtt_var, 0.5)").alias("j"), (F.count_if(F.col("status") >= 500) * 100.0 / F.count("*")).alias("e")).select("asn", F.round(X.network_health_score(F.col("l"), F.col("c"), F.col("j"), F.col("e")), 4).alias("health"))), f"{CTES}, g AS (SELECT asn, avg(ploss) AS l, quantile_cont(tcp_rtt - rtt_min, 0.5) AS c, quantile_cont(rtt_var, 0.5) AS j, count(*) FILTER (status >= 500) * 100.0 / count(*) AS e FROM logs GROUP BY 1) SELECT asn, round(CAST(100 * (1 - (0.4 * least(l / 0.05, 1) + 0.3 * least(c / 100000, 1) + 0.2 * least(j / 50000, 1) + 0.1 * least(e / 10, 1))) AS DOUBLE), 4) AS health FROM g"
    out["geo_fallback"] = (lambda x: X.geo_fallback(x.withColumn("lat", F.when(F.col("event_id") % 2 == 0, F.col("lat"))).withColumn("lon", F.lit(None).cast("double")), pops(x.sparkSession)).groupBy("lat", "lon").agg(n_rows())), f"{CTES} SELECT CASE WHEN event_id % 2 = 0 THEN lat ELSE pop_lat END AS lat, pop_lon AS lon, count(*) AS n FROM logs JOIN {pops_sql} USING (pop) GROUP BY 1, 2"
    out["asn_label"] = (lambda x: X.asn_label(x, x.filter("asn < 64505").select("asn", F.concat(F.lit("AS"), F.col("asn")).alias("name")).distinct()).groupBy("asn_label").agg(n_rows())), f"{CTES} SELECT CASE WHEN asn < 64505 THEN concat('AS', asn) ELSE CAST(asn AS VARCHAR) END AS asn_label, count(*) AS n FROM logs GROUP BY 1"
    out["resolve_window"] = (lambda x: X.resolve_window(x).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"))), f"{CTES}, m AS (SELECT to_timestamp(ceil(floor(epoch(max(timestamp))) / 60) * 60) AS e FROM logs) SELECT strftime(e - INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS \"end\" FROM m"
    out["proxy_analysis"] = (lambda x: M.proxy_analysis(x, pops(x.sparkSession))), f"""{CTES}, d AS (SELECT *, 2 * 6371 * asin(sqrt(power(sin(radians(lat - pop_lat) / 2), 2) + cos(radians(lat)) * cos(radians(pop_lat)) * power(sin(radians(lon - pop_lon) / 2), 2))) > rtt_min / 1000.0 * 100 + 150 AS far, rtt_min / tcp_rtt AS ratio FROM logs JOIN {pops_sql} USING (pop))
SELECT CASE WHEN far OR ratio < 0.1 THEN 'High' ELSE 'Medium' END AS risk, count(*) AS requests, count(DISTINCT ip) AS ips, count(*) FILTER (far) AS impossible FROM d WHERE far OR ratio < 0.2 GROUP BY 1"""
    out["cache_collapse_detail"] = (lambda x: M.cache_collapse_detail(x, "/click/item/10")), f"{CTES}, r AS (SELECT *, starts_with(cache, 'HIT') AS hit FROM logs WHERE url = '/click/item/10' AND (starts_with(cache, 'HIT') OR starts_with(cache, 'MISS'))), b AS (SELECT count(*) FILTER (hit) * 1.0::DOUBLE / count(*) AS rate FROM r WHERE is_b) SELECT {HOUR} AS hour, count(*) AS cacheable, count(*) FILTER (hit) AS hits, round(count(*) * max(rate), 4) AS expected_hits FROM r, b GROUP BY 1"
    out["session_detail"] = (lambda x: M.session_detail(A.with_sessions(x, ["ip"], 86400), {"ip": "10.1.5.21"}, 1).select("rid", "url", "status")), f"{CTES}, l AS (SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (ORDER BY timestamp, rid) AS quiet FROM logs WHERE ip = '10.1.5.21'), n AS (SELECT *, count(*) FILTER (quiet > 86400000000) OVER (ORDER BY timestamp, rid ROWS UNBOUNDED PRECEDING) AS breaks FROM l) SELECT rid, url, status FROM n WHERE breaks = 0 ORDER BY timestamp, rid LIMIT 500"
    out["events_per_session_cap"] = (lambda x: M.events_per_session_cap(x, 20).groupBy("edge_sid").agg(n_rows(), F.max("rid").alias("last"))), f"{CTES}, r AS (SELECT edge_sid, rid FROM logs QUALIFY row_number() OVER (PARTITION BY edge_sid ORDER BY timestamp, rid) <= 20) SELECT edge_sid, count(*) AS n, max(rid) AS last FROM r GROUP BY 1"
    out["share_of_total"] = (lambda x: M.share_of_total(x.groupBy("country").agg(F.count("*").alias("count")))), f"{CTES} SELECT country, count(*) AS count, round(CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM logs GROUP BY 1"
    out["rank_two_ways"] = (lambda x: M.rank_two_ways(x.groupBy("url").agg(F.count("*").alias("n"), F.sum("resp_bytes").alias("bytes")), "n", "bytes", 5, ["url"])), f"{CTES}, g AS (SELECT url, count(*) AS n, CAST(sum(resp_bytes) AS BIGINT) AS bytes FROM logs GROUP BY 1) SELECT * FROM g QUALIFY row_number() OVER (ORDER BY n DESC, url) <= 5 OR row_number() OVER (ORDER BY bytes DESC, url) <= 5"
    out["top_k_per_group"] = (lambda x: M.top_k_per_group(x.groupBy("country", "url").agg(F.count("*").alias("n")), ["country"], [F.desc("n"), "url"], 3)), f"{CTES}, g AS (SELECT country, url, count(*) AS n FROM logs GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, url) AS rank FROM g QUALIFY rank <= 3"
    out["loss_runs"] = (lambda x: M.loss_runs(x.groupBy((F.unix_timestamp(F.col("timestamp").cast("timestamp")) / 3600).cast("long").alias("n")).agg(F.count_if(F.col("status") >= 500).alias("bad")), "bad > 0")), f"{CTES}, h AS (SELECT epoch_us(timestamp) // 3600000000 AS n, count(*) FILTER (status >= 500) AS bad FROM logs GROUP BY 1), i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS i FROM h WHERE bad > 0) SELECT min(n) AS start, count(*) AS length FROM i GROUP BY i"
    out["weighted_percentiles"] = (lambda x: M.weighted_percentiles(x.filter("coalesce(ottfb, ttfb * 1e6) IS NOT NULL").groupBy(F.expr(HOUR).alias("hour"), "pop").agg(F.count("*").alias("weight"), F.expr("round(percentile(coalesce(ottfb, ttfb * 1000000), 0.95) / 1000.0, 6)").alias("p95_ms")), ["pop"], "p95_ms")), f"{CTES}, h AS (SELECT {HOUR} AS hour, pop, count(*) AS weight, round(quantile_cont(coalesce(ottfb, ttfb * 1000000), 0.95) / 1000.0, 6) AS p95_ms FROM logs GROUP BY 1, 2) SELECT pop, round(sum(p95_ms * weight) / sum(weight), 6) AS p95_ms, CAST(sum(weight) AS BIGINT) AS weight FROM h GROUP BY 1"
    out["insufficient_baseline"] = (lambda x: M.insufficient_baseline(x, "2024-01-24 00:00:00", 552)), f"{CTES}, h AS (SELECT round((epoch(TIMESTAMP '2024-01-24 00:00:00') - floor(epoch(min(timestamp)))) / 3600.0, 4) AS hours FROM logs) SELECT CAST(hours AS DOUBLE) AS hours, hours < 552 AS insufficient FROM h"
    out["alert_cooldown"] = (lambda x: M.alert_cooldown(x.filter("status >= 500").select(F.col("pop").alias("name"), F.col("timestamp").cast("timestamp").alias("at")), 86400).groupBy("name").agg(n_rows())), CTES.replace("WITH", "WITH RECURSIVE", 1) + ", a AS (SELECT DISTINCT pop AS name, epoch_us(timestamp) // 1000000 AS t FROM logs WHERE status >= 500), r AS (SELECT name, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT a.name, min(a.t) AS t FROM r JOIN a ON a.name = r.name AND a.t >= r.t + 86400 GROUP BY a.name) SELECT name, count(*) AS n FROM r GROUP BY 1"
    out["rum_header_stats"] = (lambda x: rum_vitals(x).groupBy("browser").agg(F.countDistinct("req_id").alias("beacons"), F.max("timestamp").cast("string").alias("newest"))), f"{CTES} SELECT browser, count(DISTINCT req_id) AS beacons, CAST(max(timestamp) AS VARCHAR) AS newest FROM vitals GROUP BY 1"
    bots = lambda x: x.sparkSession.sql("SELECT * FROM VALUES ('Googlebot', 'googlebot', 'google.com'), ('GPTBot', 'gptbot', 'openai.com'), ('ChatGPT', 'chatgpt', NULL) AS t(bot, pattern, host_suffix)")
    # An address in two feeds, an IPv6 range, a range that cuts a digit, and one that is no range.
    feeds = lambda x: x.sparkSession.sql("SELECT * FROM VALUES ('Googlebot', '10.0.0.0/16'), ('GPTBot', '10.0.0.0/17'), ('GPTBot', '2001:db8:1::/47'), ('ChatGPT', '10.2.0.0/15'), ('GPTBot', '10.1.x/33') AS t(feed, cidr)")
    # A group of an address has four digits at most: larger user numbers take two groups.
    v6 = lambda: F.concat(F.lit("2001:DB8:"), F.col("user_id") % 4, F.lit("::"), F.hex(F.shiftright("user_id", 16)), F.lit(":"), F.hex(F.col("user_id").bitwiseAND(65535)))
    address = lambda x: x.withColumn("ip", F.when((F.col("user_id") % 7 == 0) & F.col("ua").startswith("GPTBot"), v6()).otherwise(F.col("ip")))
    host = lambda: F.get(F.array(*[F.lit(h) for h in ("crawl.google.com", "evilgoogle.com", "google.com", "x.openai.com", "openai.com.evil.example")]), (F.col("user_id") % 6).cast("int"))
    status = lambda: F.when(F.col("user_id") % 11 == 0, "pending").when(F.col("user_id") % 11 == 1, "nxdomain").otherwise("ok")
    hosts = lambda x: address(x).filter("user_id % 5 > 0").groupBy("ip").agg(F.min("user_id").alias("user_id")).select("ip", host().alias("host"), status().alias("status"), (F.col("user_id") % 13 > 0).alias("fcrdns"))
    out["wellknown_bots"] = (lambda x: B.wellknown_bots(B.enrich_bots(address(x), bots(x), feeds(x), hosts(x)))), f"""{CTES}, l AS (SELECT * REPLACE (CASE WHEN user_id % 7 = 0 AND ua LIKE 'GPTBot%' THEN concat('2001:DB8:', user_id % 4, '::', printf('%X', user_id)) ELSE ip END AS ip) FROM logs),
u AS (SELECT ip, min(user_id) AS u FROM l WHERE user_id % 5 > 0 GROUP BY 1), h AS (SELECT ip, ['crawl.google.com', 'evilgoogle.com', 'google.com', 'x.openai.com', 'openai.com.evil.example'][u % 6 + 1] AS host, u % 11 AS st, u % 13 > 0 AS back FROM u),
b AS (SELECT ip, ua, CASE WHEN ua LIKE 'Googlebot%' THEN 'Googlebot' WHEN ua LIKE 'GPTBot%' THEN 'GPTBot' ELSE 'ChatGPT' END AS bot_name FROM l WHERE ua LIKE 'Googlebot%' OR ua LIKE 'GPTBot%' OR ua LIKE '%ChatGPT%'),
s AS (SELECT bot_name, CASE
  WHEN bot_name = 'Googlebot' AND ip LIKE '10.0.%' OR bot_name = 'GPTBot' AND ip LIKE '10.0.%' AND CAST(split_part(ip, '.', 3) AS INTEGER) < 128 OR bot_name = 'GPTBot' AND (ip LIKE '2001:DB8:0:%' OR ip LIKE '2001:DB8:1:%') OR bot_name = 'ChatGPT' AND (ip LIKE '10.2.%' OR ip LIKE '10.3.%') THEN 'verified'
  WHEN bot_name = 'ChatGPT' THEN 'unverified' WHEN h.ip IS NULL OR st = 0 THEN 'pending' WHEN st = 1 OR host IS NULL OR NOT back THEN 'impersonator'
  WHEN bot_name = 'Googlebot' AND (host = 'google.com' OR host LIKE '%.google.com') OR bot_name = 'GPTBot' AND (host = 'openai.com' OR host LIKE '%.openai.com') THEN 'verified' ELSE 'impersonator' END AS st FROM b LEFT JOIN h USING (ip))
SELECT bot_name, count(*) FILTER (st = 'verified') AS verified, count(*) FILTER (st = 'impersonator') AS impersonator, count(*) FILTER (st = 'unverified') AS unverified, count(*) FILTER (st = 'pending') AS pending FROM s GROUP BY 1"""
    out["io_usage"] = (lambda x: M.io_usage(x, M.io_tiers(x.sparkSession, 100, ((150, 5.0), (180, 3.0), (None, 1.0))))), f"""{CTES}, m AS (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS requests, count(io_output_format) AS transforms, CAST(coalesce(sum(io_input_bytes - io_output_bytes), 0) AS BIGINT) AS saved_bytes FROM logs GROUP BY 1)
SELECT *, round(transforms * 100.0 / requests, 4) AS traffic_pct, round((greatest(0, least(transforms, 150) - 100) * 5.0 + greatest(0, least(transforms, 180) - 150) * 3.0 + greatest(0, transforms - 180)) / 10000, 6) AS cost FROM m"""
    out["top_bots"] = B.top_bots, f"{CTES}, t AS (SELECT CASE WHEN ua LIKE 'Googlebot%' THEN 'googlebot' WHEN ua LIKE 'GPTBot%' THEN 'gptbot' END AS token, resp_bytes FROM logs), u AS (SELECT CAST(sum(resp_bytes) AS BIGINT) AS site FROM t) SELECT token, count(*) AS requests, CAST(sum(resp_bytes) AS BIGINT) AS bytes, round(CAST(sum(resp_bytes) * 100.0 / max(site) AS DOUBLE), 4) AS bytes_pct FROM t, u WHERE token IS NOT NULL GROUP BY 1"
    return out
