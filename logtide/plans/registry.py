"""Registered queries of the log analytics operators and the SQL they are compared with.

Every query reads the ``events`` table through the derived request log.  The comparison SQL of reports and detections
is written out in ``read_sql`` and ``detection_sql``, that of the other operators here and in ``more_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import detections as D
from ..operators.detect_all import DetectAll
from ..operators.reads import HOUR, READS
from ..operators.rollups import ROLLUPS
from . import detection_sql, extra_queries, ingest_queries, more_queries, read_sql, rollup_queries
from ..sources.request_log import BASELINE_HOURS, CTES, WINDOW_HOURS, request_log, rum_errors, rum_vitals

Query = Callable[[SparkSession, str], DataFrame]

#: Thresholds for the queries: the tables are small against the traffic that the defaults assume.
_EASIER = {
    "low_and_slow": {"paths_floor": 1},
    "credential_enumeration": {"least": 10},
    "content_discovery": {"least": 2, "share": 0.02, "urls": 2},
    "session_harvesting": {"least": 5},
    "stale_browser_version": {"least": 50, "factor": 0.5},
    "residential_fingerprint_dispersion": {"ips": 10, "asns": 2},
    "orphaned_deep_crawl": {"least": 10, "urls": 5},
    "tail_latency": {"ratio_floor": 2},
    "asn_concentration": {"floor": 0.05, "factor": 0.5, "plus": 0},
    "referer_monoculture": {"factor": 0.5},
    "asn_hosting_shift": {"least": 10, "factor": 0.5},
    "latency_regression": {"ratio": 1.2, "plus_ms": 20},
    "pop_latency_regression": {"ratio": 1.05, "plus_ms": 5},
    "city_latency_regressions": {"ratio": 1.05, "plus_ms": 5},
    "region_latency": {"ratio": 1.05, "plus_ms": 5},
    "image_optimization_opportunities": {"floor": 1024},
    "metro_delivery_degradation": {"factor": 0.9},
    "payload_compression_regression": {"min_w": 5, "min_b": 10},
    "request_size_anomaly": {"factor": 1.0},
    "connection_abuse": {"factor": 2},
    "city_surges": {"factor": 0.9},
    "asn_metro_performance": {"min_w": 10, "min_b": 20},
}


def _detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = DetectAll(request_log(spark, sf_dir), _pops(spark), _EASIER)
    return found.items().drop("meta")


def _detect_all_sql(oracles: dict[str, str]) -> str:
    """All detections one by one, each from rows of its own, and the verdicts over their items."""
    each = " UNION ALL ".join(f"SELECT '{n.removeprefix('detect_')}' AS id, CAST(label AS VARCHAR) AS label, current_val, baseline_val, unit, severity FROM ({sql.removeprefix(CTES).lstrip(', ').join(('WITH ', ''))})" for n, sql in oracles.items())
    return f"""{CTES.replace('logs AS (', 'logs AS MATERIALIZED (', 1)}, items AS ({each})
SELECT *, CASE WHEN id = 'proxy_surge' THEN 'warning' WHEN count(*) FILTER (severity = 'critical') OVER (PARTITION BY id) > 0 THEN 'critical'
  WHEN id LIKE 'repeated_patterns%' AND count(*) FILTER (severity = 'warning') OVER (PARTITION BY id) = 0 THEN 'info' ELSE 'warning' END AS verdict FROM items"""


def _logs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(request_log(spark, sf_dir))


def _behind(sql: str) -> str:
    """``sql``, a statement or one that goes on with named sub-queries, behind the shared ones."""
    return f"{CTES} {sql}" if sql.startswith("SELECT") else f"{CTES}, {sql}"


def _reports() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sources = {"logs": lambda x: x, "vitals": rum_vitals, "errors": rum_errors}
    for name, report in READS.items():
        queries[name] = _logs(lambda logs, r=report: r.frame(sources[r.source](logs)))
    for name in D.DETECTIONS:
        queries[f"detect_{name}"] = _logs(lambda logs, n=name, e=_EASIER.get(name, {}): D.detect(n, logs, **e))
    for dim in ("asn", "region", "pop"):
        queries[f"network_quality_{dim}"] = _logs(lambda logs, d=dim: READS["network_quality"].frame(logs, group=d))
    queries["fingerprint_top_n_ja3"] = _logs(lambda logs: READS["fingerprint_top_n"].frame(logs, column="ja3"))
    oracles = {n: _behind(sql) for n, sql in read_sql.SQL.items()} | {f"detect_{n}": _behind(sql) for n, sql in detection_sql.SQL.items()}
    return queries, oracles


def _pops(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('JFK', 40.6D, -73.8D), ('LAX', 33.9D, -118.4D), ('LHR', 51.5D, -0.5D), ('NRT', 35.8D, 140.4D), ('SYD', -33.9D, 151.2D) AS t(pop, pop_lat, pop_lon)")


_POPS_SQL = "(VALUES ('JFK', 40.6::DOUBLE, -73.8::DOUBLE), ('LAX', 33.9::DOUBLE, -118.4::DOUBLE), ('LHR', 51.5::DOUBLE, -0.5::DOUBLE), ('NRT', 35.8::DOUBLE, 140.4::DOUBLE), ('SYD', -33.9::DOUBLE, 151.2::DOUBLE)) p(pop, pop_lat, pop_lon)"
_FIELDS = ["ip", "country", "ua", "url", "status", "asn"]
_FIELD_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, is_w, is_b, {HOUR} AS hour FROM logs WHERE {f} IS NOT NULL" for f in _FIELDS)
_SESSION_SQL = """s0 AS (SELECT *, lag(timestamp) OVER (PARTITION BY {keys} ORDER BY timestamp, rid) AS prev_ts FROM logs),
s1 AS (SELECT *, sum(CASE WHEN prev_ts IS NULL OR epoch_us(timestamp) - epoch_us(prev_ts) > CAST({gap} AS BIGINT) * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY timestamp, rid ROWS UNBOUNDED PRECEDING) AS session_no FROM s0)"""


def _sessions_sql(gap: int) -> str:
    return f"""{CTES}, {_SESSION_SQL.format(keys='ip, ja4', gap=gap)}
SELECT ip, ja4, CAST(session_no AS BIGINT) AS session_no, CAST(min(timestamp) AS VARCHAR) AS first_ts, CAST(max(timestamp) AS VARCHAR) AS last_ts, count(*) AS requests,
  count(*) FILTER (status BETWEEN 400 AND 499) AS err4, count(*) FILTER (status >= 500) AS err5, CAST(sum(resp_bytes) AS BIGINT) AS bytes, count(DISTINCT url) AS urls,
  count(*) >= 100 OR count(*) FILTER (status BETWEEN 400 AND 499) * 100.0 / count(*) >= 20 AS flagged
FROM s1 GROUP BY ip, ja4, session_no"""


_EDGES_SQL = f"""{CTES}, {_SESSION_SQL.format(keys='ip, ua', gap=86400)},
s2 AS (SELECT lag(url) OVER (PARTITION BY ip, ua, session_no ORDER BY timestamp, rid) AS prev, url AS curr, count(*) OVER w AS events,
  (max(epoch_us(timestamp)) OVER w - min(epoch_us(timestamp)) OVER w) / 1000000.0::DOUBLE / greatest(count(*) OVER w - 1, 1) AS dwell FROM s1 WINDOW w AS (PARTITION BY ip, ua, session_no)),
edges AS (SELECT prev, curr, count(*) AS n FROM s2 WHERE events >= 2 AND dwell >= 0.2 AND prev IS NOT NULL GROUP BY 1, 2)"""
#: Sessions of the baseline give the matrix (b0, b1, b2, edges), sessions of all rows the steps (s0, s1, steps).
_BASE_EDGES_SQL = ", ".join([
    _SESSION_SQL.format(keys="ip, ua", gap=86400).replace("FROM logs", "FROM logs WHERE is_b").replace("s0", "b0").replace("s1", "b1"),
    "b2 AS" + _EDGES_SQL.split("s2 AS", 1)[1].replace("s1", "b1").replace("s2", "b2"),
])
_L2_STEP_SQL = f"""{CTES}, {_BASE_EDGES_SQL}, {_SESSION_SQL.format(keys='ip, ua', gap=86400)},
t AS (SELECT prev AS r, sum(n) AS total FROM edges GROUP BY 1), v AS (SELECT count(DISTINCT r) AS vocab FROM (SELECT prev AS r FROM edges UNION SELECT curr FROM edges)),
steps AS (SELECT rid, lag(url) OVER w AS prev, lag(url, 2) OVER w AS anchor, url AS curr FROM s1 WINDOW w AS (PARTITION BY ip, ua, session_no ORDER BY timestamp, rid)),
p AS (SELECT steps.*, CASE WHEN steps.prev IS NULL OR vocab = 0 THEN 1.0::DOUBLE ELSE greatest(
    CASE WHEN tp.total IS NULL THEN 1e-12::DOUBLE ELSE (coalesce(ep.n, 0) + 0.5::DOUBLE) / (tp.total + 0.5::DOUBLE * vocab) END,
    CASE WHEN ta.total IS NOT NULL AND anchor <> steps.prev THEN (coalesce(ea.n, 0) + 0.5::DOUBLE) / (ta.total + 0.5::DOUBLE * vocab) * 0.7::DOUBLE ELSE 0.0::DOUBLE END) END AS p
  FROM steps CROSS JOIN v LEFT JOIN t tp ON steps.prev = tp.r LEFT JOIN t ta ON anchor = ta.r
  LEFT JOIN edges ep ON ep.prev = steps.prev AND ep.curr IS NOT DISTINCT FROM steps.curr LEFT JOIN edges ea ON ea.prev = anchor AND ea.curr IS NOT DISTINCT FROM steps.curr)
SELECT rid, prev, anchor, curr, round(p, 8) AS prob, CAST(greatest(0, least(100, round_even(-log10(p) * (100.0::DOUBLE / 6.0), 0))) AS INTEGER) AS score FROM p"""
_SCORED = "sc AS (SELECT edge_sid AS sid, max(edge_score) AS score, bool_or(user_id % 3 = 0) AS bad, max(edge_score_reason) AS reason FROM logs WHERE edge_score IS NOT NULL GROUP BY edge_sid)"


def _scored(logs: DataFrame) -> DataFrame:
    rows = logs.filter("edge_score IS NOT NULL")
    return rows.groupBy("edge_sid").agg(F.max("edge_score").alias("score"), F.bool_or(F.col("user_id") % 3 == 0).alias("bad"), F.max("edge_score_reason").alias("edge_score_reason"))


_GAMMA = "CAST(ceil(ln({v}) / ln(1.02::DOUBLE)) AS INTEGER)"
_TOP_SQL = f"{CTES}, r AS ({_FIELD_ROWS}), c AS (SELECT field, value, count(*) AS count FROM r {{where}} GROUP BY 1, 2)"
_RANKED = "SELECT field, value, count, CAST(sum(count) OVER (PARTITION BY field) AS BIGINT) AS total, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS rank FROM c QUALIFY rank <= {k}"


def _expected(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.expr(HOUR).alias("hour")).agg(F.count("*").alias("expected"))


def _stored(logs: DataFrame) -> DataFrame:
    return logs.filter("NOT (hour(timestamp) % 6 IN (2, 3) AND event_id % 2 = 0)").groupBy(F.expr(HOUR).alias("hour")).agg(F.count("*").alias("stored"))


def _cidr(logs: DataFrame) -> DataFrame:
    spark = logs.sparkSession
    feeds = spark.sql("SELECT * FROM VALUES ('a', '10.1.0.0/16'), ('b', '10.2.8.0/21'), ('c', '10.3.3.7/32') AS t(feed, cidr)")
    return S.cidr_join(logs, feeds).groupBy("feed").agg(F.count("*").alias("requests"), F.countDistinct("ip").alias("ips"))


def _waf_bots(logs: DataFrame) -> DataFrame:
    bots = logs.select("waf_req_id", F.concat(F.lit("bot"), F.col("event_id") % 50 % 5).alias("bot_name"), F.when(F.col("event_id") % 50 < 25, "search").otherwise("ai").alias("category")).distinct()
    return A.waf_bots(logs, bots)


def _special() -> tuple[dict[str, Query], dict[str, str]]:
    q: dict[str, Query] = {}
    o: dict[str, str] = {}

    def add(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        q[name] = _logs(f)
        if sql:
            o[name] = sql

    add("top_n", lambda x: A.top_n(x, _FIELDS), _TOP_SQL.format(where="") + _RANKED.format(k=10))
    add("correlate_errors", lambda x: A.correlate_errors(x, ["country", "url"]), f"{CTES}, r AS (SELECT 'country' AS field, country AS value FROM logs WHERE status >= 400 UNION ALL SELECT 'url', url FROM logs WHERE status >= 400), c AS (SELECT field, value, count(*) AS count FROM r GROUP BY 1, 2)" + _RANKED.format(k=5))
    exploded = "x AS (SELECT trim(unnest(string_split({c}, ','))) AS value FROM logs WHERE {c} <> '')"
    for column in ("waf_sig", "edge_score_reason"):
        add(f"exploded_top_n_{column}", lambda x, c=column: A.exploded_top_n(x, c), f"{CTES}, {exploded.format(c=column)} SELECT value, count(*) AS count FROM x WHERE value <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    add("field_values", lambda x: A.field_values(x, "url", "item"), f"{CTES} SELECT url AS value, count(*) AS count FROM logs WHERE url ILIKE '%item%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
    add("field_values_bots", lambda x: x.filter("ua IS NOT NULL").groupBy("ua").agg(F.count("*").alias("n")).filter(F.col("ua").rlike(D.BOT)).groupBy(F.lower(F.regexp_extract("ua", "([A-Za-z]+[Bb]ot)", 1)).alias("value")).agg(F.sum("n").alias("count")),
        f"{CTES} SELECT lower(regexp_extract(ua, '([A-Za-z]+[Bb]ot)', 1)) AS value, count(*) AS count FROM logs WHERE regexp_matches(ua, '{D.BOT}') GROUP BY 1")
    add("top_values_sample", lambda x: A.top_n(A.sample_rows(x, 5000), _FIELDS, 200))
    add("quality_scatter", lambda x: A.sample_rows(x.filter("tcp_rtt > 0 AND ttfb > 0"), 2000).select((F.col("tcp_rtt") / 1000).alias("rtt_ms"), (F.col("ttfb") * 1000).alias("ttfb_ms"), "cache"))
    add("latency_scatter", lambda x: A.sample_rows(x.filter("elapsed / 1000.0 >= ttfb * 1000.0"), 300).select((F.col("ttfb") * 1000).alias("origin_ms"), (F.col("elapsed") / 1000 - F.col("ttfb") * 1000).alias("edge_ms"), "cache"))
    for name, gap in (("sessions", 1800), ("sessions_day_gap", 86400)):
        add(name, lambda x, g=gap: A.sessions(x, gap=g), _sessions_sql(gap))
    add("session_count", lambda x: A.sessions(x).agg(F.count("*").alias("sessions"), F.count_if("flagged").alias("flagged")), f"SELECT count(*) AS sessions, count(*) FILTER (flagged) AS flagged FROM ({_sessions_sql(1800)})")
    add("scoring_sessions", lambda x: A.with_sessions(x, ["ip", "ua"], 86400).groupBy("ip", "ua", "session_no").agg(F.min("timestamp").cast("string").alias("start"), F.sort_array(F.collect_list(F.struct("timestamp", "rid", "url"))).alias("e")).select(F.sha1(F.concat_ws("|", "ip", "ua", "start")).alias("sid"), F.size("e").cast("long").alias("events"), F.get("e", F.lit(0))["url"].alias("entry")),
        f"{CTES}, {_SESSION_SQL.format(keys='ip, ua', gap=86400)} SELECT sha1(concat_ws('|', ip, ua, CAST(min(timestamp) AS VARCHAR))) AS sid, count(*) AS events, (list(url ORDER BY timestamp, rid))[1] AS entry FROM s1 GROUP BY ip, ua, session_no")
    add("sessions_from_hours", lambda x: A.sessions_from_hours(ROLLUPS["sessions"].build(x), gap=86400), f"SELECT ip, ja4, session_no, first_ts, last_ts, requests, err4, bytes FROM ({_sessions_sql(86400)})")
    add("shield_routes", A.shield_routes, f"""{CTES}, e AS (SELECT rid, pop AS edge_pop, coalesce(ottfb, ttfb * 1000000) AS e FROM logs WHERE edge), s AS (SELECT prid, pop AS shield_pop, coalesce(ottfb, ttfb * 1000000) AS s FROM logs WHERE NOT edge AND prid <> ''),
p AS (SELECT edge_pop, shield_pop, count(*) AS requests, round(quantile_cont(e - s, 0.5) / 1000.0, 6) AS p50_ms, round(quantile_cont(e - s, 0.95) / 1000.0, 6) AS p95_ms, round(quantile_cont(e - s, 0.99) / 1000.0, 6) AS p99_ms FROM e JOIN s ON s.prid = e.rid GROUP BY 1, 2)
SELECT *, count(*) OVER () AS total_routes FROM p QUALIFY row_number() OVER (ORDER BY requests DESC, edge_pop, shield_pop) <= 20 OR row_number() OVER (ORDER BY p50_ms DESC NULLS LAST, edge_pop, shield_pop) <= 20""")
    edges = lambda x: A.transitions(x, gap=86400)
    add("transition_matrix", edges, f"{_EDGES_SQL} SELECT prev, curr, n FROM edges")
    add("l2_score", lambda x: A.l2_scores(edges(x)), f"""{_EDGES_SQL}, t AS (SELECT prev, sum(n) AS row_total FROM edges GROUP BY 1), v AS (SELECT count(DISTINCT r) AS vocab FROM (SELECT prev AS r FROM edges UNION SELECT curr FROM edges)),
p AS (SELECT edges.*, CAST(row_total AS BIGINT) AS row_total, (n + 0.5::DOUBLE) / (row_total + 0.5::DOUBLE * vocab) AS p FROM edges JOIN t USING (prev), v)
SELECT prev, curr, n, row_total, round(p, 8) AS prob, CAST(greatest(0, least(100, round_even(-log10(p) * (100.0::DOUBLE / 6.0), 0))) AS INTEGER) AS score FROM p""")
    add("l2_step_score", lambda x: A.l2_step_scores(x, edges(x.filter("is_b")), gap=86400), _L2_STEP_SQL)
    add("l1_score", lambda x: A.l1_scores(x).groupBy("l1").agg(F.count("*").alias("n")), f"""{CTES}, g AS (SELECT edge_cookie_compliance AS c, row_number() OVER w AS seq, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 AS dwell, edge_sid, timestamp, rid FROM logs WINDOW w AS (PARTITION BY edge_sid ORDER BY timestamp, rid)),
r AS (SELECT c, seq, avg(dwell) OVER w AS m, avg(dwell * dwell) OVER w AS q FROM g WINDOW w AS (PARTITION BY edge_sid ORDER BY timestamp, rid ROWS UNBOUNDED PRECEDING)),
p AS (SELECT CASE WHEN seq > 3 AND m < 0.2 THEN 50 WHEN seq > 3 AND m <= 3 AND q - m * m < 0.05 THEN 40 ELSE 0 END AS pace, CASE WHEN c = 'tampered' THEN 100 WHEN c IN ('missing', 'expired', 'replayed') THEN 75 ELSE 0 END AS cookie FROM r)
SELECT least(100, pace + cookie) AS l1, count(*) AS n FROM p GROUP BY 1""")
    add("roc_auc", lambda x: A.roc_auc(_scored(x)), f"{CTES}, {_SCORED} SELECT count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad) AS n_good, (SELECT round(coalesce(avg(CASE WHEN g.score < b.score THEN 1.0 WHEN g.score = b.score THEN 0.5 ELSE 0.0 END), 0.5), 8) FROM sc g, sc b WHERE b.bad AND NOT g.bad) AS auc FROM sc")
    add("auc_per_reason", lambda x: A.auc_per_reason(_scored(x)), f"{CTES}, {_SCORED}, r AS (SELECT trim(unnest(string_split(reason, ','))) AS reason, score, bad FROM sc) SELECT reason, count(*) FILTER (bad) AS nb, count(*) FILTER (NOT bad) AS ng, (SELECT round(coalesce(avg(CASE WHEN g.score < b.score THEN 1.0 WHEN g.score = b.score THEN 0.5 ELSE 0.0 END), 0.5), 8) FROM r g, r b WHERE b.bad AND NOT g.bad AND g.reason = r.reason AND b.reason = r.reason) AS auc FROM r WHERE reason <> '' GROUP BY reason")
    add("scoring_curves", lambda x: A.scoring_curves(_scored(x)), f"""{CTES}, {_SCORED}, t AS (SELECT CAST(i AS INTEGER) AS threshold FROM range(101) r(i)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND bad) AS tp, count(*) FILTER (score >= threshold AND NOT bad) AS fp, count(*) FILTER (bad) AS nb, count(*) FILTER (NOT bad) AS ng FROM t, sc GROUP BY 1)
SELECT threshold, tp, fp, round(tp * 1.0::DOUBLE / nullif(nb, 0), 8) AS tpr, round(fp * 1.0::DOUBLE / nullif(ng, 0), 8) AS fpr, round(tp * 1.0::DOUBLE / nullif(tp + fp, 0), 8) AS precision FROM c""")
    add("threshold_sweep", lambda x: A.threshold_sweep(_scored(x), [25, 50, 75, 90]), f"{CTES}, {_SCORED} SELECT threshold, count(*) FILTER (score >= threshold) AS flagged, count(*) FILTER (score >= threshold AND NOT bad) AS flagged_good, count(*) FILTER (score >= threshold AND bad) AS flagged_bad, count(*) FILTER (score < threshold AND NOT bad) AS passed_good, count(*) FILTER (score < threshold AND bad) AS passed_bad FROM (VALUES (25), (50), (75), (90)) t(threshold), sc GROUP BY 1")
    add("threshold_preview", lambda x: A.threshold_sweep(_scored(x), [50]), f"{CTES}, {_SCORED} SELECT 50 AS threshold, count(*) FILTER (score >= 50) AS flagged, count(*) FILTER (score >= 50 AND NOT bad) AS flagged_good, count(*) FILTER (score >= 50 AND bad) AS flagged_bad, count(*) FILTER (score < 50 AND NOT bad) AS passed_good, count(*) FILTER (score < 50 AND bad) AS passed_bad FROM sc")
    # Alerts, anchored on the newest row.
    last = "timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL {a} MINUTES AND timestamp <= (SELECT max(timestamp) FROM logs) - INTERVAL {b} MINUTES"
    rate = "count(*) FILTER (WHERE status >= 500) * 100.0 / nullif(count(*), 0)"
    add("alert_absolute", lambda x: A.alert_absolute(x, rate, ">", 5.0, 1440), f"{CTES} SELECT count(*) AS requests, CAST(coalesce({rate}, 0) AS DOUBLE) AS val, coalesce({rate}, 0) > 5.0 AS triggered FROM logs WHERE {last.format(a=1440, b=0)}")
    add("alert_relative", lambda x: A.alert_relative(x, rate, 10.0, 1440, 14400), f"{CTES}, n AS (SELECT count(*) AS requests, CAST({rate} AS DOUBLE) AS now FROM logs WHERE {last.format(a=1440, b=0)}), t AS (SELECT CAST({rate} AS DOUBLE) AS \"then\" FROM logs WHERE {last.format(a=14400 + 1440, b=14400)}), v AS (SELECT *, CASE WHEN requests >= 10 AND \"then\" <> 0 THEN round((now - \"then\") / \"then\" * 100.0, 6) END AS val FROM n, t) SELECT requests, now, \"then\", val, coalesce(val > 10.0 AND requests >= 50, false) AS triggered FROM v")
    add("alert_zscore", lambda x: A.alert_zscore(x, "count(*)", 60, 14), f"{CTES}, m AS (SELECT max(timestamp) AS t FROM logs), h AS (SELECT date_trunc('hour', timestamp) AS h, CAST(count(*) AS DOUBLE) AS val FROM logs, m WHERE timestamp >= t - INTERVAL 14 DAYS AND timestamp <= t - INTERVAL 1 HOUR AND hour(timestamp) = hour(t) GROUP BY 1), b AS (SELECT avg(val) AS mean, stddev_samp(val) AS sd FROM h), n AS (SELECT count(*) AS requests, CAST(count(*) AS DOUBLE) AS val FROM logs WHERE {last.format(a=60, b=0)}), z AS (SELECT requests, val, mean, round((val - mean) / (CASE WHEN coalesce(sd, 0) = 0 THEN 0.0001 ELSE sd END), 6) AS zscore FROM n, b) SELECT requests, val, round(mean, 6) AS mean, zscore, coalesce(zscore > 3.0 AND requests >= 50, false) AS triggered FROM z")
    # Rollups with mergeable sketches.
    add("gamma_quantile", lambda x: A.gamma_quantile(A.gamma_histogram(x, [F.expr(HOUR).alias("hour"), F.col("pop")], "ottfb"), ["pop"], 0.95), f"{CTES}, s AS (SELECT pop, {_GAMMA.format(v='ottfb')} AS c, count(*) AS n FROM logs WHERE ottfb > 0 GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY pop ORDER BY c) AS run, sum(n) OVER (PARTITION BY pop) AS all_n FROM s) SELECT pop, CAST(max(all_n) AS BIGINT) AS weight, round(power(1.02::DOUBLE, min(c)) * 2 / (1.02::DOUBLE + 1), 6) AS value FROM r WHERE run >= all_n * 0.95 GROUP BY pop")
    counts = f"{CTES}, r AS ({_FIELD_ROWS}), c AS (SELECT hour, field, value, count(*) AS count FROM r WHERE value <> '' GROUP BY 1, 2, 3), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY hour, field ORDER BY count DESC, value) <= 5 UNION ALL SELECT hour, field, '__total__', CAST(sum(count) AS BIGINT) FROM c GROUP BY 1, 2)"
    add("rollup_field_counts", lambda x: A.rollup_field_counts(x, _FIELDS, 5), f"{counts} SELECT * FROM k")
    add("rollup_field_counts_day", lambda x: A.merge_days(A.rollup_field_counts(x, _FIELDS, 5)), f"{counts} SELECT substr(hour, 1, 10) AS day, field, value, CAST(sum(count) AS BIGINT) AS count FROM k GROUP BY 1, 2, 3")
    add("rollup_virtual_fields", A.rollup_virtual_fields, f"{CTES}, x AS (SELECT {HOUR} AS hour, trim(unnest(string_split(waf_sig, ','))) AS value FROM logs WHERE waf_sig <> '') SELECT hour, value, count(*) AS count FROM x WHERE value <> '' GROUP BY 1, 2")
    add("rollup_ip_spread_days", lambda x: A.ip_spread_days(A.rollup_ip_spread(x)))
    add("rollup_ip_spread_exact", lambda x: x.groupBy(F.expr("CAST(CAST(timestamp AS DATE) AS STRING)").alias("day"), "country").agg(F.countDistinct("ip").alias("ips"), F.count("*").alias("rows")), f"{CTES} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, country, count(DISTINCT ip) AS ips, count(*) AS rows FROM logs GROUP BY 1, 2")
    add("rollup_verified_bots_ts", A.verified_bots_ts, f"{CTES}, x AS (SELECT {HOUR} AS bucket, unnest(string_split(waf_sig, ',')) AS tag FROM logs WHERE waf_sig ILIKE '%VERIFIED-BOT.%') SELECT bucket, replace(tag, 'VERIFIED-BOT.', '') AS bot_type, count(*) AS count FROM x WHERE tag LIKE 'VERIFIED-BOT.%' GROUP BY 1, 2")
    q["verified_bots_ts"], o["verified_bots_ts"] = q["rollup_verified_bots_ts"], o["rollup_verified_bots_ts"]
    add("ngwaf_top_bots", _waf_bots, f"{CTES}, b AS (SELECT DISTINCT waf_req_id, concat('bot', event_id % 50 % 5) AS bot_name, CASE WHEN event_id % 50 < 25 THEN 'search' ELSE 'ai' END AS category FROM logs) SELECT bot_name, category, count(*) AS cnt FROM logs JOIN b USING (waf_req_id) GROUP BY 1, 2")
    # Video and browser telemetry.
    add("cmcd_overview", A.cmcd_overview, f"{CTES} SELECT (SELECT count(DISTINCT cmcd_sid) FROM logs) AS active_sessions, round(CAST(count(*) FILTER (cmcd_bs) * 100.0 / count(*) AS DOUBLE), 4) AS rebuffer_rate, round(avg(cmcd_br), 6) AS avg_bitrate, round(avg(cmcd_bl), 6) AS avg_buffer_length, quantile_cont(cmcd_mtp, 0.5) AS median_throughput, (SELECT max(n) FROM (SELECT count(DISTINCT cmcd_sid) AS n FROM logs GROUP BY {HOUR})) AS peak_viewers, (SELECT round(avg(d), 0) FROM (SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS d FROM logs GROUP BY cmcd_sid) WHERE d > 0) AS avg_dur FROM logs")
    for name, dim in (("cmcd_top_content", "cmcd_cid"), ("cmcd_rebuffer_country", "country"), ("cmcd_rebuffer_asn", "asn")):
        add(name, lambda x, d=dim: A.cmcd_per_session(x, d), f"{CTES}, p AS (SELECT {dim} AS value, cmcd_sid, max(CASE WHEN cmcd_bs THEN 1 ELSE 0 END) AS reb, avg(cmcd_br) AS br, avg(cmcd_bl) AS bl FROM logs GROUP BY 1, 2) SELECT value, count(*) AS session_count, round(CAST(sum(reb) * 100.0 / count(*) AS DOUBLE), 2) AS rebuffer_rate, round(avg(br), 4) AS avg_br, round(avg(bl), 4) AS avg_bl FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
    add("cmcd_durations", lambda x: x.groupBy("cmcd_sid").agg((F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))) - F.min(F.unix_micros(F.col("timestamp").cast("timestamp")))).alias("us")).groupBy(F.expr("CASE WHEN us < 3600000000 THEN '<1h' WHEN us < 86400000000 THEN '1h-1d' ELSE '>1d' END").alias("duration_bucket")).agg(F.count("*").alias("session_count")),
        f"{CTES} SELECT CASE WHEN us < 3600000000 THEN '<1h' WHEN us < 86400000000 THEN '1h-1d' ELSE '>1d' END AS duration_bucket, count(*) AS session_count FROM (SELECT epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS us FROM logs GROUP BY cmcd_sid) GROUP BY 1")
    add("rum_counts", lambda x: A.rum_counts(rum_vitals(x), rum_errors(x)), f"{CTES}, b AS (SELECT req_id, CASE WHEN metric_name LIKE 'event_%' THEN 'i' ELSE 'p' END AS kind FROM vitals UNION ALL SELECT req_id, 'e' FROM errors) SELECT count(DISTINCT req_id) FILTER (kind = 'p') AS pageviews, count(DISTINCT req_id) FILTER (kind = 'i') AS interactions, count(DISTINCT req_id) FILTER (kind = 'e') AS errors_count, count(DISTINCT req_id) AS total_beacons FROM b")
    add("rum_environments", lambda x: A.rum_environments(rum_vitals(x)), f"{CTES} SELECT coalesce(browser, 'Unknown') AS browser, coalesce(os, 'Unknown') AS os, coalesce(device, 'Unknown') AS device, count(DISTINCT req_id) AS count, grouping(browser, os, device) AS gid FROM vitals GROUP BY GROUPING SETS ((browser), (os), (device))")
    add("rum_worst_pages", lambda x: A.rum_worst_pages(rum_vitals(x), rum_errors(x)), f"{CTES}, m AS (SELECT pathname AS path, count(DISTINCT req_id) AS views, round(coalesce(avg(metric_value) FILTER (metric_name IN ('LCP', 'TTFB')), 0.0), 6) AS avg_load_time, round(quantile_cont(metric_value, 0.75) FILTER (metric_name = 'LCP'), 6) AS lcp FROM vitals GROUP BY 1), e AS (SELECT pathname AS path, count(DISTINCT req_id) AS e FROM errors GROUP BY 1) SELECT path, views, avg_load_time, lcp, round(CAST(coalesce(e, 0) * 100.0 / views AS DOUBLE), 6) AS error_rate FROM m LEFT JOIN e USING (path) ORDER BY error_rate DESC, avg_load_time DESC, path LIMIT 5")
    add("rum_trends", lambda x: A.rum_trends(rum_vitals(x), rum_errors(x)), f"{CTES}, v AS (SELECT {HOUR} AS hour, round(quantile_cont(metric_value, 0.75) FILTER (metric_name = 'LCP'), 6) AS lcp, count(DISTINCT req_id) AS views FROM vitals GROUP BY 1), e AS (SELECT {HOUR} AS hour, count(DISTINCT req_id) AS errors FROM errors GROUP BY 1) SELECT hour, lcp, coalesce(views, 0) AS views, coalesce(errors, 0) AS errors, round(coalesce(errors, 0) * 100.0::DOUBLE / nullif(coalesce(views, 0) + coalesce(errors, 0), 0), 6) AS error_rate FROM v FULL JOIN e USING (hour)")
    add("rum_live", lambda x: A.recent(rum_vitals(x).withColumnRenamed("req_id", "rid"), 50, ["rid", "metric_name", "pathname"]), f"{CTES} SELECT req_id AS rid, metric_name, pathname FROM vitals ORDER BY timestamp DESC, req_id DESC LIMIT 50")
    add("rum_beacon_health", lambda x: rum_vitals(x).select("req_id", "timestamp").unionByName(rum_errors(x).select("req_id", "timestamp")).agg(F.countDistinct("req_id").alias("beacons"), F.max("timestamp").cast("string").alias("newest")), f"{CTES} SELECT count(DISTINCT req_id) AS beacons, CAST(max(timestamp) AS VARCHAR) AS newest FROM (SELECT req_id, timestamp FROM vitals UNION ALL SELECT req_id, timestamp FROM errors)")
    # Scoring, errors, pages, accounting.
    add("top_flagged", A.top_flagged, f"{CTES} SELECT rid, edge_sid, edge_score, edge_score_l2, ip, url, status FROM logs WHERE edge_score IS NOT NULL ORDER BY edge_score DESC, timestamp DESC, rid DESC LIMIT 50")
    add("score_health", lambda x: x.filter("edge OR edge_score IS NOT NULL").agg(F.count("*").alias("total_edge_rows"), F.count("edge_score").alias("scored_rows"), F.expr("count(DISTINCT edge_sid) FILTER (WHERE edge_score IS NOT NULL)").alias("distinct_sids"), F.round(F.avg("edge_score"), 6).alias("avg_score"), F.expr("percentile(edge_score, 0.5)").alias("p50_score"), F.expr("percentile(edge_score, 0.95)").alias("p95_score"), F.max("edge_score").alias("max_score"), F.expr("count_if(edge_score_l2 >= 50)").alias("l2_high_count")),
        f"{CTES} SELECT count(*) AS total_edge_rows, count(edge_score) AS scored_rows, count(DISTINCT edge_sid) FILTER (edge_score IS NOT NULL) AS distinct_sids, round(avg(edge_score), 6) AS avg_score, quantile_cont(edge_score, 0.5) AS p50_score, quantile_cont(edge_score, 0.95) AS p95_score, max(edge_score) AS max_score, count(*) FILTER (edge_score_l2 >= 50) AS l2_high_count FROM logs WHERE edge OR edge_score IS NOT NULL")
    add("score_reasons", lambda x: A.exploded_top_n(x.filter("edge_score IS NOT NULL"), "edge_score_reason"), f"{CTES}, x AS (SELECT trim(unnest(string_split(edge_score_reason, ','))) AS value FROM logs WHERE edge_score IS NOT NULL AND edge_score_reason <> '') SELECT value, count(*) AS count FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    add("recent_errors", lambda x: A.recent(x, 20, ["rid", "status", "url", "ip"], "status >= 400"), f"{CTES} SELECT rid, status, url, ip FROM logs WHERE status >= 400 ORDER BY timestamp DESC, rid DESC LIMIT 20")
    add("facts_page", lambda x: A.facts_page(x, ("2024-01-20 00:00:00", "zzz"), 100, ["rid", "url"]), f"{CTES} SELECT CAST(timestamp AS VARCHAR) AS timestamp, rid, url FROM logs WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00' OR (timestamp = TIMESTAMP '2024-01-20 00:00:00' AND rid < 'zzz') ORDER BY logs.timestamp DESC, rid DESC LIMIT 100")
    add("export_rows", lambda x: A.recent(x, 1000, ["rid", "ip", "url", "status"]), f"{CTES} SELECT rid, ip, url, status FROM logs ORDER BY timestamp DESC, rid DESC LIMIT 1000")
    add("log_accounting", lambda x: A.log_accounting(_stored(x), _expected(x)), f"""{CTES}, e AS (SELECT {HOUR} AS hour, count(*) AS expected FROM logs GROUP BY 1), s AS (SELECT {HOUR} AS hour, count(*) AS stored FROM logs WHERE NOT (hour(timestamp) % 6 IN (2, 3) AND event_id % 2 = 0) GROUP BY 1),
b AS (SELECT hour, coalesce(expected, 0) AS expected, coalesce(stored, 0) AS stored, coalesce(expected, 0) - coalesce(stored, 0) AS gap FROM e FULL JOIN s USING (hour)), l AS (SELECT hour, epoch(CAST(hour AS TIMESTAMP)) // 3600 - row_number() OVER (ORDER BY hour) AS island FROM b WHERE gap > 0), r AS (SELECT hour, count(*) OVER (PARTITION BY island) AS run_length FROM l)
SELECT hour, expected, stored, gap, coalesce(run_length, 0) AS run_length, round(gap * 100.0::DOUBLE / nullif(expected, 0), 4) AS loss_pct, CASE WHEN gap * 100.0 / nullif(expected, 0) >= 50 THEN 'critical' WHEN gap * 100.0 / nullif(expected, 0) >= 20 THEN 'severe' WHEN gap * 100.0 / nullif(expected, 0) >= 5 THEN 'elevated' WHEN gap > 0 THEN 'mild' ELSE 'none' END AS severity FROM b LEFT JOIN r USING (hour)""")
    op = "CASE WHEN method = 'GET' THEN 'read' ELSE 'write' END"
    add("usage_ops", lambda x: A.usage_ops(x.groupBy(F.expr(HOUR).alias("hour"), F.expr(op).alias("op_class")).agg(F.count("*").alias("ops")), x.filter("event_id % 10 <> 0").groupBy(F.expr(HOUR).alias("hour"), F.expr(op).alias("op_class")).agg(F.count("*").alias("ops"))), f"{CTES}, c AS (SELECT {HOUR} AS hour, {op} AS op_class, count(*) AS counted FROM logs GROUP BY 1, 2), b AS (SELECT {HOUR} AS hour, {op} AS op_class, count(*) AS billed FROM logs WHERE event_id % 10 <> 0 GROUP BY 1, 2) SELECT hour, op_class, coalesce(counted, 0) AS counted, coalesce(billed, 0) AS billed, coalesce(billed, 0) - coalesce(counted, 0) AS residual FROM c FULL JOIN b USING (hour, op_class)")
    add("column_summary", lambda x: A.column_summary(x, ["ip", "url", "io_output_format", "edge_score"]), f"{CTES}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM logs" for c in ("ip", "url", "io_output_format", "edge_score")) + ") SELECT \"column\", count(v) AS non_null, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS greatest FROM r GROUP BY 1")
    add("downsample", lambda x: A.downsample(READS["usage_bandwidth"].frame(x).withColumn("series", F.lit("all")), "series", "bucket", "bytes", 12).select("bucket", "bytes"),
        _behind(f"d AS ({read_sql.SQL['usage_bandwidth']}), t AS (SELECT bucket, bytes, row_number() OVER (ORDER BY bucket) AS i, count(*) OVER () AS n, ntile(8) OVER (ORDER BY bucket) AS tile FROM d), m AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY bucket) AS head, row_number() OVER (ORDER BY bytes, bucket) AS lo, row_number() OVER (ORDER BY bytes DESC, bucket) AS hi FROM t) SELECT bucket, bytes FROM m WHERE n <= 12 OR i = 1 OR i = n OR head = 1 OR lo = 1 OR hi = 1"))
    add("cidr_filter", _cidr, f"{CTES}, n AS (SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS x FROM logs), f AS (SELECT ip, CASE WHEN x BETWEEN 167837696 AND 167903231 THEN 'a' WHEN x BETWEEN 167905280 AND 167907327 THEN 'b' WHEN x = 167969543 THEN 'c' END AS feed FROM n) SELECT feed, count(*) AS requests, count(DISTINCT ip) AS ips FROM f GROUP BY 1")
    spec = {"country": {"mode": "include", "values": ["US", "D*"]}, "url": {"mode": "exclude", "values": ["/wp-*"]}, "io_output_format": {"mode": "include", "values": [None]}, "nothing": {"mode": "exclude", "values": ["x"]}}
    add("filter_spec", lambda x: S.filter_spec(x, spec).groupBy("country").agg(F.count("*").alias("n")), f"{CTES} SELECT country, count(*) AS n FROM logs WHERE (country = 'US' OR country ILIKE 'D%') AND NOT url ILIKE '/wp-%' AND io_output_format IS NULL GROUP BY 1")
    add("csv_contains", lambda x: x.filter(S.csv_contains("waf_sig", ["XSS", "CMDEXE"])).agg(F.count("*").alias("n")), f"{CTES} SELECT count(*) AS n FROM logs WHERE list_contains(list_transform(string_split(waf_sig, ','), lambda v: trim(v)), 'XSS') AND waf_sig LIKE '%CMDEXE%'")
    add("mask_ip", lambda x: x.groupBy(S.mask_ip(F.col("ip")).alias("masked")).agg(F.count("*").alias("n")), f"{CTES} SELECT concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3), '.xxx') AS masked, count(*) AS n FROM logs GROUP BY 1")
    add("redact_pii", lambda x: x.groupBy(S.redact_pii(F.col("edge_sid"), "salt").alias("cid")).agg(F.count("*").alias("n")), f"{CTES} SELECT sha256('salt' || edge_sid) AS cid, count(*) AS n FROM logs GROUP BY 1")
    add("normalize_route", lambda x: S.normalize_routes(x).groupBy("route", "category").agg(F.count("*").alias("n")), f"{CTES} SELECT regexp_replace(url, '/[0-9]+$', '/*') AS route, CASE WHEN url LIKE '/auth/%' OR url LIKE '/signup/%' THEN 'auth' ELSE 'other' END AS category, count(*) AS n FROM logs GROUP BY 1, 2")
    add("tunnel_filter", lambda x: x.join(F.broadcast(_pops(x.sparkSession)), "pop").filter((S.haversine_km(F.col("lat"), F.col("lon"), F.col("pop_lat"), F.col("pop_lon")) > F.col("rtt_min") / 1000.0 * 100 + 150) | (F.col("rtt_min") / F.col("tcp_rtt") < 0.1)).groupBy("pop").agg(F.count("*").alias("n")),
        f"{CTES} SELECT pop, count(*) AS n FROM logs JOIN {_POPS_SQL} USING (pop) WHERE 2 * 6371 * asin(sqrt(power(sin(radians(lat - pop_lat) / 2), 2) + cos(radians(lat)) * cos(radians(pop_lat)) * power(sin(radians(lon - pop_lon) / 2), 2))) > rtt_min / 1000.0 * 100 + 150 OR rtt_min / tcp_rtt < 0.1 GROUP BY 1")
    # Detections with joins or sequences.
    shown = detection_sql.shown
    scaled = f"coalesce(b_cnt, 0) * 1.0 / {BASELINE_HOURS}.0 * {WINDOW_HOURS}.0"
    add("detect_waf_signal_spikes", D.waf_signal_spikes, f"{CTES}, x AS (SELECT trim(unnest(string_split(waf_sig, ','))) AS label, is_w, is_b FROM logs WHERE waf_sig <> ''), g AS (SELECT label, count(*) FILTER (is_w) AS w_cnt, count(*) FILTER (is_b) AS b_cnt FROM x WHERE label <> '' AND label <> 'BOT-ANALYSIS' GROUP BY 1), c AS (SELECT label, w_cnt, b_cnt, round(CAST(w_cnt AS DOUBLE) / greatest({scaled}, 0.5), 4) AS spike_ratio FROM g WHERE w_cnt >= 3 AND w_cnt > {scaled} * 2 + 2 ORDER BY 4 DESC, 1 LIMIT 15) {shown('waf_signal_spikes')}")
    add("detect_origin_latency_spike", D.origin_latency_spike, f"{CTES}, o AS (SELECT quantile_cont(ottfb, 0.95) FILTER (is_w) / 1000.0 AS w_p95, quantile_cont(ottfb, 0.95) FILTER (is_b) / 1000.0 AS b_p95 FROM logs), u AS (SELECT url AS label, count(*) AS requests, round(quantile_cont(ottfb, 0.95) / 1000.0, 1) AS p95_ms FROM logs WHERE is_w GROUP BY 1 HAVING count(*) >= 10), c AS (SELECT u.*, w_p95, b_p95 FROM u, o WHERE w_p95 > b_p95 * 2 ORDER BY p95_ms DESC, label LIMIT 10) {shown('origin_latency_spike')}")
    add("detect_shield_path_degradation", D.shield_path_degradation, f"{CTES}, e AS (SELECT rid, pop AS edge_pop, ottfb AS e, is_w, is_b FROM logs WHERE edge), s AS (SELECT prid, pop AS s_pop, ottfb AS s FROM logs WHERE NOT edge AND prid <> ''), j AS (SELECT edge_pop, coalesce(s_pop, 'Direct to Origin') AS shield_pop, (e - coalesce(s, 0)) / 1000.0 AS t, is_w, is_b FROM e LEFT JOIN s ON s.prid = e.rid), g AS (SELECT edge_pop, shield_pop, quantile_cont(t, 0.5) FILTER (is_w) AS w_p50, quantile_cont(t, 0.5) FILTER (is_b) AS b_p50, count(*) FILTER (is_w) AS w_cnt FROM j GROUP BY 1, 2), c AS (SELECT concat(edge_pop, ' → ', shield_pop) AS label, * FROM g WHERE w_cnt >= 5 AND w_p50 > b_p50 * 1.5 ORDER BY w_p50 / nullif(b_p50, 0) DESC NULLS LAST, edge_pop, shield_pop LIMIT 20) {shown('shield_path_degradation')}")
    add("detect_impossible_distance", lambda x: D.impossible_distance(x, _pops(x.sparkSession)), f"{CTES}, f AS (SELECT ja4 AS label, round(2 * 6371 * asin(sqrt(power(sin(radians(lat - pop_lat) / 2), 2) + cos(radians(lat)) * cos(radians(pop_lat)) * power(sin(radians(lon - pop_lon) / 2), 2))), 1) AS d, round(CAST(tcp_rtt AS DOUBLE) / 2.0 / 1e6 * 200000 * 2, 1) AS m FROM logs JOIN {_POPS_SQL} USING (pop) WHERE is_w AND tcp_rtt > 0), c AS (SELECT label, count(*) AS hits, round(max(d - m), 1) AS worst_excess_km, max(d) AS max_dist_km, min(m) AS min_allowed_km FROM f WHERE d > m GROUP BY 1 HAVING count(*) >= 2 ORDER BY 3 DESC, 1 LIMIT 15) {shown('impossible_distance')}")
    for name, key, spread in (("repeated_patterns", "ip", "ua"), ("repeated_patterns_fp", "ja4", "ip")):
        add(f"detect_{name}", lambda x, k=key, s=spread: D.repeated_patterns(x, k, s), _behind(detection_sql.repeated(key, spread)))
    # The tokens of crawlers and the endings that are cut from them, written out for the comparison.
    crawl = "([a-z0-9_.-]*(?:bot|crawler|spider|slurp|archiver|scraper|externalagent|extended|other|preview)[a-z0-9_.-]*|headless[a-z0-9_.-]*|python-[a-z0-9_.-]+|go-http-client|curl|wget|scrapy|aiohttp|httpx|okhttp|axios)"
    ending = "(-searchbot|-assistbot|-externalagent|-extended|-user|searchbot|assistbot|externalagent|extended|crawler|spider|slurp|archiver|scraper|preview|other|bot).*$"
    add("detect_crawler_disparity", D.crawler_disparity, f"""{CTES}, t AS (SELECT *, regexp_extract(lower(ua), '{crawl}', 1) AS tok, regexp_extract(lower(ua), 'https?://(www[.])*([^/.:;) ]+)', 2) AS site FROM logs),
k AS (SELECT CASE WHEN regexp_replace(tok, '{ending}', '') = '' THEN tok ELSE regexp_replace(tok, '{ending}', '') END AS stem, tok, site, is_w, is_b, resp_bytes FROM t WHERE tok <> ''),
g AS (SELECT stem, min(tok) FILTER (is_w) AS label, max(site) FILTER (is_w) AS site, count(*) FILTER (is_w) AS w_crawls, count(*) FILTER (is_b) AS b_crawls, CAST(coalesce(sum(resp_bytes) FILTER (is_w), 0) AS BIGINT) AS w_bytes,
  CAST(coalesce(sum(resp_bytes) FILTER (is_b), 0) AS BIGINT) AS b_bytes FROM k GROUP BY 1 HAVING count(*) FILTER (is_w) >= 50),
v AS (SELECT DISTINCT ip, is_w, CASE WHEN ua LIKE '%ChatGPT-User%' THEN 'chatgpt' ELSE regexp_extract(lower(referer), 'https?://(www[.])*([^/.:; ]+)', 2) END AS ref FROM logs WHERE regexp_extract(lower(ua), '{crawl}', 1) = ''),
j AS (SELECT stem, count(DISTINCT ip) FILTER (is_w) AS w_ref, count(DISTINCT ip) FILTER (NOT is_w) AS b_ref FROM g JOIN v ON ref <> '' AND (stem = ref OR (length(regexp_replace(stem, '[aeiou]', '', 'g')) >= 3 AND regexp_replace(stem, '[aeiou]', '', 'g') = regexp_replace(ref, '[aeiou]', '', 'g'))
  OR (length(stem) >= 3 AND length(ref) >= 3 AND (contains(ref, stem) OR contains(stem, ref))) OR (site <> '' AND site = ref)) GROUP BY 1),
n AS (SELECT g.*, coalesce(w_ref, 0) AS w_referrals, greatest(coalesce(w_ref, 0), 1) AS wr, greatest(coalesce(b_ref, 0), 1) AS br FROM g LEFT JOIN j USING (stem)),
r AS (SELECT label, w_crawls, w_referrals, w_bytes, round(w_crawls / wr, 4) AS crawls_per_referral, round(b_crawls / br, 4) AS baseline_crawls_per_referral, round(w_bytes / wr, 4) AS bytes_per_referral, round(b_bytes / br, 4) AS baseline_bytes_per_referral,
  round(w_bytes * 100.0 / (SELECT sum(resp_bytes) FROM logs WHERE is_w), 2) AS bandwidth_share_pct FROM n),
c AS (SELECT * FROM r WHERE w_referrals = 0 OR crawls_per_referral >= 100 OR bytes_per_referral >= 1048576 ORDER BY crawls_per_referral DESC, w_bytes DESC, label LIMIT 10) {shown('crawler_disparity')}""")
    detected = _REPORTS[1] | o
    q["detect_all"], o["detect_all"] = _detect_all, _detect_all_sql({n: detected[n] for n in sorted(detected) if n.startswith("detect_")})
    for name, (frame, sql) in {**more_queries.entries(_pops, _POPS_SQL), **extra_queries.entries(_pops, _POPS_SQL), **rollup_queries.entries()}.items():
        add(name, frame, sql)
    return q, o


_REPORTS = _reports()
_SPECIAL, _INGEST = _special(), ingest_queries.queries()


def queries() -> dict[str, Query]:
    return {**_REPORTS[0], **_SPECIAL[0], **{n: q for n, (q, _) in _INGEST.items()}}


def oracles() -> dict[str, str]:
    return {**_REPORTS[1], **_SPECIAL[1], **{n: sql for n, (_, sql) in _INGEST.items() if sql}}
