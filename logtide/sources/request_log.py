"""The request log that the registered queries read: a wide view derived from the ``events`` table.

The text runs in Spark and DuckDB alike.  Every column is integer arithmetic on the event and user id, changed from
the window start on wherever a detection needs a signal, so that it grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_START = "2024-01-24 00:00:00"
WINDOW_HOURS = 168
BASELINE_HOURS = 552

LOG_SQL = f"""
WITH e AS (
  SELECT event_id AS i, user_id AS u, event_type AS et, value AS v, ts, (ts >= TIMESTAMP '{WINDOW_START}') AS w FROM events
)
SELECT CASE WHEN w AND i % 8 = 7 THEN (CASE WHEN hour(ts) < 6 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) WHEN hour(ts) < 12 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '6' HOUR
    WHEN hour(ts) < 18 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '12' HOUR ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '18' HOUR END) ELSE ts END AS timestamp, w AS is_w, NOT w AS is_b, i AS event_id,
  CASE WHEN w AND i % 8 = 7 THEN '10.8.8.8' WHEN w AND i % 50 = 2 THEN concat('10.9.9.', i % 3) ELSE concat('10.', u % 4, '.', u % 16, '.', u % 250) END AS ip,
  CAST(CASE WHEN w AND i % 50 = 2 THEN 403 WHEN et = 'error' AND i % 4 = 0 THEN 500 WHEN et = 'error' AND i % 4 = 1 THEN 503
            WHEN et = 'error' AND i % 4 = 2 THEN 404 WHEN et = 'error' THEN 401
            WHEN w AND i % 40 < 4 THEN 502 ELSE 200 END AS INT) AS status,
  CAST(ROUND(v * 1000) AS BIGINT) * (CASE WHEN w AND i % 40 < 6 THEN 6 ELSE 1 END) AS elapsed,
  CASE WHEN w AND i % 50 = 4 THEN 'PASS' WHEN w AND i % 40 BETWEEN 10 AND 19 THEN (CASE WHEN i % 3 = 0 THEN 'PASS' ELSE 'MISS' END)
       WHEN i % 10 < 6 THEN 'HIT' WHEN i % 10 = 6 THEN 'HIT-STALE' WHEN i % 10 < 9 THEN 'MISS' ELSE 'PASS' END AS cache,
  CAST(ROUND(v * 100) AS BIGINT) AS resp_bytes,
  CASE WHEN i % 50 = 0 THEN '/wp-login.php' WHEN i % 50 = 1 AND w THEN '/.env'
       WHEN i % 50 = 2 THEN '/auth/login' WHEN i % 50 = 3 THEN concat('/img/p', i % 5, '.jpg')
       WHEN i % 50 = 4 THEN concat('/js/app', i % 5, '.js')
       ELSE concat('/', et, '/item/', i % 40) END AS url,
  CASE WHEN et = 'purchase' AND w THEN 'POST' WHEN et = 'signup' THEN 'PUT' ELSE 'GET' END AS method,
  CASE WHEN i % 97 = 5 THEN 'Mozilla/5.0 (compatible; ChatGPT-User/1.0)' WHEN w AND i % 3 = 1 THEN 'Dalvik/2.1.0 (Linux; U; Android 14)' ELSE (CASE u % 6 WHEN 0 THEN 'Mozilla/5.0 Chrome/120.0.0.0' WHEN 1 THEN 'Mozilla/5.0 (iPhone) Mobile Safari'
       WHEN 2 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)' WHEN 3 THEN 'Mozilla/5.0 Chrome/133.0.0.0'
       WHEN 4 THEN 'GPTBot/1.0 (+https://openai.com/gptbot)' ELSE 'python-requests/2.31' END) END AS ua,
  CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN 'https://www.google.com/s' ELSE 'https://news.example.com/a' END AS referer,
  CASE i % 5 WHEN 0 THEN 'JFK' WHEN 1 THEN 'LAX' WHEN 2 THEN 'LHR' WHEN 3 THEN 'NRT' ELSE 'SYD' END AS pop,
  CASE WHEN w AND u % 25 = 7 THEN 'NZ' WHEN u % 4 = 0 THEN 'US' WHEN u % 4 = 1 THEN 'DE' WHEN u % 4 = 2 THEN 'JP' ELSE 'BR' END AS country,
  concat('city', u % 12) AS city, concat('region', u % 6) AS region, CAST(500 + u % 12 AS INT) AS metro,
  CAST(30 + u % 12 AS DOUBLE) AS lat, CAST(u % 12 * 5 - 70 AS DOUBLE) AS lon,
  CAST(CASE WHEN w AND u % 25 = 7 THEN 64999 ELSE 64500 + u % 10 END AS BIGINT) AS asn,
  CAST((20000 + (i % 97) * 1000) * (CASE WHEN w AND u % 12 = 4 THEN 3 ELSE 1 END) AS BIGINT) AS tcp_rtt,
  CAST(2000 + (i % 31) * 500 AS BIGINT) AS rtt_min,
  CAST((1000 + (i % 17) * 1000) * (CASE WHEN w AND u % 10 = 3 THEN 5 ELSE 1 END) AS BIGINT) AS rtt_var,
  CAST((i % 20) * (CASE WHEN w AND u % 10 = 3 THEN 5 ELSE 1 END) AS DOUBLE) / 1000 AS ploss,
  CAST(i % 3 AS BIGINT) AS retrans,
  CAST(CASE WHEN w AND u % 12 = 5 THEN 200000 ELSE 1000000 END + (i % 13) * 1000 AS BIGINT) AS delivery_rate,
  CASE WHEN i % 7 = 0 OR (w AND u % 10 = 6 AND i % 7 < 4) THEN 'hosting' WHEN i % 35 = 1 OR (w AND i % 7 IN (1, 2)) THEN 'public' ELSE '' END AS p_type,
  CASE WHEN w AND i % 3 = 0 THEN 'cellular' WHEN i % 3 < 2 THEN 'broadband' ELSE '' END AS c_type,
  CASE i % 4 WHEN 0 THEN 'slow' WHEN 1 THEN 'fast' ELSE 'medium' END AS c_speed,
  CASE WHEN i % 10 < (CASE WHEN w THEN 2 ELSE 6 END) THEN 'quic' ELSE 'tcp' END AS transport,
  CASE i % 3 WHEN 0 THEN 'HTTP/1.1' WHEN 1 THEN 'HTTP/2' ELSE 'HTTP/3' END AS proto,
  CASE WHEN i % 4 = 0 THEN 'TLSv1.2' ELSE 'TLSv1.3' END AS tls,
  (i % 5 = 0) AS is_ipv6,
  CASE WHEN i % 11 = 0 THEN 'SQLI,XSS' WHEN i % 11 = 1 AND w THEN 'CMDEXE, XSS' WHEN i % 11 = 2 THEN 'VERIFIED-BOT.SEARCH' ELSE '' END AS waf_sig,
  CASE WHEN i % 11 < 2 THEN 406 ELSE 200 END AS waf_resp, concat('w', i % 50) AS waf_req_id,
  CASE WHEN w AND i % 8 = 7 THEN 'ja4_beat' ELSE concat('ja4_', CASE WHEN w THEN u % 5 ELSE u % 40 END) END AS ja4, concat('ja3_', u % 20) AS ja3,
  concat('c_', CASE WHEN w THEN u % 4 ELSE u % 30 END) AS tls_ciphers_sha,
  concat('s_', CASE WHEN w AND u % 15 = 2 THEN i ELSE u % 3 END) AS cookie_session,
  (i % 2 = 0) AS edge, CAST(i AS STRING) AS rid,
  CASE WHEN i % 2 = 1 THEN CAST(i - 1 AS STRING) ELSE '' END AS prid,
  CASE u % 3 WHEN 0 THEN 'us-east' WHEN 1 THEN 'eu-west' ELSE 'ap-south' END AS server_region,
  CAST((ROUND(v * 400) + (i % 2) * 100) * (CASE WHEN w THEN 3 ELSE 1 END) AS BIGINT) AS ottfb,
  CAST((ROUND(v * 400) + (i % 2) * 100) * (CASE WHEN w THEN 3 ELSE 1 END) + (i % 9) * 1000 AS BIGINT) AS ottlb,
  CAST(i % 1000 AS DOUBLE) / 1000 AS ttfb,
  CAST(CASE WHEN w AND i % 6 = 4 THEN 503 WHEN et = 'error' AND (w OR i % 3 = 0) THEN 503 ELSE 200 END AS INT) AS ost,
  concat('192.0.2.', i % 6) AS oip,
  CAST((5 + i % 20) * (CASE WHEN w THEN 8 ELSE 1 END) AS DOUBLE) AS oconnect_ms, CAST(i % 9 % 4 AS INT) AS oretries,
  CAST(i % 5000 AS BIGINT) AS obytes,
  CAST(i % 30 + (CASE WHEN w AND u % 30 = 3 THEN 400 ELSE 0 END) AS BIGINT) AS conn_requests,
  CAST(100 + (i % 50) * 20 + (CASE WHEN w AND u % 30 = 5 THEN 9000 ELSE 0 END) AS BIGINT) AS req_header_bytes, CAST(200 + i % 300 AS BIGINT) AS req_bytes,
  CAST(i % 300 AS DOUBLE) AS ttl, CAST(i % 200 AS DOUBLE) AS age, CAST(i % 3 AS INT) AS hits,
  CASE WHEN i % 4 < (CASE WHEN w THEN 1 ELSE 4 END) THEN 'gzip' ELSE '' END AS resp_header_content_encoding,
  CAST(CASE WHEN i % 50 = 3 THEN 40000 + i % 1000 END AS BIGINT) AS io_input_bytes,
  CAST(CASE WHEN i % 50 = 3 THEN 15000 + i % 500 END AS BIGINT) AS io_output_bytes,
  CASE WHEN i % 50 = 3 THEN 'jpeg' END AS io_input_format, CASE WHEN i % 50 = 3 THEN (CASE WHEN i % 4 = 3 THEN 'webp' ELSE 'avif' END) END AS io_output_format,
  CAST(CASE WHEN i % 3 < 2 THEN i * 7 % 101 END AS INT) AS edge_score, CAST(CASE WHEN i % 3 < 2 THEN i * 3 % 101 END AS INT) AS edge_score_l2,
  CASE i % 6 WHEN 0 THEN 'fast-dwell, rare-route' WHEN 1 THEN 'cookie-missing' WHEN 3 THEN 'compute-unavailable' ELSE '' END AS edge_score_reason,
  CASE i % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'expired' ELSE '' END AS edge_cookie_compliance,
  concat('sid', u) AS edge_sid, CAST(300 + i % 700 AS BIGINT) AS edge_score_rtt_us, CAST(20 + i % 90 AS BIGINT) AS edge_score_exec_us,
  concat('v', u, '_', i % 8) AS cmcd_sid, concat('clip', i % 9) AS cmcd_cid, CAST(ROUND(v * 10) AS BIGINT) AS cmcd_br, CAST(i % 4000 AS BIGINT) AS cmcd_bl,
  (et = 'error') AS cmcd_bs, CAST(1000 + i % 900 AS BIGINT) AS cmcd_mtp,
  CASE i % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'a' ELSE 'm' END AS cmcd_ot, CASE i % 2 WHEN 0 THEN 'h' ELSE 'd' END AS cmcd_sf, (i % 40 = 0) AS cmcd_su,
  et AS event_type, u AS user_id
FROM e
"""

#: Named sub-queries that the comparison SQL may use after its own WITH.
RUM_SQL = """
SELECT timestamp, rid AS req_id, edge_sid AS cid,
  CASE event_type WHEN 'click' THEN 'LCP' WHEN 'view' THEN 'CLS' WHEN 'purchase' THEN 'INP' WHEN 'signup' THEN 'TTFB' ELSE 'event_click' END AS metric_name,
  CAST(elapsed AS DOUBLE) / 100 AS metric_value,
  CASE WHEN elapsed < 20000 THEN 'good' WHEN elapsed < 60000 THEN 'needs_improvement' ELSE 'poor' END AS metric_rating,
  CASE WHEN ua LIKE '%Chrome%' THEN 'Chrome' WHEN ua LIKE '%Safari%' THEN 'Safari' END AS browser,
  CASE WHEN ua LIKE '%iPhone%' THEN 'iOS' ELSE 'Linux' END AS os, CASE WHEN ua LIKE '%Mobile%' THEN 'mobile' ELSE 'desktop' END AS device,
  url AS pathname, city, country, pop
FROM logs WHERE event_type <> 'error'
"""

RUM_ERROR_SQL = """
SELECT timestamp, rid AS req_id, edge_sid AS cid, url AS pathname, concat('error ', status) AS error_message,
  concat('/js/app', event_id % 5, '.js') AS error_file, event_id % 7 AS error_line, event_id % 11 AS error_col
FROM logs WHERE event_type = 'error'
"""

CTES = f"WITH logs AS ({LOG_SQL}), vitals AS ({RUM_SQL}), errors AS ({RUM_ERROR_SQL})"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log over ``events``; only the columns that a query uses are computed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(LOG_SQL.replace("FROM events", "FROM {events}").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), events=events)


def rum_vitals(logs: DataFrame) -> DataFrame:
    return logs.sparkSession.sql(RUM_SQL.replace("FROM logs", "FROM {logs}"), logs=logs)


def rum_errors(logs: DataFrame) -> DataFrame:
    return logs.sparkSession.sql(RUM_ERROR_SQL.replace("FROM logs", "FROM {logs}"), logs=logs)
