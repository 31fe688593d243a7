"""Column expressions over the request log: latency, assets, protocols, histograms, user agents, referrers, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reads import ASSETS, DURATION_EDGES, HEADER_EDGES, TTL_EDGES, metrics

# The tokens by which crawlers and clients of libraries name themselves.
CRAWLER = (
    "([a-z0-9_.-]*(?:bot|crawler|spider|slurp|archiver|scraper|externalagent|extended|other|preview)[a-z0-9_.-]*|headless[a-z0-9_.-]*|python-[a-z0-9_.-]+"
    "|go-http-client|curl|wget|scrapy|aiohttp|httpx|okhttp|axios)"
)

def origin_latency_us() -> Column:
    """Microseconds to the origin's first byte; ttfb is in seconds."""
    return F.coalesce(F.col("ottfb"), F.col("ttfb") * 1_000_000)


def metric_expr(name: str, statuses: Sequence[int] = (404,)) -> Column:
    """A named metric as an aggregate column."""
    return F.expr(metrics(statuses=tuple(statuses))[name]).alias(name)


def asset_type(url: Column) -> Column:
    """The class of an asset by what stands behind the last dot of its URL."""
    ending = F.lower(F.substring_index(url, ".", -1))
    out = F.lit("API/Dynamic")
    for name, endings in ASSETS.items():
        out = F.when(F.contains(url, F.lit(".")) & ending.isin(*endings), name).otherwise(out)
    return out


def encoding_norm(encoding: Column) -> Column:
    e = F.coalesce(encoding, F.lit(""))
    return F.when(e.contains("br"), "br").when(e.contains("gzip"), "gzip").when(e == "", "uncompressed").otherwise("other")


def proto_label(proto: Column) -> Column:
    return F.when(proto.isin("HTTP/1.0", "HTTP/1.1"), "HTTP/1").when(proto.isin("HTTP/2", "HTTP/2.0", "h2"), "HTTP/2").when(proto.isin("HTTP/3", "HTTP/3.0", "h3"), "HTTP/3").otherwise("Other")


def proto_flags(proto: Column) -> list[Column]:
    label = proto_label(proto)
    return [F.when(label == f"HTTP/{v}", 1).otherwise(0).alias(f"is_http{v}") for v in (1, 2, 3)]


def bucketed(column: Column, edges: Sequence[tuple[float, str]], last: str) -> Column:
    out = None
    for top, name in edges:
        out = F.when(column <= top, name) if out is None else out.when(column <= top, name)
    return out.otherwise(last)


def histogram(df: DataFrame, column: str, edges: Sequence[tuple[float, str]], last: str) -> DataFrame:
    """Rows per bucket with the least value, for ordering."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(bucketed(F.col(column), edges, last).alias("bucket"))
    return rows.agg(F.count("*").alias("count"), F.min(column).alias("min_val")).orderBy("min_val")


def size_histogram(df: DataFrame, column: str = "req_header_bytes") -> DataFrame:
    return histogram(df, column, HEADER_EDGES, ">32KB")


def ttl_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, "ttl", TTL_EDGES, ">1d")


def conn_histogram(df: DataFrame) -> DataFrame:
    return histogram(df.filter("conn_requests > 0"), "conn_requests", [(1, "1"), (5, "2-5"), (20, "6-20")], "21+")


def duration_histogram(df: DataFrame, column: str = "dur") -> DataFrame:
    return histogram(df, column, DURATION_EDGES, ">1h")


def ua_crawler_token(ua: Column) -> Column:
    return F.regexp_extract(F.lower(ua), CRAWLER, 1)


def ua_chrome_major(ua: Column) -> Column:
    return F.regexp_extract(ua, r"Chrome/([0-9]+)\.", 1).try_cast("int")


def referer_domain(referer: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(referer), r"https?://(?:www\.)*([^/.:;\s]+)", 1), F.lit(""))


def fetcher_stem(ua: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(ua), "([a-z0-9]+)-(?:user|externalfetcher)", 1), F.lit(""))


def url_flags(logs: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Add a boolean per pattern, row by row: a shuffle of the log by URL would cost more than the matching."""
    return logs.withColumns({n: F.coalesce(F.col("url").rlike(p), F.lit(False)) for n, p in patterns.items()})


def network_health_score(loss: Column, congestion_us: Column, jitter_us: Column, error_pct: Column) -> Column:
    """100 (1 - (0.4 loss + 0.3 congestion + 0.2 jitter + 0.1 errors)), each clipped to 0..1 of its bad value."""
    part = lambda c, bad: F.least(F.greatest(F.coalesce(c, F.lit(0)) / bad, F.lit(0)), F.lit(1))
    return F.lit(100) * (1 - (0.4 * part(loss, 0.05) + 0.3 * part(congestion_us, 100000) + 0.2 * part(jitter_us, 50000) + 0.1 * part(error_pct, 10)))


def with_labels(rows: DataFrame, names: DataFrame, key: str, label: str) -> DataFrame:
    """Display names by lookup (ASN, city); what has no name shows its key.  ``names`` is a reference list."""
    return rows.join(names.select(key, F.col("name")), key, "left").withColumn(label, F.coalesce("name", F.col(key).cast("string"))).drop("name")


def asn_label(rows: DataFrame, names: DataFrame) -> DataFrame:
    return with_labels(rows, names, "asn", "asn_label")


def city_label(city: str = "city", region: str = "region", country: str = "country") -> Column:
    return F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in (city, region, country)])


def geo_fallback(rows: DataFrame, pops: DataFrame) -> DataFrame:
    """Empty coordinates become those of the POP; ``pops`` is a fixed table of a few hundred sites."""
    both = rows.join(F.broadcast(pops.select("pop", "pop_lat", "pop_lon")), "pop", "left")
    return both.withColumn("lat", F.coalesce("lat", "pop_lat")).withColumn("lon", F.coalesce("lon", "pop_lon")).drop("pop_lat", "pop_lon")


def resolve_window(logs: DataFrame, hours: float | None = None, quantum_minutes: int = 1) -> DataFrame:
    """One row (start, end): the last ``hours`` up to the newest row, in whole quanta; by default 24 h, or 1 h where
    there is less than a day of history."""
    span = logs.agg(F.min("timestamp").cast("timestamp").alias("lo"), F.max("timestamp").cast("timestamp").alias("hi"))
    q = quantum_minutes * 60
    end = F.timestamp_seconds(F.ceil(F.unix_timestamp("hi") / q) * q)
    length = F.lit(hours * 3600.0) if hours else F.when(F.unix_timestamp("hi") - F.unix_timestamp("lo") >= 86400, 86400.0).otherwise(3600.0)
    return span.select(F.timestamp_seconds(F.unix_timestamp(end) - length).alias("start"), end.alias("end"))
