"""Shared scans: one aggregate that serves many detections, and reports that need several grouped measures at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detections import COMPRESS, PROBE
from .reads import HOUR, MINUTE

def _both(name: str, cond: Column) -> list[Column]:
    return [F.count_if(F.col("is_w") & cond).alias(f"w_{name}"), F.count_if(F.col("is_b") & cond).alias(f"b_{name}")]


def _p(column: str, p: float, cond: str) -> Column:
    return F.expr(f"round(percentile({column}, {p}) FILTER (WHERE {cond}) / 1000.0D, 6)")


def url_extended(logs: DataFrame) -> DataFrame:
    """Per URL: probes, compression, images, cache lifetimes and retries.  Patterns are matched on the distinct URLs,
    after the aggregate, not on every row."""
    small = F.expr("NOT regexp_like(lower(coalesce(resp_header_content_encoding, '')), 'gzip|br|zstd|deflate')")
    sized = F.expr("status = 200 AND resp_bytes >= 1024")
    ttl = "is_w AND ttl > 0 AND hits IS NOT NULL AND age IS NOT NULL"
    out = logs.filter("url IS NOT NULL").groupBy("url").agg(
        *_both("total", F.lit(True)), *_both("err", F.col("status") >= 400), *_both("sized", sized), *_both("uncompressed", sized & small),
        F.count_if(F.col("is_w") & (F.col("status") == 200)).alias("w_ok"), F.expr("coalesce(sum(resp_bytes) FILTER (WHERE is_w AND status = 200), 0)").alias("w_ok_bytes"),
        F.count_if(F.col("is_w") & (F.col("status") == 200) & F.lower("ua").contains("mobile")).alias("w_mobile"),
        F.expr(f"count_if({ttl})").alias("ttl_cnt"), *[F.expr(f"round(avg({c}) FILTER (WHERE {ttl}), 6)").alias(f"avg_{c}") for c in ("ttl", "hits", "age")],
        F.count_if(F.col("is_w") & (F.col("oretries") > 0)).alias("retry_cnt"), F.expr("max(oretries) FILTER (WHERE is_w)").alias("retry_max"),
    )
    image = F.lower("url").rlike("[.](jpg|jpeg|png|gif)")
    return out.withColumns({"is_probe": F.col("url").rlike(PROBE), "is_text": F.col("url").rlike(COMPRESS), "is_image": image})


def fingerprints(logs: DataFrame) -> DataFrame:
    """Per TLS fingerprint and per cipher list: addresses, networks and requests, all and outside hosting."""
    w, b, home = F.col("is_w"), F.col("is_b"), F.coalesce(F.col("p_type") != "hosting", F.lit(True))
    distinct = lambda c, cond: F.countDistinct(F.when(cond, F.col(c)))
    # Distinct values per key and kind are small sets: each (key, ip, asn) is counted once, then added up.
    rows = logs.select(F.explode(F.array(F.struct(F.lit("fp").alias("kind"), F.col("ja4").alias("value")), F.struct(F.lit("cipher").alias("kind"), F.col("tls_ciphers_sha").alias("value")))).alias("k"), "ip", "asn", "is_w", "is_b", home.alias("home"))
    rows = rows.filter("k.value <> ''").groupBy("k", "ip", "asn", "home", "is_w", "is_b").agg(F.count("*").alias("n"))
    return rows.groupBy("k.kind", "k.value").agg(
        distinct("ip", w).alias("w_ips"), distinct("ip", b).alias("b_ips"), F.sum(F.when(w, F.col("n")).otherwise(0)).alias("w_reqs"),
        distinct("ip", w & F.col("home")).alias("w_home_ips"), distinct("asn", w & F.col("home")).alias("w_home_asns"), distinct("asn", b & F.col("home")).alias("b_home_asns"),
    )


def geo_latency(logs: DataFrame) -> DataFrame:
    """Per POP, server region and metro: p95 latency and median delivery rate in window and baseline."""
    place = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in ("pop", "server_region", "metro")]))
    rows = logs.select(place.alias("p"), "elapsed", "ottfb", "delivery_rate", "is_w", "is_b").filter("p.value <> ''")
    return rows.groupBy("p.dim", "p.value").agg(
        _p("elapsed", 0.95, "is_w").alias("w_p95"), _p("elapsed", 0.95, "is_b").alias("b_p95"), *_both("lat_total", F.col("elapsed").isNotNull()),
        F.expr("round(percentile(ottfb, 0.95) FILTER (WHERE is_w AND elapsed IS NOT NULL) / 1000.0D, 0)").alias("w_ottfb_p95"),
        *[F.expr(f"percentile(delivery_rate, 0.5) FILTER (WHERE is_{s} AND delivery_rate > 0)").alias(f"{s}_rate") for s in "wb"], *_both("rate_total", F.col("delivery_rate") > 0),
    )


#: The eight groupings of the dimension scan.
DIMS = (("country",), ("p_type",), ("method",), ("c_type", "c_speed"), ("ost",), ("oip",), ("referer",), ("ua",))


def dimensions(logs: DataFrame) -> DataFrame:
    """Counts in window and baseline, and of origin errors, for each value of eight dimensions, from one scan.

    Rows are counted per combination of nothing but the dimension at hand: a row is exploded into its eight values,
    which partial aggregation folds before the shuffle.
    """
    name = lambda d: F.struct(F.lit("+".join(d)).alias("dim"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d]).alias("value"))
    rows = logs.select(F.explode(F.array(*[name(d) for d in DIMS])).alias("d"), "ost", "is_w", "is_b")
    return rows.groupBy("d.dim", "d.value").agg(*_both("cnt", F.lit(True)), *_both("ost_known", F.col("ost").isNotNull()), *_both("ost_5xx", F.col("ost") >= 500))


def exact_window(minutes: DataFrame, logs: DataFrame, start: str, end: str, sums: Sequence[str], fresh) -> DataFrame:
    """Sums over [start, end]: whole minutes from the minute rollup, the two edges from the rows.

    ``minutes`` has ``minute`` and ``sums``; ``fresh`` makes the same table from rows.  The filters are literals, so
    that both sides are pruned where they are read.
    """
    first = F.lit(start).cast("timestamp_ntz")
    last = F.lit(end).cast("timestamp_ntz")
    whole_from = F.date_trunc("minute", first + F.expr("INTERVAL 59.999999 SECONDS")).cast("timestamp_ntz")
    whole_to = F.date_trunc("minute", last).cast("timestamp_ntz")
    minute = F.col("minute").cast("timestamp_ntz")
    inside = minutes.filter((minute >= whole_from) & (minute < whole_to))
    ts = F.col("timestamp")
    edges = logs.filter((ts >= first) & (ts <= last) & ((ts < whole_from) | (ts >= whole_to)))
    rows = inside.select("minute", *sums).unionByName(fresh(edges).select("minute", *sums))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


#: Measures and dimensions of the minute facts, by family.
FACTS = {
    "origin": (("pop", "edge"), "ottfb", "ost >= 500"),
    "performance": (("url",), "elapsed", "status >= 500"),
    "network": (("asn", "country"), "tcp_rtt", "ploss > 0.01"),
    "security": (("ja4",), "req_header_bytes", "waf_sig <> ''"),
    "cmcd": (("cmcd_cid",), "cmcd_mtp", "cmcd_bs"),
    "request": (("method", "status"), "resp_bytes", "status >= 400"),
}


#: Rows that one task takes into minute facts.
_FACT_ROWS = 250_000


def fact_tasks(logs: DataFrame) -> int:
    """Tasks for the minute facts of a family: as many as it takes for :data:`_FACT_ROWS` rows each."""
    return max(1, -(-logs.count() // _FACT_ROWS))


def minute_facts(logs: DataFrame, family: str, gamma: float = 1.02, tasks: int | None = None) -> DataFrame:
    """Minute by dimension: rows, flagged rows, sum, and the logarithmic histogram of the family's measure, which
    merges exactly by adding counts.  A cell's histogram has a bounded number of centroids.

    Cells are nearly as many as rows, so rows are dealt by minute and dimension once, to a number of tasks that follows
    from theirs; all that follows by these keys stays in the task.
    """
    dims, measure, flag = FACTS[family]
    value = F.col(measure).cast("double")
    at = F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(gamma))).cast("int"))
    keys = [F.expr(MINUTE).alias("minute"), *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims]]
    names = ["minute", *dims]
    rows = logs.select(*keys, at.alias("centroid"), F.expr(flag).alias("__flag"), F.col(measure).alias("__measure"))
    dealt = rows.repartition(tasks or fact_tasks(logs), *names)
    cells = dealt.groupBy(*names, "centroid").agg(F.count("*").alias("n"), F.count_if("__flag").alias("flagged"), F.sum("__measure").alias("total"))
    out = cells.groupBy(*names).agg(
        F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.sum("total").cast("double").alias("total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("centroid").isNotNull(), F.struct("centroid", "n"))))).alias("sketch"),
    )
    return out


def merge_facts(facts: DataFrame, keys: Sequence[str], p: float, gamma: float = 1.02) -> DataFrame:
    """Facts merged to ``keys``: rows, flagged rows, sum and the quantile ``p`` of the merged histograms."""
    from pyspark.sql import Window

    sums = facts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.sum("total").alias("total"))
    cells = facts.select(*keys, F.explode("sketch").alias("centroid", "k")).groupBy(*keys, "centroid").agg(F.sum("k").alias("k"))
    by = Window.partitionBy(*keys)
    run = cells.select(*keys, "centroid", F.sum("k").over(by.orderBy("centroid")).alias("upto"), F.sum("k").over(by).alias("every"))
    at = run.filter(F.col("upto") >= F.col("every") * p).groupBy(*keys).agg(F.min("centroid").alias("c"))
    value = F.round(F.pow(F.lit(gamma), F.col("c")) * 2 / (gamma + 1), 6)
    return sums.join(at, list(keys), "left").select(*keys, "n", "flagged", F.round("total", 3).alias("total"), value.alias("value"))


#: Dimensions of the browser rollup.
RUM_DIMS = ("metric_name", "metric_rating", "browser", "os", "device", "pathname", "country", "city", "pop")
RUM_ERROR_DIMS = ("error_message", "error_file", "pathname")


def rollup_rum(vitals: DataFrame, errors: DataFrame) -> DataFrame:
    """(hour, kind, dimension, value): beacons, rows, sum and number of values, from one scan of each table."""
    entry = lambda d: F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("Unknown")).alias("value"))
    hour = F.expr(HOUR).alias("hour")

    def facts(rows: DataFrame, kind: str, dims: Sequence[str], value: Column) -> DataFrame:
        rows = rows.select(hour, "req_id", value.alias("x"), F.explode(F.array(*[entry(d) for d in dims])).alias("d"))
        out = rows.groupBy("hour", "d.dim", "d.value").agg(F.countDistinct("req_id").alias("beacons"), F.count("*").alias("rows"), F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 4).alias("value_sum"))
        return out.withColumn("kind", F.lit(kind))

    return facts(vitals, "vital", RUM_DIMS, F.col("metric_value")).unionByName(facts(errors, "error", RUM_ERROR_DIMS, F.lit(None).cast("double")))


def alert_preview(logs: DataFrame, metric: str, hours: int = 168) -> DataFrame:
    """The metric by hour over the last ``hours``, beside mean and deviation of the same hour of day before them."""
    newest = logs.agg(F.max("timestamp")).first()[0]
    if newest is None:
        newest = "1970-01-01 00:00:00"
    start = F.date_trunc("hour", F.lit(str(newest)).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")).cast("timestamp_ntz")
    series = logs.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("at")).agg(F.expr(metric).cast("double").alias("value"))
    before = series.filter(F.col("at") < start).groupBy(F.hour("at").alias("h")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("days"))
    shown = series.filter(F.col("at") >= start).withColumn("h", F.hour("at"))
    # 24 rows of one hour of day each.
    out = shown.join(F.broadcast(before), "h", "left")
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, F.lit(0.0001)).otherwise(F.col("sd"))
    return out.select(F.col("at").cast("string").alias("hour"), F.round("value", 6).alias("value"), F.round("mean", 6).alias("mean"), F.col("days"), F.round((F.col("value") - F.col("mean")) / sd, 6).alias("zscore"))


def flagged_clients(logs: DataFrame, pops: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` requests that look most like a tunnel: too far for their round trip, or a first hop far shorter than
    the whole way.  Distances are computed on the distinct places and joined back null-safe."""
    from ..functions.scalars import haversine_km

    places = logs.filter("lat IS NOT NULL AND lon IS NOT NULL").select("pop", "lat", "lon").distinct().join(F.broadcast(pops), "pop")
    places = places.select(F.col("pop").alias("p"), F.col("lat").alias("la"), F.col("lon").alias("lo"), haversine_km(F.col("lat"), F.col("lon"), F.col("pop_lat"), F.col("pop_lon")).alias("km"))
    on = F.col("pop").eqNullSafe(F.col("p")) & F.col("lat").eqNullSafe(F.col("la")) & F.col("lon").eqNullSafe(F.col("lo"))
    rows = logs.filter("ip <> '' AND rtt_min IS NOT NULL").join(places, on, "left")
    far = F.coalesce(F.col("km") > F.col("rtt_min") / 1000.0 * 100 + 150, F.lit(False))
    ratio = F.when(F.col("tcp_rtt") > 0, F.col("rtt_min") / F.col("tcp_rtt"))
    rank = F.when(far | F.coalesce(ratio < 0.1, F.lit(False)), 3).when(ratio < 0.2, 2).otherwise(1)
    rows = rows.withColumns({"rank": rank, "impossible": far}).filter("rank > 1")
    rows = rows.orderBy(F.desc("rank"), F.desc_nulls_last("km"), "rid").limit(k)
    return rows.select(
        "rid", "ip", "asn", "pop", F.round(F.col("rtt_min") / 1000.0, 2).cast("double").alias("rtt_min_ms"), F.round(F.col("tcp_rtt") / 1000.0, 2).cast("double").alias("tcp_rtt_ms"),
        F.round("km", 1).alias("distance_km"), "impossible", F.when(F.col("rank") == 3, "High").otherwise("Medium").alias("risk"), "country", "city",
    )


def bot_efficiency(logs: DataFrame) -> DataFrame:
    """Bytes that each crawler family takes beside the visitors that its site refers.

    User agents are counted first and matched after; visitors are distinct addresses per referring site, of agents
    that are no crawlers.  Families and sites meet by equal names.
    """
    crawler = "(bot|crawler|spider|slurp|archiver|scraper|externalagent|extended|headless)"
    low = F.lower(F.coalesce("ua", F.lit("")))
    site = logs.agg(F.greatest(F.sum("resp_bytes"), F.lit(1)).alias("site_bytes"))
    uas = logs.filter("ua <> ''").groupBy("ua").agg(F.count("*").alias("cnt"), F.sum("resp_bytes").alias("bytes"))
    token = F.regexp_extract(F.lower("ua"), "([a-z0-9]+?)[-]?" + crawler, 1)
    bots = uas.filter(F.lower("ua").rlike(crawler)).groupBy(token.alias("stem")).agg(F.sum("cnt").alias("crawls"), F.sum("bytes").alias("crawl_bytes"))
    fetcher = F.nullif(F.regexp_extract(low, "([a-z0-9]+)-(user|externalfetcher)", 1), F.lit(""))
    domain = F.nullif(F.regexp_extract(F.lower(F.coalesce("referer", F.lit(""))), r"https?://(www\.)*([^/.:;\s]+)", 2), F.lit(""))
    people = logs.filter("ip <> ''").filter(~low.rlike(crawler)).select(F.coalesce(fetcher, domain).alias("stem"), "ip").filter("stem IS NOT NULL").distinct()
    visits = people.groupBy("stem").agg(F.count("*").alias("referred"))
    out = bots.join(visits, "stem", "left").crossJoin(F.broadcast(site))
    out = out.withColumn("referred", F.coalesce("referred", F.lit(0)))
    return out.select("stem", "crawls", "crawl_bytes", "referred", F.round(F.col("crawl_bytes") / F.greatest("referred", F.lit(1)), 4).alias("bytes_per_referral"), F.round(F.col("crawl_bytes") * 100.0 / F.col("site_bytes"), 4).cast("double").alias("share_pct"))


def cmcd_timeseries(logs: DataFrame) -> DataFrame:
    """Every hour from the first to the last: viewers, sessions that begin, share of rebuffering, buffer, bitrate,
    throughput and startups; hours without rows are zero."""
    rows = logs.filter("cmcd_sid IS NOT NULL").withColumn("at", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    hours = rows.groupBy("at").agg(
        F.countDistinct("cmcd_sid").alias("viewers"), F.round(F.count_if("cmcd_bs") * 100.0 / F.count("*"), 4).cast("double").alias("rebuffer_pct"),
        F.round(F.avg("cmcd_bl"), 6).alias("avg_buffer"), F.round(F.avg("cmcd_br"), 6).alias("avg_bitrate"), F.expr("percentile(cmcd_mtp, 0.5)").alias("throughput"), F.count_if("cmcd_su").alias("startups"),
    )
    fresh = rows.groupBy("cmcd_sid").agg(F.min("at").alias("at")).groupBy("at").agg(F.count("*").alias("new_sessions"))
    spine = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("at"))
    out = spine.join(hours, "at", "left").join(fresh, "at", "left").fillna(0)
    return out.withColumn("bucket", F.col("at").cast("string")).drop("at")
