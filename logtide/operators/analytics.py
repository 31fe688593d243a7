"""Operators that are more than one grouped aggregate: top values, sessions, routes, scores, alerts, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import HOUR

GAP_SECONDS = 1800


def top_n(logs: DataFrame, fields: Sequence[str], k: int = 10) -> DataFrame:
    """(field, value, count, total, rank): the top ``k`` values of every field, from one scan and one aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counts = logs.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("field").agg(F.sum("count").alias("total"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(totals), "field")


def exploded_top_n(logs: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Top items of a comma-separated column; whole strings are counted before they are split."""
    strings = logs.filter(f"{column} IS NOT NULL AND {column} <> ''").groupBy(column).agg(F.count("*").alias("n"))
    items = strings.select(F.explode(F.split(column, ",")).alias("x"), "n").select(F.trim("x").alias("value"), "n").filter("value <> ''")
    return items.groupBy("value").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def field_values(logs: DataFrame, field: str, search: str = "", k: int = 100) -> DataFrame:
    rows = logs.select(F.col(field).cast("string").alias("value")).filter("value IS NOT NULL AND value <> ''")
    if search:
        rows = rows.filter(F.col("value").ilike(f"%{search}%"))
    return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def sample_rows(rows: DataFrame, n: int, key: str = "rid") -> DataFrame:
    """A repeatable sample: the ``n`` rows with the least hash of ``key``."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def with_sessions(logs: DataFrame, keys: Sequence[str] = ("ip", "ja4"), gap: int = GAP_SECONDS) -> DataFrame:
    """Add session_no per key: a new session after ``gap`` seconds of silence.

    Rows are ordered within an hour of a key only, so that a client with a large part of all rows is as many groups as it has
    hours.  What an hour's rows amount to - its stretches without such a silence, of which there are few - is stitched along
    the key, and the numbers go back to the rows of the hour, which lie where they were.
    """
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = logs.withColumn("__us", at).withColumn("__hour", F.floor(F.col("__us") / 3_600_000_000))
    hour = Window.partitionBy(*keys, "__hour").orderBy("__us", "rid")
    quiet = F.col("__us") - F.lag("__us").over(hour)
    rows = rows.withColumn("__start", F.when(quiet.isNull() | (quiet > gap * 1_000_000), 1).otherwise(0))
    rows = rows.withColumn("__piece", F.sum("__start").over(hour.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, "__hour", "__piece").agg(F.min("__us").alias("__first"), F.max("__us").alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__first", "__piece")
    silence = F.col("__first") - F.lag("__last").over(along)
    pieces = pieces.withColumn("__new", F.when(silence.isNull() | (silence > gap * 1_000_000), 1).otherwise(0))
    pieces = pieces.withColumn("__no", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hours = pieces.groupBy(*keys, "__hour").agg(F.map_from_entries(F.collect_list(F.struct("__piece", "__no"))).alias("__numbers"))
    hours = hours.toDF(*[f"__k{i}" for i in range(len(keys))], "__h", "__numbers")
    same = F.col("__hour").eqNullSafe(F.col("__h"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(hours, same).withColumn("session_no", F.element_at("__numbers", F.col("__piece")))
    return out.select(*logs.columns, "session_no")


def sessions(logs: DataFrame, keys: Sequence[str] = ("ip", "ja4"), gap: int = GAP_SECONDS, min_requests: int = 100, min_4xx_pct: float = 20.0) -> DataFrame:
    """One row per session with its size, errors, bytes and flag."""
    out = with_sessions(logs, keys, gap).groupBy(*keys, "session_no").agg(
        F.min("timestamp").cast("string").alias("first_ts"), F.max("timestamp").cast("string").alias("last_ts"), F.count("*").alias("requests"),
        F.count_if(F.col("status").between(400, 499)).alias("err4"), F.count_if(F.col("status") >= 500).alias("err5"), F.sum("resp_bytes").alias("bytes"), F.countDistinct("url").alias("urls"),
    )
    pct = F.col("err4") * 100.0 / F.col("requests")
    return out.withColumn("flagged", (F.col("requests") >= min_requests) | (pct >= min_4xx_pct))


def sessions_from_hours(hours: DataFrame, keys: Sequence[str] = ("ip", "ja4"), gap: int = GAP_SECONDS) -> DataFrame:
    """Stitch hourly per-client rows (first_ts, last_ts, reqs, err4, bytes) into sessions by the same gap rule."""
    by = Window.partitionBy(*keys).orderBy("first_ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    quiet = us("first_ts") - F.lag(us("last_ts")).over(by)
    rows = hours.withColumn("s", F.when(quiet.isNull() | (quiet > gap * 1_000_000), 1).otherwise(0))
    rows = rows.withColumn("session_no", F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "session_no").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("reqs").alias("requests"), F.sum("err4").alias("err4"), F.sum("bytes").alias("bytes"))


def shield_routes(logs: DataFrame, k: int = 20) -> DataFrame:
    """Edge-to-shield routes by requests and by overhead: either rank puts a route on the list."""
    edge = logs.filter("edge").select("rid", F.col("pop").alias("edge_pop"), F.expr("coalesce(ottfb, ttfb * 1000000)").alias("e"))
    shield = logs.filter("NOT edge AND prid IS NOT NULL AND prid <> ''").select(F.col("prid").alias("rid"), F.col("pop").alias("shield_pop"), F.expr("coalesce(ottfb, ttfb * 1000000)").alias("s"))
    over = lambda p: F.round(F.expr(f"percentile(e - s, {p}) / 1000.0"), 6)
    routes = edge.join(shield, "rid").groupBy("edge_pop", "shield_pop").agg(F.count("*").alias("requests"), over(0.5).alias("p50_ms"), over(0.95).alias("p95_ms"), over(0.99).alias("p99_ms"))
    # Windows over all rows of the aggregate: at most the square of the number of sites.
    by = lambda c: F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "edge_pop", "shield_pop"))
    ranked = routes.withColumn("r1", by("requests")).withColumn("r2", by("p50_ms")).withColumn("total_routes", F.count("*").over(Window.partitionBy(F.lit(1))))
    return ranked.filter((F.col("r1") <= k) | (F.col("r2") <= k)).drop("r1", "r2")


def transitions(logs: DataFrame, keys: Sequence[str] = ("ip", "ua"), route: str = "url", gap: int = GAP_SECONDS, min_events: int = 2, min_dwell: float = 0.2) -> DataFrame:
    """(prev, curr, n): route changes within sessions that are long and slow enough to be people."""
    rows = with_sessions(logs, keys, gap)
    session = Window.partitionBy(*keys, "session_no")
    by = session.orderBy("timestamp", "rid")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    n = F.count("*").over(session)
    rows = rows.select(
        F.lag(route).over(by).alias("prev"), F.col(route).alias("curr"), n.alias("events"),
        ((F.max(us).over(session) - F.min(us).over(session)) / 1e6 / F.greatest(n - 1, F.lit(1))).alias("dwell"),
    )
    kept = rows.filter((F.col("events") >= min_events) & (F.col("dwell") >= min_dwell) & F.col("prev").isNotNull())
    return kept.groupBy("prev", "curr").agg(F.count("*").alias("n"))


def l2_scores(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(prev, curr, n, row_total, prob, score): smoothed transition probability and its anomaly score, 0 to 100."""
    vocab = edges.select(F.explode(F.array("prev", "curr")).alias("r")).agg(F.countDistinct("r").alias("vocab"))
    rows = edges.groupBy("prev").agg(F.sum("n").alias("row_total"))
    out = edges.join(rows, "prev").crossJoin(F.broadcast(vocab))
    prob = (F.col("n") + alpha) / (F.col("row_total") + F.lit(alpha) * F.col("vocab"))
    score = F.bround(-F.log10("prob") * (100.0 / 6.0)).cast("int")
    out = out.withColumn("prob", prob).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return out.select("prev", "curr", "n", "row_total", F.round("prob", 8).alias("prob"), "score")


def l2_step_scores(logs: DataFrame, edges: DataFrame, keys: Sequence[str] = ("ip", "ua"), route: str = "url", gap: int = GAP_SECONDS, alpha: float = 0.5, beta: float = 0.7) -> DataFrame:
    """(rid, prev, anchor, curr, prob, score): every request of every session against a matrix fitted before.

    ``edges`` are the :func:`transitions` of the baseline.  The probability of a step is the larger of the direct one
    and ``beta`` times the one from the anchor, the route before the previous one, where the matrix has that route.
    A previous route that the matrix has not seen gives 1e-12; the first request of a session, and any request against
    an empty matrix, scores 0.
    """
    by = Window.partitionBy(*keys, "session_no").orderBy("timestamp", "rid")
    rows = with_sessions(logs, keys, gap).select("rid", F.lag(route).over(by).alias("prev"), F.lag(route, 2).over(by).alias("anchor"), F.col(route).alias("curr"))
    vocab = edges.select(F.explode(F.array("prev", "curr")).alias("r")).agg(F.countDistinct("r").alias("vocab"))
    totals = edges.groupBy("prev").agg(F.sum("n").alias("total"))

    def lookup(rows: DataFrame, who: str) -> DataFrame:
        total = totals.select(F.col("prev").alias("__t"), F.col("total").alias(f"{who}_total"))
        pair = edges.select(F.col("prev").alias("__p"), F.col("curr").alias("__c"), F.col("n").alias(f"{who}_n"))
        rows = rows.join(total, F.col(who) == F.col("__t"), "left").drop("__t")
        return rows.join(pair, (F.col(who) == F.col("__p")) & F.col("curr").eqNullSafe(F.col("__c")), "left").drop("__p", "__c")

    rows = lookup(lookup(rows, "prev"), "anchor").crossJoin(F.broadcast(vocab))
    smooth = lambda who: (F.coalesce(f"{who}_n", F.lit(0)) + alpha) / (F.col(f"{who}_total") + F.lit(alpha) * F.col("vocab"))
    direct = F.when(F.col("prev_total").isNull(), 1e-12).otherwise(smooth("prev"))
    skip = F.when(F.col("anchor_total").isNotNull() & (F.col("anchor") != F.col("prev")), smooth("anchor") * beta)
    prob = F.when(F.col("prev").isNull() | (F.col("vocab") == 0), 1.0).otherwise(F.greatest(direct, skip))
    score = F.bround(-F.log10("prob") * (100.0 / 6.0)).cast("int")
    rows = rows.withColumn("prob", prob).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return rows.select("rid", "prev", "anchor", "curr", F.round("prob", 8).alias("prob"), "score")


def l1_scores(logs: DataFrame, key: str = "edge_sid") -> DataFrame:
    """Dwell-time rules: too fast or too regular after three requests of a session."""
    by = Window.partitionBy(key).orderBy("timestamp", "rid")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = logs.select(key, "timestamp", "rid", "edge_cookie_compliance", F.row_number().over(by).alias("seq"), ((us - F.lag(us).over(by)) / 1e6).alias("dwell"))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("m", F.avg("dwell").over(run)).withColumn("v", F.avg(F.col("dwell") * F.col("dwell")).over(run) - F.col("m") * F.col("m"))
    late = F.col("seq") > 3
    score = (
        F.when(late & (F.col("m") < 0.2), 50).otherwise(0)
        + F.when(late & (F.col("v") < 0.05) & F.col("m").between(0.2, 3), 40).otherwise(0)
        + F.when(F.col("edge_cookie_compliance").isin("missing", "expired", "replayed"), 75).when(F.col("edge_cookie_compliance") == "tampered", 100).otherwise(0)
    )
    return rows.select(key, "rid", "seq", F.least(score, F.lit(100)).alias("l1"))


def combined_score(l1: Column, l2: Column, days: Column) -> Column:
    """l1 + l2 x ramp(days / 3), capped and quantised to fives."""
    raw = l1 + l2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), days / 3.0))
    return (F.floor(F.least(F.lit(100.0), raw) / 5) * 5).cast("int")


def roc_auc(scored: DataFrame, score: str = "score", bad: str = "bad") -> DataFrame:
    """One row: Mann-Whitney U with half-credit for ties, by counts per score; 0.5 where a class is empty."""
    per = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(bad)).alias("b"), F.count_if(~F.col(bad)).alias("g"))
    below = F.coalesce(F.sum("g").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("wins", F.col("b") * (below + F.col("g") / 2.0)).agg(F.sum("wins").alias("w"), F.sum("b").alias("nb"), F.sum("g").alias("ng"))
    return wins.select(F.coalesce("nb", F.lit(0)).alias("n_bad"), F.coalesce("ng", F.lit(0)).alias("n_good"), F.round(F.when((F.col("nb") > 0) & (F.col("ng") > 0), F.col("w") / (F.col("nb") * F.col("ng"))).otherwise(0.5), 8).alias("auc"))


def auc_per_reason(scored: DataFrame, reasons: str = "edge_score_reason") -> DataFrame:
    rows = scored.withColumn("reason", F.explode(F.transform(F.split(reasons, ","), lambda x: F.trim(x)))).filter("reason <> ''")
    per = rows.groupBy("reason", F.col("score").alias("s")).agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    below = F.coalesce(F.sum("g").over(Window.partitionBy("reason").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = per.withColumn("w", F.col("b") * (below + F.col("g") / 2.0)).groupBy("reason").agg(F.sum("w").alias("w"), F.sum("b").alias("nb"), F.sum("g").alias("ng"))
    return out.select("reason", "nb", "ng", F.round(F.when((F.col("nb") > 0) & (F.col("ng") > 0), F.col("w") / (F.col("nb") * F.col("ng"))).otherwise(0.5), 8).alias("auc"))


def scoring_curves(scored: DataFrame) -> DataFrame:
    """ROC and precision-recall points at every threshold from 100 down to 0 (bad is positive)."""
    per = scored.groupBy("score").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    grid = scored.sparkSession.range(101).select(F.col("id").cast("int").alias("threshold"))
    all_ = grid.join(per, F.col("threshold") == F.col("score"), "left").fillna(0, ["b", "g"])
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    rows = all_.withColumn("tp", F.sum("b").over(down)).withColumn("fp", F.sum("g").over(down)).withColumn("nb", F.sum("b").over(whole)).withColumn("ng", F.sum("g").over(whole))
    return rows.select("threshold", "tp", "fp", F.expr("round(tp * 1.0D / nullif(nb, 0), 8)").alias("tpr"), F.expr("round(fp * 1.0D / nullif(ng, 0), 8)").alias("fpr"), F.expr("round(tp * 1.0D / nullif(tp + fp, 0), 8)").alias("precision"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Flagged and passed, good and bad, at each threshold: counts per score first, thresholds against those."""
    per = scored.groupBy("score", "bad").agg(F.count("*").alias("n"))
    grid = scored.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    both = per.crossJoin(F.broadcast(grid)).withColumn("hit", F.col("score") >= F.col("threshold"))
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return both.groupBy("threshold").agg(
        pick(F.col("hit")).alias("flagged"), pick(F.col("hit") & ~F.col("bad")).alias("flagged_good"), pick(F.col("hit") & F.col("bad")).alias("flagged_bad"),
        pick(~F.col("hit") & ~F.col("bad")).alias("passed_good"), pick(~F.col("hit") & F.col("bad")).alias("passed_bad"),
    )


def _newest(logs: DataFrame) -> Column | None:
    """The newest timestamp as a literal, so that what is filtered by it prunes files and hours; one value is read."""
    newest = logs.agg(F.max("timestamp").cast("string")).first()[0]
    return None if newest is None else F.lit(newest).cast(logs.schema["timestamp"].dataType)


def _last(logs: DataFrame, minutes: int, ago: int = 0, newest: Column | None = None) -> DataFrame:
    """Rows of the last ``minutes`` up to ``ago`` minutes before the newest row, which is read where it is not given."""
    newest = _newest(logs) if newest is None else newest
    if newest is None:
        return logs.limit(0)
    end = newest - F.expr(f"INTERVAL {ago} MINUTES")
    return logs.filter((F.col("timestamp") >= end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("timestamp") <= end))


_COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def _scope(logs: DataFrame, scope: str) -> DataFrame:
    return logs if scope == "all" else logs.filter("edge" if scope == "edge" else "NOT edge")


def alert_absolute(logs: DataFrame, metric: str, operator: str, threshold: float, minutes: int, scope: str = "all") -> DataFrame:
    out = _last(_scope(logs, scope), minutes).agg(F.count("*").alias("requests"), F.coalesce(F.expr(metric), F.lit(0)).cast("double").alias("val"))
    return out.withColumn("triggered", _COMPARE[operator](F.col("val"), F.lit(threshold)))


def alert_relative(logs: DataFrame, metric: str, threshold: float, minutes: int, comparison: int, increase: bool = True) -> DataFrame:
    """Change in percent against the same window ``comparison`` minutes earlier; needs 50 requests to trigger."""
    newest = _newest(logs)
    now = _last(logs, minutes, newest=newest).agg(F.count("*").alias("requests"), F.expr(metric).cast("double").alias("now"))
    then = _last(logs, minutes, comparison, newest).agg(F.expr(metric).cast("double").alias("then"))
    change = (F.col("now") - F.col("then")) / F.col("then") * 100.0 * (1 if increase else -1)
    rows = now.crossJoin(then).withColumn("val", F.when((F.col("requests") >= 10) & (F.col("then") != 0), F.round(change, 6)))
    return rows.withColumn("triggered", F.coalesce((F.col("val") > threshold) & (F.col("requests") >= 50), F.lit(False)))


def alert_zscore(logs: DataFrame, metric: str, minutes: int = 60, days: int = 7, threshold: float = 3.0) -> DataFrame:
    """The last window against the same hour of earlier days."""
    newest = _newest(logs)
    end = F.lit(None).cast("timestamp_ntz") if newest is None else newest
    past = logs.filter((F.col("timestamp") >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("timestamp") <= end - F.expr("INTERVAL 1 HOUR")) & (F.hour("timestamp") == F.hour(end)))
    hourly = past.groupBy(F.date_trunc("hour", "timestamp").alias("h")).agg(F.expr(metric).cast("double").alias("val"))
    base = hourly.agg(F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"))
    now = _last(logs, minutes, newest=newest).agg(F.count("*").alias("requests"), F.expr(metric).cast("double").alias("val"))
    sd = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1e-4).otherwise(F.col("sd"))
    rows = now.crossJoin(base).withColumn("zscore", F.round((F.col("val") - F.col("mean")) / sd, 6))
    return rows.select("requests", "val", F.round("mean", 6).alias("mean"), "zscore", F.coalesce((F.col("zscore") > threshold) & (F.col("requests") >= 50), F.lit(False)).alias("triggered"))


def gamma_histogram(logs: DataFrame, keys: Sequence[Column], value: str, gamma: float = 1.02) -> DataFrame:
    """Mergeable quantile sketch: counts per logarithmic bucket (about 1 % relative error); merging is a sum."""
    rows = logs.filter(F.col(value) > 0).withColumn("centroid", F.ceil(F.log(F.col(value)) / F.log(F.lit(gamma))).cast("int"))
    return rows.groupBy(*keys, "centroid").agg(F.count("*").alias("n"))


def gamma_quantile(sketch: DataFrame, keys: Sequence[str], p: float, gamma: float = 1.02) -> DataFrame:
    merged = sketch.groupBy(*keys, "centroid").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys)
    rows = merged.withColumn("run", F.sum("n").over(by.orderBy("centroid"))).withColumn("all", F.sum("n").over(by))
    hit = rows.filter(F.col("run") >= F.col("all") * p).groupBy(*keys).agg(F.min("centroid").alias("c"), F.first("all").alias("weight"))
    return hit.select(*keys, "weight", F.round(F.pow(F.lit(gamma), F.col("c")) * 2 / (gamma + 1), 6).alias("value"))


def rollup_field_counts(logs: DataFrame, fields: Sequence[str], per_hour: int = 500) -> DataFrame:
    """(hour, field, value, count), the top values of each hour and their total as ``__total__``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counts = logs.select(F.expr(HOUR).alias("hour"), pairs.alias("p")).select("hour", "p.*").filter("value IS NOT NULL AND value <> ''").groupBy("hour", "field", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("hour", "field").orderBy(F.desc("count"), "value"))
    totals = counts.groupBy("hour", "field").agg(F.sum("count").alias("count")).select("hour", "field", F.lit("__total__").alias("value"), "count")
    return counts.withColumn("r", rank).filter(F.col("r") <= per_hour).drop("r").unionByName(totals)


def merge_days(hourly: DataFrame) -> DataFrame:
    """Hourly counts to days; counts add up."""
    return hourly.groupBy(F.substring("hour", 1, 10).alias("day"), "field", "value").agg(F.sum("count").alias("count"))


def rollup_virtual_fields(logs: DataFrame, column: str = "waf_sig") -> DataFrame:
    strings = logs.filter(f"{column} <> ''").groupBy(F.expr(HOUR).alias("hour"), column).agg(F.count("*").alias("n"))
    items = strings.select("hour", F.explode(F.split(column, ",")).alias("x"), "n").select("hour", F.trim("x").alias("value"), "n")
    return items.filter("value <> ''").groupBy("hour", "value").agg(F.sum("n").alias("count"))


def rollup_ip_spread(logs: DataFrame, field: str = "country", k: int = 5000) -> DataFrame:
    """(hour, value): distinct addresses that were observed, a sample of at most ``k`` of them as a mergeable sketch, whether the
    sample is capped, the hash where it ends, and rows.

    The sample has the addresses of smallest md5, so that reruns and other hours sample alike.  Every task keeps just its
    own ``k`` smallest of a value before the shuffle (Spark limits the groups of the window).
    """
    named = logs.filter(F.col(field).isNotNull() & F.col("ip").isNotNull())
    pairs = named.groupBy(F.expr(HOUR).alias("hour"), F.col(field).alias("value"), "ip").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("hour", "value").agg(F.count("*").alias("observed"), F.sum("n").alias("rows"))
    place = F.row_number().over(Window.partitionBy("hour", "value").orderBy(F.md5("ip"), "ip"))
    sample = pairs.withColumn("place", place).filter(F.col("place") <= k).groupBy("hour", "value").agg(F.hll_sketch_agg("ip", 12).alias("ips_sketch"), F.count("*").alias("sampled"), F.max(F.md5("ip")).alias("last_hash"))
    return totals.join(sample, ["hour", "value"]).withColumn("capped", F.col("observed") > F.col("sampled"))


def ip_spread_days(hourly: DataFrame) -> DataFrame:
    """Days from hours: the union of the samples, and whether any was capped (then ``ips`` is a lower bound)."""
    out = hourly.groupBy(F.substring("hour", 1, 10).alias("day"), "value").agg(F.hll_union_agg("ips_sketch").alias("s"), F.sum("rows").alias("rows"), F.max("capped").alias("capped"))
    return out.select("day", "value", F.hll_sketch_estimate("s").alias("ips"), "rows", "capped")


def correlate_errors(logs: DataFrame, fields: Sequence[str], k: int = 5) -> DataFrame:
    return top_n(logs.filter("status >= 400"), fields, k)


def recent(logs: DataFrame, n: int, columns: Sequence[str], where: str = "true") -> DataFrame:
    return logs.filter(where).orderBy(F.desc("timestamp"), F.desc("rid")).select(*columns).limit(n)


def facts_page(logs: DataFrame, after: tuple[str, str] | None, size: int, columns: Sequence[str]) -> DataFrame:
    """A page of rows, newest first, after the keyset cursor (timestamp, rid)."""
    if after:
        ts = F.lit(after[0]).cast("timestamp_ntz")
        logs = logs.filter((F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("rid") < after[1])))
    return logs.orderBy(F.desc("timestamp"), F.desc("rid")).limit(size).select(F.col("timestamp").cast("string").alias("timestamp"), *columns)


def log_accounting(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against stored rows per hour: gap, loss percent and runs of consecutive hours with a loss."""
    both = expected.join(stored, "hour", "full").fillna(0, ["expected", "stored"])
    both = both.withColumn("gap", F.col("expected") - F.col("stored"))
    hours = (F.unix_seconds(F.col("hour").cast("timestamp")) / 3600).cast("long")
    lossy = both.filter("gap > 0").withColumn("island", hours - F.row_number().over(Window.orderBy("hour")))
    runs = lossy.withColumn("run_length", F.count("*").over(Window.partitionBy("island"))).select("hour", "run_length")
    out = both.join(runs, "hour", "left").fillna(0, ["run_length"])
    loss = F.round(F.expr("gap * 100.0D / nullif(expected, 0)"), 4)
    return out.withColumn("loss_pct", loss).withColumn("severity", gap_severity(F.col("loss_pct")))


def gap_severity(loss: Column) -> Column:
    return F.when(loss >= 50, "critical").when(loss >= 20, "severe").when(loss >= 5, "elevated").when(loss > 0, "mild").otherwise("none")


def downsample(series: DataFrame, key: str, order: str, value: str, points: int) -> DataFrame:
    """At most ``points`` rows a series: first, last, least and greatest, and one of each equal part between."""
    by = Window.partitionBy(key).orderBy(order)
    rows = series.withColumn("__n", F.count("*").over(Window.partitionBy(key))).withColumn("__i", F.row_number().over(by))
    rows = rows.withColumn("__tile", F.ntile(max(1, points - 4)).over(by))
    first = lambda part, *o: F.row_number().over(Window.partitionBy(*part).orderBy(*o)) == 1
    marks = {"__head": first((key, "__tile"), order), "__lo": first((key,), F.asc(value), order), "__hi": first((key,), F.desc(value), order)}
    rows = rows.withColumns(marks)
    ends = (F.col("__n") <= points) | (F.col("__i") == 1) | (F.col("__i") == F.col("__n"))
    keep = ends | F.col("__lo") | F.col("__hi") | F.col("__head")
    return rows.filter(keep).select(*series.columns)


def grouping_sets_counts(logs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Window and baseline counts for each of ``dims`` in one pass."""
    out = logs.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("gid"), F.count_if("is_w").alias("w_cnt"), F.count_if("is_b").alias("b_cnt"))
    name = F.coalesce(*[F.when(F.col("gid") == (2 ** len(dims) - 1) - 2 ** (len(dims) - 1 - k), F.lit(d)) for k, d in enumerate(dims)])
    value = F.coalesce(*[F.when(name == d, F.col(d).cast("string")) for d in dims])
    return out.select(name.alias("dim"), value.alias("value"), "w_cnt", "b_cnt")


def cmcd_overview(logs: DataFrame) -> DataFrame:
    rows = logs.filter("cmcd_sid IS NOT NULL")
    base = rows.agg(F.countDistinct("cmcd_sid").alias("active_sessions"), F.round(F.count_if("cmcd_bs") * 100.0 / F.count("*"), 4).cast("double").alias("rebuffer_rate"), F.round(F.avg("cmcd_br"), 6).alias("avg_bitrate"), F.round(F.avg("cmcd_bl"), 6).alias("avg_buffer_length"), F.expr("percentile(cmcd_mtp, 0.5)").alias("median_throughput"))
    peak = rows.groupBy(F.expr(HOUR).alias("h")).agg(F.countDistinct("cmcd_sid").alias("n")).agg(F.max("n").alias("peak_viewers"))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    spans = rows.groupBy("cmcd_sid").agg(((F.max(us) - F.min(us)) / 1e6).alias("dur")).filter("dur > 0").agg(F.round(F.avg("dur"), 0).alias("avg_dur"))
    return base.crossJoin(peak).crossJoin(spans)


def cmcd_per_session(logs: DataFrame, dim: str, k: int = 20) -> DataFrame:
    """Per session first, then per ``dim``: sessions, rebuffer rate, mean bitrate and buffer."""
    per = logs.filter(f"{dim} IS NOT NULL").groupBy(F.col(dim).alias("value"), "cmcd_sid").agg(F.max(F.when(F.col("cmcd_bs"), 1).otherwise(0)).alias("reb"), F.avg("cmcd_br").alias("br"), F.avg("cmcd_bl").alias("bl"))
    out = per.groupBy("value").agg(F.count("*").alias("session_count"), F.round(F.sum("reb") * 100.0 / F.count("*"), 2).cast("double").alias("rebuffer_rate"), F.round(F.avg("br"), 4).alias("avg_br"), F.round(F.avg("bl"), 4).alias("avg_bl"))
    return out.orderBy(F.desc("session_count"), "value").limit(k)


def rum_counts(vitals: DataFrame, errors: DataFrame) -> DataFrame:
    """Page views, interactions, errors and beacons by distinct request id."""
    v = vitals.select("req_id", F.when(F.col("metric_name").like("event_%"), "i").otherwise("p").alias("kind"))
    both = v.unionByName(errors.select("req_id", F.lit("e").alias("kind"))).distinct()
    d = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("req_id")))
    return both.agg(d("p").alias("pageviews"), d("i").alias("interactions"), d("e").alias("errors_count"), F.countDistinct("req_id").alias("total_beacons"))


def rum_environments(vitals: DataFrame) -> DataFrame:
    sets = [[F.col(c)] for c in ("browser", "os", "device")]
    out = vitals.groupingSets(sets, F.col("browser"), F.col("os"), F.col("device")).agg(F.countDistinct("req_id").alias("count"), F.grouping_id().alias("gid"))
    return out.select(*[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("browser", "os", "device")], "count", F.col("gid").cast("long").alias("gid"))


def rum_worst_pages(vitals: DataFrame, errors: DataFrame, k: int = 5) -> DataFrame:
    load = "metric_name IN ('LCP', 'TTFB')"
    pages = vitals.filter("pathname IS NOT NULL").groupBy(F.col("pathname").alias("path")).agg(
        F.countDistinct("req_id").alias("views"), F.round(F.coalesce(F.expr(f"avg(metric_value) FILTER (WHERE {load})"), F.lit(0.0)), 6).alias("avg_load_time"), F.round(F.expr("percentile(metric_value, 0.75) FILTER (WHERE metric_name = 'LCP')"), 6).alias("lcp")
    )
    bad = errors.filter("pathname IS NOT NULL").groupBy(F.col("pathname").alias("path")).agg(F.countDistinct("req_id").alias("e"))
    out = pages.join(bad, "path", "left").withColumn("error_rate", F.round(F.coalesce("e", F.lit(0)) * 100.0 / F.col("views"), 6).cast("double")).drop("e")
    return out.orderBy(F.desc("error_rate"), F.desc("avg_load_time"), "path").limit(k)


def rum_trends(vitals: DataFrame, errors: DataFrame) -> DataFrame:
    v = vitals.groupBy(F.expr(HOUR).alias("hour")).agg(F.round(F.expr("percentile(metric_value, 0.75) FILTER (WHERE metric_name = 'LCP')"), 6).alias("lcp"), F.countDistinct("req_id").alias("views"))
    e = errors.groupBy(F.expr(HOUR).alias("hour")).agg(F.countDistinct("req_id").alias("errors"))
    out = v.join(e, "hour", "full").fillna(0, ["views", "errors"])
    return out.withColumn("error_rate", F.round(F.expr("errors * 100.0D / nullif(views + errors, 0)"), 6))


def usage_ops(counted: DataFrame, billed: DataFrame) -> DataFrame:
    """Operations counted per class and hour against the provider's totals; the residual is what is unexplained."""
    c = counted.groupBy("hour", "op_class").agg(F.sum("ops").alias("counted"))
    b = billed.groupBy("hour", "op_class").agg(F.sum("ops").alias("billed"))
    return c.join(b, ["hour", "op_class"], "full").fillna(0, ["counted", "billed"]).withColumn("residual", F.col("billed") - F.col("counted"))


def top_flagged(logs: DataFrame, k: int = 50) -> DataFrame:
    return logs.filter("edge_score IS NOT NULL").orderBy(F.desc("edge_score"), F.desc("timestamp"), F.desc("rid")).limit(k).select("rid", "edge_sid", "edge_score", "edge_score_l2", "ip", "url", "status")


def verified_bots_ts(logs: DataFrame) -> DataFrame:
    strings = logs.filter("waf_sig ILIKE '%VERIFIED-BOT.%'").groupBy(F.expr(HOUR).alias("bucket"), "waf_sig").agg(F.count("*").alias("n"))
    tags = strings.select("bucket", F.explode(F.split("waf_sig", ",")).alias("tag"), "n").filter("tag LIKE 'VERIFIED-BOT.%'")
    return tags.groupBy("bucket", F.replace("tag", F.lit("VERIFIED-BOT."), F.lit("")).alias("bot_type")).agg(F.sum("n").alias("count"))


def waf_bots(logs: DataFrame, bots: DataFrame, keys: Sequence = ("bot_name", "category")) -> DataFrame:
    """Requests per ``keys``, columns of the WAF's bot table or of the log, joined by request id.

    Where only bot columns are asked for, ids are counted before the join.
    """
    bots = bots.filter("bot_name IS NOT NULL")
    rows = logs.filter("waf_req_id IS NOT NULL")
    if all(isinstance(k, str) and k in bots.columns for k in keys):
        ids = rows.groupBy("waf_req_id").agg(F.count("*").alias("n"))
        return ids.join(bots, "waf_req_id").groupBy(*keys).agg(F.sum("n").alias("cnt"))
    own = [k for k in keys if not isinstance(k, str)]
    of_bots = [k for k in keys if isinstance(k, str)]
    cells = rows.groupBy("waf_req_id", *own).agg(F.count("*").alias("n"))
    names = [c for c in cells.columns if c not in ("waf_req_id", "n")]
    return cells.join(bots, "waf_req_id").groupBy(*names, *of_bots).agg(F.sum("n").alias("cnt"))


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-null and null rows, distinct values, least and greatest, as text."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(rows.alias("r")).select("r.*").groupBy("column").agg(F.count("v").alias("non_null"), F.count_if(F.col("v").isNull()).alias("nulls"), F.countDistinct("v").alias("n_distinct"), F.min("v").alias("least"), F.max("v").alias("greatest"))
