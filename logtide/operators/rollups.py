"""Hourly rollups of which every measure can be merged: sums, least and greatest values, quantile and distinct sketches.

A :class:`Rollup` names its keys and measures; building it from rows, merging hours to days or to fewer keys, and reading
quantiles are derived from the kind of each measure.  No rollup stores a finished percentile, average or distinct count.

The quantile sketch is a logarithmic histogram: a map from the centroid of a value to its count, where centroid c stands
for values in (gamma**(c-1), gamma**c].  Maps merge exactly by adding counts, have a bounded number of centroids (some
2,300 for values up to 1e20 with gamma = 1.02), and give quantiles within (gamma - 1) / (gamma + 1), one percent.  Values of zero or less share a
centroid of their own, which stands for zero.  Distinct values are HLL sketches.

Rows are dealt to (measure, centroid) cells and folded in the task before the shuffle, so that a hot key costs at most a
cell for each task and centroid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import HEADER_EDGES, HOUR, MINUTE, ORIGIN_LATENCY, TTL_EDGES, _buckets

GAMMA = 1.02
#: Centroid of values of zero or less.
ZERO = -32768
_HLL_BITS = 12


def centroid(value: Column) -> Column:
    """The centroid of a value; null for null."""
    value = value.cast("double")
    log = F.ceil(F.log(value) / F.log(F.lit(GAMMA))).cast("int")
    return F.when(value.isNotNull(), F.when(value > 0, log).otherwise(F.lit(ZERO)))


def sketch_quantile(sketch: Column, p: float) -> Column:
    """The value of the centroid at which ``p`` of the counts are reached; null for an empty sketch."""
    cells = F.array_sort(F.map_entries(sketch))
    # Ranks from 1: the first cell whose running count reaches p times all.
    need = F.aggregate(F.map_values(sketch), F.lit(0).cast("bigint"), lambda s, n: s + n) * F.lit(p)
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("at"))

    def step(done: Column, cell: Column) -> Column:
        upto = done["upto"] + cell["value"]
        return F.struct(upto.alias("upto"), F.when(done["at"].isNotNull(), done["at"]).when(upto >= need, cell["key"]).alias("at"))

    at = F.aggregate(cells, start, step)["at"]
    return F.when(at == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), at) * 2 / (GAMMA + 1))


@dataclass(frozen=True)
class Rollup:
    """Keys (the first is the time bucket) and measures by kind, as SQL expressions of a row."""

    keys: Mapping[str, str]
    sums: Mapping[str, str]
    least: Mapping[str, str] = field(default_factory=dict)
    greatest: Mapping[str, str] = field(default_factory=dict)
    sketches: Mapping[str, str] = field(default_factory=dict)
    distinct: Mapping[str, str] = field(default_factory=dict)
    where: str = "true"
    #: What readers see: name -> (sketch, p, unit that values are divided by), and name -> SQL of sums.
    quantiles: Mapping[str, tuple[str, float, float]] = field(default_factory=dict)
    ratios: Mapping[str, str] = field(default_factory=dict)

    @property
    def bucket(self) -> str:
        return next(iter(self.keys))

    def _combined(self, table: DataFrame, keys: Sequence[str]) -> list[Column]:
        """Aggregates that merge columns of this rollup, sketches apart."""
        out = [F.sum(c).alias(c) for c in self.sums] + [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in self.greatest]
        return out + [F.hll_union_agg(c).alias(c) for c in self.distinct]

    def build(self, rows: DataFrame) -> DataFrame:
        """The rollup of ``rows``."""
        kept = rows if self.where == "true" else rows.filter(self.where)
        kept = kept.select(*[F.expr(e).alias(n) for n, e in self.keys.items()], *[F.expr(e).alias(n) for kind in (self.sums, self.least, self.greatest) for n, e in kind.items()],
                           *[F.expr(f"CAST({e} AS STRING)").alias(n) for n, e in self.distinct.items()], *[centroid(F.expr(e)).alias(n) for n, e in self.sketches.items()])
        first = [F.sum(c).alias(c) for c in self.sums] + [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in self.greatest]
        first += [F.hll_sketch_agg(c, _HLL_BITS).alias(c) for c in self.distinct]
        if not self.sketches:
            return kept.groupBy(*self.keys).agg(*first)
        # One row for the plain measures, which has no centroid, and one for each sketch.
        plain = F.struct(F.lit(None).cast("string").alias("sketch"), F.lit(None).cast("int").alias("at"))
        cells = [F.struct(F.lit(c).alias("sketch"), F.col(c).alias("at")) for c in self.sketches]
        dealt = kept.withColumn("__cell", F.explode(F.array(plain, *cells))).filter("__cell.sketch IS NULL OR __cell.at IS NOT NULL")
        main = F.col("__cell.sketch").isNull()
        parts = [F.sum(F.when(main, F.col(c))).alias(c) for c in self.sums] + [F.min(F.when(main, F.col(c))).alias(c) for c in self.least] + [F.max(F.when(main, F.col(c))).alias(c) for c in self.greatest]
        parts += [F.hll_sketch_agg(F.when(main, F.col(c)), _HLL_BITS).alias(c) for c in self.distinct]
        counted = dealt.groupBy(*self.keys, "__cell").agg(F.count("*").alias("__n"), *parts)
        return self._assembled(counted, list(self.keys))

    def _assembled(self, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Cells (keys, cell, n, plain measures in the cells without sketch) as one row for each key."""
        main = F.col("__cell.sketch").isNull()
        plain = [F.sum(F.when(main, F.col(c))).alias(c) for c in self.sums] + [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in self.greatest]
        plain += [F.hll_union_agg(F.when(main, F.col(c))).alias(c) for c in self.distinct]
        entry = lambda s: F.when(F.col("__cell.sketch") == s, F.struct(F.col("__cell.at").alias("key"), F.col("__n").alias("value")))
        maps = [F.map_from_entries(F.array_sort(F.collect_list(entry(s)))).alias(s) for s in self.sketches]
        return counted.groupBy(*keys).agg(*plain, *maps).select(*keys, *self.sums, *self.least, *self.greatest, *self.distinct, *self.sketches)

    def merge(self, table: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """``table`` with its rows of equal ``keys`` merged; nothing is lost but the keys that are left out."""
        keys = list(keys if keys is not None else self.keys)
        if not self.sketches:
            return table.groupBy(*keys).agg(*self._combined(table, keys))
        none = F.array(F.struct(F.lit(None).cast("string").alias("sketch"), F.lit(None).cast("int").alias("at"), F.lit(0).cast("bigint").alias("k")))

        def entries(s: str) -> Column:
            return F.transform(F.map_entries(s), lambda e: F.struct(F.lit(s).alias("sketch"), e["key"].alias("at"), e["value"].alias("k")))

        cells = [entries(s) for s in self.sketches]
        rows = table.withColumn("__x", F.explode(F.concat(none, *[F.coalesce(c, F.array().cast("array<struct<sketch:string,at:int,k:bigint>>")) for c in cells])))
        rows = rows.withColumn("__cell", F.struct(F.col("__x.sketch").alias("sketch"), F.col("__x.at").alias("at")))
        main = F.col("__cell.sketch").isNull()
        plain = [F.sum(F.when(main, F.col(c))).alias(c) for c in self.sums] + [F.min(F.when(main, F.col(c))).alias(c) for c in self.least] + [F.max(F.when(main, F.col(c))).alias(c) for c in self.greatest]
        plain += [F.hll_union_agg(F.when(main, F.col(c))).alias(c) for c in self.distinct]
        return self._assembled(rows.groupBy(*keys, "__cell").agg(F.sum("__x.k").alias("__n"), *plain), keys)

    def days(self, hourly: DataFrame) -> DataFrame:
        """Hours, or minutes, merged to days."""
        day = F.substring(self.bucket, 1, 10)
        return self.merge(hourly.withColumn(self.bucket, day)).withColumnRenamed(self.bucket, "day")

    def read(self, table: DataFrame) -> DataFrame:
        """Keys, plain measures, ratios, quantiles and distinct counts as a report shows them."""
        hidden = {*self.sketches, *self.distinct}
        kinds = dict(table.dtypes)
        shown = [F.round(c, 3).alias(c) if c in self.sums and kinds[c] == "double" else F.col(c) for c in table.columns if c not in hidden]
        shown += [F.expr(e).alias(n) for n, e in self.ratios.items()]
        shown += [F.round(sketch_quantile(F.col(s), p) / F.lit(per), 6).alias(n) for n, (s, p, per) in self.quantiles.items()]
        return table.select(*shown, *[F.hll_sketch_estimate(c).alias(c) for c in self.distinct])


def one_if(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1L ELSE 0L END"


def _value_if(value: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN coalesce({value}, 0) ELSE 0 END"


_ALL, _RTT = "1L", "tcp_rtt > 0"
_HIT3, _HIT2 = "cache IN ('HIT', 'HIT-STALE', 'HIT-CLUSTER')", "cache IN ('HIT', 'HIT-STALE')"
_ORIGIN = {"where": f"{ORIGIN_LATENCY} IS NOT NULL", "sketches": {"latency": ORIGIN_LATENCY}, "quantiles": {"p50_ms": ("latency", 0.5, 1e3), "p95_ms": ("latency", 0.95, 1e3), "p99_ms": ("latency", 0.99, 1e3)}}
_TUNNEL = "(tcp_rtt > 0 AND CAST(rtt_min AS DOUBLE) / tcp_rtt < 0.1)"
_BOTH = "ttfb IS NOT NULL AND elapsed IS NOT NULL"
#: Rounded twice: the last bits of a sum follow from the order of its rows, and may else decide a tie.
_AVG_PLOSS = "round(round(ploss_sum, 9) / nullif(ploss_cnt, 0), 6)"
_TTFB, _OTTFB, _OTTLB = "CAST(ttfb AS DOUBLE) * 1000.0D", "coalesce(ottfb, 0) / 1000.0D", "coalesce(ottlb, 0) / 1000.0D"

ROLLUPS: dict[str, Rollup] = {
    "time_series": Rollup(
        {"minute": MINUTE},
        {"requests": _ALL, "err4": one_if("status BETWEEN 400 AND 499"), "err5": one_if("status >= 500"), "hits": one_if(_HIT2), "cache_total": one_if("cache IS NOT NULL"), "bytes": "coalesce(resp_bytes, 0)", "ttfb_sum": "coalesce(ttfb, 0.0D)", "ttfb_cnt": one_if("ttfb IS NOT NULL")},
    ),
    # All that the value pages are read from.
    "overview": Rollup(
        {"hour": HOUR},
        {
            "requests": _ALL, "hit_requests": one_if(_HIT3), "miss_requests": one_if("cache = 'MISS'"), "pass_requests": one_if("cache = 'PASS'"), "synth_requests": one_if("cache = 'SYNTH'"),
            "origin_requests": one_if("cache IN ('MISS', 'PASS', 'SYNTH', 'ERROR')"), "bandwidth_saved_bytes": _value_if("resp_bytes", _HIT3), "total_bandwidth_bytes": "coalesce(resp_bytes, 0)",
            "shield_hit_requests": one_if(f"NOT edge AND {_HIT3}"), "shield_total_requests": one_if("NOT edge"), "threats_blocked": one_if("waf_sig <> '' AND waf_resp = 406"),
            "hit_elapsed_sum": _value_if("elapsed", _HIT3), "hit_elapsed_count": one_if(f"elapsed IS NOT NULL AND {_HIT3}"), "miss_elapsed_sum": _value_if("elapsed", "cache = 'MISS'"), "miss_elapsed_count": one_if("elapsed IS NOT NULL AND cache = 'MISS'"),
            "hit_ttfb_sum": _value_if("ttfb", _HIT3), "hit_ttfb_count": one_if(f"ttfb IS NOT NULL AND {_HIT3}"), "miss_ttfb_sum": _value_if("ttfb", "cache = 'MISS'"), "miss_ttfb_count": one_if("ttfb IS NOT NULL AND cache = 'MISS'"),
            "waterfall_count": one_if(_BOTH), "edge_processing_sum": _value_if(f"greatest(0.0D, {_TTFB} - {_OTTFB})", _BOTH), "origin_wait_sum": _value_if(_OTTFB, _BOTH),
            "origin_download_sum": _value_if(f"greatest(0.0D, {_OTTLB} - {_OTTFB})", _BOTH), "client_download_sum": _value_if(f"greatest(0.0D, elapsed / 1000.0D - greatest({_OTTLB}, {_TTFB}))", _BOTH),
            "image_requests": one_if("io_output_bytes IS NOT NULL"), "image_saved_bytes": _value_if("io_input_bytes - io_output_bytes", "io_input_bytes > io_output_bytes"),
        },
    ),
    "sessions": Rollup({"hour": HOUR, "ip": "ip", "ja4": "ja4"}, {"reqs": _ALL, "err4": one_if("status BETWEEN 400 AND 499"), "err5": one_if("status >= 500"), "bytes": "coalesce(resp_bytes, 0)"}, {"first_ts": "CAST(timestamp AS STRING)"}, {"last_ts": "CAST(timestamp AS STRING)"}),
    "origin_summary": Rollup({"hour": HOUR}, {"weight": _ALL, "err5": one_if("ost >= 500")}, **_ORIGIN),
    "origin_pop": Rollup({"hour": HOUR, "pop": "pop"}, {"weight": _ALL}, **_ORIGIN),
    "origin_ip": Rollup({"hour": HOUR, "oip": "oip"}, {"weight": _ALL, "err5": one_if("ost >= 500")}, **_ORIGIN),
    "origin_path": Rollup({"hour": HOUR, "edge": "edge"}, {"weight": _ALL}, **_ORIGIN),
    "origin_latency_ts": Rollup({"minute": MINUTE}, {"weight": _ALL}, **_ORIGIN),
    "slow_urls": Rollup({"hour": HOUR, "url": "url"}, {"weight": _ALL}, **_ORIGIN),
    "perf_latency": Rollup({"hour": HOUR, "url": "url"}, {"weight": _ALL}, sketches={"elapsed": "elapsed"}, where="elapsed IS NOT NULL", quantiles={"p50": ("elapsed", 0.5, 1e3), "p95": ("elapsed", 0.95, 1e3), "p99": ("elapsed", 0.99, 1e3)}),
    "ttl_dist": Rollup({"hour": HOUR, "bucket": _buckets("ttl", TTL_EDGES, ">1d")}, {"count": _ALL}, {"min_ttl": "ttl"}, where="ttl IS NOT NULL"),
    "pop_health": Rollup(
        {"hour": HOUR, "pop": "pop"}, {"requests": _ALL, "errors": one_if("status >= 400"), "hits": one_if(_HIT2), "bytes": "coalesce(resp_bytes, 0)"},
        sketches={"rtt": "tcp_rtt", "ttfb": "ttfb * 1000.0D"}, quantiles={"p50_rtt_us": ("rtt", 0.5, 1.0), "p95_ttfb_ms": ("ttfb", 0.95, 1.0)},
    ),
    "network_quality": Rollup({"hour": HOUR, "country": "country"}, {"weight": _ALL}, sketches={"rtt": "tcp_rtt"}, where=_RTT, quantiles={"rtt_ms": ("rtt", 0.5, 1e3)}),
    "network_rtt": Rollup({"hour": HOUR, "asn": "asn"}, {"weight": _ALL}, sketches={"rtt": "tcp_rtt"}, where=_RTT, quantiles={"p95_us": ("rtt", 0.95, 1.0), "p99_us": ("rtt", 0.99, 1.0)}),
    "network_summary": Rollup(
        {"hour": HOUR}, {"requests": _ALL, "ploss_sum": "coalesce(ploss, 0.0D)", "ploss_cnt": one_if("ploss IS NOT NULL"), "retrans": "coalesce(retrans, 0)"},
        sketches={"rtt": "tcp_rtt"}, where=_RTT, quantiles={"rtt_med_us": ("rtt", 0.5, 1.0)}, ratios={"avg_ploss": _AVG_PLOSS},
    ),
    "network_speed": Rollup({"hour": HOUR, "asn": "asn", "c_speed": "c_speed"}, {"cnt": _ALL}, where="c_speed <> ''"),
    "network_geo": Rollup({"hour": HOUR, "country": "country", "city": "city", "metro": "metro"}, {"reqs": _ALL}, sketches={"rtt": "tcp_rtt"}, where=_RTT, quantiles={"rtt_med_us": ("rtt", 0.5, 1.0)}),
    "network_heatmap": Rollup(
        {"hour": HOUR, "asn": "asn"}, {"reqs": _ALL, "ploss_sum": "coalesce(ploss, 0.0D)", "ploss_cnt": one_if("ploss IS NOT NULL"), "err5": one_if("status >= 500")},
        sketches={"rtt": "tcp_rtt", "rtt_var": "rtt_var"}, where=_RTT, quantiles={"rtt_med_us": ("rtt", 0.5, 1.0), "jitter": ("rtt_var", 0.5, 1.0)}, ratios={"avg_ploss": _AVG_PLOSS},
    ),
    "req_size": Rollup({"hour": HOUR, "bucket": _buckets("req_header_bytes", HEADER_EDGES, ">32KB")}, {"count": _ALL}, {"min_val": "req_header_bytes"}),
    "conn_reuse": Rollup(
        {"hour": HOUR, "bucket": "CASE WHEN conn_requests = 1 THEN '1' WHEN conn_requests <= 5 THEN '2-5' WHEN conn_requests <= 20 THEN '6-20' ELSE '21+' END"}, {"count": _ALL}, greatest={"max_val": "conn_requests"}, where="conn_requests > 0",
    ),
    "top_ips": Rollup({"hour": HOUR, "ip": "ip"}, {"reqs": _ALL}, greatest={"max_header": "req_header_bytes"}),
    "coverage": Rollup({"hour": HOUR}, {"total_rows": _ALL, "ja3_rows": one_if("ja3 <> ''"), "ja4_rows": one_if("ja4 <> ''")}),
    "proxy_quality": Rollup({"hour": HOUR, "tunnel": _TUNNEL}, {"count": _ALL}, distinct={"ips": "ip"}),
    "proxy_flagged": Rollup({"hour": HOUR, "ip": "ip"}, {"count": _ALL}, {"min_rtt": "rtt_min"}, where=_TUNNEL),
    "bot_eff": Rollup({"hour": HOUR, "ua": "ua"}, {"cnt": _ALL, "bytes": "coalesce(resp_bytes, 0)"}, where="ua IS NOT NULL AND ua <> ''"),
    "wellknown_bots": Rollup({"hour": HOUR, "bot": "lower(regexp_extract(ua, '([A-Za-z0-9_-]*[Bb]ot)', 1))"}, {"requests": _ALL}, distinct={"ips": "ip"}, where="ua LIKE '%bot%' OR ua LIKE '%Bot%'"),
}


# Coverage: which hours of a rollup can be read, and how the others are had.

#: Up to so many stretches of hours are literal ranges in a filter; more are one range and a join.
_MAX_RANGES = 100


def hour_counts(rows: DataFrame) -> DataFrame:
    """(hour, rows) of what is stored."""
    return rows.groupBy(F.expr(HOUR).alias("hour")).agg(F.count("*").alias("rows"))


def coverage_of(rows: DataFrame, open_from: str) -> DataFrame:
    """(hour, rows, complete): the hours that a rollup was built from, how many rows each had then, and whether it was closed."""
    return hour_counts(rows).withColumn("complete", F.col("hour") < open_from)


def gaps(stored: DataFrame, coverage: DataFrame) -> DataFrame:
    """Hours that are stored but not covered: absent from the rollup, still open when it was built, or built from fewer
    rows than there are now."""
    sound = coverage.filter("complete").select("hour", F.col("rows").alias("built"))
    return stored.join(sound, (stored["hour"] == sound["hour"]) & (F.col("built") >= F.col("rows")), "left_anti").select("hour")


def hour_ranges(hours: Sequence[str]) -> list[tuple[str, str]]:
    """Neighbouring hours (``YYYY-MM-DD HH:00:00``) as stretches [from, to)."""
    out: list[list[datetime]] = []
    for at in sorted({datetime.fromisoformat(h) for h in hours}):
        if out and out[-1][1] == at:
            out[-1][1] = at + timedelta(hours=1)
        else:
            out.append([at, at + timedelta(hours=1)])
    return [(str(a), str(b)) for a, b in out]


def rows_of_hours(logs: DataFrame, hours: Sequence[str]) -> DataFrame:
    """The rows of ``hours``, by literal ranges of the timestamp that reach the scan."""
    ranges = hour_ranges(hours)
    at = lambda text: F.lit(text).cast(logs.schema["timestamp"].dataType)
    if not ranges:
        return logs.limit(0)
    ts = F.col("timestamp")
    if len(ranges) > _MAX_RANGES:
        wanted = logs.sparkSession.createDataFrame([(h,) for h in hours], "__hour string")
        rows = logs.filter((ts >= at(ranges[0][0])) & (ts < at(ranges[-1][1]))).withColumn("__hour", F.expr(HOUR))
        return rows.join(F.broadcast(wanted), "__hour", "left_semi").drop("__hour")
    return logs.filter(reduce(lambda a, b: a | b, [(ts >= at(a)) & (ts < at(b)) for a, b in ranges]))


def _gap_hours(stored: DataFrame, coverage: DataFrame, start: str, end: str) -> list[str]:
    """Hours of [start, end) that the rollup does not cover; a row an hour is all that reaches the driver."""
    within = stored.filter((F.col("hour") >= start) & (F.col("hour") < end))
    return sorted(r["hour"] for r in gaps(within, coverage).collect())


def read_rollup_plus_live(rollup: Rollup, table: DataFrame, coverage: DataFrame, logs: DataFrame, start: str, end: str, stored: DataFrame | None = None) -> DataFrame:
    """The rollup over the hours of [start, end): covered hours from ``table``, all others built from the rows of just those hours.

    ``stored`` (hour, rows) says how many rows there are; by default they are counted, which reads one column.
    """
    inside = (F.col("timestamp") >= F.lit(start).cast(logs.schema["timestamp"].dataType)) & (F.col("timestamp") < F.lit(end).cast(logs.schema["timestamp"].dataType))
    stored = hour_counts(logs.filter(inside)) if stored is None else stored
    missing = _gap_hours(stored, coverage, start, end)
    spark, hour = table.sparkSession, F.substring(rollup.bucket, 1, 13)
    kept = table.filter((F.col(rollup.bucket) >= start) & (F.col(rollup.bucket) < end))
    if missing:
        absent = spark.createDataFrame([(h[:13],) for h in missing], "__hour string")
        kept = kept.withColumn("__hour", hour).join(F.broadcast(absent), "__hour", "left_anti").drop("__hour")
    return kept.unionByName(rollup.build(rows_of_hours(logs, missing)))


def rollup_heal(rollup: Rollup, table: DataFrame, coverage: DataFrame, logs: DataFrame, open_from: str) -> tuple[DataFrame, DataFrame]:
    """``table`` and its coverage with every gap before ``open_from`` built anew, and only those."""
    closed = hour_counts(logs.filter(F.col("timestamp") < F.lit(open_from).cast(logs.schema["timestamp"].dataType)))
    hours = _gap_hours(closed, coverage, "", open_from)
    if not hours:
        return table, coverage
    rows = rows_of_hours(logs, hours)
    spark = table.sparkSession
    gone = F.broadcast(spark.createDataFrame([(h, h[:13]) for h in hours], "__full string, __hour string"))
    kept = table.withColumn("__hour", F.substring(rollup.bucket, 1, 13)).join(gone, "__hour", "left_anti").drop("__hour")
    sound = coverage.join(gone, coverage["hour"] == F.col("__full"), "left_anti")
    return kept.unionByName(rollup.build(rows)), sound.unionByName(coverage_of(rows, open_from))


def partial_hour_merge(rollup: Rollup, table: DataFrame, fresh: DataFrame, watermark: str) -> DataFrame:
    """``table`` with the rows that came after ``watermark`` merged into it, measure by measure."""
    late = fresh.filter(F.col("timestamp") > F.lit(watermark).cast(fresh.schema["timestamp"].dataType))
    return rollup.merge(table.unionByName(rollup.build(late)))


def rollup_repair_day(rollup: Rollup, table: DataFrame, logs: DataFrame, day: str, measure: str) -> tuple[DataFrame, DataFrame]:
    """``table`` with the hours of one day built anew from rows, and what that changed: (hour, was, now, differs)."""
    first = datetime.fromisoformat(day)
    built = rollup.build(rows_of_hours(logs, [str(first + timedelta(hours=h)) for h in range(24)]))
    hour = F.concat(F.substring(rollup.bucket, 1, 13), F.lit(":00:00"))
    of_day = F.col(rollup.bucket).startswith(day)
    totals = lambda t, name: t.groupBy(hour.alias("hour")).agg(F.sum(measure).alias(name))
    report = totals(table.filter(of_day), "was").join(totals(built, "now"), "hour", "full").fillna(0, ["was", "now"])
    return table.filter(~of_day).unionByName(built), report.withColumn("differs", F.col("was") != F.col("now"))


def rebuild_hours(rollup: Rollup, facts: DataFrame, table_path: str, staging_path: str, hours: Sequence[str], count: str) -> None:
    """Replace the partitions of ``hours`` of the stored rollup by what ``facts`` give now.

    The new hours are written aside first, and their measure ``count`` must add up to the facts' number of rows; only then are
    the partitions swapped.  Both steps may be repeated after a failure.
    """
    spark = facts.sparkSession
    rows = rows_of_hours(facts, hours)
    built = rollup.build(rows)
    built.write.mode("overwrite").parquet(staging_path)
    ready = spark.read.schema(built.schema).parquet(staging_path)
    have, want = ready.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0], rows.count()
    if have != want:
        raise ValueError(f"the rebuilt hours count {have} rows, the facts {want}: the stored hours stay as they are")
    hour = F.concat(F.substring(rollup.bucket, 1, 13), F.lit(":00:00"))
    ready.withColumn("part_hour", hour).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_hour").parquet(table_path)
