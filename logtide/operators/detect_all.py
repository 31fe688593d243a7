"""All detections of :mod:`detections` at once, from a few shared scans of the log.

Detections that group by the same kind of key are answered by one aggregate: their measures, each narrowed to the rows
that its detection counts, are computed side by side, equal ones once.  A scan with several keys (POP, region, city,
network...) deals each row to its keys before it is aggregated, and partial aggregation folds them in the task.  The
aggregates are kept (:meth:`DetectAll.release` gives them up); thresholds, top-K and cards work on those.

The log is read nine times, where the detections one by one read it some sixty times; :func:`log_reads` counts the scans
of plans.  Detections whose columns the log lacks are left out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.report import Report
from ..sources.request_log import BASELINE_HOURS, WINDOW_HOURS
from . import detections as D

_CITY = "concat_ws(', ', city, region, country)"
#: Scans: the key of each dimension, and the detections by their dimension.
SCANS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "url": (
        {"url": "url"},
        dict.fromkeys(
            ("error_spikes", "cache_collapse", "cacheability_regression", "cache_ttl_mismatch", "origin_retries", "latency_regression", "tail_latency",
             "image_optimization_opportunities", "payload_compression_regression", "new_probe_urls"), "url",
        ),
    ),
    "ip": (
        {"ip": "ip"},
        dict.fromkeys(("low_and_slow", "credential_enumeration", "content_discovery", "session_harvesting", "request_size_anomaly", "connection_abuse", "orphaned_deep_crawl"), "ip"),
    ),
    "fingerprint": (
        {"ja4": "ja4", "cipher": "tls_ciphers_sha", "chrome": "concat('Chrome ', regexp_extract(ua, 'Chrome/([0-9]+)[.]', 1))"},
        {"botnet_grouping": "ja4", "residential_fingerprint_dispersion": "ja4", "cipher_spread": "cipher", "stale_browser_version": "chrome"},
    ),
    "place": (
        {"city": _CITY, "pop": "pop", "server_region": "server_region", "metro": "metro", "asn": "asn", "asn_metro": "concat_ws('/', CAST(asn AS STRING), CAST(metro AS STRING))", "service": "'service'"},
        {
            "city_error_spikes": "city", "city_surges": "city", "new_city_traffic": "city", "city_latency_regressions": "city", "pop_latency_regression": "pop",
            "region_latency": "server_region", "metro_delivery_degradation": "metro", "asn_hosting_shift": "asn", "network_asn_health": "asn", "asn_metro_performance": "asn_metro",
            "cache_hit_cliff": "service", "http3_fallback": "service", "timeout_split": "service",
        },
    ),
    "value": (
        {"country": "country", "asn": "asn", "ua": "ua", "referer": "referer", "method": "method", "connection": "concat_ws('/', c_type, c_speed)", "ost": "ost", "oip": "oip", "p_type": "p_type", "waf_sig": "waf_sig"},
        {
            "new_country_traffic": "country", "new_asn_traffic": "asn", "asn_concentration": "asn", "ua_monoculture": "ua", "referer_monoculture": "referer", "method_drift": "method",
            "connection_type_mix": "connection", "origin_error_rate": "ost", "origin_ip_failure": "oip", "proxy_surge": "p_type",
        },
    ),
}
#: What the detections with functions of their own need of the scans: scan, dimension, rows, measures.
_EXTRA = {
    "origin_url": ("url", "url", "ottfb IS NOT NULL AND is_w", D.ORIGIN_P95_URL),
    "origin_all": ("place", "service", "ottfb IS NOT NULL", D.ORIGIN_P95),
    "far": ("fingerprint", "ja4", D.TOO_FAR, D.EXCESS),
    "waf": ("value", "waf_sig", "waf_sig IS NOT NULL AND waf_sig <> ''", {"w": "count(*) FILTER (WHERE is_w)", "b": "count(*) FILTER (WHERE is_b)"}),
    "agents": (
        "value", "ua", "true",
        {"w": "count(*) FILTER (WHERE is_w)", "b": "count(*) FILTER (WHERE is_b)", **{f"{k}b": f"coalesce(sum(resp_bytes) FILTER (WHERE is_{k}), 0)" for k in "wb"}},
    ),
}
_AGGREGATE = re.compile(r"\b(?:count|sum|avg|max|min|percentile)\(")
#: Conditions that several measures of a scan share are computed once a row.
_FLAGS = {"probe_url": f"regexp_like(url, '{D.PROBE}')", "auth_url": f"regexp_like(url, '{D.AUTH}')"}


def _closing(text: str, opened: int) -> int:
    """Place behind the parenthesis that closes the one at ``opened``; quoted ones do not count."""
    depth, quoted = 0, False
    for i in range(opened, len(text)):
        if text[i] == "'":
            quoted = not quoted
        elif not quoted:
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return i + 1
    raise ValueError(text)


def narrow(measure: str, condition: str) -> str:
    """``measure`` with each of its aggregates over just the rows that meet ``condition``."""
    out, at = [], 0
    while found := _AGGREGATE.search(measure, at):
        end = _closing(measure, found.end() - 1)
        out.append(measure[at:end])
        head = " FILTER (WHERE "
        if measure.startswith(head, end):
            stop = _closing(measure, end + len(" FILTER "))
            out.append(f"{head}({condition}) AND ({measure[end + len(head) : stop - 1]}))")
            at = stop
        else:
            out.append(f"{head}{condition})")
            at = end
    return "".join([*out, measure[at:]])


def log_reads(table: DataFrame) -> int:
    """Scans of stored tables in the plan of ``table``; kept aggregates are none.  Small local tables do not count."""
    plan = table._jdf.queryExecution().withCachedData().toString()
    return len(re.findall(r"^[\s:+|-]*Relation\b", plan, re.M))


class _Scan:
    """One aggregate over the log, from which the frames of its parts are cut."""

    def __init__(self, dims: Mapping[str, str]):
        self.dims, self.measures, self.parts = dims, {}, {}

    def add(self, name: str, dim: str, where: str, measures: Mapping[str, str]) -> None:
        for flag, text in _FLAGS.items():
            where, measures = where.replace(text, flag), {n: m.replace(text, flag) for n, m in measures.items()}
        condition = where if len(self.dims) == 1 else f"dim = '{dim}' AND ({where})"
        aliases = {n: self.measures.setdefault(narrow(m, condition), f"m{len(self.measures)}") for n, m in {**measures, "__rows": "count(*)"}.items()}
        self.parts[name] = (dim, aliases)

    def run(self, logs: DataFrame) -> None:
        rows = logs.withColumns({flag: F.expr(text) for flag, text in _FLAGS.items() if any(flag in m for m in self.measures)})
        used = {dim for dim, _ in self.parts.values()}
        if len(self.dims) == 1:
            (dim, key), = self.dims.items()
            rows = rows.withColumns({"dim": F.lit(dim), "label": F.expr(f"CAST({key} AS STRING)")})
        else:
            keys = [F.struct(F.lit(dim).alias("dim"), F.expr(f"CAST({key} AS STRING)").alias("label")) for dim, key in self.dims.items() if dim in used]
            rows = rows.withColumn("key", F.explode(F.array(*keys))).withColumns({"dim": F.col("key.dim"), "label": F.col("key.label")})
        self.kept = rows.groupBy("dim", "label").agg(*[F.expr(m).alias(n) for m, n in self.measures.items()])
        self.reads = log_reads(self.kept)
        self.kept.persist(StorageLevel.MEMORY_AND_DISK)

    def part(self, name: str) -> DataFrame:
        """label and measures of the groups that have rows of ``name``."""
        dim, aliases = self.parts[name]
        rows = self.kept.filter((F.col("dim") == dim) & (F.col(aliases["__rows"]) > 0))
        return rows.select("label", *[F.col(a).alias(n) for n, a in aliases.items() if n != "__rows"])


def _needs(*texts: str) -> set[str]:
    """Names in SQL texts, quoted parts left out."""
    return {w for t in texts for w in re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "", t))}


class DetectAll:
    """Items of all detections over ``logs`` (with ``is_w`` and ``is_b``); ``thresholds`` has overrides by detection.

    ``pops`` (pop, pop_lat, pop_lon) is a fixed table of sites; without it impossible distances are left out.
    """

    def __init__(self, logs: DataFrame, pops: DataFrame | None = None, thresholds: Mapping[str, Mapping[str, object]] | None = None, window_hours: float = WINDOW_HOURS, baseline_hours: float = BASELINE_HOURS):
        self.hours = {"window_hours": window_hours, "baseline_hours": baseline_hours}
        self.thresholds = thresholds or {}
        have = set(logs.columns)
        #: Columns that detections may name; any that the log lacks takes its detections with it.
        missing = set(D.LOG_COLUMNS) - have
        lacks = lambda *texts: bool(_needs(*texts) & missing)
        if not lacks("timestamp"):
            logs = logs.withColumn("sec", F.expr(D.SECOND))
        far = pops is not None and not lacks(D.TOO_FAR, D.DISTANCE, D.REACH, "pop")
        self.found: dict[str, DataFrame] = {}
        self.scans: dict[str, _Scan] = {}
        extra = {n: e for n, e in _EXTRA.items() if not lacks(e[2], *e[3].values(), SCANS[e[0]][0][e[1]]) and (n != "far" or far)}
        for scan, (dims, names) in SCANS.items():
            names = {n: d for n, d in names.items() if not self._lacking(D.DETECTIONS[n], dims[d], lacks)}
            made = self.scans[scan] = _Scan({d: k for d, k in dims.items() if not lacks(k)})
            for n, dim in names.items():
                report, given = D.DETECTIONS[n], {**self.thresholds.get(n, {}), **self.hours}
                made.add(n, dim, report.filled(report.where, **given), {m: report.filled(e, **given) for m, e in report.measures.items()})
            for n, (of, dim, where, measures) in extra.items():
                if of == scan:
                    made.add(n, dim, where, measures)
            if not made.parts:
                continue
            rows = logs
            if scan == "fingerprint" and far:
                rows = logs.join(F.broadcast(pops), "pop", "left").withColumns({"distance_km": F.expr(D.DISTANCE), "max_km": F.expr(D.REACH)})
            made.run(rows)
            for n in names:
                given = {**self.thresholds.get(n, {}), **self.hours}
                part = made.part(n)
                key_where = D.DETECTIONS[n].key_where
                self.found[n] = D.DETECTIONS[n].finish(part if key_where == "true" else part.filter(key_where), **given)
        part = lambda n: self.scans[extra[n][0]].part(n)
        if {"origin_url", "origin_all"} <= extra.keys():
            self.found["origin_latency_spike"] = D.slow_origin_urls(part("origin_url"), part("origin_all").drop("label"))
        if "far" in extra:
            self.found["impossible_distance"] = D.far_clients(part("far"))
        if "waf" in extra:
            self.found["waf_signal_spikes"] = D.waf_signals(part("waf").withColumnRenamed("label", "waf_sig"), **self.hours)
        if not lacks("rid prid edge pop ottfb"):
            self.found["shield_path_degradation"] = D.shield_path_degradation(logs)
        if not lacks("ip ja4 ua timestamp"):
            cells = self._keep(D.client_seconds(logs, "ip", "ja4"))
            self.found["repeated_patterns"] = D.regular_clients(cells, "ip", "ua")
            self.found["repeated_patterns_fp"] = D.regular_clients(cells, "ja4", "ip")
        if "agents" in extra and not lacks("ip referer"):
            seen = self._keep(D.visitors(logs))
            self.found["crawler_disparity"] = D.crawlers_and_visitors(self._keep(part("agents").withColumnRenamed("label", "ua")), seen)

    @staticmethod
    def _lacking(report: Report, key: str, lacks) -> bool:
        return lacks(key, report.where, *report.measures.values())

    def _keep(self, table: DataFrame) -> DataFrame:
        self.scans[f"kept-{len(self.scans)}"] = kept = _Scan({})
        kept.kept, kept.reads = table, log_reads(table)
        return table.persist(StorageLevel.MEMORY_AND_DISK)

    def items(self) -> DataFrame:
        """id, label, current_val, baseline_val, unit, severity, meta (the other measures) and the verdict of the card."""
        shown = ["label", "current_val", "baseline_val", "unit", "severity"]

        def card(name: str, found: DataFrame) -> DataFrame:
            rest = [x for c in found.columns if c not in shown for x in (F.lit(c), F.col(c).cast("string"))]
            meta = F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")
            return found.select(F.lit(name).alias("id"), *[F.col(c).cast("double" if c.endswith("_val") else "string").alias(c) for c in shown], meta.alias("meta"))

        rows = reduce(DataFrame.unionByName, [card(n, f) for n, f in self.found.items()])
        # A card has at most some 25 items.
        has = lambda level: F.max(F.col("severity") == level).over(Window.partitionBy("id"))
        graded = F.col("id").isin("repeated_patterns", "repeated_patterns_fp") & ~has("warning")
        verdict = F.when(F.col("id") == "proxy_surge", "warning").when(has("critical"), "critical").when(graded, "info").otherwise("warning")
        return rows.withColumn("verdict", verdict)

    def cards(self) -> DataFrame:
        """One row for each detection that could run: id, verdict (clean where nothing was found) and number of items."""
        spark = next(iter(self.found.values())).sparkSession
        names = spark.createDataFrame([(n,) for n in sorted(self.found)], "id string")
        told = self.items().groupBy("id").agg(F.first("verdict").alias("verdict"), F.count("*").alias("items"))
        return names.join(told, "id", "left").select("id", F.coalesce("verdict", F.lit("clean")).alias("verdict"), F.coalesce("items", F.lit(0)).alias("items"))

    def log_reads(self) -> int:
        """Scans of the log: those that made the kept aggregates, and those of the plan of :meth:`items`."""
        return sum(getattr(scan, "reads", 0) for scan in self.scans.values()) + log_reads(self.items())

    def release(self) -> None:
        """Give up the kept aggregates."""
        for scan in self.scans.values():
            if hasattr(scan, "kept"):
                scan.kept.unpersist()
