"""Cards: severities on both sides of their thresholds, and all detections from shared scans."""

import pytest
from pyspark.sql import functions as F

from logtide.operators import detections as D
from logtide.operators.detect_all import SCANS, DetectAll, log_reads, narrow
from logtide.plans import registry
from logtide.sources.request_log import request_log

from .test_queries import sf_dir  # noqa: F401

#: Measures of a label and the severity that they have.
LEVELS = [
    ("error_spikes", {"w_rate": 0.5, "b_rate": 0.1}, "critical"), ("error_spikes", {"w_rate": 0.499, "b_rate": None}, "warning"),
    ("city_error_spikes", {"w_rate": 0.5, "b_rate": 0.1}, "critical"), ("city_error_spikes", {"w_rate": 0.49, "b_rate": 0.1}, "warning"),
    ("cache_collapse", {"w_rate": 0.1, "b_rate": 0.6}, "critical"), ("cache_collapse", {"w_rate": 0.1, "b_rate": 0.59}, "warning"), ("cache_collapse", {"w_rate": 0.11, "b_rate": 0.9}, "warning"),
    ("cacheability_regression", {"w_rate": 0.8, "b_rate": 0.1}, "critical"), ("cacheability_regression", {"w_rate": 0.8, "b_rate": 0.11}, "warning"),
    ("cache_hit_cliff", {"w_rate": 0.4, "b_rate": 0.7}, "critical"), ("cache_hit_cliff", {"w_rate": 0.41, "b_rate": 0.7}, "warning"),
    ("origin_error_rate", {"w_cnt": 1, "w_total": 100, "w_5xx": 5}, "warning"), ("origin_error_rate", {"w_cnt": 1, "w_total": 100, "w_5xx": 6}, "critical"),
    ("origin_ip_failure", {"error_pct": 20.0, "median_rate": 1.0}, "warning"), ("origin_ip_failure", {"error_pct": 20.1, "median_rate": 1.0}, "critical"),
    ("new_country_traffic", {"w_cnt": 9}, "info"), ("new_country_traffic", {"w_cnt": 10}, "warning"), ("new_city_traffic", {"w_cnt": 49}, "info"), ("new_city_traffic", {"w_cnt": 50}, "warning"),
    ("new_asn_traffic", {"w_cnt": 99}, "info"), ("new_asn_traffic", {"w_cnt": 100}, "warning"),
    ("city_surges", {"w_cnt": 30, "b_cnt": 1, "spike_ratio": 9.9}, "info"), ("city_surges", {"w_cnt": 30, "b_cnt": 1, "spike_ratio": 10.0}, "warning"),
    ("ua_monoculture", {"w_share": 0.5, "b_share": None}, "critical"), ("asn_concentration", {"w_share": 0.49, "b_share": 0.1}, "warning"), ("method_drift", {"w_share": 0.25, "b_share": 0.1}, "critical"),
    ("asn_hosting_shift", {"w_rate": 0.6, "b_rate": None}, "critical"), ("asn_hosting_shift", {"w_rate": 0.59, "b_rate": 0.0}, "warning"),
    ("latency_regression", {"w_p": 5000.0, "b_p": 1.0}, "critical"), ("latency_regression", {"w_p": 4999.0, "b_p": 1.0}, "warning"), ("asn_metro_performance", {"w_p": 150.0, "b_p": 50.0}, "critical"),
    ("tail_latency", {"p99_ms": 10.0, "p50_ms": 1.0, "ratio": 10.0}, "warning"), ("tail_latency", {"p99_ms": 11.0, "p50_ms": 1.0, "ratio": 10.1}, "critical"),
    ("image_optimization_opportunities", {"avg_kb": 1.0, "total_bytes": 600_000, "mobile_ratio": 0.5}, "info"), ("image_optimization_opportunities", {"avg_kb": 1.0, "total_bytes": 600_000, "mobile_ratio": 0.51}, "warning"),
    ("image_optimization_opportunities", {"avg_kb": 1025.0, "total_bytes": 600_000, "mobile_ratio": 0.0}, "critical"), ("image_optimization_opportunities", {"avg_kb": 1.0, "total_bytes": 10 * 1024 * 1024 + 1, "mobile_ratio": 0.0}, "critical"),
    ("origin_latency_spike", {"p95_ms": 50.0, "b_p95": 10.0}, "warning"), ("origin_latency_spike", {"p95_ms": 50.1, "b_p95": 10.0}, "critical"),
    ("shield_path_degradation", {"w_p50": 3.0, "b_p50": 1.0, "ratio": 3.0}, "critical"), ("shield_path_degradation", {"w_p50": 2.9, "b_p50": 1.0, "ratio": 2.9}, "warning"),
    ("network_asn_health", {"w_ploss": 0.05, "b_ploss": None}, "critical"), ("network_asn_health", {"w_ploss": None, "b_ploss": 0.1}, "warning"),
    ("metro_delivery_degradation", {"w_med": 250_000, "b_med": 1_000_000}, "critical"), ("metro_delivery_degradation", {"w_med": 300_000, "b_med": 1_000_000}, "warning"),
    ("http3_fallback", {"w_rate": 0.1, "b_rate": 0.5}, "critical"), ("http3_fallback", {"w_rate": 0.11, "b_rate": 0.5}, "warning"), ("payload_compression_regression", {"w_rate": 0.9, "b_rate": 0.0}, "critical"),
    ("timeout_split", {"w_conn": 300.0, "b_conn": 100.0, "w_read": 1.0, "b_read": 1.0}, "critical"), ("timeout_split", {"w_conn": 1.0, "b_conn": 1.0, "w_read": 299.0, "b_read": 100.0}, "warning"),
    ("botnet_grouping", {"w_ips": 50, "b_ips": 1}, "critical"), ("cipher_spread", {"w_ips": 49, "b_ips": 1}, "warning"), ("new_probe_urls", {"w_cnt": 5}, "critical"), ("new_probe_urls", {"w_cnt": 4}, "warning"),
    ("waf_signal_spikes", {"w_cnt": 9, "b_cnt": 1, "spike_ratio": 10.0}, "critical"), ("request_size_anomaly", {"max_val": 64_000, "b_p95": 1.0}, "warning"), ("request_size_anomaly", {"max_val": 64_001, "b_p95": 1.0}, "critical"),
    ("connection_abuse", {"max_val": 501, "b_p95": 1.0}, "critical"), ("impossible_distance", {"max_dist_km": 1.0, "min_allowed_km": 1.0, "worst_excess_km": 5000.1}, "critical"),
    ("repeated_patterns", {"avg_interval": 9.0, "stddev": 0.1, "cv_corr": 0.01, "modal_frac": 0.95, "n_events": 30}, "critical"),
    ("repeated_patterns", {"avg_interval": 9.0, "stddev": 0.1, "cv_corr": 0.01, "modal_frac": 0.95, "n_events": 29}, "warning"),
    ("repeated_patterns", {"avg_interval": 9.0, "stddev": 0.1, "cv_corr": 0.29, "modal_frac": 0.6, "n_events": 99}, "info"),
    ("low_and_slow", {"distinct_paths": 10}, "critical"), ("low_and_slow", {"distinct_paths": 9}, "warning"), ("credential_enumeration", {"w_denied": 100, "b_denied": 0}, "critical"),
    ("content_discovery", {"w_404": 99, "b_404": 0}, "warning"), ("session_harvesting", {"w_sessions": 100, "b_sessions": 0}, "critical"), ("stale_browser_version", {"w_reqs": 1, "w_ips": 1, "surge_ratio": 5.0}, "critical"),
    ("orphaned_deep_crawl", {"w_reqs": 200, "w_distinct_urls": 10, "b_reqs": 0}, "critical"), ("orphaned_deep_crawl", {"w_reqs": 199, "w_distinct_urls": 10, "b_reqs": 0}, "warning"),
    ("residential_fingerprint_dispersion", {"w_asns": 9, "b_ips": 1, "asn_ratio": 3.0}, "critical"),
    ("crawler_disparity", {"crawls_per_referral": 4999.0, "baseline_crawls_per_referral": 1.0, "w_bytes": 1, "bandwidth_share_pct": 10.0, "w_referrals": 1}, "warning"),
    ("crawler_disparity", {"crawls_per_referral": 4999.0, "baseline_crawls_per_referral": 1.0, "w_bytes": 1, "bandwidth_share_pct": 10.0, "w_referrals": 0}, "critical"),
    ("connection_type_mix", {"w_share": 0.9, "b_share": 0.1}, "warning"), ("proxy_surge", {"w_cnt": 90, "w_all": 100}, "warning"), ("origin_retries", {"avg_retries": 9.0}, "warning"), ("cache_ttl_mismatch", {"avg_hits": 0.1}, "warning"),
]


def test_severities(spark):
    frames = []
    for k, (name, measures, _) in enumerate(LEVELS):
        literal = {n: F.lit(v) if v is not None else F.lit(None).cast("double") for n, v in measures.items()}
        shown = D._shown(name, spark.range(1).select(F.lit("x").alias("label"), *[c.alias(n) for n, c in literal.items()]))
        frames.append(shown.select(F.lit(k).alias("k"), "severity"))
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    got = {r.k: r.severity for r in union.collect()}
    assert [(LEVELS[k], got[k]) for k in range(len(LEVELS)) if got[k] != LEVELS[k][2]] == []


def test_every_detection_has_a_card_and_a_scan():
    special = {"origin_latency_spike", "shield_path_degradation", "impossible_distance", "waf_signal_spikes", "repeated_patterns", "repeated_patterns_fp", "crawler_disparity"}
    shared = {n for _, names in SCANS.values() for n in names}
    assert len(D.CARDS) == 51 and set(D.CARDS) == set(D.DETECTIONS) | special and shared == set(D.DETECTIONS)
    assert {f"detect_{n}" for n in D.CARDS} <= set(registry.queries())


@pytest.mark.parametrize("measure, narrowed", [
    ("count(*)", "count(*) FILTER (WHERE c)"),
    ("max(a) FILTER (WHERE is_w) - min(b)", "max(a) FILTER (WHERE (c) AND (is_w)) - min(b) FILTER (WHERE c)"),
    ("round(avg(coalesce(x, (1))) / 2, 1)", "round(avg(coalesce(x, (1))) FILTER (WHERE c) / 2, 1)"),
    ("count(DISTINCT u) FILTER (WHERE f(u, ')') = 1)", "count(DISTINCT u) FILTER (WHERE (c) AND (f(u, ')') = 1))"),
])
def test_narrow(measure, narrowed):
    assert narrow(measure, "c") == narrowed


def test_shared_scans_equal_separate_ones_and_read_less(spark, sf_dir):  # noqa: F811
    logs, pops = request_log(spark, sf_dir), registry._pops(spark)
    every = DetectAll(logs, pops, registry._EASIER)
    items = every.items().collect()
    assert every.log_reads() * 5 <= 51
    alone = sum(log_reads(registry.queries()[f"detect_{n}"](spark, sf_dir)) for n in D.CARDS)
    assert every.log_reads() * 6 <= alone
    cards = {r.id: (r.verdict, r["items"]) for r in every.cards().collect()}
    assert len(cards) == 51
    every.release()
    for name in ("error_spikes", "new_probe_urls", "origin_latency_spike", "waf_signal_spikes", "repeated_patterns", "crawler_disparity", "low_and_slow", "timeout_split", "cache_ttl_mismatch"):
        alone = registry.queries()[f"detect_{name}"](spark, sf_dir).collect()
        mine = [i for i in items if i.id == name]
        key = lambda r: (r.label, r.current_val, r.baseline_val, r.unit, r.severity)
        assert sorted(map(key, alone)) == sorted(map(key, mine)) and cards[name] == ((mine[0].verdict if mine else "clean"), len(mine))


def test_detections_without_their_columns_are_left_out(spark, sf_dir):  # noqa: F811
    every = DetectAll(request_log(spark, sf_dir).drop("ja4", "ottfb", "url"))
    gone = {"botnet_grouping", "residential_fingerprint_dispersion", "timeout_split", "origin_latency_spike", "shield_path_degradation", "impossible_distance", "error_spikes", "low_and_slow"}
    assert not gone & set(every.found) and {"cipher_spread", "connection_abuse", "new_country_traffic"} <= set(every.found)
    assert every.items().count() >= 1
    every.release()
