"""Registered log queries against DuckDB, on a small events table written by the test."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from logtide.plans import registry

from .oracle import assert_same, connect

NAMES = [
    "time_series", "top_n", "exploded_top_n_waf_sig", "origin_summary", "origin_pop_latency", "shield_routes", "pop_health", "network_heatmap", "perf_top_urls",
    "threat_intel", "assets_summary", "value_overview", "sessions_day_gap", "sessions_from_hours", "transition_matrix", "l2_score", "roc_auc", "scoring_curves",
    "alert_relative", "alert_zscore", "rollup_field_counts", "rollup_minute_facts", "gamma_quantile", "rum_environments", "rum_trends",
    "cmcd_overview", "log_accounting", "filter_spec", "cidr_filter", "normalize_route", "coalesced_url", "coalesced_dim", "facts_page",
    "detect_error_spikes", "detect_cache_collapse", "detect_origin_error_rate", "detect_ua_monoculture", "detect_latency_regression", "detect_botnet_grouping",
    "detect_waf_signal_spikes", "detect_shield_path_degradation", "detect_stale_browser_version", "detect_low_and_slow", "detect_proxy_surge",
    "detect_cacheability_regression", "detect_origin_ip_failure", "detect_credential_enumeration", "detect_repeated_patterns", "asn_leaderboard", "network_summary", "metro_leaderboard", "exact_window",
    "rollup_rum", "alert_preview", "proxy_clients", "bot_efficiency", "cmcd_timeseries", "coalesced_fp", "coalesced_geo_latency", "coalesced_url_extended", "ngwaf_bots_ts", "alert_cooldown", "scoring_sessions",
    "quarantine_split", "ingest_outcomes", "replace_by_source", "write_facts", "rum_extract", "stream_ingest", "stream_dedup", "stream_sessions", "stream_session_score", "stream_capped_sessions", "stream_alerts", "stream_late_data", "corrupt_container",
    "read_rollup_plus_live", "read_rollup_plus_live_pop", "read_rollup_plus_live_minutes", "rollup_heal", "rollup_overview", "rollup_overview_day", "rollup_pop_health_day", "rollup_network_heatmap_day", "rollup_perf_latency_day",
    "rollup_sessions_day", "rollup_conn_reuse_day", "rollup_repair_day", "rollup_repair_day_report", "partial_hour_merge", "rollup_rum_vitals_day", "rollup_ip_spread", "wellknown_bots", "asset_type", "io_usage",
]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    rng, out = random.Random(3), tmp_path_factory.mktemp("sf")
    start, n = datetime.datetime(2024, 1, 1), 3000
    kinds = ["click", "view", "purchase", "signup", "error"]
    table = pa.table({
        "event_id": list(range(n)), "ts": [start + datetime.timedelta(seconds=int(i * 30 * 86400 / n) + i % 7) for i in range(n)],
        "user_id": [rng.randrange(60) for _ in range(n)], "event_type": [rng.choice(kinds) for _ in range(n)],
        "value": [round(rng.random() * 100, 2) for _ in range(n)], "props": ["{}"] * n,
    })
    pq.write_table(table, out / "events.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracles()[name])


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_entry_imports_without_corpus_operators():
    import __spark_entry__ as entry

    assert "time_series" in entry.queries()
