"""Bot enrichment: user-agent patterns, address feeds and host names, all on distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cidr_join


def enrich_bots(logs: DataFrame, patterns: DataFrame, feeds: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add bot_name and bot_state (verified, impersonator, unverified or pending).

    ``patterns`` (bot, pattern, host_suffix) is the registry of known bots, a short fixed list; ``feeds`` (feed, cidr)
    are the bots' published ranges, IPv4 and IPv6; ``hosts`` (ip, host and, where known, status and fcrdns) are resolved names.

    An address in one of the bot's ranges is verified.  Any other is judged by its name: without a host suffix for the
    bot it is unverified; not looked up yet (no row, or status ``pending``), pending; without a name, or with one that
    does not lead back to the address (``fcrdns`` false), an impersonator; and verified where the name is the suffix or
    ends in it after a dot.
    """
    # Requests of one agent from one address are one pair, folded before any shuffle; patterns are matched on agents.
    seen = logs.filter("ua IS NOT NULL AND ip IS NOT NULL").select("ua", "ip").distinct()
    uas = seen.select("ua").distinct().join(F.broadcast(patterns), F.expr("lower(ua) RLIKE pattern")).groupBy("ua").agg(F.min(F.struct("bot", "host_suffix")).alias("m")).select("ua", "m.*")
    pairs = seen.join(uas, "ua")
    names = hosts.select("ip", "host", *[(F.col(c) if c in hosts.columns else F.lit(default)).alias(c) for c, default in (("status", "ok"), ("fcrdns", True))], F.lit(True).alias("known"))
    rows = cidr_join(pairs, feeds).join(names, "ip", "left")
    suffix, host = F.col("host_suffix"), F.col("host")
    led_back = F.coalesce(F.col("status").isin("nxdomain", "error") == F.lit(False), F.lit(True)) & host.isNotNull() & F.coalesce("fcrdns", F.lit(False))
    by_name = (
        F.when(suffix.isNull(), "unverified")
        .when(F.col("known").isNull() | F.coalesce(F.col("status") == "pending", F.lit(False)), "pending")
        .when(led_back & ((host == suffix) | host.endswith(F.concat(F.lit("."), suffix))), "verified")
        .otherwise("impersonator")
    )
    state = F.when(F.coalesce(F.array_contains("feeds", F.col("bot")), F.lit(False)), "verified").otherwise(by_name)
    named = rows.select("ua", "ip", F.col("bot").alias("bot_name"), state.alias("bot_state"))
    return logs.join(named, ["ua", "ip"], "left")


def wellknown_bots(enriched: DataFrame) -> DataFrame:
    """Requests of each bot by state."""
    return enriched.filter("bot_name IS NOT NULL").groupBy("bot_name").pivot("bot_state", ["verified", "impersonator", "unverified", "pending"]).count().fillna(0)


def top_bots(logs: DataFrame) -> DataFrame:
    """Share of requests and bytes per crawler token."""
    tok = F.regexp_extract(F.lower("ua"), "([a-z0-9_.-]*(?:bot|crawler|spider)[a-z0-9_.-]*)", 1)
    per = logs.groupBy("ua").agg(F.count("*").alias("n"), F.sum("resp_bytes").alias("b")).groupBy(tok.alias("token")).agg(F.sum("n").alias("requests"), F.sum("b").alias("bytes"))
    site = per.agg(F.sum("bytes").alias("site"))
    return per.filter("token <> ''").crossJoin(F.broadcast(site)).select("token", "requests", "bytes", F.round(F.col("bytes") * 100.0 / F.col("site"), 4).cast("double").alias("bytes_pct"))
