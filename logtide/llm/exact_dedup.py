"""Exact deduplication: a tree merge of sorted digest runs.

Every input partition is a run of digests, sorted by digest.  Runs merge in binomial rounds, ``2**fan_bits`` ways at a
time: in each round run ``r`` hands its entries to run ``r >> fan_bits``, and the receiving run is merged in digest
order, keeping per digest the best entry and the sum of the counts, and is written sorted again.  A digest so costs each merged run at most ``2**fan_bits`` entries, however many
copies there are; the runs themselves stay spread over the cluster because entries are hashed by run *and* digest.
The winners travel the same tree downwards, so that no join sees a hot key either.

An entry's identity is the sha-256 of the normalised text, verified by its byte length and an independent 64-bit
hash; entries that differ in any of them never merge.

Defined results: null text counts as empty; all empty texts are one group; of equal texts the longest original
(code points) stays, then the smallest doc_id (null ids last), then, among repeated rows, one row.  An empty table
gives an empty result.  Texts of any length are digested whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, drop_chars, pick, split_by_ids, stage

_KEY = ["digest", "check", "n_bytes"]


def _entries(docs: DataFrame) -> DataFrame:
    norm = drop_chars(F.coalesce("text", F.lit("")), SPACE_CHARS)
    return (
        pick(docs, "doc_id", "text")
        .withColumn("norm", norm)
        .select(
            "doc_id",
            F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"),
            F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.octet_length("norm").alias("n_bytes"),
        )
    )


def exact_duplicates(docs: DataFrame, runs: int = 512, fan_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``runs`` is the number of leaf runs of the merge tree (input partitions share them round robin).
    """
    rows = stage(
        _entries(docs).select(
            "*",
            F.monotonically_increasing_id().alias("uid"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        ),
        "dedup-rows",
    )
    best = F.struct((-F.col("n_chars")).alias("rank"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    merge = lambda entries, *sums: stage(entries.groupBy("run", *_KEY).agg(*sums).sortWithinPartitions("run", *_KEY), "dedup-runs")
    level = merge(rows, F.min(best).alias("best"), F.count("*").alias("n"))
    levels, width = [level], runs
    while width > 1:
        level = merge(level.withColumn("run", F.shiftright("run", fan_bits)), F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(level)
        width = -(-width // 2**fan_bits)
    # Only groups of two or more have anything to tell the runs below.
    down = levels[-1].filter("n > 1")
    for below in reversed(levels[:-1]):
        parent = down.withColumnRenamed("run", "parent")
        down = (
            below.select("run", *_KEY)
            .withColumn("parent", F.shiftright("run", fan_bits))
            .join(parent, ["parent", *_KEY])
            .drop("parent")
        )
    won = down.select("run", *_KEY, F.col("best.doc_id").alias("w_id"), F.col("best.uid").alias("w_uid"), "n")
    out = rows.join(won, ["run", *_KEY], "left")
    grouped = F.col("n").isNotNull()
    return out.select(
        "doc_id",
        F.when(grouped, F.col("w_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("w_uid") == F.col("uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, runs: int = 512) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops, all columns unchanged.

    Repeated rows (one doc_id and equal text more than once) leave one row.
    """
    found = stage(exact_duplicates(docs, runs).select("doc_id", "text_sha256", "kept"), "dedup-found")
    suspects = found.filter("not kept").select("doc_id").distinct()
    kept = (
        found.join(suspects.withColumnRenamed("doc_id", "s"), F.col("doc_id").eqNullSafe(F.col("s")), "left_semi")
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
        .filter("kept")
        .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "copies")
    )
    # Rows whose id has no dropped row pass where they are read; only the others are told apart by a join.
    maybe, clear = split_by_ids(docs, suspects)
    names = clear.columns
    at_id, at_text = (f"__c{docs.columns.index(n)}" for n in ("doc_id", "text"))
    sha = F.sha2(drop_chars(F.coalesce(F.col(at_text), F.lit("")), SPACE_CHARS), 256)
    ids = suspects.withColumnRenamed("doc_id", "__s").hint("merge")
    rows = maybe.withColumn("__digest", sha)
    safe = rows.join(ids, F.col(at_id).eqNullSafe(F.col("__s")), "left_anti").select(*names)
    joined = rows.join(kept.hint("merge"), F.col(at_id).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")))
    once = joined.filter("copies = 1").select(*names)
    # Equal rows under one id may still differ in white space or other columns: the longest text stays.
    again = (
        joined.filter("copies > 1")
        .groupBy("__digest", at_id)
        .agg(F.max_by(F.struct(*names), F.struct(F.char_length(at_text), *names)).alias("row"))
        .select("row.*")
    )
    return clear.unionByName(safe).unionByName(once).unionByName(again).toDF(*docs.columns)
