"""The registered queries of the corpus operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, read_back
from .classifier import fit_quality_model, score_quality
from .common import WORD, sources_table, stage, stage_path
from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .line_dedup import dedup_lines
from .merkle import verify_documents
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack_documents
from .periodic_runs import periodic_runs, strongest
from .quality_rules import quality_rules
from .sharding import shard_documents
from .token_store import read_token_set, write_token_set


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(sources_table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-set")
    write_token_set(sources_table(spark, sf_dir, "documents"), path)
    return read_token_set(spark, path, with_ids=False)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(sources_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sources_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), hard.alias("text"))
    formatted = stage(format_conversations(table.unionByName(extra)), "chat")
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sources_table(spark, sf_dir, "documents"), with_ids=False)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_table(spark, sf_dir, "documents")
    labels = sources_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_quality(docs, fit_quality_model(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(sources_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(sources_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(sources_table(spark, sf_dir, "documents")).drop("distance")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(sources_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(sources_table(spark, sf_dir, "documents"), sources_table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten ends in a stretch of its own words that repeats with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    chosen = F.coalesce((F.col("h") % 10 == 0) & (n > 0), F.lit(False))
    a = (g % n).cast("int")
    rest = n - F.col("a")
    period = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), rest)), " ")
    return words.withColumn("a", F.when(chosen, a)).withColumn("p", F.when(chosen, period)).select("doc_id", F.when(chosen, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_planted(sources_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    top = found.select("doc_id", "runs", strongest(F.col("runs")).alias("best"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verify_documents(sources_table(spark, sf_dir, "documents"), changed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_token_binary, op3_source_mixing, op4_chat_format, op5_packing, op6_quality_classifier,
        op7_sharding, op8_ngram_jaccard, op9_quality_rules, op10_line_dedup, op11_decontamination, op12_periodic_runs,
        op13_merkle_manifest,
    )
}
