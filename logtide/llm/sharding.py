"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws ``-ln(u) / weight`` from a hash of the
document id and the child's name, and the smallest draw wins; a child is so chosen in proportion to its weight.
Changing a child's weight changes no sibling's draw, so movement is confined to the subtrees whose weights change.
A shard that is added after the base layout opens a region of its own: it draws against the other regions as a
whole, no old subtree changes weight, and rows move only into the new shard.

Slots number a shard's rows without gaps.  A shard is never gathered: rows fall into ``slot_buckets`` hash buckets,
bucket counts are pre-aggregated (their table has at most shards x slot_buckets rows, a fixed size), and only the
rows of one bucket are numbered together.

Defined results: null text has no bytes (size 16, crc32 0); a null doc_id hashes as the empty string; equal texts
are placed by their ids, so that a group of copies spreads over all shards; repeated rows get the same shard and
different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage, unit_hash


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 40, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """Shards 0..base-1 in regions of ``racks`` racks of ``per_rack`` shards; every later shard is its own region."""
    size = racks * per_rack
    first = [Shard(s // size, s // per_rack, s) for s in range(min(shards, base))]
    regions, all_racks = -(-base // size), -(-base // per_rack)
    return first + [Shard(regions + k, all_racks + k, base + k) for k in range(max(0, shards - base))]


def _children(tree: list[Shard], parent: str, child: str) -> dict[int, dict[int, float]]:
    """Summed weights of the children below each parent."""
    out: dict[int, dict[int, float]] = {}
    for s in tree:
        below = out.setdefault(getattr(s, parent) if parent else 0, {})
        below[getattr(s, child)] = below.get(getattr(s, child), 0.0) + s.weight
    return dict(sorted(out.items()))


def _descend(rows: DataFrame, tree: list[Shard], parent: str, child: str, at: Column) -> DataFrame:
    """Add the column __child: of the children below ``at``, the one with the smallest draw."""
    table = _children(tree, parent, child)
    entry = lambda c, w: F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w"))
    options = F.create_map(*[x for p, below in table.items() for x in (F.lit(p), F.array(*[entry(c, w) for c, w in sorted(below.items())]))])
    draw = lambda c: F.struct((-F.log(unit_hash(F.col("doc_id"), F.concat(F.lit(child), c["c"].cast("string")))) / c["w"]).alias("d"), c["c"].alias("c"))
    return rows.withColumn(f"__{child}", F.array_min(F.transform(options[at], draw))["c"])


def place(rows: DataFrame, tree: list[Shard], out: str = "shard") -> DataFrame:
    """Add the column ``out``: the shard of each row's doc_id.  All JVM-side, no shuffle."""
    rows = _descend(rows, tree, "", "region", F.lit(0))
    rows = _descend(rows, tree, "region", "rack", F.col("__region"))
    rows = _descend(rows, tree, "rack", "shard", F.col("__rack"))
    return rows.withColumn(out, F.col("__shard")).drop("__region", "__rack", "__shard")


def shard_documents(docs: DataFrame, shards: int = 40, slot_buckets: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = place(rows, layout(shards))
    rows = place(rows, layout(shards + 1), "grown_shard")
    bucket = F.floor(unit_hash(F.lit("slot"), F.col("doc_id")) * slot_buckets).cast("int")
    rows = stage(rows.withColumn("bucket", bucket), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most shards x slot_buckets rows of three numbers: under 1 MB with the default parameters, at any scale.
    rows = rows.join(F.broadcast(offsets), ["shard", "bucket"])
    numbered = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + numbered - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write ``docs`` as Parquet, one folder per shard, all columns kept beside ``shard``."""
    at = docs.columns.index("doc_id")
    flat = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    placed = place(flat.withColumn("doc_id", F.col(f"__c{at}")), layout(shards)).drop("doc_id")
    placed.toDF(*docs.columns, "shard").write.partitionBy("shard").parquet(path)
