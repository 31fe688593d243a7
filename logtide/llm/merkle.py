"""Merkle manifest of a dataset: a tree of digests for each group, a tree over the groups' roots, and proofs by climbing.

Build.  Leaves are digests of rows, sorted by group and key and numbered in a table.  Levels are built ``stride`` at a
time: up to 2**stride neighbours meet in one group, which halves them level by level.  Every node that is met there
becomes a row of the manifest, linked to its parent: the ancestor ``stride`` levels up (or the root, where that is
nearer), with the siblings on the way.  The roots of the groups are the leaves of one more tree.

Climb.  A recursive query starts at the first link of each leaf with the hash to be proved and ascends by the parent links, appending the
siblings to the proof and folding the hash with them, until it has passed the last tree.

Nodes above the first rows are stored once for each block of 2**block_bits leaves below them, so that no more than so many
climbs meet at one row, however large a group is: a root is no hot key.  The copies are 1 in 2**block_bits of the leaves
a step.  Upper nodes reach their copies by broadcast while they are few (which is counted), else by a join.

Defined results: nulls, empty and long texts are hashed as they are (``-`` for null, else the number of UTF-8 bytes,
``:`` and the value); null groups come first, null keys first, rows of one key in the order of their leaves, so that
reruns agree; repeated rows are leaves of their own; a single leaf is its group's root; an empty table has no leaves and an
empty manifest; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage, unstage

_DIGEST = 32


def field(value: Column) -> Column:
    """A field as the hashed text has it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _join(left: Column, right: Column) -> Column:
    """Parent of two digests, of which the right one may be missing."""
    return F.unhex(F.sha2(F.concat(_hex(left), F.coalesce(_hex(right), F.lit(""))), 256))


@dataclass
class Manifest:
    """``leaves``: number, group, at, block, start (hash to climb with), and the caller's columns.  ``nodes``: the linked node rows.
    ``roots``: group, subroot and root.  ``steps``: links that the highest climb passes."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    steps: int


def _numbered(leaves: DataFrame, group: str, key: str) -> DataFrame:
    """Leaves with their place ``at`` in their tree, which is named by the number of its first leaf."""
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("digest"), F.col("input")]
    dealt = leaves.withColumn("input", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("input")
    rows = stage(dealt.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("uid", 33)
    # One row for each partition: where its leaves begin.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begin"))
    number = F.col("begin") + F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("number", number).drop("part", "begin", "uid")


def _halve(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda j: _join(F.get(level, 2 * j), F.get(level, 2 * j + 1)))


def _rise(nodes: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """From nodes (tree, n nodes of the tree on this level, at, digest): (node rows with their siblings, nodes ``stride`` levels up)."""
    blocks = nodes.groupBy("tree", F.shiftright("at", stride).alias("up")).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("level0")
    )
    # A tree ends where one node is left, else all blocks rise by the whole stride.
    bits = F.length(F.bin(F.col("n") - 1))
    height = F.when(F.col("n") > 1 << stride, F.lit(stride)).when(F.col("n") > 1, bits).otherwise(F.lit(0)).cast("int")
    blocks = blocks.withColumn("height", height)
    for t in range(stride):
        here = F.col(f"level{t}")
        blocks = blocks.withColumn(f"level{t + 1}", F.when(F.col("height") > t, _halve(here)).otherwise(here))
    blocks = stage(blocks, "merkle-levels")

    def linked(j: Column) -> Column:
        beside = [F.get(f"level{t}", F.shiftright(j, t).bitwiseXOR(F.lit(1))) for t in range(stride)]
        siblings = F.slice(F.array(*beside), F.lit(1), F.col("height"))
        return F.struct((F.shiftleft(F.col("up"), stride) + j).alias("at"), siblings.alias("siblings"))

    inner = blocks.filter("height > 0")
    rows = inner.select("tree", "up", F.explode(F.transform(F.sequence(F.lit(0), F.size("level0") - 1), linked)).alias("row")).select("tree", "up", "row.*")
    higher = blocks.select("tree", (F.floor((F.col("n") - 1) / (1 << stride)) + 1).alias("n"), F.col("up").alias("at"), F.get(f"level{stride}", F.lit(0)).alias("digest"))
    return rows, higher


def _strides(n: Column, stride: int) -> Column:
    """Links from a leaf to the root of a tree of ``n`` leaves."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / stride)).otherwise(0).cast("int")


def _strides_of(n: int, stride: int) -> int:
    return -(-max(0, n - 1).bit_length() // stride)


def _forest(nodes: DataFrame, stride: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(node rows of each stride, root of each tree); ``most`` is the number of leaves of the largest tree."""
    rows, n = [], most
    while n > 1:
        links, nodes = _rise(nodes, stride)
        rows.append(stage(links, "merkle-links"))
        nodes, n = stage(nodes, "merkle-nodes"), ((n - 1) >> stride) + 1
    return rows, nodes.select("tree", F.col("digest").alias("subroot"))


def _copies(links: DataFrame, blocks: DataFrame, shift: int, few: int) -> DataFrame:
    """Node rows for each block of leaves below them."""
    upper = links.select("tree", F.col("at").alias("node"), "siblings")
    upper = F.broadcast(upper) if upper.count() <= few else upper
    return blocks.withColumn("node", F.shiftright("block", shift)).join(upper, ["tree", "node"])


def _packed(step: Column, at: Column, node: Column, siblings: Column) -> list[Column]:
    """A node row: its key, its place among its neighbours as bits from the lowest level on (1: right), which siblings
    there are, and the siblings behind one another."""
    there = F.transform(siblings, lambda s: F.when(s.isNull(), F.lit("0")).otherwise(F.lit("1")))
    joined = F.aggregate(siblings, F.lit(b""), lambda done, s: F.concat(done, F.coalesce(s, F.lit(b""))))
    return [step.cast("int").alias("step"), F.col("tree"), at.alias("at"), F.col("block"), node.alias("node"), F.array_join(there, "").alias("present"), joined.alias("siblings")]


def build_manifest(leaves: DataFrame, group: str, key: str, stride: int = 10, few: int = 1 << 16, block_bits: int = 8) -> Manifest:
    """Manifest of ``leaves`` (``digest``, ``start``, ``group``, ``key`` and columns that are handed on)."""
    block_bits = min(block_bits, stride)
    rows = _numbered(stage(leaves, "merkle-digests"), group, key)
    trees = stage(rows.groupBy(group).agg(F.min("number").alias("tree"), F.count("*").alias("n")), "merkle-trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    named = trees.select(F.col(group).alias("__group"), "tree", "n")
    named = F.broadcast(named) if n_trees <= few else named
    rows = rows.join(named, F.col(group).eqNullSafe(F.col("__group"))).drop("__group").withColumn("at", F.col("number") - F.col("tree"))
    last = _strides(F.col("n"), stride) + F.lit(_strides_of(n_trees, stride))
    rows = stage(rows.withColumn("block", F.shiftright("at", block_bits)).withColumn("last", last), "merkle-numbered")

    inner, subroots = _forest(rows.select("tree", "n", "at", "digest"), stride, most)
    subroots = stage(subroots.join(trees, "tree"), "merkle-subroots")
    # The groups' roots in the order of their groups, which is that of their first leaves: numbered like the leaves.
    tops = _numbered(subroots.select(F.col("tree").alias("name"), F.col("subroot").alias("digest"), F.lit(0).alias("all")), "all", "name")
    tops = stage(tops.select("name", F.lit(-1).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("number").alias("at"), "digest"), "merkle-tops")
    outer, root = _forest(tops.drop("name"), stride, n_trees)

    # A tree's own links come before those of the tree of roots.
    places = trees.join(tops.select(F.col("name").alias("tree"), F.col("at").alias("top")), "tree").select("tree", _strides(F.col("n"), stride).alias("inner"), "top")
    blocks = rows.filter(F.col("at") % (1 << block_bits) == 0).select("tree", "block")
    blocks = stage(blocks.join(F.broadcast(places) if n_trees <= few else places, "tree"), "merkle-blocks")
    parts = []
    for k, links in enumerate(inner):
        if k == 0:
            made = links.withColumn("block", F.shiftright("at", block_bits))
            parts.append(made.select(*_packed(F.lit(0), F.col("at"), F.col("at"), F.col("siblings"))))
        else:
            made = _copies(links, blocks, stride * k - block_bits, few)
            parts.append(made.select(*_packed(F.lit(k), F.col("block"), F.col("node"), F.col("siblings"))))
    for k, links in enumerate(outer):
        upper = links.select(F.col("at").alias("node"), "siblings")
        upper = F.broadcast(upper) if upper.count() <= few else upper
        made = blocks.withColumn("node", F.shiftright("top", stride * k)).join(upper, "node")
        parts.append(made.select(*_packed(F.col("inner") + k, F.col("block"), F.col("node"), F.col("siblings"))))
    empty = blocks.limit(0).select(*_packed(F.lit(0), F.col("block"), F.col("block"), F.array(F.lit(b""))))
    for part in parts:
        empty = empty.unionByName(part)
    nodes = stage(empty, "merkle-manifest")
    only = root.select(F.col("subroot").alias("root"))
    roots = stage(subroots.select("tree", "subroot").crossJoin(F.broadcast(only)), "merkle-roots")
    unstage(*inner, *outer, blocks, tops)
    return Manifest(rows, nodes, roots, len(inner) + len(outer))


#: A row's siblings fold into the hash from the lowest level on: {start} is the hash, n the node row.
_FOLD = """aggregate(
           sequence(1, length(n.present)),
           struct({start} AS hash, 0 AS used),
           (done, t) -> CASE
             WHEN substring(n.present, t, 1) = '0' THEN struct(unhex(sha2(CAST(lower(hex(done.hash)) AS BINARY), 256)) AS hash, done.used AS used)
             WHEN shiftright(n.node, t - 1) % 2 = 0 THEN struct(
               unhex(sha2(CAST(lower(concat(hex(done.hash), hex(substring(n.siblings, {size} * done.used + 1, {size})))) AS BINARY), 256)) AS hash, done.used + 1 AS used)
             ELSE struct(
               unhex(sha2(CAST(lower(concat(hex(substring(n.siblings, {size} * done.used + 1, {size})), hex(done.hash))) AS BINARY), 256)) AS hash, done.used + 1 AS used)
           END
         ).hash"""
#: The climb.  The first link of a leaf is keyed by its place, all later ones by its block, so that the rows of the leaves
#: themselves, which are most of the manifest, are read once.  A dataset of one leaf has no links at all.
_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT l.number, CASE WHEN n.at IS NULL THEN 0 ELSE 1 END AS step, l.last, l.tree, l.block,
         CASE WHEN n.at IS NULL THEN l.start ELSE {first} END AS folded, coalesce(n.siblings, CAST('' AS BINARY)) AS proof
  FROM {leaves} l LEFT JOIN {lowest} n ON l.tree = n.tree AND l.at = n.at
  UNION ALL
  SELECT c.number, c.step + 1, c.last, c.tree, c.block, {next}, concat(c.proof, n.siblings)
  FROM climb c JOIN {upper} n ON c.step = n.step AND c.tree = n.tree AND c.block = n.at
)
SELECT number, folded, proof FROM climb WHERE step = last
"""


def climb(manifest: Manifest, *columns: Column | str) -> DataFrame:
    """number and ``columns`` of every leaf, made from folded (the hash at the end of its climb) and proof (the siblings it
    passed, from the leaf to the root and left to right, behind one another)."""
    spark = manifest.leaves.sparkSession
    # Spark stops a recursion at a million rows unless told otherwise.
    settings = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(manifest.steps + 2)}
    before = {k: spark.conf.get(k) for k in settings}
    first, later = (_FOLD.format(start=start, size=_DIGEST) for start in ("l.start", "c.folded"))
    query = _CLIMB.replace("{first}", first).replace("{next}", later)
    lowest, upper = manifest.nodes.filter("step = 0"), manifest.nodes.filter("step > 0")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        passed = spark.sql(query, leaves=manifest.leaves, lowest=lowest, upper=upper)
        return stage(passed.select("number", *(columns or ("folded", "proof"))), "merkle-climb")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def verify_rows(docs: DataFrame, values: list[Column], tampered: list[Column], changed: Column, group: str, key: str, stride: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``key``, leaf, subroot, root, proof_sha256 (of the siblings' digests as text) and
    folded_root, the root that results where the rows that are ``changed`` have the values ``tampered`` instead."""
    honest = row_digest(*values)
    claimed = F.when(F.coalesce(changed, F.lit(False)), row_digest(*tampered)).otherwise(honest)
    manifest = build_manifest(docs.select(F.col(key), F.col(group), honest.alias("digest"), claimed.alias("start")), group, key, stride)
    climbed = climb(manifest, F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"))
    few = manifest.roots.count() <= 1 << 16
    leaves = manifest.leaves.select("number", key, "tree", _hex(F.col("digest")).alias("leaf"))
    roots = manifest.roots.select("tree", _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"))
    named = leaves.join(F.broadcast(roots) if few else roots, "tree")
    out = named.join(climbed, "number")
    return out.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verify_documents(docs: DataFrame, changed: Column, stride: int = 10) -> DataFrame:
    """:func:`verify_rows` of doc_id, source, lang, n_chars and text by lang, with n_chars + 1 claimed for the rows that are ``changed``."""
    rows = pick(docs, "doc_id", "source", "lang", "n_chars", "text")
    values = [F.col(c) for c in rows.columns]
    claims = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in rows.columns]
    return verify_rows(rows, values, claims, changed, "lang", "doc_id", stride)
