"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / weight`` from a hash of its id, where the weight is its quality.
Within a source the documents are taken in ascending key order until the source's word budget is spent.  Complete
epochs come first: a target of 1.4 times a source takes every document once, and then 0.4 of the source in key
order.  The last document may be taken in part, so that a source meets its budget to the word.

The prefix sums need no task that holds a source: keys fall into logarithmic buckets (``per_octave`` to the factor
of two, so that any weight spreads alike), bucket sums are pre-aggregated, and only the rows of one bucket are ever
ordered together.  The join that hands out bucket offsets is keyed by source and bucket.

Defined results: null text counts as empty (size 0, taken 0); null sources form one source, ordered last;
documents of equal key go by id, then size; repeated rows are taken separately; texts of any length are counted whole;
extra columns, whatever their names, are ignored (``apply_mix`` keeps them); empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, stage, unit_hash

#: Symbols that mark markup debris; the quality weight falls with their share of the text.
DEBRIS = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """Weight from 0.1 to 1: one minus ten times the share of debris symbols; an empty text weighs 1."""
    n = F.char_length(text)
    share = (n - F.char_length(F.translate(text, DEBRIS, ""))).cast("double") / n.cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * share))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Targets per source from (source, source_size): ``share`` of all words split by weight, none above
    ``ceiling`` times its source, the excess shared again by weight.

    Closed form of the repeated sharing: with sources in ascending order of cap over weight, the final rate is the
    largest of ``(total - caps before) / weights from here``.  The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rates = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.element_at(rates, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / onward)
    t = t.withColumn("rate", F.max("rate").over(every))
    return t.select("source", "source_size", F.least("cap", F.col("rate") * F.col("weight")).alias("target"))


def _sampled(docs: DataFrame, keep: Sequence[Column | str], weight: str | None, seed: str, per_octave: int) -> DataFrame:
    """keep, doc_id, source, size, weight, sample_key and its logarithmic bucket, for each row."""
    text = F.coalesce("text", F.lit(""))
    # A weight is positive; others count as the least one.
    own = quality_weight(text) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-6))
    rows = docs.select(*keep, "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), own.alias("weight"))
    rows = rows.withColumn("sample_key", -F.log(unit_hash(F.lit(seed), F.col("doc_id"))) / F.col("weight"))
    return rows.withColumn("bucket", F.floor(F.log2("sample_key") * F.lit(float(per_octave))).cast("int"))


def _offsets(rows: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(source, bucket, bucket_size, offset, source_size, target): words before each bucket of a source."""
    sums = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, ceiling)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
    return offsets.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def _budget() -> Column:
    """Words that a source's last, partial epoch takes."""
    return F.floor(F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
    per_octave: int = 1024,
    weight: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, epochs, weight, sample_key.

    ``weights`` repeat over the sources in code point order, null last.  ``weight`` names a column of quality weights,
    such as a classifier's score; without one, the share of markup debris decides.
    """
    rows = stage(_sampled(pick(docs, "doc_id", "source", "text", *([weight] if weight else [])), [], weight, seed, per_octave), "mix-rows")
    offsets = _offsets(rows, weights, share, ceiling).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset", "source_size", "target")
    joined = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).drop("o_source", "o_bucket")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("sample_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("epochs", _epochs()).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), _budget() - F.col("before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", "weight", "sample_key")


def apply_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
    per_octave: int = 1024,
    weight: str | None = None,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """``docs`` as the mix reads them: a document of ``taken`` words comes once for each complete time it is taken
    and once more, cut after its last taken word, for a fraction; documents not taken go.  All columns stay;
    ``n_chars``, where there is one, follows a cut text.  Documents without words are kept once, as they cost none.

    Texts are not shuffled: the partial epoch of a source ends in one key bucket, and rows of the buckets before and
    behind it are decided where they are read, by a table of one row per source (broadcast up to
    ``broadcast_sources`` rows).  Only rows of the boundary buckets, about one in ``per_octave``, are ordered.

    Every row goes by its own size and share, also where ids repeat or are null: rows of equal key go by doc_id, size
    and a hash of the text, and equal rows are taken one after the other.  Null texts are empty texts, null sources
    one source; an empty table stays empty.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = {n: f"__c{docs.columns.index(n)}" for n in ("doc_id", "text", "source", *([weight] if weight else []))}
    flat = docs.toDF(*names)
    keyed = flat.select(*names, *[F.col(c).alias(n) for n, c in at.items()])
    rows = _sampled(keyed, names, weight, seed, per_octave)
    offsets = _offsets(rows.select("source", "bucket", "size"), weights, share, ceiling).withColumn("epochs", _epochs()).withColumn("budget", _budget())
    # The bucket in which the budget ends: the first one that reaches it.
    ends = F.min(F.when(F.col("offset") + F.col("bucket_size") >= F.col("budget"), F.struct("bucket", "offset")))
    table = stage(offsets.groupBy("source", "epochs", "budget").agg(ends.alias("last")), "mix-sources")
    table = table.select(F.col("source").alias("__s"), "epochs", "budget", F.col("last.bucket").alias("edge"), F.col("last.offset").alias("edge_offset"))
    table = F.broadcast(table) if table.count() <= broadcast_sources else table.hint("merge")
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("__s")))
    edge = F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    outside = rows.filter(~edge).withColumn("part", F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("sample_key", "doc_id", "size", F.xxhash64(at["text"])).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge_offset") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = rows.filter(edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - before)))
    rows = outside.unionByName(inside)
    whole = F.when(F.col("size") > 0, F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(F.lit(0)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select(*names, F.explode(parts).alias("__part"))
    words = F.regexp_extract_all(F.col(at["text"]), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("__part") < 0, F.col(at["text"])).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col("__part"), F.lit(0))), ""))
    rows = rows.withColumn(at["text"], cut)
    if "n_chars" in docs.columns:
        n = f"__c{docs.columns.index('n_chars')}"
        rows = rows.withColumn(n, F.when(F.col("__part") < 0, F.col(n)).otherwise(F.char_length(at["text"]).cast("long")))
    return rows.select(*names).toDF(*docs.columns)
