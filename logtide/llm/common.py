"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is ASCII space and U+0009 to U+000D throughout, in Java and Python regex syntax alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Used only by sessions on one machine that name no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it; a cluster's session must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application in the shared folder."""
    return f"{shared_root(spark)}/logtide/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables that this application has staged; results that still read them must be written first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/logtide/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, never a recomputation that could
    number rows differently.  Unlike ``checkpoint()`` the table is columnar, so later reads are pruned.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, so that disk is not held until the session ends."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, by exact case, whatever other columns there are.

    Extra columns may clash with these (``Text`` beside ``text``, or a repeated name: the first one counts).
    """
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(at, names)])


def sources_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def unit_hash(*parts: Column | str) -> Column:
    """Uniform double in (0, 1) from the md5 of the joined parts; any engine can recompute it."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def value_key(*parts: Column) -> Column:
    """64-bit hash of strings that tells null from empty; beside doc_id it names a row by what it says."""
    return F.xxhash64(*[c for p in parts for c in (F.coalesce(p, F.lit("")), p.isNull())])


#: A bitmap has some 16 bits an id, so that few other rows pass, up to 16 MB; more ids than it serves are joined.
_MAX_BITS = 27


def mark_by_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id", max_bits: int = _MAX_BITS) -> DataFrame:
    """``rows`` with the column __maybe: false only where ``key`` is surely none of ``ids``, a table of its own.

    A bitmap of the hashed ids, sized by their number up to 2**max_bits / 8 bytes, is broadcast and tested where the rows
    are read, so that only the rows that it lets through need a shuffle.  More ids than it serves let more other rows
    through; none is lost.
    """
    return _marked(rows, ids, key, min(max(15, (16 * ids.count()).bit_length()), max_bits))


def _marked(rows: DataFrame, ids: DataFrame, key: str, bits: int) -> DataFrame:
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    marks = ids.select(slot(key).alias("h")).select(F.floor(F.col("h") / 32768).alias("__block"), (F.col("h") % 32768).alias("bit"))
    # At most 2**bits / 32768 rows of 4 KB.
    blocks = marks.groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    out = rows.withColumn("__h", slot(key)).withColumn("__block", F.floor(F.col("__h") / 32768)).join(F.broadcast(blocks), "__block", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__h") % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = out.withColumn("__maybe", F.coalesce(F.getbit(byte, (F.col("__h") % 8).cast("int")) == 1, F.lit(False)))
    return out.select(*rows.columns, "__maybe")


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", max_bits: int = _MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` that may have one of ``ids``, rows that have none), in columns __c0, __c1, ...

    Told by :func:`mark_by_ids`.  Where its bitmap would grow beyond 2**max_bits / 8 bytes, most rows are no rarity among
    the ids any more: then the ids are joined.
    """
    at = f"__c{docs.columns.index(key)}"
    flat = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    names = flat.columns
    bits = max(15, (16 * ids.count()).bit_length())
    if bits > max_bits:
        known = ids.select(F.col(key).alias("__known")).distinct().hint("merge")
        same = F.col(at).eqNullSafe(F.col("__known"))
        return flat.join(known, same, "left_semi"), flat.join(known, same, "left_anti")
    rows = _marked(flat, ids.select(F.col(key).alias(at)), at, bits)
    return rows.filter("__maybe").select(*names), rows.filter("not __maybe").select(*names)


def drop_rows(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """``docs`` without the rows whose ``key``, and ``more`` columns, are in ``dropped``, every column unchanged; null
    keys match null keys.

    The keys are looked up by exact case.  Rows that repeat the dropped keys go with them.
    """
    keys = [key, *more]
    gone = stage(dropped.select(*keys).distinct(), "dropped")
    maybe, clear = split_by_ids(docs, gone, key)
    same = [F.col(f"__c{docs.columns.index(k)}").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    told = maybe.join(gone.toDF(*[f"__key{i}" for i in range(len(keys))]).hint("merge"), same, "left_anti")
    return clear.unionByName(told).toDF(*docs.columns)
