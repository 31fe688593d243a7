"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words; two lines are near where ``min(1, words // words_per_edit)`` insertions, deletions or
substitutions of a word turn one into the other, ``words`` being the number in the shorter one: one word may differ,
and no more than one in ``words_per_edit``.  A line goes if it is near an earlier line (by doc_id, then line number);
blank lines always stay.

1. Equal lines collapse to their first occurrence (pre-aggregated by hash, verified by a second hash and length).
2. Of two near lines either the first or the second half is equal.  Lines that share no half with any other line
   cannot have a partner and emit nothing; this only avoids work, no near pair is lost.
3. The others emit every variant within the bound - the line less each one of its words - as hashed keys.  The
   hashes of all variants of a line come from two running xors, so the cost is linear in its words.
4. Equal variants join.  Lines that agree after losing the word at the same place are all near each other, so each
   needs only the earliest; a line that equals another one's variant is joined with it.  No group emits its pairs.
5. Candidates are verified word by word, and the later line goes.

What is shuffled to find partners is mostly without any.  Keys and variants are counted first, and rows whose key occurs
once are left where they are read (:func:`mark_by_ids`); so are lines without copies, and texts that lose no line.

A document is a doc_id with a text: within the steps doc_id is the pair of the id and the text's hash, so that different
texts under one id, or none, are different documents.

Defined results: null text counts as empty and has no lines; repeated rows of one doc_id and text count as one document
and get the same result; null doc_ids come first, different texts of one id in the order of their hashes; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, mark_by_ids, pick, stage, unstage, value_key


def _words(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(SPACE_CHARS)), SPACE + "+")


def _identity() -> list[Column]:
    """What equal lines have in common."""
    return [F.xxhash64("words").alias("h"), F.hash("words").alias("c"), F.size("words").alias("n")]


def _half_keys() -> Column:
    """Four keys: first and second half for the line's own length and for one word less."""
    n = F.col("n")

    def halves(m: Column) -> list[Column]:
        a = F.floor(m / 2).cast("int")
        head = F.xxhash64(m, F.lit("head"), F.slice("words", F.lit(1), a))
        tail = F.xxhash64(m, F.lit("tail"), F.slice("words", n - (m - a) + 1, m - a))
        return [head, tail]

    return F.array(*halves(n), *halves(n - 1))


def _lines(docs: DataFrame, words_per_edit: int) -> DataFrame:
    exploded = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    rows = exploded.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("words", _words(F.col("line")))
    rows = rows.select("doc_id", "line_no", "words", *_identity())
    return rows.select("doc_id", "line_no", "h", "c", "n", F.when(F.col("n") >= words_per_edit, _half_keys()).alias("halves"))


def _near(a: Column, b: Column) -> Column:
    """Whether word arrays ``a`` and ``b`` differ by at most one word; both sides keep what follows the first
    mismatch, which is cut from the longer one, or from both."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda words, start: F.slice(words, start, F.greatest(F.size(words), F.lit(1)))
    longer = F.size(a) - F.size(b)
    return (
        F.when(at == 0, longer == 0)
        .when(longer == 0, rest(a, at + 1) == rest(b, at + 1))
        .when(longer == 1, rest(a, at + 1) == rest(b, at))
        .when(longer == -1, rest(a, at) == rest(b, at + 1))
        .otherwise(F.lit(False))
    )


def _possible(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return mark_by_ids(rows, ids, key).filter("__maybe").drop("__maybe")


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, c, n) of the lines in ``first`` that are near an earlier one of them."""
    keys = first.filter("halves is not null").select("doc_id", "line_no", F.explode("halves").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "lines-shared")
    able = _possible(keys, shared, "key").join(shared, "key", "left_semi").select("doc_id", "line_no").distinct()
    able = stage(able.withColumn("at", F.struct("doc_id", "line_no")), "lines-able")
    picked = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("at", F.struct("doc_id", "line_no"))
    picked = _possible(picked, able, "at").select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    picked = picked.join(able.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi").dropDuplicates(["doc_id", "line_no"])
    lines = stage(picked.withColumn("n", F.size("words")), "lines-words")

    at = F.struct("doc_id", "line_no")
    words = lines.select(at.alias("at"), "n", F.posexplode("words").alias("pos", "w"))
    words = words.select("at", "n", "pos", F.xxhash64("w", "pos").alias("here"), F.xxhash64("w", F.col("pos") - 1).alias("moved"))
    upto = Window.partitionBy("at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("at")
    variants = words.select(
        "at", "n", "pos",
        F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))
        .bitwiseXOR(F.bit_xor("moved").over(whole)).bitwiseXOR(F.bit_xor("moved").over(upto)).alias("v"),
        F.bit_xor("here").over(whole).alias("own"),
    )
    variants = stage(variants, "lines-variants")

    own = variants.filter("pos = 0").select(F.col("at").alias("o_at"), F.col("n").alias("o_n"), F.col("own").alias("o_v"))
    values = variants.select("v").unionByName(own.select(F.col("o_v").alias("v")))
    values = stage(values.groupBy("v").agg(F.count("*").alias("k")).filter("k > 1").select("v"), "lines-values")
    met = stage(_possible(variants.drop("own"), values, "v"), "lines-met")
    same_place = met.groupBy("v", "pos", "n").agg(F.min("at").alias("early"), F.count("*").alias("k")).filter("k > 1")
    swapped = met.join(same_place, ["v", "pos", "n"]).select("early", F.col("at").alias("late"))
    cut = met.join(own, (F.col("v") == F.col("o_v")) & (F.col("n") - 1 == F.col("o_n")))
    cut = cut.select(F.least("at", "o_at").alias("early"), F.greatest("at", "o_at").alias("late"))
    pairs = stage(swapped.unionByName(cut).filter("early < late").distinct(), "lines-pairs")

    side = lambda who: lines.select(at.alias(who), F.col("words").alias(f"{who}_words"))
    checked = pairs.join(side("early"), "early").join(side("late"), "late")
    late = checked.filter(_near(F.col("early_words"), F.col("late_words"))).select(F.col("late_words").alias("words"))
    near = stage(late.select(*_identity()).distinct(), "lines-near")
    unstage(shared, able, lines, variants, values, met, pairs)
    return near


def dedup_lines(docs: DataFrame, words_per_edit: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the dropped lines, n_lines, n_dropped."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(F.struct("doc_id", value_key(F.coalesce("text", F.lit(""))).alias("text_key")).alias("doc_id"), "text")
    lines = stage(_lines(docs, words_per_edit), "lines-all")
    first = lines.groupBy("h", "c", "n").agg(
        F.min(F.struct("doc_id", "line_no")).alias("at"), F.max("halves").alias("halves"), F.count("*").alias("copies")
    )
    first = stage(first.select("h", "c", "n", "at.doc_id", "at.line_no", "halves", "copies"), "lines-first")
    near = near_lines(docs, first)
    # Lines to look at again: those that occur more than once and those that are near an earlier one.
    at = F.struct("doc_id", "line_no")
    found = first.filter("copies > 1").select("h", "c", "n", at.alias("f_at"), F.lit(False).alias("near"))
    found = found.unionByName(near.withColumn("near", F.lit(True)), allowMissingColumns=True)
    found = stage(found.groupBy("h", "c", "n").agg(F.max("f_at").alias("f_at"), F.max("near").alias("near")), "lines-found")
    unstage(first, near)
    out = _possible(lines.select("doc_id", "line_no", "h", "c", "n"), found, "h").join(found, ["h", "c", "n"])
    dropped = out.filter(F.col("near") | ~at.eqNullSafe(F.col("f_at"))).select("doc_id", "line_no")
    by_doc = stage(dropped.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "lines-dropped")
    unstage(lines, found)
    told = mark_by_ids(docs, by_doc)
    gone = by_doc.withColumnRenamed("doc_id", "d")
    rows = told.filter("__maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "gone")
    rows = rows.unionByName(told.filter("not __maybe").select("doc_id", "text"), allowMissingColumns=True)
    rows = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("stay", stay)
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    )
    return rows.select(
        "doc_id.doc_id", text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
