r"""Chat formatting with a grammar round trip.

Template, one after another for each turn:  ``<s>[INST] role [/INST]\ntext\n</s>``.

Each turn is rendered as it is, reparsed by a deterministic parser and compared with its source.  Where the two
differ, the control strings in its role and text are escaped with one backslash more than stands before them, and
the turn is rendered and reparsed again; the parser takes one backslash off.  A turn that still differs would fail
the job.  Everything is JVM-side regular expressions and array functions.

Defined results: null role or text counts as empty; turns go by turn number (null first), then role, then text;
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result.
Texts may be of any length.  A conversation is one string of the output, so its turns meet in one row by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

_CONTROL = r"(?:</?s>|\[/?INST\])"
_LOOSE = r"(?<!\\)" + _CONTROL
_TURN = r"(?s)\A<s>\[INST\] (.*?) (?<!\\)\[/INST\]\n(.*)\n\z"
_END = r"(?<!\\)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(\\*" + _CONTROL + ")"), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(\\*" + _CONTROL + ")"), F.lit("$1"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), role, F.lit(" [/INST]\n"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(_head(role), text, F.lit("\n</s>"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; a piece that breaks the grammar gives null fields."""
    pieces = F.split(formatted, _END, -1)

    def turn(piece: Column) -> Column:
        role, text = F.regexp_extract(piece, _TURN, 1), F.regexp_extract(piece, _TURN, 2)
        good = piece.rlike(_TURN) & ~role.rlike(_LOOSE) & ~text.rlike(_LOOSE)
        return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(text)).alias("text"))

    # Behind the last turn's end stands one empty piece; anything else there is a piece that breaks the grammar.
    turns = F.transform(pieces, turn)
    return F.when(F.element_at(pieces, -1) == "", F.slice(turns, 1, F.size(pieces) - 1)).otherwise(turns)


def _recovers(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    first = F.get(turns, F.lit(0))
    return (F.size(turns) == 1) & first["role"].eqNullSafe(role) & first["text"].eqNullSafe(text)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points from 0, end exclusive, of the
    assistant texts), n_turns, n_escaped."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumn("conflict", ~_recovers(render_turn(role, text), role, text))
    rows = rows.withColumn("r", F.when(F.col("conflict"), escape(role)).otherwise(role))
    rows = rows.withColumn("t", F.when(F.col("conflict"), escape(text)).otherwise(text))
    again = F.when(
        F.col("conflict") & ~_recovers(render_turn(F.col("r"), F.col("t")), role, text),
        F.raise_error(F.lit("a turn does not survive the round trip")).cast("string"),
    ).otherwise(render_turn(F.col("r"), F.col("t")))
    rows = rows.withColumn("rendered", again)
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0)) + F.char_length(_head(F.col("r")))
    rows = rows.select(
        "conv_id", "conflict", "role", F.row_number().over(in_turn).alias("n"), "rendered",
        start.cast("long").alias("start"), (start + F.char_length("t")).cast("long").alias("end"),
    )
    parts = F.sort_array(F.collect_list(F.struct("n", "rendered", "role", "start", "end")))
    conv = rows.groupBy("conv_id").agg(parts.alias("parts"), F.count_if("conflict").alias("n_escaped"))
    spans = F.transform(F.filter("parts", lambda p: p["role"] == "assistant"), lambda p: F.struct(p["start"], p["end"]))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.size("parts").cast("long").alias("n_turns"),
        "n_escaped",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (reparsed), loss_text (unescaped text under the loss mask), formatted_chars."""
    texts = F.transform(
        "loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return formatted.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(texts, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
