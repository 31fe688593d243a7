"""Ad-hoc SQL over the request log: registered views, limits, restricted readers, presets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import redact_pii


def sql_query(spark: SparkSession, text: str, limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(at most ``limit`` rows, one row that says whether there are more)."""
    out = spark.sql(text)
    more = out.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return out.limit(limit), more


def sql_window_view(logs: DataFrame, name: str, start: str, end: str, hide: Sequence[str] = (), salt: str | None = None) -> DataFrame:
    """Register ``logs`` between two times, half open, with personal columns masked; ``cid`` is hashed with the salt."""
    rows = logs.filter((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz")))
    rows = rows.withColumns({c: redact_pii(F.col(c), salt if c == "cid" else None) for c in hide if c in rows.columns})
    rows.createOrReplaceTempView(name)
    return rows


PRESETS = {"sample": "SELECT * FROM {view} LIMIT 100", "rows": "SELECT count(*) AS rows FROM {view}"}


def sql_preset(spark: SparkSession, preset: str, view: str) -> DataFrame:
    return spark.table(view).summary() if preset == "stats" else spark.sql(PRESETS[preset].format(view=view))
