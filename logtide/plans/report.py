"""Declarative reports: grouped measures, totals, derived columns, thresholds and a deterministic top-K.

A report names its aggregates as SQL expressions; :meth:`Report.frame` turns them into one DataFrame plan (filter,
one grouped aggregate, a one-row total where needed, filter, top-K), and Catalyst does the rest: column pruning,
filter push-down, partial aggregation and ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def distinct(column: str, condition: str | None = None) -> str:
    return f"count(DISTINCT {column})" + (f" FILTER (WHERE {condition})" if condition else "")


def total(column: str, condition: str | None = None) -> str:
    tail = f" FILTER (WHERE {condition})" if condition else ""
    return f"CAST(coalesce(sum({column}){tail}, 0) AS BIGINT)"


def quantile(column: str, p: float, condition: str | None = None) -> str:
    return f"percentile({column}, {p})" + (f" FILTER (WHERE {condition})" if condition else "")


def mean(column: str, condition: str | None = None) -> str:
    return f"avg({column})" + (f" FILTER (WHERE {condition})" if condition else "")


def ordering(name: str) -> Column:
    """``-name`` is descending; nulls are last both ways."""
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()


@dataclass(frozen=True)
class Report:
    keys: Mapping[str, str] = field(default_factory=dict)
    measures: Mapping[str, str] = field(default_factory=dict)
    where: str = "true"
    key_where: str = "true"
    totals: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, str] = field(default_factory=dict)
    having: str = "true"
    order: Sequence[str] = ()
    limit: int | None = None
    columns: Sequence[str] | None = None
    params: Mapping[str, object] = field(default_factory=dict)
    source: str = "logs"

    def _fill(self, text: str, overrides: Mapping[str, object]) -> str:
        values = {**self.params, **overrides}
        for k, v in values.items():
            text = text.replace("{" + k + "}", str(v))
        return text

    def filled(self, text: str, **overrides: object) -> str:
        """``text`` with the thresholds put in."""
        return self._fill(text, overrides)

    def _output(self) -> list[str]:
        return list(self.columns or [*self.keys, *self.measures, *self.totals, *self.derived])

    def _order(self) -> list[str]:
        rest = [k for k in self.keys if k not in [o.lstrip("-") for o in self.order]]
        return [*self.order, *rest]

    def aggregate(self, rows: DataFrame, **overrides: object) -> DataFrame:
        """Keys and measures.  ``key_where`` speaks of keys alone: Catalyst moves it below the aggregate."""
        fill = lambda text: self._fill(text, overrides)
        kept = rows if self.where == "true" else rows.filter(fill(self.where))
        keys = [F.expr(fill(e)).alias(n) for n, e in self.keys.items()]
        out = kept.groupBy(*keys).agg(*[F.expr(fill(e)).alias(n) for n, e in self.measures.items()])
        return out if self.key_where == "true" else out.filter(fill(self.key_where))

    def finish(self, out: DataFrame, **overrides: object) -> DataFrame:
        """Totals, derived columns, thresholds and the top-K over what :meth:`aggregate` returns."""
        fill = lambda text: self._fill(text, overrides)
        if self.totals:
            # One row: the totals of the aggregate, whose exchange is reused.
            one = out.agg(*[F.expr(fill(e)).alias(n) for n, e in self.totals.items()])
            out = out.crossJoin(F.broadcast(one))
        for n, e in self.derived.items():
            out = out.withColumn(n, F.expr(fill(e)))
        if self.having != "true":
            out = out.filter(fill(self.having))
        if self.limit is not None:
            out = out.orderBy(*[ordering(o) for o in self._order()]).limit(self.limit)
        return out.select(*self._output())

    def frame(self, rows: DataFrame, **overrides: object) -> DataFrame:
        """The report over ``rows``; ``overrides`` replace its thresholds."""
        return self.finish(self.aggregate(rows, **overrides), **overrides)
