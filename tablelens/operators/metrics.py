"""User metrics: per-row columns and single indicators.

A metric is a Spark ``Column`` built with the helpers below, or Spark SQL text over them. There
is no formula language of our own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import finite, number_of, quoted, round_half_up, text_of


class MetricError(ValueError):
    """A metric that cannot be evaluated on this table."""


@dataclass(frozen=True)
class Cells:
    """Helpers bound to one table; every operand is read as a number and null stays null."""

    df: DataFrame
    numbers: str = "br"

    def _known(self, name: str) -> str:
        if name not in self.df.columns:
            raise MetricError(f"unknown column: {name}")
        return name

    def num(self, name: str) -> Column:
        return number_of(self.df, self._known(name), self.numbers)

    @staticmethod
    def div(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))

    @staticmethod
    def round(x: Column, digits: int = 0) -> Column:
        return round_half_up(x, digits)

    def sum(self, name: str) -> Column:
        return F.sum(self.num(name))

    def avg(self, name: str) -> Column:
        return F.avg(self.num(name))

    def min(self, name: str) -> Column:
        return F.min(self.num(name))

    def max(self, name: str) -> Column:
        return F.max(self.num(name))

    def count(self, name: str | None = None) -> Column:
        return F.count(F.lit(1)) if name is None else F.count(quoted(self._known(name)))

    def sum_if(self, name: str, where: str, value: str | float) -> Column:
        return F.sum(F.when(text_of(self.df, self._known(where)) == str(value), self.num(name)))

    def count_if(self, where: str, value: str | float) -> Column:
        return F.count_if(text_of(self.df, self._known(where)) == str(value))


Metric = Callable[[Cells], Column] | str


def _build(metric: Metric, df: DataFrame, numbers: str) -> Column:
    if isinstance(metric, str):
        if not metric.strip():
            raise MetricError("empty metric")
        return F.expr(metric)
    return metric(Cells(df, numbers))


def add_row_metric(df: DataFrame, name: str, metric: Metric, numbers: str = "br") -> DataFrame:
    """A new numeric column; what cannot be computed in a row is null there."""
    try:
        return df.withColumn(name, finite(_build(metric, df, numbers)))
    except AnalysisException as e:
        raise MetricError(str(e).splitlines()[0]) from e


def add_row_metrics(df: DataFrame, metrics: list[tuple[str, Metric]], numbers: str = "br") -> tuple[DataFrame, list[str]]:
    """Metrics in order; later ones may use earlier ones and broken ones are skipped and named."""
    skipped = []
    for name, metric in metrics:
        target = f"{name} (métrica)" if name in df.columns else name
        try:
            added = add_row_metric(df, target, metric, numbers)
            added.schema  # analysis happens here
            df = added
        except (MetricError, AnalysisException):
            skipped.append(name)
    return df, skipped


def indicator(df: DataFrame, metric: Metric, name: str = "value", numbers: str = "br") -> DataFrame:
    """One row with one aggregate expression; every column has to stand inside an aggregate."""
    try:
        out = df.agg(finite(_build(metric, df, numbers)).alias(name))
        out.schema
        return out
    except AnalysisException as e:
        raise MetricError(str(e).splitlines()[0]) from e
