"""What a user configured for a table, applied to a table: renames, merges, types, filters, metrics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import quoted, text_of
from tablelens.operators.filters import date_between, equals, text_search
from tablelens.operators.metrics import Metric, add_row_metrics


@dataclass(frozen=True)
class Recipe:
    renames: dict[str, str] = field(default_factory=dict)
    forced: dict[str, str] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    merges: dict[str, dict[str, str]] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    date_range: tuple[str, str | None, str | None] | None = None
    metrics: tuple[tuple[str, Metric], ...] = ()
    metric_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    search: str = ""


def rename(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in renames.items() if b and a != b and a in df.columns})


def move_column(recipe: Recipe, old: str, new: str) -> Recipe:
    """The same recipe after a column got another name."""

    def moved(d: dict) -> dict:
        return {(new if k == old else k): v for k, v in d.items()}

    span = recipe.date_range
    if span and span[0] == old:
        span = (new, *span[1:])
    # SQL text is the only kind of metric that carries column names we can rewrite
    metrics = tuple((n, m.replace(f"`{old}`", f"`{new}`") if isinstance(m, str) else m) for n, m in recipe.metrics)
    uses = {n: tuple(new if c == old else c for c in cols) for n, cols in recipe.metric_columns.items()}
    return replace(
        recipe,
        forced=moved(recipe.forced),
        filters=moved(recipe.filters),
        merges=moved(recipe.merges),
        units=moved(recipe.units),
        date_range=span,
        metrics=metrics,
        metric_columns=uses,
    )


def apply_merges(df: DataFrame, merges: dict[str, dict[str, str]]) -> DataFrame:
    """Replace listed spellings by the chosen one, whatever their number.

    Cells are compared as text. A text column is replaced as it is; another one turns into text where a
    spelling is listed for it, because the chosen spelling is text. Adaptive execution picks the join.
    """
    for name, mapping in merges.items():
        if name not in df.columns or not mapping:
            continue
        table = df.sparkSession.createDataFrame(list(mapping.items()), "spelling string, suggested string")
        df = merge_with(df, name, table)
    return df


def merge_with(df: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """The same with a table ``(spelling, suggested)`` of any size, as found by the linkage step."""
    order = df.columns
    known = spellings.select(F.col("spelling").alias("_from"), F.col("suggested").alias("_to"))
    return (
        df.join(known, text_of(df, column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", text_of(df, column)))
        .select(*[quoted(c) for c in order])
    )


def reconcile(recipe: Recipe, columns: list[str]) -> tuple[Recipe, list[tuple[str, str]]]:
    """Keep what refers to existing columns; list what was dropped as ``(part, name)``."""
    dropped: list[tuple[str, str]] = []

    def kept(part: str, d: dict) -> dict:
        dropped.extend((part, k) for k in d if k not in columns)
        return {k: v for k, v in d.items() if k in columns}

    span = recipe.date_range
    if span and span[0] not in columns:
        dropped.append(("date_range", span[0]))
        span = None
    made = {n for n, _ in recipe.metrics}
    metrics = []
    for name, metric in recipe.metrics:
        missing = [c for c in recipe.metric_columns.get(name, ()) if c not in columns and c not in made]
        if missing:
            dropped.append(("metric", name))
        else:
            metrics.append((name, metric))
    fresh = replace(
        recipe,
        forced=kept("type", recipe.forced),
        filters=kept("filter", recipe.filters),
        merges=kept("merge", recipe.merges),
        date_range=span,
        metrics=tuple(metrics),
    )
    return fresh, dropped


def apply_recipe(df: DataFrame, recipe: Recipe) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Renames, merges, row metrics, filters, period and search, in that order."""
    df = rename(df, recipe.renames)
    recipe, dropped = reconcile(recipe, df.columns)
    df = apply_merges(df, recipe.merges)
    df, skipped = add_row_metrics(df, list(recipe.metrics))
    dropped += [("metric", n) for n in skipped]
    df = equals(df, recipe.filters)
    if recipe.date_range:
        df = date_between(df, *recipe.date_range)
    return text_search(df, recipe.search), dropped
