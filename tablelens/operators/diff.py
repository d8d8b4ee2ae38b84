"""What changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import number_of, text_of


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    one = before.agg(F.count(F.lit(1)).alias("before"))
    return one.withColumn("after", after.agg(F.count(F.lit(1))).scalar())


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = [(c, "added") for c in after.columns if c not in before.columns]
    rows += [(c, "removed") for c in before.columns if c not in after.columns]
    return before.sparkSession.createDataFrame(rows, "column string, change string")


def _sums(df: DataFrame, columns: list[str], out: str, numbers: str) -> DataFrame:
    totals = df.agg(*[F.coalesce(F.sum(number_of(df, c, numbers)), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)])
    table = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias(out)) for i, c in enumerate(columns)])
    return totals.select(F.inline(table))


def changed_sums(before: DataFrame, after: DataFrame, columns: list[str], top: int | None = None, numbers: str = "br") -> DataFrame:
    """Sums of numeric columns that differ, the largest change first."""
    common = [c for c in columns if c in before.columns and c in after.columns]
    both = _sums(before, common, "before", numbers).join(_sums(after, common, "after", numbers), "column")
    out = both.where("before <> after").orderBy(F.abs(F.col("after") - F.col("before")).desc(), "column")
    return out.limit(top) if top else out


def value_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Values of category columns found in one version only: ``(column, value, change)``."""
    common = [c for c in columns if c in before.columns and c in after.columns]

    def distinct(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in common])
        return df.select(F.inline(pairs)).where("value is not null").distinct()

    a, b = distinct(before), distinct(after)
    new = b.join(a, ["column", "value"], "left_anti").withColumn("change", F.lit("new"))
    gone = a.join(b, ["column", "value"], "left_anti").withColumn("change", F.lit("gone"))
    return new.unionByName(gone)


def compare_versions(before: DataFrame, after: DataFrame, before_profile: DataFrame, after_profile: DataFrame) -> dict[str, DataFrame]:
    """All parts of a version comparison, with the columns chosen by the two profiles."""
    types = lambda p: {r.column: r.type for r in p.select("column", "type").collect()}  # one row per column
    a, b = types(before_profile), types(after_profile)
    numeric = [c for c in before.columns if a.get(c) in ("number", "integer") and b.get(c) in ("number", "integer")]
    categories = [c for c in before.columns if c in after.columns and b.get(c) == "category"]
    return {
        "rows": row_counts(before, after),
        "columns": column_changes(before, after),
        "sums": changed_sums(before, after, numeric),
        "values": value_changes(before, after, categories),
    }


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(text_of(df, column).alias("value")).where("value is not null").distinct()
