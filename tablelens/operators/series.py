"""Time series with visible gaps, and order-dependent summaries of aggregated rows.

Windows here run over months or labels, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.ranks import running_total_desc
from tablelens.functions.values import date_of, month_key, number_of
from tablelens.operators.aggregate import aggregate


def monthly(
    df: DataFrame, date_col: str, value: str | None = None, how: str = "count", numbers: str = "br", date_order: str = "dmy"
) -> DataFrame:
    """``(label, value)`` per month from the first to the last one.

    A month without rows is 0 for counts and sums and has no data for every other aggregate.
    """
    v = F.lit(1.0) if how == "count" else number_of(df, value, numbers)
    rows = df.select(F.trunc(date_of(df, date_col, date_order), "month").alias("month"), v.alias("_v")).dropna()
    found = aggregate(rows, ["month"], how)
    span = found.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    value_col = F.coalesce("value", F.lit(0.0)) if how in ("count", "sum") else F.col("value")
    return months.join(found, "month", "left").select(month_key("month").alias("label"), value_col.alias("value"))


def variation(series: DataFrame, order: str = "label", value: str = "value") -> DataFrame:
    """Percent change against the previous listed row; no data after 0 or no data."""
    previous = F.lag(value).over(Window.orderBy(order))
    change = F.try_divide(F.col(value) - previous, F.nullif(previous, F.lit(0.0))) * 100
    return series.withColumn("variation", change)


def pareto(groups: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Values from the largest down with their cumulative percentage of the total."""
    rows = groups.where(F.col(value).isNotNull())
    total = rows.agg(F.coalesce(F.nullif(F.sum(value), F.lit(0.0)), F.lit(1.0)).alias("t")).scalar()
    return (
        running_total_desc(rows, value, label, "_sum")
        .withColumn("cumulative", F.col("_sum") / total * 100)
        .drop("_sum")
    )


def highlights(series: DataFrame, order: str = "label", label: str = "label", value: str = "value") -> DataFrame:
    """Facts of one series: extremes, total, first and last value with data, change, gaps."""
    v = F.col(value)
    at = F.when(v.isNotNull(), F.col(order))
    facts = series.agg(
        F.max_by(label, F.when(v.isNotNull(), F.struct(v, F.col(label)))).alias("max_label"),
        F.max(v).alias("max_value"),
        F.min_by(label, F.when(v.isNotNull(), F.struct(v, F.col(label)))).alias("min_label"),
        F.min(v).alias("min_value"),
        F.sum(v).alias("total"),
        F.min_by(label, at).alias("first_label"),
        F.min_by(value, at).alias("first_value"),
        F.max_by(label, at).alias("last_label"),
        F.max_by(value, at).alias("last_value"),
        F.count_if(v.isNull()).alias("gaps"),
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.col("first_value"), F.lit(0.0)) * 100
    share = F.col("max_value") / F.coalesce(F.nullif(F.col("total"), F.lit(0.0)), F.lit(1.0)) * 100
    return facts.withColumns({"change": change, "max_share": share})


def leading_series(long: DataFrame) -> DataFrame:
    """The series with the largest sum, its share of all sums, its peak and the number of gaps."""
    per = long.groupBy("series").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.max("value").alias("peak"),
        F.max_by("label", F.when(F.col("value").isNotNull(), F.struct("value", "label"))).alias("peak_label"),
        F.count_if(F.col("value").isNull()).alias("gaps"),
    )
    best = F.struct("total", "peak", "peak_label")
    return per.agg(
        F.max_by("series", F.struct("total", "series")).alias("series"),
        F.max_by(best, F.struct("total", "series")).alias("b"),
        F.sum("total").alias("_all"),
        F.sum("gaps").alias("gaps"),
    ).select(
        "series",
        "b.*",
        (F.col("b.total") / F.coalesce(F.nullif(F.col("_all"), F.lit(0.0)), F.lit(1.0)) * 100).alias("share"),
        "gaps",
    )


def series_changes(long: DataFrame, order: str = "label") -> DataFrame:
    """First and last value with data of every series and the change between them."""
    at = F.when(F.col("value").isNotNull(), F.col(order))
    ends = long.groupBy("series").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs("first_value"), F.lit(0.0)) * 100
    return ends.where("first_value <> last_value").withColumn("change", change)


def representative(df: DataFrame, key: str, value: str, rank_by: Column | str, largest: bool = False) -> DataFrame:
    """One value per key: the one ranked first (or last) by ``rank_by``."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(key).agg(pick(F.col(value), rank_by if isinstance(rank_by, Column) else F.col(rank_by)).alias(value))
