"""Analytic role of each column, and which aggregates make sense for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.operators.aggregate import cross_values
from tablelens.operators.series import monthly

GROUPABLE = ("dimension", "flag", "time")


def roles(profile: DataFrame) -> DataFrame:
    """``(position, column, role, unit, additive, period, manual, reasons)`` per column.

    ``reasons`` are codes of the rules that decided.
    """
    c = F.col
    name, number = c("column"), c("type").isin("number", "integer")
    low, high = F.coalesce("min", F.lit(0.0)), F.coalesce("max", F.lit(0.0))
    coordinate = number & name.rlike(V.COORDINATE_NAME) & (low >= -180) & (high <= 180)
    code_name = number & name.rlike(V.CODE_NAME) & (low >= 0)
    zero_led = number & (c("zero_led_share") >= V.LEADING_ZERO_SHARE)
    rule = (
        F.when(c("type").isin("lat", "lon"), "coordinate_type")
        .when(c("period"), "period_values")
        .when(c("type") == "date", "date_values")
        .when(c("type") == "boolean", "two_values")
        .when(c("type") == "id", "nearly_unique")
        .when(coordinate, "coordinate_name")
        .when(code_name, "code_name")
        .when(zero_led, "leading_zeros")
        .when(number & c("percent"), "percent_values")
        .when(number & name.rlike(V.PERCENT_NAME), "percent_name")
        .when(number & (c("currency_values") | name.rlike(V.CURRENCY_NAME)), "currency")
        .when((c("type") == "integer") & name.rlike(V.COUNT_NAME), "count_name")
        .when(number, "plain_number")
        .when(c("type") == "category", "repeated_values")
        .otherwise("free_text")
    )

    def by_rule(groups: dict[str, list[str]], other: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for value, rules in groups.items():
            out = out.when(c("rule").isin(rules), value)
        return out.otherwise(other)

    role = by_rule(
        {
            "geo": ["coordinate_type", "coordinate_name"],
            "time": ["period_values", "date_values"],
            "flag": ["two_values"],
            "identifier": ["nearly_unique", "code_name", "leading_zeros"],
            "measure": ["percent_values", "percent_name", "currency", "count_name", "plain_number"],
            "dimension": ["repeated_values"],
        },
        F.lit("text"),
    )
    unit = by_rule(
        {"percent": ["percent_values", "percent_name"], "currency": ["currency"], "count": ["count_name"]},
        F.lit(None).cast("string"),
    )
    return profile.withColumn("rule", rule).select(
        "position",
        "column",
        role.alias("role"),
        unit.alias("unit"),
        c("rule").isin("currency", "count_name", "plain_number").alias("additive"),
        (c("period") & (role == "time")).alias("period"),
        "manual",
        F.array_compact(F.array(F.when(c("manual"), "type_set_by_user"), c("rule"))).alias("reasons"),
    )


def default_aggregate(role: Column, additive: Column) -> Column:
    """Mean for a measure that must not be summed, else sum."""
    return F.when((role == "measure") & ~additive, "mean").otherwise("sum")


def filter_effects(full: DataFrame, view: DataFrame) -> DataFrame:
    """Columns whose fill or distinct count changed between two profiles."""
    a = full.select("position", "column", F.col("filled").alias("filled_full"), F.col("distinct").alias("distinct_full"))
    b = view.select("column", F.col("filled").alias("filled_view"), F.col("distinct").alias("distinct_view"))
    return a.join(b, "column").where("filled_full <> filled_view or distinct_full <> distinct_view")


def default_choice(role_rows: DataFrame) -> DataFrame:
    """One row ``(x, y, how)``: the first dimension with the first measure."""
    c = F.col
    pick = role_rows.agg(
        F.min_by("column", F.when(c("role") == "dimension", c("position"))).alias("d"),
        F.min_by("column", F.when(c("role").isin(*GROUPABLE), c("position"))).alias("g"),
        F.min_by("column", F.when(c("role") == "measure", c("position"))).alias("y"),
        F.min_by(default_aggregate(c("role"), c("additive")), F.when(c("role") == "measure", c("position"))).alias("how"),
    )
    x = F.coalesce("d", "g")
    return pick.select(x.alias("x"), "y", F.coalesce("how", F.lit("count")).alias("how")).where("x is not null")


class ChoiceError(ValueError):
    """An aggregate that has no meaning for the chosen columns; ``args[0]`` is a code."""


def explore(
    df: DataFrame, role_rows: DataFrame, x: str, y: str | None = None, how: str = "count", order_by: str | None = None, numbers: str = "br"
) -> DataFrame:
    """A hand-made aggregate, refused when the roles of the columns rule it out."""
    # two rows of metadata at most
    known = {r.column: r for r in role_rows.where(F.col("column").isin([n for n in (x, y) if n])).collect()}
    if x not in known:
        raise ChoiceError("unknown_group")
    if known[x].role not in GROUPABLE:
        raise ChoiceError(f"group_is_{known[x].role}")
    if how != "count":
        if y not in known:
            raise ChoiceError("unknown_measure")
        if known[y].role != "measure":
            raise ChoiceError(f"value_is_{known[y].role}")
        if how == "sum" and not known[y].additive:
            raise ChoiceError("sum_of_rate")
    value = None if how == "count" else y
    if known[x].role == "time" and not known[x].period:
        return monthly(df, x, value, how, numbers)
    return cross_values(df, x, value=value, how=how, order_by=order_by if known[x].period else None, numbers=numbers)
