"""Data quality alerts, rate relations between columns, and headline indicators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.values import number_of, quoted, text_of
from tablelens.operators.pairs import pair_fits, triple_misses
from tablelens.operators.profile import duplicate_rows, outliers
from tablelens.operators.roles import roles

ALERT_SCHEMA = "level string, code string, column string, n bigint"


def _alert(frame: DataFrame, level: str, code: str, column: Column, n: Column) -> DataFrame:
    return frame.select(F.lit(level).alias("level"), F.lit(code).alias("code"), column.alias("column"), n.cast("bigint").alias("n"))


def column_alerts(profile: DataFrame) -> DataFrame:
    """Alert rows that follow from the profile alone."""
    c = F.col
    hit = lambda cond, level, code, n: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("bigint").alias("n")))
    share = F.try_divide("missing", "rows")
    found = F.array_compact(
        F.array(
            hit(c("invalid") > 0, "warning", "invalid_numbers", c("invalid")),
            hit(c("missing_markers") > 0, "info", "missing_markers", c("missing_markers")),
            hit(c("filled") == 0, "warning", "empty_column", c("missing")),
            hit((c("filled") > 0) & (share >= V.MISSING_ALERT_SHARE), "warning", "many_missing", c("missing")),
            hit((c("filled") > 1) & (c("distinct") == 1), "info", "constant_column", c("filled")),
        )
    )
    return profile.select("column", F.inline(found)).select("level", "code", "column", "n")


def locale_alerts(locale: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    a = _alert(locale.where("date_ambiguous"), "warning", "ambiguous_dates", none, F.col("date_ambiguous_count"))
    b = _alert(locale.where("number_ambiguous"), "warning", "ambiguous_numbers", none, F.col("number_ambiguous_count"))
    return a.unionByName(b)


def quality_alerts(df: DataFrame, profile: DataFrame, locale: DataFrame | None = None, numbers: str = "br") -> DataFrame:
    """All alerts of a table as rows ``(level, code, column, n)``."""
    out = column_alerts(profile)
    if locale is not None:
        out = out.unionByName(locale_alerts(locale))
    dup = duplicate_rows(df).where("duplicates > 0")
    out = out.unionByName(_alert(dup, "warning", "duplicate_rows", F.lit(None).cast("string"), F.col("duplicates")))
    far = outliers(df, df.columns, numbers).where("outliers > 0")
    measured = profile.where("type in ('number', 'integer') and filled >= 8").select("column")
    far = far.join(measured, "column", "left_semi")
    return out.unionByName(_alert(far, "info", "extreme_values", F.col("column"), F.col("outliers")))


# ------------------------------------------------------------------ P = A / B x 100


def _off(a: Column, b: Column, p: Column) -> Column:
    tolerance = F.greatest(F.lit(V.RELATION_ABS_TOLERANCE), F.abs(p) * V.RELATION_REL_TOLERANCE)
    return (a > b) | (F.abs(F.try_divide(a, b) * 100 - p) > tolerance)


def relations(df: DataFrame, columns: list[str], first: int | None = None, percent: set[str] = frozenset(), numbers: str = "br") -> DataFrame:
    """Rates that come from two other columns: ``(p, a, b, n, bad)``; of the ``first`` columns if given.

    Three scans for any number of columns. Columns with one value only are left out. The second counts, per pair, the rows in which A can be a
    part of B. A pair for which that is too rare cannot give any rate, so the third checks only the others, on
    all rows. All of it is counting without a shuffle of rows. Each triple is reported once, preferably with
    the rate-named column as the result.
    """
    names = columns[:first] if first else columns
    none = df.sparkSession.createDataFrame([], "p string, a string, b string, n bigint, bad bigint")
    if len(names) < 3:
        return none
    nums = df.select(*[number_of(df, c, numbers).alias(f"c{i}") for i, c in enumerate(names)])
    facts = nums.agg(
        *[F.count_if(F.col(f"c{i}").isNull()).alias(f"e{i}") for i in range(len(names))],
        *[(F.min(f"c{i}") < F.max(f"c{i}")).alias(f"v{i}") for i in range(len(names))],
    ).first()
    varied = [i for i in range(len(names)) if facts[f"v{i}"]]
    if len(varied) < 3:
        return none
    fits = {(r.a, r.b): r for r in pair_fits(nums).collect()}  # one row per pair of columns
    pairs = [(a, b) for a in varied for b in varied if a != b]
    triples = [
        (p, a, b)
        for a, b in pairs
        for p in varied
        # at least both - empty(p) rows count, and two thirds of them have to fit
        if p not in (a, b) and fits[a, b].fits * 3 >= (fits[a, b].both - facts[f"e{p}"]) * 2 and fits[a, b].fits > 0
    ]
    if not triples:
        return none
    places = df.sparkSession.createDataFrame([(i, list(t)) for i, t in enumerate(triples)], "place int, t array<int>")
    counted = triple_misses(nums, triples, V.RELATION_ABS_TOLERANCE, V.RELATION_REL_TOLERANCE).withColumnRenamed("t", "_t")
    scores = places.join(counted, F.col("place") == F.col("_t")).select("t", "n", "bad")
    valid = scores.where("n >= 3 and bad <= floor(n / 3)")
    best = valid.groupBy(F.element_at("t", 1).alias("p")).agg(
        F.min_by(F.struct("t", "n", "bad"), F.struct("bad", F.element_at("t", 2), F.element_at("t", 3))).alias("x")
    )
    table = F.array(*[F.lit(n) for n in names])
    rate_named = F.array(*[F.lit(bool(re.search(V.RATE_NAME, n) or n in percent)) for n in names])
    name = lambda i: F.element_at(table, F.element_at("x.t", i) + 1)
    # the same three columns found in another form: the rate-named one wins, then column order
    once = (
        best.withColumn("same", F.array_sort("x.t"))
        .groupBy("same")
        .agg(F.min_by("x", F.struct(~F.element_at(rate_named, F.col("p") + 1), F.col("p"))).alias("x"))
    )
    return once.select(name(1).alias("p"), name(2).alias("a"), name(3).alias("b"), "x.n", "x.bad")


def relation_mismatches(df: DataFrame, p: str, a: str, b: str, row_key: str, numbers: str = "br") -> DataFrame:
    """Rows whose rate does not follow from the two columns."""
    rows = df.select(
        quoted(row_key).alias("row"),
        number_of(df, p, numbers).alias("p"),
        number_of(df, a, numbers).alias("a"),
        number_of(df, b, numbers).alias("b"),
    ).dropna(subset=["p", "a", "b"])
    return rows.where((F.col("b") != 0) & _off(F.col("a"), F.col("b"), F.col("p")))


# ------------------------------------------------------------------ headline indicators


def overall_rate(df: DataFrame, numerator: str, denominator: str, numbers: str = "br") -> DataFrame:
    """Sum over sum times 100 over the rows with both numbers; no data unless positive below."""
    a, b = number_of(df, numerator, numbers), number_of(df, denominator, numbers)
    both = a.isNotNull() & b.isNotNull()
    sums = df.agg(F.sum(F.when(both, a)).alias("a"), F.sum(F.when(both, b)).alias("b"))
    return sums.select(F.when(F.col("b") > 0, F.col("a") / F.col("b") * 100).alias("rate"))


def table_kpis(profile: DataFrame, measure: str | None = None) -> DataFrame:
    """Rows, columns, total or mean of the first measure, period and fill rate.

    Rows ``(position, kpi, column, value, from_date, to_date)``.
    """
    role = roles(profile).select("column", "role", "additive")
    p = profile.join(role, "column")
    c = F.col
    is_measure = (c("role") == "measure") & (F.lit(True) if measure is None else c("column") == measure)
    at_measure = F.when(is_measure, c("position"))
    at_date = F.when(c("type") == "date", c("position"))
    one = p.agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("filled").alias("filled"),
        F.min_by(F.struct("column", "sum", "mean", "additive"), at_measure).alias("m"),
        F.min_by(F.struct("column", "min_date", "max_date"), at_date).alias("d"),
    )
    none, no_date = F.lit(None).cast("string"), F.lit(None).cast("timestamp")

    def kpi(position: int, code, column=none, value=F.lit(None), start=no_date, end=no_date) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            (code if isinstance(code, Column) else F.lit(code)).alias("kpi"),
            column.alias("column"),
            value.cast("double").alias("value"),
            start.alias("from_date"),
            end.alias("to_date"),
        )

    rows = F.array(
        kpi(1, "rows", value=c("rows")),
        kpi(2, "columns", value=c("columns")),
        F.when(
            c("m").isNotNull(),
            kpi(
                3,
                F.when(c("m.additive"), "total").otherwise("mean"),
                c("m.column"),
                F.when(c("m.additive"), c("m.sum")).otherwise(c("m.mean")),
            ),
        ),
        F.when(c("d").isNotNull(), kpi(4, "period", c("d.column"), start=c("d.min_date"), end=c("d.max_date"))),
        kpi(5, "fill_rate", value=F.try_divide(c("filled"), F.greatest(F.lit(1), c("rows") * c("columns"))) * 100),
    )
    return one.select(F.inline(F.array_compact(rows)))


def period_kpis(df: DataFrame, period: str, columns: list[str], order_by: str, top: int | None = None, numbers: str = "br") -> DataFrame:
    """First and last period of the numeric columns, the largest change first (the ``top`` ones if given)."""
    at = quoted(order_by)
    nums = [number_of(df, c, numbers) for c in columns]
    box = lambda x: F.struct(x.alias("v"))
    ends = df.agg(
        F.min_by(text_of(df, period), at).alias("first_period"),
        F.max_by(text_of(df, period), at).alias("last_period"),
        *[F.min_by(box(x), at).alias(f"f{i}") for i, x in enumerate(nums)],
        *[F.max_by(box(x), at).alias(f"l{i}") for i, x in enumerate(nums)],
        *[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"s{i}") for i, x in enumerate(nums)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"f{i}.v").alias("first_value"),
                F.col(f"l{i}.v").alias("last_value"),
                (F.col(f"s{i}.lo") < F.col(f"s{i}.hi")).alias("varies"),
            )
            for i, c in enumerate(columns)
        ]
    )
    change = (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100
    found = (
        ends.select("first_period", "last_period", F.inline(rows))
        .where("varies and first_value <> 0 and last_value is not null")
        .withColumn("change", change)
        .orderBy(F.abs("change").desc(), "column")
        .drop("varies")
    )
    return found.limit(top) if top else found
