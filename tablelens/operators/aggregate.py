"""Grouped summaries in which missing is never zero.

Results are long frames; ``NULL`` means no data. ``position`` is the presentation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.ranks import medians
from tablelens.functions.values import finite, number_of, quoted, text_of, typed_values
from tablelens.operators.pairs import pair_moments

HOWS = ("count", "sum", "mean", "min", "max", "median")


def aggregate_column(how: str, value: str = "_v") -> Column:
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](value)


def aggregate(rows: DataFrame, keys: list[str], how: str, out: str = "value") -> DataFrame:
    """Group prepared rows (``keys`` and ``_v``) whose null values were dropped already."""
    if how == "count":
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(out))
    if how == "median":
        # two shuffles on (key, value) instead of one buffer with every value of a hot key
        return medians(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, "_v", "_n", out)
    if how not in HOWS:
        raise ValueError(f"unknown aggregate: {how}")
    return rows.groupBy(*keys).agg(aggregate_column(how).alias(out))


def keyed_values(df: DataFrame, keys: dict[str, Column], value: str | None, how: str, numbers: str = "br") -> DataFrame:
    """Rows with every key present and, unless rows are counted, a numeric value."""
    v = F.lit(1.0) if how == "count" else number_of(df, value, numbers)
    rows = df.select(*[c.alias(n) for n, c in keys.items()], v.alias("_v"))
    return rows.dropna(subset=[*keys, "_v"])


def group_values(df: DataFrame, key: str, value: str | None = None, how: str = "count", numbers: str = "br") -> DataFrame:
    """``(label, value)`` per distinct key."""
    return aggregate(keyed_values(df, {"label": text_of(df, key)}, value, how, numbers), ["label"], how)


def ranking(
    df: DataFrame, key: str, value: str | None = None, how: str = "count", top: int | None = None, numbers: str = "br"
) -> DataFrame:
    """Groups from the largest value down; equal values in label order."""
    ordered = group_values(df, key, value, how, numbers).orderBy(F.col("value").desc(), "label")
    return ordered.limit(top) if top else ordered


def in_source_order(
    df: DataFrame, key: str, order_by: str, value: str | None = None, how: str = "count", numbers: str = "br"
) -> DataFrame:
    """Groups in the order in which their label first appears along ``order_by``."""
    keys = {"label": text_of(df, key)}
    v = F.lit(1.0) if how == "count" else number_of(df, value, numbers)
    rows = df.select(keys["label"].alias("label"), v.alias("_v"), quoted(order_by).alias("_at")).dropna(subset=["label", "_v"])
    first = rows.groupBy("label").agg(F.min("_at").alias("position"))
    return aggregate(rows, ["label"], how).join(first, "label").orderBy("position", "label")


def ratio_values(
    df: DataFrame, key: str, numerator: str, denominator: str, top: int | None = None, numbers: str = "br"
) -> DataFrame:
    """Sum over sum per group, times 100, over rows that have both numbers."""
    rows = df.select(
        text_of(df, key).alias("label"),
        number_of(df, numerator, numbers).alias("a"),
        number_of(df, denominator, numbers).alias("b"),
    ).dropna()
    out = (
        rows.groupBy("label")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where("b > 0")
        .select("label", (F.try_divide("a", "b") * 100).alias("value"))
        .orderBy(F.col("value").desc(), "label")
    )
    return out.limit(top) if top else out


# ------------------------------------------------------------------ two dimensions


def where_lists(df: DataFrame, where: dict[str, list[str]] | None) -> Column:
    """Value lists per column; the no-value marker in a list accepts empty cells.

    Typed columns are compared with typed values, which reach the scan.
    """
    cond = F.lit(True)
    for name, accepted in (where or {}).items():
        text = text_of(df, name)
        typed = typed_values(df, name, accepted)
        listed = quoted(name).isin(typed) if typed is not None else text.isin(list(accepted))
        cond = cond & ((F.coalesce(listed, F.lit(False)) & text.isNotNull()) | text.isNull() if V.NO_VALUE in accepted else listed)
    return cond


def cross_values(
    df: DataFrame,
    x: str,
    series_by: str | None = None,
    value: str | None = None,
    how: str = "sum",
    where: dict[str, list[str]] | None = None,
    top: int | None = None,
    order_by: str | None = None,
    numbers: str = "br",
    dense: bool = False,
) -> DataFrame:
    """One value per ``x`` label and series: ``(label, series, value, label_value)``.

    Without ``series_by`` the series is null. The largest ``top`` labels stay if it is given; with
    ``order_by`` labels come in first-seen order instead. Cells stay long, so any number of series is
    fine. A label without cells has one row without a series; ``dense`` lists every kept label with every
    series, absent ones as null, which is labels times series rows.
    """
    rows = df.where(where_lists(df, where))
    keys = {"label": text_of(df, x)}
    totals = aggregate(keyed_values(rows, keys, value, how, numbers), ["label"], how, "label_value")
    if order_by:
        seen = rows.select(keys["label"].alias("label"), quoted(order_by).alias("_at")).dropna(subset=["label"])
        position = seen.groupBy("label").agg(F.min("_at").alias("position"))
        totals = position.join(totals, "label", "left")
    if series_by is None:
        plain = totals.select("label", F.lit(None).cast("string").alias("series"), F.col("label_value").alias("value"), *(["position"] if order_by else []))
        if order_by:
            return plain.orderBy("position", "label")
        ordered = plain.orderBy(F.col("value").desc(), "label")
        return ordered.limit(top) if top else ordered
    if not order_by:
        # a label with no numeric value at all still is on the axis
        axis = rows.select(keys["label"].alias("label")).dropna().distinct()
        totals = axis.join(totals, "label", "left")
    if top and not order_by:
        totals = totals.orderBy(F.col("label_value").desc_nulls_last(), "label").limit(top)
    source = keyed_values(rows, {**keys, "series": text_of(df, series_by)}, value, how, numbers)
    if top and not order_by:
        source = source.join(totals.select("label"), "label", "left_semi")
    cells = aggregate(source, ["label", "series"], how)
    head = ["label", "label_value", *(["position"] if order_by else [])]
    if not dense:
        return totals.join(cells, "label", "left").select(*head, "series", "value")
    return _every_series(totals, cells).join(cells, ["label", "series"], "left").select(*head, "series", "value")


def _every_series(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Every label with every series of the cells; a null series if there is none."""
    names = cells.agg(F.collect_set("series").alias("s")).select("s").scalar()
    return labels.withColumn("series", F.explode_outer(names))


def stacked_counts(df: DataFrame, x: str, stack: str, top: int | None = None, dense: bool = False) -> DataFrame:
    """Row counts per label and series, of the ``top`` largest labels if given; with ``dense`` absent pairs count as 0."""
    rows = df.select(text_of(df, x).alias("label"), text_of(df, stack).alias("series")).dropna()
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("label_total"))
    kept = rows
    if top:
        labels = labels.orderBy(F.col("label_total").desc(), "label").limit(top)
        kept = rows.join(labels.select("label"), "label", "left_semi")
    counts = kept.groupBy("label", "series").agg(F.count(F.lit(1)).alias("value"))
    if not dense:
        return labels.join(counts, "label").select("label", "label_total", "series", "value")
    # every series of the table, also those that no kept label has
    pairs = _every_series(labels, rows.select("series").distinct())
    return pairs.join(counts, ["label", "series"], "left").select("label", "label_total", "series", F.coalesce("value", F.lit(0)).alias("value"))


def percent_of_label(long: DataFrame) -> DataFrame:
    """Share of each series within its label; a label summing to 0 has no data."""
    total = F.sum("value").over(Window.partitionBy("label"))
    return long.withColumn("share", F.try_divide(F.col("value"), F.nullif(total, F.lit(0.0))) * 100)


def heat_matrix(long: DataFrame) -> DataFrame:
    """The cells of a cross table with the overall smallest and largest value."""
    span = long.agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("value"), F.lit(0.0)).alias("hi"))
    return long.withColumns(
        {"low": span.select("lo").scalar(), "high": span.select("hi").scalar()}
    )


# ------------------------------------------------------------------ several columns per row


def compare_columns(df: DataFrame, x: str, columns: list[str], order_by: str | None = None, numbers: str = "br") -> DataFrame:
    """Several numeric columns side by side: ``(label, series, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), number_of(df, c, numbers).alias("value")) for c in columns])
    extra = [quoted(order_by).alias("position")] if order_by else []
    return df.select(text_of(df, x).alias("label"), *extra, F.inline(pairs)).where("label is not null")


def part_and_rest(
    df: DataFrame, x: str, part: str, whole: str, order_by: str | None = None, row: int | None = None, numbers: str = "br"
) -> DataFrame:
    """Part and remainder per row; a part above its whole is no data.

    ``row`` picks one labelled row by its zero-based place along ``order_by`` (negative: the last).
    """
    a, b = number_of(df, part, numbers), number_of(df, whole, numbers)
    ok = a <= b
    out = df.select(
        text_of(df, x).alias("label"),
        F.when(ok, a).alias("part"),
        F.when(ok, b - a).alias("rest"),
        *([quoted(order_by).alias("position")] if order_by else []),
    ).where("label is not null")
    if row is None:
        return out
    if not order_by:
        raise ValueError("choosing a row needs order_by")
    if row < 0:
        return out.orderBy(F.col("position").desc()).limit(1)
    # past the end the last row is shown
    return out.orderBy("position").limit(row + 1).orderBy(F.col("position").desc()).limit(1)


def indicator_profile(df: DataFrame, x: str, indicators: list[str], numbers: str = "br") -> DataFrame:
    """Each value as a percentage of the largest value of its indicator."""
    long = compare_columns(df, x, indicators, numbers=numbers)
    tops = long.groupBy("series").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("_top"))
    return long.join(F.broadcast(tops), "series").select(
        "label", F.col("series").alias("indicator"), (F.try_divide("value", F.nullif("_top", F.lit(0.0))) * 100).alias("value")
    )


def first_to_last_change(df: DataFrame, x: str, indicators: list[str], order_by: str, numbers: str = "br") -> DataFrame:
    """Percent change of every indicator from the first to the last labelled row."""
    rows = df.where(text_of(df, x).isNotNull())
    cells = [
        F.struct(number_of(df, c, numbers).alias("v"))
        for c in indicators
    ]
    ends = rows.agg(
        *[F.min_by(cell, quoted(order_by)).alias(f"f{i}") for i, cell in enumerate(cells)],
        *[F.max_by(cell, quoted(order_by)).alias(f"l{i}") for i, cell in enumerate(cells)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("indicator"), F.col(f"f{i}.v").alias("first"), F.col(f"l{i}.v").alias("last"))
            for i, c in enumerate(indicators)
        ]
    )
    return (
        ends.select(F.inline(pairs))
        .where("first <> 0 and last is not null")
        .withColumn("change", (F.col("last") - F.col("first")) / F.abs("first") * 100)
        .orderBy(F.col("change").desc(), "indicator")
    )


def histogram(df: DataFrame, column: str, numbers: str = "br") -> DataFrame:
    """Equal-width bins between the extremes, 4 to 12 of them, empty bins kept."""
    rows = df.select(number_of(df, column, numbers).alias("v")).where("v is not null")
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).where("n > 0")
    bins = F.least(F.lit(12), F.greatest(F.lit(4), F.ceil(F.sqrt("n")))).cast("int")
    width = (F.col("hi") - F.col("lo")) / bins
    plan = span.select("lo", bins.alias("bins"), F.when(width == 0, 1.0).otherwise(width).alias("w"))
    shape = plan.select(F.struct("lo", "bins", "w").alias("s")).scalar()
    placed = rows.withColumn("s", shape).select(
        F.least(F.col("s.bins") - 1, F.floor((F.col("v") - F.col("s.lo")) / F.col("s.w"))).cast("int").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = plan.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("from_value"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("to_value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


# ------------------------------------------------------------------ correlation and points


def _moments(x: Column, y: Column) -> list[Column]:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return [
        F.count(a).alias("n"),
        F.covar_pop(a, b).alias("sxy"),
        F.var_pop(a).alias("sxx"),
        F.var_pop(b).alias("syy"),
    ]


def _r(prefix: str = "") -> Column:
    sxx, syy, sxy = (F.col(prefix + n) for n in ("sxx", "syy", "sxy"))
    flat = (sxx == 0) | (syy == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(sxy, F.sqrt(sxx * syy)))


def pearson(df: DataFrame, a: str, b: str, numbers: str = "br") -> DataFrame:
    """Correlation over rows with both values; 0 when one of them never varies."""
    x, y = number_of(df, a, numbers), number_of(df, b, numbers)
    return df.agg(*_moments(x, y)).select("n", _r().alias("r"))


def best_correlation(
    df: DataFrame, columns: list[str], first: int | None = None, min_rows: int = 8, min_r: float = 0.5, numbers: str = "br"
) -> DataFrame:
    """The most correlated pair of the numeric columns (of the ``first`` ones if given).

    All pairs come from one scan, as products of matrices with null masks, without a shuffle of rows; equal strengths go
    to the pair listed first.
    """
    names = columns[:first] if first else columns
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n bigint, r double")
    nums = df.select(*[number_of(df, c, numbers).alias(f"c{i}") for i, c in enumerate(names)])
    x, y = F.try_divide("sx", "n"), F.try_divide("sy", "n")

    def spread(squares: str, mean: Column) -> Column:
        """The variance; what rounding leaves of a column without one is 0."""
        raw = F.try_divide(squares, "n")
        return F.when(raw - mean * mean > raw * 1e-13, raw - mean * mean).otherwise(F.lit(0.0))

    moments = pair_moments(nums).select("i", "j", "n", spread("sxx", x).alias("sxx"), spread("syy", y).alias("syy"), (F.try_divide("sxy", "n") - x * y).alias("sxy"))
    strong = moments.select("i", "j", "n", _r().alias("r")).where((F.col("n") >= min_rows) & (F.abs("r") >= min_r))
    table = F.array(*[F.lit(n) for n in names])
    # equal up to rounding counts as equal
    best = strong.orderBy(F.round(F.abs("r"), 12).desc(), "i", "j").limit(1)
    return best.select(F.element_at(table, F.col("i") + 1).alias("a"), F.element_at(table, F.col("j") + 1).alias("b"), "n", "r")


def scatter_points(df: DataFrame, x: str, y: str, numbers: str = "br") -> DataFrame:
    return df.select(number_of(df, x, numbers).alias("x"), number_of(df, y, numbers).alias("y")).dropna()


def magnitude_groups(profile: DataFrame, size: int = 4) -> DataFrame:
    """Numeric columns of like magnitude, ``size`` per group; percentages form their own group."""
    nums = profile.where("type in ('number', 'integer') and max > 0")
    power = F.when(F.coalesce("percent", F.lit(False)), "pct").otherwise(F.floor(F.log10("max")).cast("string"))
    w = Window.partitionBy("magnitude").orderBy("position")
    return (
        nums.withColumn("magnitude", power)
        .withColumn("part", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
        .groupBy("magnitude", "part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda s: s["column"]).alias("columns"))
    )
