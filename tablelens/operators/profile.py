"""Column profiles from one value-frequency table.

The table is unpivoted once and counted per (column, value); parsing, typing and statistics then
work on distinct values weighted by their count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import vocabulary as V
from tablelens.functions.ranks import lower_quantiles, medians
from tablelens.functions.values import (
    finite,
    is_missing_marker,
    is_numeric,
    is_temporal,
    parse_date,
    parse_number,
    quoted,
    text_of,
    trimmed,
)

NUMERIC_TYPES = ("number", "integer")
TYPES = ("number", "integer", "date", "category", "boolean", "text", "id", "lat", "lon")


NUMBER, BOOLEAN, TIME, TEXT = range(4)


def _kind(dtype: T.DataType) -> int:
    if is_numeric(dtype):
        return NUMBER
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return TIME if is_temporal(dtype) else TEXT


def _cell(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """A cell as text, whole number or real number; the two others are null.

    Typed columns are counted as they are stored, so only text is ever parsed.
    """
    dtype, c = df.schema[name].dataType, quoted(name)
    text, whole, real = (F.lit(None).cast(t) for t in ("string", "bigint", "double"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        real = finite(c)
    elif isinstance(dtype, (T.IntegralType, T.BooleanType)):
        whole = c.cast("bigint")
    elif is_temporal(dtype):
        whole = F.unix_millis(c.cast("timestamp"))
    elif is_numeric(dtype):
        text = c.cast("string")
    else:
        text = text_of(df, name)
    return text, whole, real


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(position, text, whole, real, kind, n)`` per column and distinct value, missing cells included.

    ``position`` is the column's place in the table; ``kind`` tells numbers, booleans, times and
    text apart. A value that fills a third of the rows is one row here: the count is combined
    before the shuffle.

    ``kind`` follows from the position, so it is carried as an aggregate instead of a key: a later
    filter on parsed values then stays above the shuffle, and all readers share one shuffle.
    """
    cells = []
    for i, c in enumerate(columns or df.columns):
        text, whole, real = _cell(df, c)
        kind = F.lit(_kind(df.schema[c].dataType))
        cells.append(F.struct(F.lit(i).alias("position"), kind.alias("kind"), text.alias("text"), whole.alias("whole"), real.alias("real")))
    keys = ["position", "text", "whole", "real"]
    return df.select(F.inline(F.array(*cells))).groupBy(*keys).agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"))


def parsed_frequencies(freq: DataFrame, numbers: str = "br", date_order: str = "dmy") -> DataFrame:
    """Frequencies with ``filled``, ``marker``, ``num`` and ``ts`` per distinct value."""
    kind, text, whole, real = (F.col(c) for c in ("kind", "text", "whole", "real"))
    is_text = kind == TEXT
    marker = is_text & is_missing_marker("text")
    num = F.when(kind == NUMBER, F.coalesce(real, whole.cast("double"), text.try_cast("double"))).when(
        is_text & ~marker, parse_number("text", numbers)
    )
    ts = F.when(kind == TIME, F.timestamp_millis(whole)).when(is_text & ~marker, parse_date("text", date_order))
    present = text.isNotNull() | whole.isNotNull() | real.isNotNull()
    return freq.select("*", marker.alias("marker"), (present & ~marker).alias("filled"), num.alias("num"), ts.alias("ts"))


def printed_value() -> Column:
    """The text of a counted value, as the cell reads in a table."""
    real, whole = F.col("real"), F.col("whole")
    number = F.when((F.floor(real) == real) & (F.abs(real) < 1e15), real.cast("bigint").cast("string")).otherwise(real.cast("string"))
    moment = F.date_format(F.timestamp_millis(whole), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    flag = F.when(whole == 1, "true").otherwise("false")
    return F.coalesce(
        "text", number, F.when(F.col("kind") == TIME, moment).when(F.col("kind") == BOOLEAN, flag).otherwise(whole.cast("string"))
    )


def _weighted(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")


def _every(cond: Column) -> Column:
    """True when all filled values satisfy the condition."""
    return F.coalesce(F.bool_and(F.when(F.col("filled"), F.coalesce(cond, F.lit(False)))), F.lit(False))


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(F.when(F.col("filled"), F.coalesce(cond, F.lit(False)))), F.lit(False))


def _column_facts(parsed: DataFrame) -> DataFrame:
    filled, num, text = F.col("filled"), F.col("num"), F.col("text")
    is_text = F.col("kind") == TEXT
    # rules about spelling look at text only; everything else skips them
    said = lambda cond: is_text & F.coalesce(cond, F.lit(False))
    word, cell = F.lower("text"), trimmed("text")
    year = F.when(is_text, cell.rlike(V.YEAR_VALUE)).otherwise((num == F.floor(num)) & num.between(1900, 2099))
    return parsed.groupBy("position").agg(
        F.sum("n").cast("bigint").alias("rows"),
        _weighted(filled).alias("filled"),
        _weighted(F.col("marker")).alias("markers"),
        F.count_if(filled).alias("distinct"),
        _every(F.col("kind") == BOOLEAN).alias("all_boolean"),
        _every(said(word.isin(V.BOOLEAN_WORDS))).alias("all_boolean_words"),
        _weighted(num.isNotNull()).alias("numeric"),
        _any((F.col("kind") == NUMBER) | said(text.rlike(V.NUMBER_LOOK))).alias("looks_numeric"),
        F.coalesce(F.bool_and(num == F.floor(num)), F.lit(True)).alias("all_whole"),
        _weighted(F.col("ts").isNotNull()).alias("dated"),
        _weighted(filled & said(cell.endswith("%"))).alias("with_percent"),
        _every(year).alias("all_years"),
        _every(said(F.regexp_replace(F.lower(cell), r"\.$", "").isin(V.MONTH_WORDS))).alias("all_months"),
        _weighted(said(F.length(cell) > 0)).alias("texts"),
        _weighted(said(cell.rlike(V.LEADING_ZERO_VALUE))).alias("zero_led"),
        _any(said(cell.rlike(V.CURRENCY_VALUE))).alias("currency_values"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.sum(num * F.col("n")).alias("sum"),
        F.min("ts").alias("min_date"),
        F.max("ts").alias("max_date"),
    )


def _flag(names: list[str], test) -> Column:
    """A per-column constant looked up by position."""
    return F.element_at(F.array(*[F.lit(bool(test(n))) for n in names]), F.col("position") + 1)


def _technical_type(names: list[str], geo: dict[str, str] | None) -> tuple[Column, Column]:
    c = F.col
    low = lambda n: n.lower()
    share = lambda k: c(k) / c("filled")
    base = (
        F.when(c("filled") == 0, "text")
        .when(c("all_boolean") | ((c("distinct") <= 2) & c("all_boolean_words")), "boolean")
        .when((share("numeric") >= V.NUMBER_SHARE) & c("looks_numeric") & c("all_whole"), "integer")
        .when((share("numeric") >= V.NUMBER_SHARE) & c("looks_numeric"), "number")
        .when(share("dated") >= V.DATE_SHARE, "date")
        .when(
            (c("distinct") <= F.greatest(F.lit(float(V.CATEGORY_FLOOR)), c("filled") * V.CATEGORY_SHARE))
            & (c("distinct") < c("filled")),
            "category",
        )
        .when((c("distinct") >= c("filled") * V.ID_SHARE) & (c("filled") > 5), "id")
        .when(c("distinct") <= V.CATEGORY_CEILING, "category")
        .otherwise("text")
    )
    number_like = base.isin(*NUMERIC_TYPES)
    if geo:
        is_lat, is_lon = _flag(names, lambda n: n == geo["lat"]), _flag(names, lambda n: n == geo["lon"])
    else:
        is_lat = _flag(names, lambda n: re.search(V.LATITUDE_NAME, low(n)))
        is_lon = _flag(names, lambda n: re.search(V.LONGITUDE_NAME, low(n)))
    id_name = _flag(names, lambda n: re.search(V.NUMERIC_ID_NAME, low(n)))
    code = (base == "integer") & (c("distinct") >= c("filled") * V.ID_SHARE) & (c("filled") > 5) & id_name
    placed = F.when(number_like & is_lat, "lat").when(number_like & is_lon, "lon").when(code, "id").otherwise(base)
    year_name = _flag(names, lambda n: re.search(V.YEAR_NAME, low(n).strip()))
    years = placed.isin("integer", "category", "text") & year_name & c("all_years")
    months = placed.isin("category", "text") & (c("distinct") >= 3) & c("all_months")
    period = (c("filled") > 0) & (years | months)
    return F.when(period, "category").otherwise(placed), period


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    geo: dict[str, str] | None = None,
    forced: dict[str, str] | None = None,
    numbers: str = "br",
    date_order: str = "dmy",
    median: bool = True,
) -> DataFrame:
    """One row per column: type, fill, distinct count, markers, flags and statistics."""
    names = columns or df.columns
    parsed = parsed_frequencies(value_frequencies(df, names), numbers, date_order)
    facts = _column_facts(parsed)
    inferred, period = _technical_type(names, geo)
    typed = facts.withColumns({"column": F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)})
    typed = typed.withColumns({"period": period, "_inferred": inferred})
    known = {k: v for k, v in (forced or {}).items() if k in names}
    chosen = F.col("_inferred")
    if known:
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        chosen = F.coalesce(F.element_at(table, F.col("column")), chosen)
    typed = typed.withColumn("type", chosen)
    number = F.col("type").isin(*NUMERIC_TYPES)
    measured = F.col("type").isin(*NUMERIC_TYPES, "lat", "lon")
    dated = F.col("type") == "date"
    only = lambda cond, c: F.when(cond, F.col(c))
    wide = typed
    if median:
        counted = parsed.where("num is not null").select("position", "num", "n")
        wide = typed.join(medians(counted, ["position"], "num", "n"), "position", "left")
    else:
        wide = typed.withColumn("median", F.lit(None).cast("double"))
    return wide.select(
        "position",
        "column",
        "type",
        "rows",
        "filled",
        (F.col("rows") - F.col("filled")).alias("missing"),
        F.col("markers").alias("missing_markers"),
        "distinct",
        "period",
        (number & (F.col("filled") > 0) & (F.col("with_percent") >= F.col("filled") * V.PERCENT_SHARE)).alias("percent"),
        F.when(measured, F.col("filled") - F.col("numeric")).otherwise(F.lit(0)).cast("bigint").alias("invalid"),
        only(number, "min").alias("min"),
        only(number, "max").alias("max"),
        only(number, "sum").alias("sum"),
        F.when(number, F.try_divide("sum", "numeric")).alias("mean"),
        only(number, "median").alias("median"),
        only(dated, "min_date").alias("min_date"),
        only(dated, "max_date").alias("max_date"),
        F.coalesce(F.try_divide("zero_led", "texts"), F.lit(0.0)).alias("zero_led_share"),
        "currency_values",
        F.element_at(F.array(*[F.lit(n in known) for n in names]), F.col("position") + 1).alias("manual"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Filled values and their counts per column; order by ``n`` for a report."""
    names = columns or df.columns
    freq = parsed_frequencies(value_frequencies(df, names)).where("filled")
    return freq.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1).alias("column"), printed_value().alias("value"), "n"
    )


def invalid_values(df: DataFrame, column: str, order_by: str, first: int | None = None, numbers: str = "br") -> DataFrame:
    """Cells of a numeric column that are neither empty, a marker nor a number, the ``first`` ones if given."""
    v = text_of(df, column)
    bad = v.isNotNull() & ~is_missing_marker(v) & parse_number(v, numbers).isNull()
    found = df.where(bad).select(quoted(order_by).alias("row"), v.alias("value")).orderBy("row")
    return found.limit(first) if first else found


def outliers(df: DataFrame, columns: list[str], numbers: str = "br", min_rows: int = 8) -> DataFrame:
    """Values beyond three interquartile ranges, per numeric column."""
    parsed = parsed_frequencies(value_frequencies(df, columns), numbers).where("num is not null").select("position", "num", "n")
    q = lower_quantiles(parsed, ["position"], "num", "n", {"q1": 0.25, "q3": 0.75})
    counted = parsed.groupBy("position").agg(F.sum("n").alias("rows"))
    fences = q.join(counted, "position").where((F.col("rows") >= min_rows) & (F.col("q3") > F.col("q1")))
    far = (F.col("num") < F.col("q1") - 3 * (F.col("q3") - F.col("q1"))) | (
        F.col("num") > F.col("q3") + 3 * (F.col("q3") - F.col("q1"))
    )
    # one fence row per column: bounded by the width of the table
    joined = parsed.join(F.broadcast(fences), "position")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1)
    return (
        joined.groupBy("position", "q1", "q3")
        .agg(F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).cast("bigint").alias("outliers"))
        .select(name.alias("column"), "q1", "q3", "outliers")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier identical one."""
    groups = df.select(*[text_of(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)]).groupBy(
        *[f"c{i}" for i in range(len(df.columns))]
    )
    return groups.count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )
