"""Column expressions for messy cells: numbers, dates, names and keys (no Python UDFs)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import vocabulary as V

BLANKS = " \t\n\r\x0b\x0c ﻿"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def clean_cell(c: Column | str) -> Column:
    """Trim; an empty cell is no data."""
    return F.nullif(trimmed(c), F.lit(""))


def is_missing_marker(c: Column | str, markers: list[str] = V.MISSING_MARKERS) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(markers), F.lit(False))


# ------------------------------------------------------------------ numbers


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(c: Column | str, numbers: str = "br") -> Column:
    """Regional number text to double; what is not a number is null."""
    bare = F.regexp_extract(trimmed(c), V.NUMBER_WRAPPING, 1)

    def read(s: Column) -> Column:
        no_dots, no_commas = F.translate(s, ".", ""), F.translate(s, ",", "")
        text = (
            F.when(~s.rlike(V.NUMBER_CHARACTERS), F.lit(None).cast("string"))
            .when(s.rlike(V.NUMBER_DOT_THOUSANDS_COMMA), F.translate(no_dots, ",", "."))
            .when(s.rlike(V.NUMBER_COMMA_THOUSANDS_DOT), no_commas)
        )
        if numbers == "br":
            # "1.234" also looks plain, so the thousands reading has to come first
            text = text.when(s.rlike(V.NUMBER_DOT_THOUSANDS), no_dots).when(s.rlike(V.NUMBER_COMMA_DECIMAL), F.translate(s, ",", "."))
        else:
            text = text.when(s.rlike(V.NUMBER_COMMA_THOUSANDS), no_commas)
        return text.when(s.rlike(V.NUMBER_PLAIN), s).try_cast("double")

    return let(bare, read)


def finite(c: Column | str) -> Column:
    """Double without NaN and infinities, which count as no data."""
    d = _col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def number_of(df: DataFrame, name: str, numbers: str = "br") -> Column:
    """The number in a column whatever its stored type; typed numbers skip text parsing."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(quoted(name))
    if is_numeric(dtype):
        return quoted(name).cast("double")
    if isinstance(dtype, T.StringType):
        return parse_number(quoted(name), numbers)
    return F.lit(None).cast("double")


def typed_values(df: DataFrame, name: str, texts: list[str]) -> list | None:
    """The texts as values of a whole-number or boolean column, without those that no value prints as; None for other columns.

    A predicate on the column itself can be pushed to the scan, one on its text cannot.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return [t == "true" for t in texts if t in ("true", "false")]
    if not isinstance(dtype, T.IntegralType):
        return None
    bound = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
    whole = [int(t) for t in texts if t.lstrip("-").isascii() and t.lstrip("-").isdigit() and str(int(t)) == t]
    return [n for n in whole if -(2**bound) <= n < 2**bound]


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Halves go towards plus infinity (-2.5 becomes -2), unlike SQL ``round``."""
    scale = float(10**digits)
    return F.floor(_col(c) * scale + 0.5) / scale


# ------------------------------------------------------------------ dates


def parse_date(c: Column | str, date_order: str = "dmy") -> Column:
    """Slashed or ISO text to timestamp; impossible calendar dates are null."""
    s = trimmed(c)
    first, second = (F.regexp_extract(s, V.DATE_SLASHED, i) for i in (1, 2))
    year = F.regexp_extract(s, V.DATE_SLASHED, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
    day, month = (first, second) if date_order == "dmy" else (second, first)
    slashed = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))
    return F.when(s.rlike(V.DATE_SLASHED), slashed).when(s.rlike(V.DATE_ISO_START), s.try_cast("timestamp"))


def date_of(df: DataFrame, name: str, date_order: str = "dmy") -> Column:
    dtype = df.schema[name].dataType
    if is_temporal(dtype):
        return quoted(name).cast("timestamp")
    if isinstance(dtype, T.StringType):
        return parse_date(quoted(name), date_order)
    return F.lit(None).cast("timestamp")


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def quick_period(kind: str, latest: Column | str) -> tuple[Column, Column]:
    """First and last day of a preset period, counted from the latest date in the data."""
    end = F.to_date(_col(latest))
    year = F.year(end)
    if kind == "30d":
        return F.date_sub(end, 29), end
    if kind == "90d":
        return F.date_sub(end, 89), end
    if kind == "12m":
        return F.date_add(F.make_date(year - 1, F.month(end), F.lit(1)), F.dayofmonth(end)), end
    if kind == "year":
        return F.make_date(year, F.lit(1), F.lit(1)), end
    if kind == "previous_year":
        return F.make_date(year - 1, F.lit(1), F.lit(1)), F.make_date(year - 1, F.lit(12), F.lit(31))
    if kind == "all":
        return F.lit(None).cast("date"), F.lit(None).cast("date")
    raise ValueError(f"unknown period: {kind}")


def quick_periods(df: DataFrame, date_col: str, date_order: str = "dmy") -> DataFrame:
    """Every preset period of a table as rows ``(period, from_date, to_date)``."""
    latest = df.agg(F.max(date_of(df, date_col, date_order)).alias("latest"))
    kinds = ["30d", "90d", "12m", "year", "previous_year"]
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("period"), a.alias("from_date"), b.alias("to_date"))
            for k in kinds
            for a, b in [quick_period(k, "latest")]
        ]
    )
    return latest.select(F.inline(rows))


# ------------------------------------------------------------------ text and keys


def _fold_tables() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letter, from Unicode decomposition."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    # characters without a counterpart in the target are deleted: the bare combining marks
    return "".join(source) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_tables()


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(_col(c)), _FOLD_FROM, _FOLD_TO)


def name_key(c: Column | str) -> Column:
    """Comparison key of a name: folded words separated by one space."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def field_key(c: Column | str) -> Column:
    """Comparison key of a field label: folded words separated by underscores."""
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), F.lit("_"))


def text_of(df: DataFrame, name: str) -> Column:
    """The printed form of a cell: whole doubles without ``.0``, timestamps as ISO instants."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.floor(c) == c) & (F.abs(c) < 1e15)
        return F.when(F.isnan(c), F.lit(None)).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if is_temporal(dtype):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.when(c.isNotNull(), F.lit("[binário]"))
    return c.cast("string")


def join_key(df: DataFrame, name: str) -> Column:
    """Text compared by joins: trimmed, empty never matches, leading zeros matter."""
    return clean_cell(text_of(df, name))


def without_leading_zeros(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "^0+(?=.)", "")


def within_one_edit(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_col(a), _col(b), 1) >= 0


def leading_count(c: Column | str) -> Column:
    """Leading whole number of at most six digits."""
    return F.nullif(F.regexp_extract(_col(c), r"^\s*(\d{1,6})\b", 1), F.lit("")).cast("int")


# ------------------------------------------------------------------ regional reading


def infer_locale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the suggested date order and number style, and what stays ambiguous."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = df.select(F.explode(F.array(*[quoted(n) for n in names])).alias("v")).where("v is not null")
    s = trimmed("v")
    date = F.col("v").rlike(V.DATE_SLASHED)
    a = F.regexp_extract("v", V.DATE_SLASHED, 1).try_cast("int")
    b = F.regexp_extract("v", V.DATE_SLASHED, 2).try_cast("int")
    us = s.rlike(V.NUMBER_COMMA_THOUSANDS_DOT)
    br = s.rlike(V.NUMBER_DOT_THOUSANDS_COMMA) | s.rlike(V.NUMBER_SHORT_COMMA_DECIMAL)
    seen = cells.agg(
        F.count_if(date & (a > 12) & (b <= 12)).alias("day_first"),
        F.count_if(date & (b > 12) & (a <= 12)).alias("month_first"),
        F.count_if(date & (a <= 12) & (b <= 12)).alias("either"),
        F.count_if(~date & us).alias("us"),
        F.count_if(~date & ~us & br).alias("br"),
        F.count_if(~date & ~us & ~br & s.rlike(V.NUMBER_ONE_DOT_GROUP)).alias("dotted"),
    )
    c = F.col
    return seen.select(
        F.when(c("month_first") > c("day_first"), "mdy").otherwise("dmy").alias("date_order"),
        F.when(c("us") > c("br"), "us").otherwise("br").alias("numbers"),
        ((c("day_first") == 0) & (c("month_first") == 0) & (c("either") > 0)).alias("date_ambiguous"),
        c("either").alias("date_ambiguous_count"),
        ((c("dotted") > 0) & (c("us") == 0) & (c("br") == 0)).alias("number_ambiguous"),
        c("dotted").alias("number_ambiguous_count"),
    )
