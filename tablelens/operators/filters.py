"""Row filters; every one is a predicate that Catalyst can push to the scan where the source allows."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import date_of, fold, is_temporal, quoted, text_of, typed_values


def equals(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Equality on many columns, compared as text; an empty cell equals the empty text.

    Whole-number and boolean columns are compared with the typed value, which reaches the scan; a text
    that none of their values prints as matches no row. Doubles have many spellings and stay text.
    """
    cond = F.lit(True)
    for name, value in wanted.items():
        typed = typed_values(df, name, [value])
        same = text_of(df, name) == value if typed is None else quoted(name) == typed[0] if typed else F.lit(False)
        cond = cond & (F.coalesce(text_of(df, name), F.lit("")) == "" if value == "" else same)
    return df.where(cond)


def date_between(df: DataFrame, column: str, start: str | None = None, end: str | None = None, date_order: str = "dmy") -> DataFrame:
    """Inclusive date range with the whole last day; undated rows are outside."""
    if not start and not end:
        return df
    stored = is_temporal(df.schema[column].dataType)
    # a stored timestamp is compared as it is, so that the scan can skip row groups
    at = quoted(column) if stored else date_of(df, column, date_order)
    cond = at.isNotNull()
    if start:
        cond = cond & (at >= F.lit(start).cast("timestamp"))
    if end:
        cond = cond & (at < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    return df.where(cond)


def fold_words(text: str) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return [w for w in re.split(r"\s+", bare.lower()) if w]


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All cells of a row as folded text; dates read both as ISO and day/month/year."""
    cells = []
    for name in columns or df.columns:
        if is_temporal(df.schema[name].dataType):
            ts = quoted(name)
            cells.append(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" "), F.date_format(ts, "dd/MM/yyyy")))
        else:
            cells.append(text_of(df, name))
    return fold(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cells]))


def text_search(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which every word of ``term`` occurs, whatever the case and accents."""
    words = fold_words(term)
    if not words:
        return df
    line = row_text(df, columns)
    cond = F.lit(True)
    for w in words:
        cond = cond & line.contains(w)
    return df.where(cond)


def any_column_contains(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which one cell contains ``term``, ignoring case only."""
    cond = F.lit(False)
    for name in columns or df.columns:
        cond = cond | F.coalesce(F.lower(text_of(df, name)).contains(term.lower()), F.lit(False))
    return df.where(cond)


def by_label(df: DataFrame, column: str, label: str, time_axis: bool = False, date_order: str = "dmy") -> DataFrame:
    """The rows behind a clicked label: that month on a time axis, else equality."""
    month = re.fullmatch(r"(\d{4})-(\d{2})", label) if time_axis else None
    if not month:
        return equals(df, {column: label})
    at = quoted(column) if is_temporal(df.schema[column].dataType) else date_of(df, column, date_order)
    first = F.lit(f"{label}-01").cast("timestamp")
    return df.where((at >= first) & (at < F.add_months(first.cast("date"), 1).cast("timestamp")))
