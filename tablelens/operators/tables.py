"""Sorted pages of a table."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablelens.functions.values import date_of, fold, number_of, quoted, text_of
from tablelens.session import cut_lineage

_DIGIT_WIDTH = 20
#: Rows that a page may skip by sorting; deeper pages first narrow the rows down.
DIRECT = 50_000
#: Ranges that one scan counts when narrowing.
_RANGES = 32


def natural_key(c: Column) -> Column:
    """Folded text in which digit runs are padded, so that "item 2" comes before "item 10"."""
    padded = F.regexp_replace(fold(c), r"\d+", "0" * _DIGIT_WIDTH + "$0")
    return F.regexp_replace(padded, r"0*(\d{%d})(?!\d)" % _DIGIT_WIDTH, "$1")


def sort_key(df: DataFrame, column: str, kind: str | None, numbers: str = "br", date_order: str = "dmy") -> Column:
    if kind in ("number", "integer", "lat", "lon"):
        return number_of(df, column, numbers)
    if kind == "date":
        return date_of(df, column, date_order)
    return natural_key(text_of(df, column))


def sort_rows(df: DataFrame, column: str, order_by: str, descending: bool = False, kind: str | None = None, numbers: str = "br") -> DataFrame:
    """Typed order with empty cells last both ways; equal keys keep the order of ``order_by``."""
    key = sort_key(df, column, kind, numbers)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), quoted(order_by))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of a row in the given order, from 0 without gaps. Rows that tie in all of ``order`` get their places in any order.

    The order is dealt to ranges, each sorted on its own; only the number of rows per range meets on the driver, one number per shuffle partition.
    The ranges are written to the checkpoint folder, because bounds taken from another sample would number the rows anew.
    """
    ranges = df.repartitionByRange(*[quoted(c) for c in order]).sortWithinPartitions(*[quoted(c) for c in order])
    ranges = cut_lineage(ranges.withColumns({"_range": F.spark_partition_id(), "_within": F.monotonically_increasing_id()}))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_within").alias("first")).orderBy("_range").collect()
    before = accumulate((r.n for r in counts), initial=0)
    shift = df.sparkSession.createDataFrame([(r["_range"], b - r["first"]) for r, b in zip(counts, before)], "_range int, _shift bigint")
    # one row per range: bounded by the number of shuffle partitions
    return ranges.join(F.broadcast(shift), "_range").withColumn(name, F.col("_within") + F.col("_shift")).drop("_range", "_within", "_shift")


def page(sorted_rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of sorted rows, counted from 1."""
    skip = (max(1, number) - 1) * size
    return (sorted_rows.offset(skip) if skip else sorted_rows).limit(size)


def _ordered(rows: DataFrame, descending: bool) -> DataFrame:
    key = F.col("_page_key")
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("_page_tie").asc_nulls_first())


def _not_before(bound: Row, descending: bool) -> Column:
    """Rows at or after a bound in page order: empty keys last, equal keys by the tie."""
    key = F.col("_page_key")
    tied = F.coalesce(F.col("_page_tie") >= F.lit(bound["_page_tie"]), F.lit(False)) if bound["_page_tie"] is not None else F.lit(True)
    if bound["_page_key"] is None:
        return key.isNull() & tied
    edge = F.lit(bound["_page_key"])
    return F.coalesce(key < edge if descending else key > edge, F.lit(True)) | (key.eqNullSafe(edge) & tied)


def page_of(
    df: DataFrame, key: Column, tie: Column, number: int, size: int, descending: bool = False, direct: int = DIRECT
) -> DataFrame:
    """One page by typed order, counted from 1, at any depth without sorting what comes before it.

    While a page lies deeper than ``direct`` rows, one scan counts the rows between a few sampled bounds and
    only the ranges that hold the page are kept; what is left is sorted. Rows equal in key and
    tie have no order among themselves; if they alone fill the ranges, they are sorted as they are.
    """
    rows = df.withColumns({"_page_key": key, "_page_tie": tie})
    skip, left = (max(1, number) - 1) * size, None
    while skip + size > direct and (left is None or left > direct):
        sample = rows.select("_page_key", "_page_tie").orderBy(F.rand(0)).limit(_RANGES * 16)
        picked = _ordered(sample, descending).collect()
        bounds = picked[8::16]
        if not bounds:
            break
        place = reduce(lambda a, b: a + b, [_not_before(b, descending).cast("int") for b in bounds])
        counted = {r["place"]: r["n"] for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        ends = list(accumulate(counted.get(i, 0) for i in range(len(bounds) + 1)))
        if skip >= ends[-1]:
            rows = rows.limit(0)
            break
        first = next(i for i, end in enumerate(ends) if end > skip)
        last = next((i for i, end in enumerate(ends) if end >= skip + size), len(bounds))
        before = ends[first - 1] if first else 0
        if ends[last] - before == ends[-1]:
            break
        if first:
            rows = rows.where(_not_before(bounds[first - 1], descending))
        if last < len(bounds):
            rows = rows.where(~_not_before(bounds[last], descending))
        skip, left = skip - before, ends[last] - before
    ordered = _ordered(rows, descending)
    return (ordered.offset(skip) if skip else ordered).limit(size).drop("_page_key", "_page_tie")


def sorted_page(
    df: DataFrame, column: str, order_by: str, number: int, size: int, descending: bool = False, kind: str | None = None, numbers: str = "br",
    direct: int = DIRECT,
) -> DataFrame:
    """The page that ``page(sort_rows(...))`` shows, at any depth."""
    return page_of(df, sort_key(df, column, kind, numbers), quoted(order_by), number, size, descending, direct)


def page_bounds(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page number within bounds, page count and the first and last row shown."""
    n = F.col("rows")
    pages = F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint")
    shown = F.least(F.greatest(F.lit(1), F.lit(number)), pages)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        pages.alias("pages"),
        shown.alias("page"),
        F.when(n > 0, (shown - 1) * size + 1).otherwise(0).alias("first"),
        F.least(n, shown * size).alias("last"),
    )


def top_k(df: DataFrame, value: str, label: str, k: int, last: str | None = None) -> DataFrame:
    """Largest values, equal ones by label; the label ``last`` goes to the end."""
    order = [F.col(value).desc(), F.col(label).asc()]
    if last is not None:
        order.insert(0, F.coalesce(F.col(label) == last, F.lit(False)).asc())
    return df.orderBy(*order).limit(k)
