"""Thematic classes, density grids, flows and coverage of mapped tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.geometry import centroid, make_parts, point, validate
from tablelens.functions.ranks import order_statistics
from tablelens.functions.values import number_of, quoted, text_of


# ------------------------------------------------------------------ attaching geometry


def attach_geometry(df: DataFrame, geometry: str, row_id: str) -> DataFrame:
    """Reference point, geometry type, shape id and problem codes of every row."""
    g, c = quoted(geometry), centroid(geometry)
    return df.withColumns(
        {
            "shape_id": F.when(g.isNotNull(), F.concat(F.lit("g"), quoted(row_id).cast("string"))),
            "latitude": c[1],
            "longitude": c[0],
            "geometry_type": g["type"],
            "problems": F.when(g.isNotNull(), validate(geometry)),
        }
    )


def geometry_notes(attached: DataFrame) -> DataFrame:
    """``(code, n)``: rows per geometry problem and rows without geometry."""
    none = F.when(F.col("geometry_type").isNull(), F.lit("without_geometry"))
    codes = F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.array_compact(F.array(none)))
    return attached.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ quantile classes


def class_breaks(df: DataFrame, value: str, classes: int = 5, numbers: str = "br") -> DataFrame:
    """One row with ``breaks``: quantile limits, averaging the two neighbours at exact ranks.

    Limits equal to the extremes or to the limit before are left out.
    """
    freq = df.select(number_of(df, value, numbers).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    steps = range(1, classes)

    def ranks(total: Column) -> Column:
        at = []
        for i in steps:
            at.append(F.greatest(F.lit(0), F.floor(total * i / classes)).cast("bigint"))
            at.append(F.greatest(F.lit(0), F.ceil(total * i / classes) - 1).cast("bigint"))
        return F.array(*at, F.lit(0).cast("bigint"), (total - 1).cast("bigint"))

    found = order_statistics(freq, [], "v", "n", ranks)
    table = found.agg(
        F.max("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"),  # 2 * classes entries
    ).where("total >= 2")
    t = F.col("total")
    exact = lambda i: (t * i) % classes == 0
    upper = lambda i: F.element_at("at", F.floor(t * i / classes).cast("bigint"))
    below = lambda i: F.element_at("at", (F.floor(t * i / classes) - 1).cast("bigint"))
    limits = F.array(
        *[F.when(exact(i), (below(i) + upper(i)) / 2).otherwise(upper(i)) for i in steps]
    )
    low, high = F.element_at("at", F.lit(0).cast("bigint")), F.element_at("at", (t - 1).cast("bigint"))
    breaks = F.array_distinct(F.filter(limits, lambda b: (b > low) & (b < high)))
    return df.sparkSession.range(1).select(
        F.coalesce(table.select(breaks.alias("b")).scalar(), F.from_json(F.lit("[]"), "array<double>")).alias("breaks")
    )


def class_of(value: Column, breaks: Column) -> Column:
    """Zero-based class; a value equal to a limit belongs to the class below it."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: b < value)))


def classified(df: DataFrame, value: str, classes: int = 5, out: str = "class", numbers: str = "br") -> DataFrame:
    breaks = class_breaks(df, value, classes, numbers).scalar()
    return df.withColumn("_breaks", breaks).withColumn(out, class_of(number_of(df, value, numbers), F.col("_breaks"))).drop("_breaks")


def legend(df: DataFrame, value: str, classes: int = 5, numbers: str = "br") -> DataFrame:
    """Value range and row count of every class; the last row counts rows without data."""
    breaks = class_breaks(df, value, classes, numbers)
    v = number_of(df, value, numbers)
    tagged = df.select(v.alias("v")).withColumn("breaks", breaks.scalar()).withColumn("class", class_of(F.col("v"), F.col("breaks")))
    counts = tagged.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).withColumn("breaks", breaks.scalar()).where("lo is not null")
    edges = F.concat(F.array("lo"), F.col("breaks"), F.array("hi"))
    frame = span.withColumn("edges", edges).select(
        F.explode(F.sequence(F.lit(0), F.size("breaks"))).alias("class"), "edges"
    )
    ranges = frame.join(counts.where("class is not null"), "class", "left").select(
        "class",
        F.element_at("edges", F.col("class") + 1).alias("from_value"),
        F.element_at("edges", F.col("class") + 2).alias("to_value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    none = F.lit(None)
    missing = counts.where("class is null").select(
        none.cast("int").alias("class"), none.cast("double").alias("from_value"), none.cast("double").alias("to_value"), F.col("n").cast("bigint")
    )
    return ranges.unionByName(missing)


# ------------------------------------------------------------------ density grid


def grid_counts(df: DataFrame, lon: str, lat: str, cell: float) -> DataFrame:
    """Points per square cell; ``lon`` and ``lat`` are the lower left corner."""
    x, y = number_of(df, lon), number_of(df, lat)
    places = df.select(F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy")).dropna()
    return (
        places.groupBy("cx", "cy")
        .agg(F.count(F.lit(1)).alias("n"))
        .select((F.col("cx") * cell).alias("lon"), (F.col("cy") * cell).alias("lat"), "n")
    )


def nice_cell(span: float, cells: int = 20) -> float:
    """A cell size of 1, 2 or 5 times a power of ten giving about ``cells`` cells over the span."""
    raw = max(span, 1e-6) / cells
    base = 10 ** math.floor(math.log10(raw))
    return next((m for m in (1, 2, 5) if raw <= m * base), 10) * base


def auto_grid(df: DataFrame, lon: str, lat: str) -> DataFrame:
    x, y = number_of(df, lon), number_of(df, lat)
    e = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()  # four numbers
    span = max((e[1] or 0) - (e[0] or 0), (e[3] or 0) - (e[2] or 0))
    return grid_counts(df, lon, lat, nice_cell(span))


def coverage(df: DataFrame, geometry: str, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """One row: drawn rows, rows without geometry and rows with an invalid one."""
    g = quoted(geometry)
    if lon and lat:
        x, y = number_of(df, lon), number_of(df, lat)
        g = F.coalesce(g, F.when(x.isNotNull() & y.isNotNull(), point(x, y)))
    spoiled = F.size(F.array_remove(validate(g), "point_at_zero")) > 0
    tagged = df.select(g.isNull().alias("none"), F.coalesce(spoiled, F.lit(False)).alias("bad"))
    return tagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("none") & ~F.col("bad")).alias("drawn"),
        F.count_if("none").alias("without_geometry"),
        F.count_if(~F.col("none") & F.col("bad")).alias("invalid"),
    )


# ------------------------------------------------------------------ flows


def coordinate_pairs(columns: list[str]) -> list[tuple[str, str, str]]:
    """``(name, lat column, lon column)`` of columns that share a prefix or suffix."""
    lat, lon, sep = "|".join(V.LATITUDE_WORDS), "|".join(V.LONGITUDE_WORDS), r"[\s_.-]"

    def split(words: str, column: str) -> tuple[str, str] | None:
        lead = re.fullmatch(rf"({words}){sep}(.+)", column, re.I)
        if lead:
            return "lead", lead.group(2)
        trail = re.fullmatch(rf"(.+){sep}({words})", column, re.I)
        return ("trail", trail.group(1)) if trail else None

    longitudes = [(c, split(lon, c)) for c in columns]
    found = []
    for c in columns:
        mine = split(lat, c)
        if not mine:
            continue
        match = next((n for n, s in longitudes if s and s[0] == mine[0] and s[1].lower() == mine[1].lower()), None)
        if match:
            found.append((mine[1], c, match))
    return found


def with_flows(df: DataFrame, pairs: list[tuple[str, str, str]] | None = None, numbers: str = "br", out: str = "flow") -> DataFrame:
    """A straight line from origin to destination per row; the same place becomes a point."""
    found = pairs or coordinate_pairs(df.columns)
    if len(found) < 2:
        raise ValueError("two coordinate pairs are needed")
    (_, lat_a, lon_a), (_, lat_b, lon_b) = found[:2]
    ok = lambda c, limit: F.when(F.abs(number_of(df, c, numbers)) <= limit, number_of(df, c, numbers))
    a, b, c, d = ok(lon_a, 180), ok(lat_a, 90), ok(lon_b, 180), ok(lat_b, 90)
    line = make_parts(F.lit("LineString"), lines=F.array(F.array(F.array(a, b), F.array(c, d))))
    whole = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return df.withColumn(out, F.when(whole & (a == c) & (b == d), point(a, b)).when(whole, line))


def origin_destination(df: DataFrame, origin: str, destination: str, weight: str | None = None, numbers: str = "br") -> DataFrame:
    v = number_of(df, weight, numbers) if weight else F.lit(1.0)
    rows = df.select(text_of(df, origin).alias("origin"), text_of(df, destination).alias("destination"), v.alias("v"))
    return rows.dropna(subset=["origin", "destination"]).groupBy("origin", "destination").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("weight")
    )


# ------------------------------------------------------------------ territory report


def territory(
    df: DataFrame, label: str, measure: str, geometry: str | None = None, lat: str | None = None, classes: int = 5, limit: int | None = None, numbers: str = "br"
) -> DataFrame:
    """Units from the largest measure down with their class; units without data come last."""
    v = number_of(df, measure, numbers)
    kind = quoted(geometry)["type"] if geometry else F.lit(None).cast("string")
    fallback = F.when(number_of(df, lat, numbers).isNotNull(), "Point") if lat else F.lit(None).cast("string")
    problems = F.coalesce(F.size(validate(geometry)), F.lit(0)) if geometry else F.lit(0)
    units = df.select(
        F.coalesce(text_of(df, label), F.lit("—")).alias("unit"),
        F.coalesce(kind, fallback, F.lit("none")).alias("geometry_type"),
        v.alias("value"),
        problems.alias("problems"),
    )
    out = classified(units, "value", classes, numbers="us").orderBy(F.col("value").desc_nulls_last(), "unit")
    return out.limit(limit) if limit else out
