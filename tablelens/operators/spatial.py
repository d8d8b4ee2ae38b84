"""Points in polygons by a cell join.

Every polygon is laid on the grid whose cells are at least as large as its bounding box, so it
touches at most four cells there. A point looks up one cell per grid size in use. Both sides meet
in an equi-join on (grid, cell, salt); the exact test follows. Where places are only counted, cells are
cut in four until few spots lie in each: those inside a polygon count as a whole, only those on its edges are tested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.geometry import bbox, edges_contain, polygon_edges
from tablelens.operators.tables import number_rows
from tablelens.session import cut_lineage


#: Spots of one cell that a task takes, and how many busy cells there can be at most.
SPOTS, BUSY = 100_000, 10_000
#: Pairs of a spot and a polygon in one cell that a task tests.
PAIRS = 2_000_000
#: Spots of a cell that are not worth cutting it up, and how often a cell is cut at most.
FEW, DEEPEST = 64, 8
#: Degrees around a cell in which an edge counts as meeting it, far above what rounding does to the exact test.
MARGIN = 1e-9
#: Polygons that the first round of ``first_polygon`` tries, and how much further each round goes.
FIRST_ROUND, ROUND_GROWTH = 256, 16


def valid_position(lon: Column, lat: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def _polygon_cells(polygons: DataFrame, polygon_id: str, geometry: str) -> DataFrame:
    # each step is exploded from one value, so that a geometry is parsed once and not wherever a part of it is used
    parsed = polygons.select(F.col(polygon_id).alias("polygon"), F.explode(F.array(F.col(geometry))).alias("shape"))
    shaped = parsed.select("polygon", F.inline(F.array(F.struct(polygon_edges("shape").alias("edges"), bbox("shape").alias("box")))))
    boxed = shaped.where(F.size("edges") > 0)
    extent = F.greatest(F.col("box.max_lon") - F.col("box.min_lon"), F.col("box.max_lat") - F.col("box.min_lat"), F.lit(1e-6))
    level = F.ceil(F.log2(extent)).cast("int")
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level")))
    return (
        boxed.withColumn("level", level)
        .withColumn("cx", F.explode(F.sequence(cell(F.col("box.min_lon")), cell(F.col("box.max_lon")))))
        .withColumn("cy", F.explode(F.sequence(cell(F.col("box.min_lat")), cell(F.col("box.max_lat")))))
    )


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Few bytes are much work here, so rows are dealt by number and not put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _on_grid(places: DataFrame, levels: list[int]) -> DataFrame:
    """Every place with its cell on each of the grids."""
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    return places.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumns({"cx": cell("lon"), "cy": cell("lat")})


def _unsent(df: DataFrame) -> DataFrame:
    """For joins of cells: Spark guesses their size by the polygons' files and would send any number of them through the driver."""
    return df.hint("merge")


def _levels(cells: DataFrame) -> list[int]:
    return sorted(r.level for r in cells.select("level").distinct().collect())  # at most some 30 sizes


def _matches(cells: DataFrame, places: DataFrame, spots_per_task: int = SPOTS) -> DataFrame:
    """``places(lon, lat, ...)`` joined to the polygons of ``cells`` that contain them; a cell with more than ``spots_per_task`` of them is split."""
    levels = _levels(cells)
    if not levels:
        return places.limit(0).withColumns({"polygon": F.lit(None).cast(cells.schema["polygon"].dataType)})
    spots = _on_grid(places, levels)
    # a busy cell is split by its measured spots and pairs; as each holds a share of all, only so many cells can be busy
    count = F.count(F.lit(1))
    crowds = spots.groupBy("level", "cx", "cy").agg(count.alias("spots"))
    areas = cells.groupBy("level", "cx", "cy").agg(count.alias("areas"))
    crowds = cut_lineage(crowds.join(_unsent(areas), ["level", "cx", "cy"], "left").withColumn("pairs", F.col("spots") * F.coalesce("areas", F.lit(0))))
    sums = crowds.agg(F.coalesce(F.sum("spots"), F.lit(0)).alias("spots"), F.coalesce(F.sum(F.col("pairs").cast("double")), F.lit(0.0)).alias("pairs")).first()
    share, work = max(spots_per_task, sums.spots // BUSY), max(PAIRS, sums.pairs / BUSY)
    busy = crowds.where((F.col("spots") > share) | (F.col("pairs") > work)).select(
        "level", "cx", "cy",
        F.greatest(F.ceil(F.col("spots") / share), F.ceil(F.col("pairs") / work)).cast("int").alias("salts"),
        # the side with more rows is dealt out, the other one is repeated
        (F.coalesce("areas", F.lit(0)) > F.col("spots")).alias("by_area"),
    )
    if sums.spots > share or sums.pairs > work:
        parted = lambda df: df.join(F.broadcast(busy), ["level", "cx", "cy"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        some = lambda *c: F.array(F.pmod(F.xxhash64(*c), F.col("salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("salts") - 1)
        by_area = F.coalesce("by_area", F.lit(False))
        spots = parted(spots).withColumn("salt", F.explode(F.when(by_area, every).otherwise(some("lon", "lat")))).drop("salts", "by_area")
        salted = parted(cells).withColumn("salt", F.explode(F.when(by_area, some("polygon")).otherwise(every))).drop("salts", "by_area")
    else:
        spots, salted = spots.withColumn("salt", F.lit(0)), cells.withColumn("salt", F.lit(0))
    near = (
        (F.col("lon") >= F.col("box.min_lon"))
        & (F.col("lon") <= F.col("box.max_lon"))
        & (F.col("lat") >= F.col("box.min_lat"))
        & (F.col("lat") <= F.col("box.max_lat"))
    )
    on = ["level", "cx", "cy", "salt"]
    return (
        _dealt(spots, *on).join(_unsent(_dealt(salted, *on)), on)
        .where(near & edges_contain("edges", F.col("lon"), F.col("lat")))
        .drop(*on, "edges", "box")
    )


def _touched(edges: Column, x0: Column, y0: Column, size: Column) -> Column:
    """Some edge comes as close as ``MARGIN`` to the cell; where none does, all places of the cell are inside or none is."""
    x1, y1 = x0 + size, y0 + size

    def touches(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        over = (
            (F.greatest(e["x0"], e["x1"]) >= x0 - MARGIN) & (F.least(e["x0"], e["x1"]) <= x1 + MARGIN)
            & (F.greatest(e["y0"], e["y1"]) >= y0 - MARGIN) & (F.least(e["y0"], e["y1"]) <= y1 + MARGIN)
        )
        side = lambda x, y: dx * (y - e["y0"]) - dy * (x - e["x0"])
        sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        slack = MARGIN * (F.abs(dx) + F.abs(dy))
        return F.coalesce(over & ~((F.least(*sides) > slack) | (F.greatest(*sides) < -slack)), F.lit(True))

    return F.exists(edges, lambda rings: F.exists(rings, lambda ring: F.exists(ring, touches)))


def _divided(cells: DataFrame, levels: list[int], leaf: int) -> DataFrame:
    """Cells cut in four down to ``leaf``: ``whole`` ones lie inside their polygon, the others are met by an edge."""
    rows = cells.withColumn("whole", F.lit(False))
    for _ in range(min(DEEPEST, max(levels) - leaf)):
        quarter = lambda q: F.struct(
            (F.col("level") - 1).alias("level"), (F.col("cx") * 2 + q % 2).cast("bigint").alias("cx"), (F.col("cy") * 2 + F.floor(q / 2)).cast("bigint").alias("cy"), F.lit(True).alias("new"))
        kept = F.struct("level", F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), F.lit(False).alias("new"))
        parts = F.when(~F.col("whole") & (F.col("level") > leaf), F.transform(F.sequence(F.lit(0), F.lit(3)), quarter)).otherwise(F.array(kept))
        rows = rows.select("polygon", "edges", "box", "whole", F.inline(parts))
        size = F.pow(F.lit(2.0), F.col("level"))
        x0, y0 = F.col("cx") * size, F.col("cy") * size
        # one value, so that edges are gone through once
        met = F.when(F.col("new"), _touched(F.col("edges"), x0, y0, size)).otherwise(~F.col("whole"))
        rows = rows.select("polygon", "edges", "box", "level", "cx", "cy", "new", F.explode(F.array(met)).alias("met"))
        size = F.pow(F.lit(2.0), F.col("level"))
        inside = edges_contain("edges", (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size)
        rows = rows.where(F.col("met") | ~F.col("new") | inside).select("polygon", "edges", "box", "level", "cx", "cy", (~F.col("met")).alias("whole"))
    return rows


def _laid(polygons: DataFrame, polygon_id: str, geometry: str, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(whole cells, cells met by an edge, crowds)``: polygons on cells so small that few places lie in each, and the places and rows in every cell.

    So a polygon costs cells and places along its edges, not all the places that it holds.
    """
    top = cut_lineage(_polygon_cells(_dealt(polygons), polygon_id, geometry))
    levels = _levels(top)
    per_cell = lambda grids: _on_grid(places, grids).groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("spots"), F.sum("n").alias("n"))
    if not levels:
        return top, top, per_cell([0])
    seen = (F.sum(F.col("spots").cast("double") * F.col("spots")) / F.sum("spots")).alias("spots")  # by a place in its cell
    leaf = max(levels)
    while leaf > min(levels) - DEEPEST and (per_cell([leaf]).agg(seen).first().spots or 0) > FEW:
        leaf -= 1
    cells = cut_lineage(_divided(top, levels, leaf))
    return cells.where("whole").drop("whole", "edges", "box"), cells.where("not whole").drop("whole"), per_cell(list(range(leaf, max(levels) + 1)))


def points_in_polygons(polygons: DataFrame, polygon_id: str, geometry: str, points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Point rows with the id of every polygon that contains them."""
    named = points.withColumns({"lon": F.col(lon).cast("double"), "lat": F.col(lat).cast("double")})
    cells = cut_lineage(_polygon_cells(_dealt(polygons), polygon_id, geometry))
    return _matches(cells, named.where(valid_position(F.col("lon"), F.col("lat"))))


def count_points(
    polygons: DataFrame, polygon_id: str, geometry: str, points: DataFrame, lon: str = "lon", lat: str = "lat", out: str = "points"
) -> DataFrame:
    """The polygon rows with their point count; 0 without points, null without a polygon.

    Overlapping polygons all count a point; a point in a hole does not count. Points on the same
    spot are combined before anything is joined, and cells that lie inside a polygon are counted as a whole.
    """
    places = cut_lineage(_places(points, lon, lat).where(valid_position(F.col("lon"), F.col("lat"))))
    whole, met, crowds = _laid(polygons, polygon_id, geometry, places)
    tested = _matches(met, places).select("polygon", "n")
    held = whole.join(_unsent(crowds), ["level", "cx", "cy"]).select("polygon", "n")
    hits = held.unionByName(tested).groupBy("polygon").agg(F.sum("n").alias("_hits"))
    has_polygon = F.coalesce(F.size(F.col(geometry)["polys"]) > 0, F.lit(False))
    return (
        polygons.join(_unsent(hits), F.col(polygon_id) == F.col("polygon"), "left")
        .withColumn(out, F.when(has_polygon, F.coalesce("_hits", F.lit(0))).cast("bigint"))
        .drop("polygon", "_hits")
    )


def _places(points: DataFrame, lon: str, lat: str) -> DataFrame:
    return (
        points.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
        .groupBy("lon", "lat")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def point_coverage(polygons: DataFrame, polygon_id: str, geometry: str, points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: points inside some polygon, outside all of them, and without a valid position."""
    places = cut_lineage(_places(points, lon, lat))
    ok = valid_position(F.col("lon"), F.col("lat"))
    totals = places.agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("invalid"),
    )
    valid = places.where(ok)
    whole, met, _ = _laid(polygons, polygon_id, geometry, valid)
    held = cut_lineage(whole.select("level", "cx", "cy").distinct())
    # a place in a cell that some polygon holds as a whole is inside; only the others are tested
    grids = _levels(held)
    covered = _on_grid(valid, grids or [0]).join(held, ["level", "cx", "cy"], "left_semi").select("lon", "lat").distinct()
    left = cut_lineage(valid.join(covered, ["lon", "lat"], "left_anti")) if grids else valid
    hit = _matches(met, left).select("lon", "lat").distinct()
    inside = valid.join((covered.unionByName(hit) if grids else hit).distinct(), ["lon", "lat"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inside"))
    return totals.withColumn("inside", inside.scalar()).select(
        F.col("inside").cast("bigint").alias("inside"),
        (F.col("valid") - F.col("inside")).cast("bigint").alias("outside"),
        F.col("invalid").cast("bigint").alias("invalid"),
    )


def first_polygon(
    polygons: DataFrame, polygon_id: str, geometry: str, order: str, points: DataFrame, point_id: str, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """``(point_id, polygon)``: the containing polygon that comes first along ``order``.

    Polygons are tried in rounds of growing size along the order, and a point that one round finds is not in the next: what comes later
    cannot change it. So a point meets few polygons however many overlap there.
    """
    named = polygons.select(F.col(order).alias("_order"), F.col(polygon_id).alias("_pid"), F.col(geometry).alias("_geom"))
    # few bytes are much work here, so polygons are dealt by number
    dealt = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut_lineage(number_rows(named, ["_order", "_pid"], "_rank").repartition(dealt))
    left = points.select(F.col(point_id).alias("_point"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    rounds, low, high, total = [], 0, FIRST_ROUND, ranked.count()
    while not rounds or low < total:
        hits = points_in_polygons(ranked.where((F.col("_rank") >= low) & (F.col("_rank") < high)), "_rank", "_geom", left)
        rounds.append(cut_lineage(hits.groupBy("_point").agg(F.min("polygon").alias("_first"))))
        low, high = high, high * ROUND_GROWTH
        if low < total:
            if rounds[-1].isEmpty():
                continue
            done = rounds[-1].select(F.col("_point").alias("_done"))
            left = cut_lineage(left.join(done, F.col("_point").eqNullSafe(F.col("_done")), "left_anti"))
            if left.isEmpty():
                break
    found = reduce(DataFrame.unionByName, rounds)
    return found.join(ranked.select("_rank", "_pid"), F.col("_first") == F.col("_rank")).select(F.col("_point").alias(point_id), F.col("_pid").alias("polygon"))
