"""Probable duplicate records: the first compatible, most complete record becomes the primary.

Records are compatible when they share the block, lie within the distance limit and agree on every
attribute filled on both sides. That is not transitive, so the order of the records matters; the
rounds below give the same answer as deciding one record after the other.

* Records equal in every compared value share one fate and are folded into one row first, so a
  large group of copies costs one row.
* A block of at most ``SETTLED`` such rows is decided in record order at once, without keys or pairs.
* A larger block whose rows all have a position falls into areas: groups of map cells with empty cells
  between them, which are decided apart. An area is then treated as a block.
* In larger blocks, for two patterns of filled attributes the comparison is an equality test on the
  attributes filled in both, so candidates meet by key: one key per pattern pair, plus the map cell
  when both have a position. Without positions only the smallest member of a key matters and is
  found by aggregation; with positions a cell of the distance limit bounds the candidates.
* Every round makes primaries of the rows that no open row comes before, and of those that the first
  ``SETTLED`` open rows of a block decide on alone: what comes later cannot change them. A
  chain of neighbours therefore takes a round per ``SETTLED`` rows, not one per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.geometry import metres_apart
from tablelens.functions.values import field_key
from tablelens.operators.linkage import components
from tablelens.session import cut_lineage

ABSENT = "\x00"
#: Different rows of a block that are decided one after the other in one step.
SETTLED = 1_000


def _row_width(row: Column, height: float) -> Column:
    """Longitude width of a cell row that covers the distance limit anywhere in the row."""
    edge = F.least((F.abs(row) + 2) * height, F.lit(89.9999))
    return height / F.cos(F.radians(edge))


def _cell(row: Column, place: Column) -> Column:
    return F.concat_ws(":", row, place)


def _cells_around(row: Column, height: float) -> Column:
    """The cells that hold all positions within the distance limit."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return F.transform(steps, lambda s: _cell(row + s["dr"], F.floor(F.col("lon") / _row_width(row + s["dr"], height)) + s["dx"]))


def _with_areas(sigs: DataFrame, block: list[str], metres: float) -> DataFrame:
    """Rows of blocks with ``placed`` (all rows have a position) as ``area``: rows of different areas are farther apart than the limit."""
    height = metres / V.METRES_PER_DEGREE * 1.0001
    row = F.floor(F.col("lat") / height)
    home = _cell(row, F.floor(F.col("lon") / _row_width(row, height)))
    rows = sigs.withColumns({"_column": F.concat_ws("\x01", *block), "_home": F.when(F.col("placed"), home)})
    spots = rows.where("placed").select("_column", "_home", "lat", "lon").distinct()
    near = spots.select("_column", "_home", F.explode(_cells_around(row, height)).alias("_near")).where("_home <> _near").distinct()
    cells = spots.select("_column", F.col("_home").alias("_near")).distinct()
    links = near.join(cells, ["_column", "_near"]).select(F.col("_column").alias("column"), F.col("_home").alias("a"), F.col("_near").alias("b"))
    joined = components(links).select(F.col("column").alias("_column"), F.col("key").alias("_home"), "component")
    return rows.join(joined, ["_column", "_home"], "left").withColumn("area", F.coalesce("component", "_home", F.lit(""))).drop("_column", "_home", "component", "placed")


def _keys(sigs: DataFrame, patterns: list[str], block: list[str], attributes: list[str], metres: float) -> tuple[DataFrame, DataFrame]:
    """Home keys (one cell) and probe keys (the cells around) of every signature."""
    height = metres / V.METRES_PER_DEGREE * 1.0001
    n = len(attributes)
    mine, other = F.col("pattern"), F.col("other")
    shared = [
        F.when((F.substr(mine, F.lit(i + 1), F.lit(1)) == "1") & (F.substr(other, F.lit(i + 1), F.lit(1)) == "1"), F.col(a))
        for i, a in enumerate(attributes)
    ]
    values = F.concat_ws("\x01", *[F.col(b) for b in block], *[F.coalesce(s, F.lit(ABSENT)) for s in shared])
    located = (F.substr(mine, F.lit(n + 1), F.lit(1)) == "1") & (F.substr(other, F.lit(n + 1), F.lit(1)) == "1")
    wide = sigs.withColumn("other", F.explode(F.array(*[F.lit(p) for p in patterns]))).withColumns({"values": values, "located": located})
    row = F.floor(F.col("lat") / height)
    base = ["ord", "lat", "lon", "located"]
    home_cell = F.when(located, _cell(row, F.floor(F.col("lon") / _row_width(row, height)))).otherwise("")
    home = wide.select(*base, F.concat_ws("\x01", mine, other, "values", home_cell).alias("key"))
    around = F.when(located, _cells_around(row, height)).otherwise(F.array(F.lit("")))
    probe = wide.select(*base, mine.alias("mine"), "other", "values", F.explode(around).alias("cell")).select(
        *base, F.concat_ws("\x01", "other", "mine", "values", "cell").alias("key")
    )
    return home, probe


def _candidates(home: DataFrame) -> DataFrame:
    """Per key the primaries to compare with: the smallest one where no distance is tested."""
    smallest = home.where("not located").groupBy("key").agg(F.min("ord").alias("p_ord")).select(
        "key", "p_ord", F.lit(None).cast("double").alias("p_lat"), F.lit(None).cast("double").alias("p_lon")
    )
    placed = home.where("located").select("key", F.col("ord").alias("p_ord"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return smallest.unionByName(placed)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _decided(sigs: DataFrame, block: list[str], attributes: list[str], metres: float) -> DataFrame:
    """``(ord, primary)`` of blocks of few rows, each compared with the primaries before it."""
    fields = ["ord", *attributes, "lat", "lon"]
    # by number: few bytes are much work here, so tasks are not put together by size
    rows = _spread(sigs, *block).groupBy(*block).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def agree(p: Column, x: Column) -> Column:
        same = [p[a].isNull() | x[a].isNull() | (p[a] == x[a]) for a in attributes]
        near = p["lat"].isNull() | x["lat"].isNull() | (metres_apart(p["lat"], p["lon"], x["lat"], x["lon"]) <= metres)
        return reduce(lambda a, b: a & b, same, F.lit(True)) & F.coalesce(near, F.lit(False))

    def step(done: Column, x: Column) -> Column:
        found = F.get(F.filter(done["primaries"], lambda p: agree(p, x)), F.lit(0))["ord"]
        decide = lambda primary: F.struct(
            F.when(primary.isNull(), F.concat(done["primaries"], F.array(x))).otherwise(done["primaries"]).alias("primaries"),
            F.concat(done["fates"], F.array(F.struct(x["ord"].alias("ord"), F.coalesce(primary, x["ord"]).alias("primary")))).alias("fates"),
        )
        return F.get(F.transform(F.array(found), decide), F.lit(0))  # the search runs once per row

    none = F.filter("rows", lambda x: F.lit(False))
    start = F.struct(none.alias("primaries"), F.transform(none, lambda x: F.struct(x["ord"].alias("ord"), x["ord"].alias("primary"))).alias("fates"))
    return rows.select(F.inline(F.aggregate("rows", start, step, lambda done: done["fates"])))


def _by_rounds(sigs: DataFrame, patterns: list[str], block: list[str], attributes: list[str], metres: float, settled: int) -> DataFrame:
    """``(ord, primary)`` of blocks of any size; what is decided leaves the keys after each round."""
    home, probe = (cut_lineage(x) for x in _keys(sigs, patterns, block, attributes, metres))
    close = (F.col("p_lat").isNull()) | (metres_apart(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) <= metres)
    before = Window.partitionBy(*block).orderBy("ord")
    open_sigs, open_home, open_probe = sigs, home, probe
    primaries: list[DataFrame] = []
    while not open_sigs.isEmpty():
        smallest = open_home.groupBy("key").agg(F.min("ord").alias("first"))
        waiting = open_probe.join(smallest, "key").where("first < ord").select("ord").distinct()
        leading = open_sigs.withColumn("place", F.row_number().over(before)).where(F.col("place") <= settled)
        decided = _decided(leading, block, attributes, metres).where("primary = ord")
        fresh = cut_lineage(open_sigs.select("ord").join(waiting, "ord", "left_anti").unionByName(decided.select("ord")).distinct())
        primaries.append(fresh)
        near = _candidates(open_home.join(fresh, "ord", "left_semi"))
        hit = open_probe.join(near, "key").where((F.col("p_ord") < F.col("ord")) & close).select("ord")
        done = cut_lineage(hit.unionByName(fresh).distinct())
        open_sigs, open_home, open_probe = (cut_lineage(x.join(done, "ord", "left_anti")) for x in (open_sigs, open_home, open_probe))
    chosen = reduce(DataFrame.unionByName, primaries)
    assigned = (
        probe.join(chosen, "ord", "left_anti")
        .join(_candidates(home.join(chosen, "ord", "left_semi")), "key")
        .where((F.col("p_ord") < F.col("ord")) & close)
        .groupBy("ord")
        .agg(F.min("p_ord").alias("primary"))
    )
    return sigs.select("ord").join(assigned, "ord", "left").select("ord", F.coalesce("primary", "ord").alias("primary"))


def find_duplicates(
    records: DataFrame,
    index: str,
    completeness: Column,
    block: list[str],
    attributes: list[str],
    lat: str = "lat",
    lon: str = "lng",
    metres: float = V.DUPLICATE_METRES,
    settled: int = SETTLED,
) -> DataFrame:
    """``(index, duplicate_of)`` for every record that repeats an earlier one.

    Earlier means more complete, then smaller ``index``. Attributes compare by their folded key;
    empty ones agree with everything.
    """
    names = [f"a{i}" for i in range(len(attributes))]
    blocks = [f"b{i}" for i in range(len(block))]
    prepared = records.select(
        F.struct((-completeness).cast("int").alias("c"), F.col(index).alias("i")).alias("ord"),
        *[F.coalesce(F.col(b).cast("string"), F.lit(ABSENT)).alias(n) for b, n in zip(block, blocks)],
        *[F.nullif(field_key(F.col(a).cast("string")), F.lit("")).alias(n) for a, n in zip(attributes, names)],
        F.when(F.col(lon).isNotNull(), F.col(lat).cast("double")).alias("lat"),
        F.when(F.col(lat).isNotNull(), F.col(lon).cast("double")).alias("lon"),
    )
    same = [*blocks, *names, "lat", "lon"]
    members = cut_lineage(prepared)
    sigs = members.groupBy(*same).agg(F.min("ord").alias("ord"))
    pattern = F.concat(*[F.when(F.col(n).isNotNull(), "1").otherwise("0") for n in [*names, "lat"]])
    sigs = cut_lineage(sigs.withColumn("pattern", pattern))
    count = F.count(F.lit(1)).alias("n")
    crowded = cut_lineage(sigs.groupBy(*blocks).agg(count, (F.count("lat") == F.count(F.lit(1))).alias("placed")).where(F.col("n") > settled).drop("n"))
    groups = [*blocks, "area"]
    parted = cut_lineage(_with_areas(_spread(sigs.join(crowded, blocks)), blocks, metres))
    busy = cut_lineage(parted.groupBy(*groups).agg(count).where(F.col("n") > settled).drop("n"))
    few = sigs.join(crowded, blocks, "left_anti").withColumn("area", F.lit("")).unionByName(parted.join(busy, groups, "left_anti"))
    fates = _decided(few, groups, names, metres)
    large = parted.join(busy, groups, "left_semi")
    patterns = [r.pattern for r in large.select("pattern").distinct().collect()]  # at most 2 ** (attributes + 1)
    if patterns:
        fates = fates.unionByName(_by_rounds(cut_lineage(_spread(large)), patterns, groups, names, metres, settled))
    fate = sigs.join(fates, "ord").select(*same, "primary")
    on = reduce(lambda x, y: x & y, [members[c].eqNullSafe(fate[c]) for c in same])
    return (
        members.join(fate, on)
        .where(members["ord"] != F.col("primary"))
        .select(members["ord"]["i"].alias(index), F.col("primary.i").alias("duplicate_of"))
    )


def duplicate_groups(duplicates: DataFrame, records: DataFrame, index: str, folder: str) -> DataFrame:
    """``(primary, copies, cross_folder)`` per group; a group spans folders when they differ.

    Members are listed by joining back on ``duplicate_of``; they are not gathered here.
    """
    paths = records.select(F.col(index), F.coalesce(F.col(folder).cast("string"), F.lit("")).alias("_folder"))
    members = duplicates.select("duplicate_of", F.col(index)).unionByName(
        duplicates.select("duplicate_of", F.col("duplicate_of").alias(index)).distinct()
    )
    return (
        members.join(paths, index)
        .groupBy(F.col("duplicate_of").alias("primary"))
        .agg(F.count(F.lit(1)).alias("copies"), (F.min("_folder") != F.max("_folder")).alias("cross_folder"))
    )


def completeness(columns: list[str]) -> Column:
    return sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))
