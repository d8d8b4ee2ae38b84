"""Exact order statistics and running totals that never put a whole group into one task.

Values fall into logarithmic bins that keep their order. Counting per bin is an ordinary
aggregation, the bins of a group are few, and only the bin holding a wanted rank is looked into: it is cut
into equal steps between its own extremes, so values with a common offset, such as times of one
day, spread as well, and only the step around the rank is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 256
_OFFSET = 300_000
#: Equal steps that a wanted bin is cut into.
STEPS = 65_536


def order_bin(value: Column) -> Column:
    """Bin number of a double; a larger value never has a smaller bin."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * BINS_PER_OCTAVE)
    code = octave * BINS_PER_OCTAVE + inside + _OFFSET
    return F.when(size < 1e-290, F.lit(0)).otherwise(F.signum(value) * code).cast("int")


def order_statistics(
    freq: DataFrame, keys: list[str], value: str, count: str, ranks: Callable[[Column], Column]
) -> DataFrame:
    """Values at the wanted zero-based ranks of every group: ``(*keys, rank, total, value)``.

    ``freq`` has one row per group and distinct value; ``ranks`` maps the group size to an
    array of ranks.
    """
    binned = freq.where(F.col(value).isNotNull()).withColumn("_bin", order_bin(F.col(value)))
    by_bin = binned.groupBy(*keys, "_bin").agg(F.sum(count).alias("_in_bin"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    placed = by_bin.select(
        *keys,
        "_bin",
        "_in_bin",
        (F.sum("_in_bin").over(group.orderBy("_bin")) - F.col("_in_bin")).alias("_before"),
        F.sum("_in_bin").over(group).alias("total"),
    )
    wanted = placed.withColumn("rank", F.explode(F.array_distinct(ranks(F.col("total"))))).where(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_in_bin"))
    )
    rows = binned.join(wanted, [*keys, "_bin"]).select(*keys, "rank", "total", "_before", F.col(value).alias("value"), F.col(count).alias("_n"))
    rows = _cut(rows, [*keys, "rank"])
    inside = Window.partitionBy(*keys, "rank").orderBy("value")
    return (
        rows.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .where((F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_n")))
        .select(*keys, "rank", "total", "value")
    )


def step_of(value: Column, low: Column, high: Column, steps: int) -> Column:
    """Which of ``steps`` equal steps between two extremes a value is in; halved first, so that no difference overflows."""
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    return F.least(F.lit(steps - 1), F.floor(F.coalesce(share, F.lit(0.0)) * steps)).cast("int")


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every group only the step that holds its rank, with the number of values before it."""
    ends = rows.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    stepped = rows.join(ends, keys).withColumn("_step", step_of(F.col("value"), F.col("_low"), F.col("_high"), STEPS)).drop("_low", "_high")
    by_step = stepped.groupBy(*keys, "_step").agg(F.sum("_n").alias("_in_step"), F.first("_before").alias("_base"))
    group = Window.partitionBy(*keys).orderBy("_step")
    placed = by_step.withColumn("_from", F.col("_base") + F.sum("_in_step").over(group) - F.col("_in_step"))
    holding = placed.where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("_in_step")))
    return stepped.join(holding.select(*keys, "_step", "_from"), [*keys, "_step"]).withColumn("_before", F.col("_from")).drop("_step", "_from")


def medians(freq: DataFrame, keys: list[str], value: str, count: str, out: str = "median") -> DataFrame:
    """Exact median per group from a value-frequency table."""

    def middle(total: Column) -> Column:
        return F.array(F.floor((total - 1) / 2).cast("bigint"), F.floor(total / 2).cast("bigint"))

    found = order_statistics(freq, keys, value, count, middle)
    return found.groupBy(*keys).agg(F.avg("value").alias(out))


def lower_quantiles(freq: DataFrame, keys: list[str], value: str, count: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles taken as the element at ``floor((n - 1) * share)`` of the sorted values."""

    def at(total: Column, share: float) -> Column:
        return F.floor((total - 1) * share).cast("bigint")

    found = order_statistics(freq, keys, value, count, lambda n: F.array(*[at(n, s) for s in shares.values()]))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank") == at(F.col("total"), s), F.col("value"))).alias(n) for n, s in shares.items()]
    )


def running_total_desc(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Running sum from the largest value down; equal values follow the hash of ``tie``.

    Levels are summed apart and shifted by what comes before: the bin, equal steps between the bin's extremes,
    the value with a slice of the hash, and the row. Neither many close values nor
    very many equal ones end up in one task.
    """
    cut = df.withColumns({"_bin": order_bin(F.col(value)), "_h": F.xxhash64(tie)}).withColumn("_slice", F.shiftright("_h", 54))
    ends = cut.groupBy("_bin").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    # nearly all rows may have one bin, so none is shuffled by it: the bins, a few hundred an octave, go to every task
    cut = cut.join(F.broadcast(ends), "_bin").withColumn("_step", step_of(F.col(value), F.col("_low"), F.col("_high"), STEPS)).drop("_low", "_high")
    levels = ["_bin", "_step", value, "_slice"]
    sums = cut.groupBy(*levels).agg(F.sum(value).alias("_sum"))
    # from the finest level up: each is summed within the one above, which is summed in turn
    shift, depth = sums.withColumn("_shift", F.lit(0.0)), [[value, "_slice"], ["_step"], ["_bin"]]
    above = levels
    for finest in depth:
        table = sums.groupBy(*above).agg(F.sum("_sum").alias("_all"))
        outer = [c for c in above if c not in finest]
        order = [F.col(c).asc() if c == "_slice" else F.col(c).desc() for c in finest]
        place = (Window.partitionBy(*outer) if outer else Window).orderBy(*order)  # the bins are one row each
        part = table.withColumn("_part", F.sum("_all").over(place) - F.col("_all")).drop("_all")
        shift = shift.join(F.broadcast(part) if above == ["_bin"] else part, above).withColumn("_shift", F.col("_shift") + F.col("_part")).drop("_part")
        above = outer
    inside = Window.partitionBy(*levels).orderBy("_h", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(shift.drop("_sum"), levels)
        .withColumn(out, F.sum(value).over(inside) + F.col("_shift"))
        .drop("_bin", "_step", "_h", "_slice", "_shift")
    )


def chunked_running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = 65_536) -> DataFrame:
    """Running sum along an integer position, summed per chunk and shifted by the chunks before."""
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = Window.partitionBy(*keys).orderBy("_chunk")
    shift = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_chunk", (F.sum("_sum").over(before) - F.col("_sum")).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.withColumn("_inside", F.sum(value).over(inside))
        .join(shift, [*keys, "_chunk"])
        .withColumn(out, F.col("_inside") + F.col("_shift"))
        .drop("_chunk", "_inside", "_shift")
    )
