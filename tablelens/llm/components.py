"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.session import cut_lineage

#: Links for a task of the rounds. Tasks follow the links, not ``spark.sql.shuffle.partitions``: each of them leaves files for every shuffle.
LINKS = 32_768


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def components(links: DataFrame, a: str = "a", b: str = "b", *, per_task: int = LINKS) -> DataFrame:
    """``node, component``: for every node of a link the smallest node that it reaches.

    Large and small stars in turn: first every larger neighbour of a node is linked to the smallest one, then
    every smaller one. Each round is two aggregations with map-side combining and two joins, links never grow
    in number, and chains shorten by about half. A node with a third of all links only meets in joins, which
    adaptive execution splits. Every round is written by ``checkpoint()``; nothing comes to the driver
    but a count and a checksum. Links of a node to itself and repeated links are allowed; nulls are ignored.
    A round has a task for about every ``per_task`` links, so the rounds of a small graph take few files.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    links = cut_lineage(links)
    seen = _state(links)
    while seen[0]:
        tasks = -(-seen[0] // per_task)
        both = links.coalesce(tasks).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        # large star: a < b, b goes to the smallest around a
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        # small star: all smaller neighbours of a, and a itself, go to the smallest of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).coalesce(tasks)
        joined = large.join(least, F.col("a") == F.col("node"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        links = cut_lineage(small.coalesce(tasks).distinct().coalesce(tasks))
        now = _state(links)
        if now == seen:
            break
        seen = now
    tasks = max(1, -(-seen[0] // per_task))
    links = links.coalesce(tasks)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
