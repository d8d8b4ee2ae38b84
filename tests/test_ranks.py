"""Order statistics and running totals where all values share one bin."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tablelens.functions import ranks as R


def test_medians_and_quantiles_of_close_values(spark):
    pick = random.Random(4)
    groups = {
        "times": [1.7e9 + pick.random() * 86_400 for _ in range(5000)], "same": [5.0] * 40, "two": [1.0, 2.0],
        "mixed": [pick.choice([-1e300, -1.0, 0.0, 1e-300, 3.0, 1e300]) for _ in range(101)], "crowd": [1e9 + 1e-6 * k for k in range(3000)] + [2e9],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    freq = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r.median for r in R.medians(freq, ["g"], "v", "n").collect()}
    assert all(abs(got[g] - statistics.median(vs)) <= 1e-9 * abs(got[g]) for g, vs in groups.items())
    low = {r.g: (r.a, r.b) for r in R.lower_quantiles(freq, ["g"], "v", "n", {"a": 0.1, "b": 0.9}).collect()}
    assert low == {g: tuple(sorted(vs)[int((len(vs) - 1) * s)] for s in (0.1, 0.9)) for g, vs in groups.items()}


def test_what_is_sorted_is_small(spark):
    """One day of seconds falls into one bin; after the cut a handful of values is left around the rank."""
    rows = spark.range(86_400).select(F.lit("g").alias("g"), F.lit(7).alias("rank"), F.lit(86_400).alias("total"), F.lit(0).alias("_before"), (F.col("id") + 1_700_000_000).cast("double").alias("value"), F.lit(1).alias("_n"))
    assert rows.select(R.order_bin(F.col("value"))).distinct().count() == 1
    assert R._cut(rows, ["g", "rank"]).count() <= 3


def test_running_total_of_close_and_equal_values(spark):
    pick = random.Random(6)
    rows = [(i, 1.7e9 + i % 700 + pick.choice([0, 0.5])) for i in range(3000)] + [(10_000 + i, v) for i, v in enumerate([3.0, 3.0, -2.0, 0.0, 8.0])]
    out = R.running_total_desc(spark.createDataFrame(rows, "id long, v double"), "v", "id", "total").collect()
    assert out[0].asDict().keys() == {"id", "v", "total"} and len(out) == len(rows)
    before, seen = 0.0, {}
    for v in sorted((v for _, v in rows), reverse=True):
        before += v
        seen.setdefault(v, []).append(before)
    got = {}
    for r in out:
        got.setdefault(r.v, []).append(r.total)
    assert all(abs(a - b) <= 1e-3 for v in seen for a, b in zip(sorted(got[v]), sorted(seen[v])))


def test_rows_of_one_bin_are_not_shuffled_by_it(spark):
    """Times of one month have one bin: a join by it alone would put all of them into one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1, 5_001).select("id", (F.lit(1.7e9) + F.col("id")).alias("v"))
        out = R.running_total_desc(rows, "v", "id", "s")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.s for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and not re.search(r"Join \[_bin#\d+\], \[_bin#\d+\], (?!Inner, Build)", plan)
    assert all(got[i] == pytest.approx(sum(1.7e9 + k for k in range(i, 5_001))) for i in (1, 2_500, 5_000))
