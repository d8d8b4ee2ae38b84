import random

from pyspark.sql import functions as F

from tablelens.operators import tables as T


def test_deep_pages_equal_sorting_everything(spark):
    pick = random.Random(3)
    rows = [(i, pick.choice([None, 1.5, 2.5, float("nan"), pick.random() * 100])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i int, v double")
    for descending in (False, True):
        key = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
        want = [r.i for r in df.orderBy(key, "i").collect()]
        for number in (1, 40, 97, 120, 121):
            got = T.page_of(df, F.col("v"), F.col("i"), number, 25, descending, direct=60)
            assert got.columns == ["i", "v"] and [r.i for r in got.collect()] == want[(number - 1) * 25 : number * 25]


def test_deep_pages_of_equal_keys_and_of_equal_rows(spark):
    same = spark.range(2_000).select(F.lit("x").alias("k"), F.col("id"))
    assert [r.id for r in T.sorted_page(same, "k", "id", 41, 25, direct=50).collect()] == list(range(1_000, 1_025))
    repeated = spark.range(500).select(F.lit("x").alias("k"), F.lit(1).alias("id"))
    assert T.sorted_page(repeated, "k", "id", 11, 25, direct=50).count() == 25
    assert T.sorted_page(repeated, "k", "id", 99, 25, direct=50).count() == 0
    assert T.sorted_page(repeated.limit(0), "k", "id", 99, 25, direct=50).count() == 0


def test_a_deep_page_sorts_few_rows(spark):
    """What is sorted is cut by filters on the key, so the sort takes at most the offset that is left."""
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("v"), "id")
    plan = T.page_of(df, F.col("v"), F.col("id"), 600, 25, direct=2_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Offset 14975" not in plan
    offset = int(plan.split("Offset ")[1].split()[0]) if "Offset " in plan else 0
    assert offset <= 2_000
