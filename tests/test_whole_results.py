"""Nothing is capped by a default, and results do not depend on how many entries there are."""

from pyspark.sql import functions as F

from tablelens.operators import aggregate as A
from tablelens.operators.filters import equals
from tablelens.operators.quality import relations
from tablelens.operators.recipe import apply_merges


def test_constant_column_is_no_rate(spark):
    df = spark.range(60).selectExpr("100.0 as const", "cast(id + 1 as double) as a", "cast(id + 1 as double) as b", "cast(id % 7 as double) as c")
    assert relations(df, df.columns).count() == 0


def test_merge_is_the_same_for_few_and_many_entries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, t string")
    few = {"1": "one", "a": "A", "x": "y"}
    many = few | {f"k{i}": f"v{i}" for i in range(1000)}
    for column, want in (("n", ["one", "2", "3"]), ("t", ["A", "b", None])):
        for mapping in (few, many):
            assert [r[column] for r in apply_merges(df, {column: mapping}).orderBy("n" if column == "t" else F.monotonically_increasing_id()).collect()] == want


def test_typed_equality_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as int) as n", "id % 2 = 0 as even").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda frame: frame._jdf.queryExecution().toString()
    assert "EqualTo(n,7)" in plan(equals(df, {"n": "7"})) and equals(df, {"n": "7"}).count() == 1
    assert equals(df, {"n": "07"}).count() == 0 and equals(df, {"n": "99999999999"}).count() == 0
    assert equals(df, {"even": "true"}).count() == 50 and equals(df, {"even": "yes"}).count() == 0
    assert "EqualTo(n,7)" in plan(df.where(A.where_lists(df, {"n": ["7"]})))
    assert df.where(A.where_lists(df, {"n": ["7", "8", "x"]})).count() == 2


def test_many_series_and_top_labels(spark):
    df = spark.range(30_000).selectExpr("cast(id % 3 as string) as x", "cast(id as string) as s", "cast(id as double) as v")
    assert A.cross_values(df, "x", "s", "v").count() == A.stacked_counts(df, "x", "s").count() == 30_000
    assert {r.label for r in A.cross_values(df, "x", "s", "v", top=1).select("label").distinct().collect()} == {"2"}
    small = df.where("v < 4")
    assert A.cross_values(small, "x", "s", "v", dense=True).count() == 12
    assert A.cross_values(small.where("v < 0"), "x", "s", "v", dense=True).count() == 0
