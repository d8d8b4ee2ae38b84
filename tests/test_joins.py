import pytest
from pyspark.sql import functions as F

from tablelens.operators import joins as J
from tablelens.operators.profile import profile


@pytest.fixture
def sales(spark):
    return spark.createDataFrame([("v1", "0123", 100), ("v2", "0456", 200), ("v3", "0456", 50), ("v4", "0999", 70), ("v5", None, 10)], "id string, cod string, valor int")


@pytest.fixture
def districts(spark):
    return spark.createDataFrame([("0123", 1000, "A"), ("0456", 2000, "B"), ("0777", 3000, "C"), (None, 1, "N")], "cod string, pop int, nome string")


def test_analysis(sales, districts):
    a = J.analyze_join(sales, districts, "cod", "cod")
    r = a.first()
    assert (r.cardinality, r.matched, r.unmatched_left, r.unmatched_right, r.null_left, r.null_right, r.result_rows) == ("N:1", 3, 2, 1, 1, 1, 5)
    keys = {(x.side, x.key) for x in J.unmatched_keys(sales, districts, "cod", "cod").collect()}
    assert keys == {("left", "0999"), ("right", "0777")}
    warn = J.fan_out(a, profile(sales), profile(districts), "cod", "cod").collect()
    assert [(w.side, w.column, w.repeats) for w in warn] == [("right", "pop", 2)]
    assert [w.code for w in J.join_warnings(a).collect()] == ["many_lost"]
    assert [x[:] for x in J.repeated_keys(sales, "cod").collect()] == [("0456", 2)]


def test_join(sales, districts):
    out = J.join_tables(sales, districts, "cod", "cod")
    assert out.columns == ["id", "cod", "valor", "pop", "nome"] and out.count() == 5
    assert {r.id: r.pop for r in out.collect()} == {"v1": 1000, "v2": 2000, "v3": 2000, "v4": None, "v5": None}
    assert J.join_tables(sales, districts, "cod", "cod", "inner").count() == 3
    again = J.join_tables(sales, sales, "cod", "cod", right_name="copia")
    assert again.columns == ["id", "cod", "valor", "id (copia)", "valor (copia)"]
    with pytest.raises(J.JoinBlocked):
        J.join_tables(sales, districts, "nope", "cod")


@pytest.mark.parametrize(
    "left, right, card, rows",
    [
        (["0123", "0777"], ["0123", "0777", "0777"], "1:N", 3),
        (["a", "a"], ["a", "a"], "N:N", 4),
        (["a", "b"], ["b", "c"], "1:1", 2),
        ([" 7 "], ["7"], "1:1", 1),
    ],
)
def test_cardinality(spark, left, right, card, rows):
    l, r = (spark.createDataFrame([(x,) for x in v], "k string") for v in (left, right))
    got = J.analyze_join(l, r, "k", "k").first()
    assert (got.cardinality, got.result_rows) == (card, rows)


def test_key_rules(spark):
    l = spark.createDataFrame([(456.0,), (123.0,)], "k double")
    r = spark.createDataFrame([("456",), ("0123",), (None,)], "k string")
    got = J.analyze_join(l, r, "k", "k").first()
    assert got.matched == 1
    assert [x[:] for x in J.leading_zero_pairs(l, r, "k", "k").collect()] == [("123", "0123")]


def test_recipes(sales, districts):
    specs = [J.JoinSpec("s", "d", "cod", "cod"), J.JoinSpec("s", "x", "cod", "cod"), J.JoinSpec("d", "s", "cod", "cod"), J.JoinSpec("s", "d", "nope", "cod")]
    out, dropped = J.apply_joins({"s": sales, "d": districts}, specs, shaped={"d"})
    assert set(out) == {"s", "d", "s + d"}
    assert [d[1] for d in dropped] == ["missing_table:x", "repeats_shapes", "missing_left_key:nope"]


def test_known_spelling(spark):
    rows = spark.createDataFrame([("sitio b",), ("novo",)], "locality string")
    known = spark.createDataFrame([("sitio b", "Sítio B")], "key string, name string")
    got = {r.locality: r.is_new for r in J.known_spelling(rows, "locality", F.col("locality"), known).collect()}
    assert got == {"Sítio B": False, "novo": True}
