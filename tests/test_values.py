from pyspark.sql import functions as F

from tablelens.functions import ranks, values


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "v string").select(expr.alias("r")).first().r


def test_numbers(spark):
    br = lambda t: one(spark, t, values.parse_number("v", "br"))
    us = lambda t: one(spark, t, values.parse_number("v", "us"))
    assert br("1.234,56") == us("1.234,56") == 1234.56
    assert br("1,234.56") == us("1,234.56") == 1234.56
    assert br("R$ 1.234,56") == 1234.56
    assert br("1.234") == 1234 and us("1.234") == 1.234
    assert us("1,234") == 1234 and br("1,5") == 1.5 and us("1,5") is None
    assert br("90%") == 90 and br("abc") is None and br("") is None and br("-7") == -7


def test_dates(spark):
    day = lambda t, o: one(spark, t, F.date_format(values.parse_date("v", o), "yyyy-MM-dd"))
    assert day("03/04/2024", "dmy") == "2024-04-03"
    assert day("03/04/2024", "mdy") == "2024-03-04"
    assert day("5/6/24", "dmy") == "2024-06-05"
    assert day("31/02/2024", "dmy") is None and day("x", "dmy") is None
    assert day("2024-02-29T10:30", "dmy") == "2024-02-29"


def test_locale(spark):
    def order(vals):
        return values.infer_locale(spark.createDataFrame([(v,) for v in vals], "v string")).first()

    assert order(["13/04/2024", "05/04/2024"]).date_order == "dmy"
    assert order(["04/13/2024", "04/05/2024"]).date_order == "mdy"
    both = order(["03/04/2024", "05/06/2024"])
    assert both.date_order == "dmy" and both.date_ambiguous and both.date_ambiguous_count == 2
    assert order(["1,234.50"]).numbers == "us" and order(["1.234"]).number_ambiguous


def test_text(spark):
    assert one(spark, " São  João-Del Rei ", values.name_key("v")) == "sao joao del rei"
    assert one(spark, "Numero da Residência", values.field_key("v")) == "numero_da_residencia"
    assert one(spark, "CEARÁ", values.fold("v")) == "ceara"
    assert one(spark, "000", values.without_leading_zeros("v")) == "0"
    assert one(spark, "12 un", values.leading_count("v")) == 12 and one(spark, "12x", values.leading_count("v")) is None
    df = spark.createDataFrame([(123.0, 1.5)], "a double, b double")
    assert df.select(values.join_key(df, "a"), values.join_key(df, "b")).first()[:] == ("123", "1.5")


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(values.round_half_up("x")).collect()] == [-2.0, 3.0]


def test_quick_periods(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-01-01",)], "d string")
    got = {r.period: (str(r.from_date), str(r.to_date)) for r in values.quick_periods(df, "d").collect()}
    assert got["30d"] == ("2024-01-31", "2024-02-29")
    assert got["12m"] == ("2023-03-02", "2024-02-29")
    assert got["previous_year"] == ("2023-01-01", "2023-12-31")


def test_order_statistics_match_sorting(spark):
    import random

    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.choice([-1, 1]) * round(10 ** rnd.uniform(-4, 6), rnd.randint(0, 4))) for _ in range(3000)]
    data += [("a", 0.0)] * 500 + [("b", 7.0)] * 900 + [("c", 5.0)]
    df = spark.createDataFrame(data, "k string, v double")
    freq = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    med = {r.k: r.median for r in ranks.medians(freq, ["k"], "v", "n").collect()}
    low = {r.k: (r.q1, r.q3) for r in ranks.lower_quantiles(freq, ["k"], "v", "n", {"q1": 0.25, "q3": 0.75}).collect()}
    for k in "abc":
        v = sorted(x for kk, x in data if kk == k)
        m = len(v) // 2
        assert med[k] == (v[m] if len(v) % 2 else (v[m - 1] + v[m]) / 2)
        assert low[k] == (v[int((len(v) - 1) * 0.25)], v[int((len(v) - 1) * 0.75)])


def test_running_totals(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 100.0), ("d", -1.0)], "k string, v double")
    got = sorted((r.v, r.t) for r in ranks.running_total_desc(df, "v", "k", "t").collect())
    assert got == [(-1.0, 109.0), (5.0, 105.0), (5.0, 110.0), (100.0, 100.0)]
    many = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 + 1.0).alias("v"))
    total = ranks.running_total_desc(many, "v", "k", "t").agg(F.count_distinct("t").alias("n"), F.max("t").alias("m")).first()
    assert total[:] == (4000, many.agg(F.sum("v")).first()[0])
    rows = spark.range(1, 1001).select(F.lit("s").alias("s"), F.col("id").alias("pos"), F.lit(2).alias("v"))
    out = ranks.chunked_running_sum(rows, ["s"], "pos", "v", "t", chunk=64)
    assert out.where("t <> pos * 2").count() == 0 and out.count() == 1000
