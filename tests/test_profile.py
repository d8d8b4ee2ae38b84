import pytest
from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tablelens.operators import quality as Q
from tablelens.operators import roles as R
from tablelens.operators.aggregate import group_values, ratio_values


def by_column(df):
    return {r.column: r for r in df.collect()}


PRODUCTS = [
    ("0001", "Caneta", "Papelaria", "R$ 2,50", "100"),
    ("0002", "Caderno", "Papelaria", "R$ 15,20", "40"),
    ("0003", "Mouse", "Informática", "R$ 59,80", "12"),
    ("0004", "Teclado", "Informática", "R$ 120,00", "8"),
    ("0005", "Cabo", "Informática", "R$ 80,00", "30"),
    ("0006", "Lápis", "Papelaria", "R$ 8,00", "200"),
]
SCHOOLS = [
    ("Escola A", "Fortaleza", 50, 45, "90%"),
    ("Escola B", "Fortaleza", 100, 80, "80%"),
    ("Escola C", "Sobral", 200, 180, "90%"),
    ("Escola D", "Sobral", 150, 130, "86,67%"),
]


def test_products(spark):
    df = spark.createDataFrame(PRODUCTS, "sku string, produto string, categoria string, preco string, estoque string")
    prof = P.profile(df)
    p, r = by_column(prof), by_column(R.roles(prof))
    assert p["preco"].type == "number" and p["preco"].sum == pytest.approx(285.5)
    assert p["estoque"].type == "integer" and p["estoque"].median == 35
    assert r["sku"].role == "identifier"
    assert r["preco"].role == "measure" and r["preco"].unit == "currency" and r["preco"].additive
    assert r["categoria"].role == "dimension"
    means = {x.label: x.value for x in group_values(df, "categoria", "preco", "mean").collect()}
    assert means == {"Papelaria": pytest.approx(25.7 / 3), "Informática": pytest.approx(259.8 / 3)}


def test_schools(spark):
    df = spark.createDataFrame(SCHOOLS, "escola string, municipio string, matriculas int, aprovados int, taxa_aprovacao string")
    prof = P.profile(df)
    r = by_column(R.roles(prof))
    assert r["taxa_aprovacao"].unit == "percent" and not r["taxa_aprovacao"].additive
    rel = Q.relations(df, ["matriculas", "aprovados", "taxa_aprovacao"], percent={"taxa_aprovacao"}).collect()
    assert [(x.p, x.a, x.b, x.n, x.bad) for x in rel] == [("taxa_aprovacao", "aprovados", "matriculas", 4, 0)]
    assert Q.relation_mismatches(df, "taxa_aprovacao", "aprovados", "matriculas", "escola").count() == 0
    assert Q.overall_rate(df, "aprovados", "matriculas").first().rate == pytest.approx(87.0)
    city = {x.label: x.value for x in ratio_values(df, "municipio", "aprovados", "matriculas").collect()}
    assert city == {"Fortaleza": pytest.approx(125 / 1.5), "Sobral": pytest.approx(310 / 3.5)}


def test_ratio_needs_a_positive_denominator(spark):
    df = spark.createDataFrame([("x", 5, 0), ("y", 5, None), ("z", 3, 6)], "g string, a int, b int")
    assert [(r.label, r.value) for r in ratio_values(df, "g", "a", "b").collect()] == [("z", 50.0)]


def test_types(spark):
    rows = [(i, f"2024-01-{i + 1:02d}", "sim" if i % 2 else "não", 2000 + i, f"nome {i}", -4.5, None) for i in range(10)]
    df = spark.createDataFrame(rows, "codigo int, dia string, ok string, ano int, texto string, lat double, vazio string")
    p = by_column(P.profile(df))
    assert {c: p[c].type for c in p} == {
        "codigo": "id", "dia": "date", "ok": "boolean", "ano": "category", "texto": "id", "lat": "lat", "vazio": "text",
    }
    assert p["ano"].period and p["vazio"].filled == 0 and str(p["dia"].max_date) == "2024-01-10 00:00:00"
    forced = by_column(P.profile(df, forced={"texto": "category"}))
    assert forced["texto"].type == "category" and forced["texto"].manual


def test_invalid_and_markers(spark):
    df = spark.createDataFrame([(i + 1, str(v)) for i, v in enumerate([10, 20, 30, 40, 50, 60, 70, 80, 90, "abc"])], "row int, v string")
    p = by_column(P.profile(df))["v"]
    assert (p.type, p.invalid) == ("integer", 1)
    assert [r[:] for r in P.invalid_values(df, "v", "row").collect()] == [(10, "abc")]
    marked = spark.createDataFrame([(v,) for v in "1,2,n/d,4,-,6,7,8,9".split(",")], "v string")
    m = by_column(P.profile(marked))["v"]
    assert (m.missing_markers, m.missing, m.invalid) == (2, 2, 0)


def test_alerts(spark):
    rows = [(float(i), float(2 * i + i % 3), None, "x") for i in range(20)] + [(1.0, 3.0, None, "x")]
    df = spark.createDataFrame(rows, "a double, b double, c string, k string")
    alerts = {(r.code, r.column): r.n for r in Q.quality_alerts(df, P.profile(df)).collect()}
    assert alerts[("empty_column", "c")] == 21 and ("constant_column", "k") in alerts
    assert alerts[("duplicate_rows", None)] == 1
    kpis = {r.kpi: r.value for r in Q.table_kpis(P.profile(df)).collect()}
    assert kpis["rows"] == 21 and kpis["total"] == 191 and kpis["fill_rate"] == pytest.approx(75)


def test_outliers_and_explore(spark):
    df = spark.createDataFrame([(float(i % 10), "a" if i % 2 else "b", f"{i % 7}%") for i in range(40)] + [(1000.0, "a", "5%")], "v double, g string, pct string")
    far = by_column(P.outliers(df, ["v"]))["v"]
    assert (far.q1, far.q3, far.outliers) == (2.0, 7.0, 1)
    rr = R.roles(P.profile(df))
    assert R.default_choice(rr).first()[:] == ("g", "v", "sum")
    assert {r.label: r.value for r in R.explore(df, rr, "g", "v", "max").collect()} == {"a": 1000.0, "b": 8.0}
    for args, code in [(("v",), "group_is_measure"), (("g", "pct", "sum"), "sum_of_rate"), (("g", "g", "mean"), "value_is_dimension")]:
        with pytest.raises(R.ChoiceError, match=code):
            R.explore(df, rr, *args)
    effects = by_column(R.filter_effects(P.profile(df), P.profile(df.where("g = 'a'"))))
    assert set(effects) == {"v", "g", "pct"}
