import pytest
from pyspark.sql import functions as F

from tablelens.operators import grids as G
from tablelens.operators import long_tables as L


def cells(spark, *sheets):
    rows = [(s, i, j, None if v is None else str(v)) for s, m in enumerate(sheets) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sheet_id int, row int, col int, text string")


SHEET = [
    ["Boletim", None, None, None, None],
    ["Mês", "Janeiro", None, None, None],
    ["Municipio", "A", "B", "C", "Total"],
    ["Notificados Dengue", 10, 20, None, None],
    ["Confirmados Dengue", 5, 10, 15, None],
    ["Descartados Dengue", 30, 30, 30, None],
    ["Notificados Zika", 1, 2, 3, None],
    ["Confirmados Zika", 0, 1, 0, None],
    ["Descartados Zika", 1, 1, 2, None],
    ["Em Andamento", 4, None, 6, None],
    [None] * 5,
    ["Mês", "FEVEREIRO", None, None, None],
    ["Municipio", "A", "B", "C", "Total"],
    ["Notificados Dengue", 30, 40, 50, None],
    ["Confirmados Dengue", 1, 1, 1, None],
]


def test_repeated_blocks(spark):
    long = G.repeated_blocks(cells(spark, SHEET, [["a", "b"], ["1", "2"]])).cache()
    rows = long.collect()
    assert {r.period for r in rows} == {"Janeiro", "Fevereiro"} and {r.entity for r in rows} == {"A", "B", "C"}
    assert rows[0].period_name == "Mês" and rows[0].entity_name == "Município" and {r.sheet_id for r in rows} == {0}
    assert sum(r.Total is None for r in rows) == 2
    assert {(r.situation, r.subgroup) for r in rows if r.indicator == "Em Andamento"} == {("Em Andamento", None)}
    sums = {r.entity: r.t for r in long.where("indicator = 'Notificados Dengue'").groupBy("entity").agg(F.sum("Total").alias("t")).collect()}
    assert sums == {"A": 40, "B": 60, "C": 50}
    rate = L.rate_by_label(long, "period", "situation", ["Confirmados"], ["Confirmados", "Descartados"], scope={"subgroup": ["Dengue", "∅"]})
    assert {r.label: r.value for r in rate.collect()} == {"Janeiro": 25.0, "Fevereiro": 100.0}
    spec = L.LongSpec("period", "entity", situation="situation", subgroup="subgroup", label="indicator")
    top = L.dominant(long, spec).first()
    assert top[:] == ("Notificados", "Dengue")
    kpis = {(r.kpi, r.label): r.value for r in L.long_kpis(long, spec).collect()}
    assert kpis[("total", "Notificados Dengue")] == 150 and kpis[("top_entity", "B")] == 60 and kpis[("peak_period", "Fevereiro")] == 120
    gaps = {(r.entity, r.period): r.kind for r in L.emptiness(long, spec).collect()}
    assert gaps == {("C", "Janeiro"): "partial", ("B", "Janeiro"): "partial"}
    stages = L.funnel(long, "situation", [("n", ["Notificados"]), ("c", ["Confirmados"])], scope={"subgroup": ["Dengue"]}).collect()
    assert [(s.value, s.of_previous) for s in stages] == [(150.0, None), (33.0, 22.0)]
    bub = {r.entity: (r.volume, r.size) for r in L.bubbles(long, "entity", "situation", ["Notificados"], ["Confirmados"], ["Confirmados", "Descartados"], ["Em Andamento"]).collect()}
    assert bub == {"A": (41, 4), "B": (62, 0), "C": (53, 6)}


def test_blocks_and_headers(spark):
    sheet = [
        ["Título", None, None],
        ["DADOS POPULACIONAIS", None, "OUTROS"],
        ["Homens", "Mulheres", "Renda"],
        [1, 2, 3],
        [4, 5, 6],
        [None, None, None],
        ["nota", None, None],
        [None, None, None],
        ["x", "x", None],
        [1, 2, 3],
        [4, 5, 6],
    ]
    c = cells(spark, sheet)
    found = {r.block: r for r in G.blocks(c).collect()}
    assert [(found[b].kind, found[b].first_row, found[b].header_row) for b in (1, 2, 3)] == [("table", 0, 1), ("context", 6, 6), ("table", 8, 8)]
    heads = G.block_headers(c).orderBy("block", "col").collect()
    assert [h.name for h in heads if h.block == 1] == ["Dados populacionais — Homens", "Dados populacionais — Mulheres", "Outros — Renda"]
    assert [h.name for h in heads if h.block == 3] == ["x", "x (2)", "Coluna 3"]
    assert {(r.part, r.text) for r in G.block_texts(c).collect()} == {("title", "Título"), ("context", "nota")}
    assert G.block_values(c).where("block = 1").count() == 6


def test_label_pairs(spark):
    df = spark.createDataFrame([("Dengue",), ("Dengua",), ("Zika",), ("Zico",)], "n string")
    assert {frozenset(r[:]) for r in L.one_letter_apart(df, "n").collect()} == {frozenset({"Dengue", "Dengua"})}
    long = spark.createDataFrame([("Casos Dengui", "Dengue"), ("Casos Dengue", "Dengue")], "indicator string, subgroup string")
    spec = L.LongSpec("p", "e", label="indicator", subgroup="subgroup")
    assert [r[:] for r in L.near_subgroup_labels(long, spec).collect()] == [("Casos Dengui", "Dengue")]
    assert [o["name"] for o in L.rate_options(["Confirmados", "Descartados", "Notificados", "Confirmados por critério"])] == ["concluded", "notified"]


def test_align(spark):
    a = spark.createDataFrame([("2023", 1, "Crato"), ("2024", 2, "Crato")], "Ano string, casos int, municipio string")
    b = spark.createDataFrame([("2024", 20, "Crato"), ("2023", 10, "Crato")], "Ano string, casos int, municipio string")
    c = spark.createDataFrame([("2020", 9), ("2021", 8)], "Ano string, x int")
    wide, used = G.align_tables({"A": a, "B": b, "C": c}, "Ano")
    assert used == ["A", "B"]
    assert wide.columns == ["Ano", "A — casos", "A — municipio", "B — casos"]
    assert {r["Ano"]: r["B — casos"] for r in wide.collect()} == {"2023": 10, "2024": 20}
