import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.functions import survey_fields as S
from tablelens.plans import campaign as C


@pytest.fixture(scope="module")
def records(spark):
    n = 0
    out = []

    def rec(**o):
        nonlocal n
        n += 1
        base = dict(
            rid=f"f{n}", origin="arquivo", type="captura", name=None, locality_key="vila a", locality_raw="Vila A", visit_date=None, exam_date=None,
            search_result="com_captura", exam_result="nao_informado", triatomine_count=None, stage=None, sex=None, species=None, lat=None, lng=None,
            channel=None, environment=None, property_count=None, zone=None, pit_ref=None, is_boundary=False, duplicate_of=None,
        )
        base.update(o)
        for k in ("visit_date", "exam_date"):
            if base[k]:
                base[k] = dt.date.fromisoformat(base[k])
        out.append(tuple(base.values()))

    b = dict(locality_key="sitio b", locality_raw="Sítio B")
    rec(type="localidade", name="Vila A", property_count=50)
    rec(type="localidade", name="Vila A (fim)")
    rec(type="localidade", property_count=10, **b)
    rec(type="pit", name="PIT 01", pit_ref="UBS A", zone="Rural")
    bra, lut = "Triatoma brasiliensis", "Panstrongylus lutzi"
    rec(species=bra, exam_result="positivo", visit_date="2026-06-10", exam_date="2026-06-20", channel="pit", environment="intra", stage="Adulto", sex="Fêmea")
    rec(species=bra, exam_result="negativo", visit_date="2026-07-01", exam_date="2026-07-20", channel="captura", environment="peri", stage="Ninfa")
    rec(species=lut, exam_result="negativo", visit_date="2026-07-15", exam_date="2026-07-10", channel="captura", environment="intra", stage="Adulto", sex="Macho")
    rec(species=bra, visit_date="2026-07-20", channel="pit", environment="intra_peri", stage="Ninfa e adulto", sex="Macho e Fêmea", **b)
    rec(**b)
    return spark.createDataFrame(out, C.RECORD_SCHEMA).cache()


def pairs(df, a, b):
    return [(r[a], r[b]) for r in df.collect()]


def test_summary_and_localities(records):
    assert C.summary(records).first()[:] == (5, 3, 1, 2, 33.3, 60, 2)
    loc = {r.key: r for r in C.by_locality(records).collect()}
    assert (loc["vila a"].total, loc["vila a"].positivo, loc["vila a"].properties, loc["vila a"].captures_per_100) == (3, 1, 50, 6.0)
    assert (loc["sitio b"].total, loc["sitio b"].properties, loc["sitio b"].captures_per_100) == (2, 10, 20.0)
    assert [r.key for r in C.coverage_ranking(C.by_locality(records)).collect()] == ["sitio b", "vila a"]
    assert [r[:] for r in C.positivity_ranking(C.by_locality(records)).collect()] == [("vila a", "Vila A", 3, 33.3)]


def test_species_months_and_orders(records):
    assert pairs(C.by_species(records), "species", "total") == [("Triatoma brasiliensis", 3), ("Panstrongylus lutzi", 1), ("Não identificada", 1)]
    assert [r[:] for r in C.timeline(records).collect()] == [("2026-06", 1, 1, 0, 0, 0, 1, 0), ("2026-07", 3, 0, 2, 1, 2, 1, 0)]
    assert C.undated(records).first().undated == 1
    assert [r.variation for r in C.month_rows(C.timeline(records)).orderBy("month").collect()] == [None, 200.0]
    assert pairs(C.by_channel(records), "key", "total") == [("captura", 2), ("pit", 2), ("nao_informado", 1)]
    assert pairs(C.by_environment(records), "key", "total") == [("intra", 2), ("peri", 1), ("intra_peri", 1), ("nao_informado", 1)]
    assert pairs(C.labels(records), "label", "total") == [("Fêmea", 2), ("Macho", 2), ("Ninfa", 2), ("Não informado", 1)]
    assert dict(pairs(C.combinations(records), "combination", "total")) == {"Fêmea": 1, "Macho": 1, "Ninfa": 1, "Ninfa, Macho e Fêmea": 1, "Não informado": 1}
    assert C.species_by_environment(records).first()[:] == ("Triatoma brasiliensis", 1, 1, 1, 0, 3)


def test_lag(records):
    t = C.lag_facts(records).first()
    assert (t.with_both_dates, t.without_exam_date, t.min_days, t.median_days) == (3, 2, -5, 10.0)
    assert [r.total for r in C.lag_buckets(records).collect()] == [1, 0, 1, 1, 0, 0, 0]


def test_origin(records):
    assert C.origin_total(records).first()[:] == (2, 2, 1, 5, 0, 1, 2, 1)
    assert C.origin_total(records, C.Filters(channel=("pit",))).first().campaign == 2
    by = {r.key: r for r in C.origin_by(records, "locality").collect()}
    assert (by["vila a"].campaign, by["vila a"].post, by["sitio b"].post, by["sitio b"].without_origin) == (2, 1, 1, 1)
    assert {r.key for r in C.origin_by(records, "environment").collect()} == {"intra", "intra_peri", "nao_informado", "peri"}
    assert [r[:] for r in C.service_posts(records).collect()] == [("PIT 01", "UBS A", "Rural", "Vila A", "vila a")]


def test_self_exclusion(records):
    f = C.Filters(species=("Panstrongylus lutzi",), locality="sitio b", start="2026-07-01", end="2026-07-31")
    assert C.summary(records, f).first().captures == 0
    assert "Triatoma brasiliensis" in [r.species for r in C.by_species(records, f).collect()]
    assert [r.key for r in C.by_locality(records, f).collect()] == ["vila a"]
    assert C.timeline(records, f).count() == 0
    g = C.Filters(species=("Triatoma brasiliensis",), start="2026-07-01", end="2026-07-31")
    assert [r.month for r in C.timeline(records, g).collect()] == ["2026-06", "2026-07"]
    one_scan = {(r.facet, r.value): r.total for r in C.facets(records, g).collect()}
    assert one_scan[("month", "2026-06")] == 1 and one_scan[("species", "Panstrongylus lutzi")] == 1
    for facet, df, key in [("species", C.by_species(records, g), "species"), ("channel", C.by_channel(records, g), "key")]:
        assert {v: t for (n, v), t in one_scan.items() if n == facet and v} == {r[key]: r.total for r in df.collect() if r[key] not in ("Não identificada", "nao_informado")}


def test_kpis_and_lists(records):
    k = {r.indicator: (r.value, r.status) for r in C.kpis(records).collect()}
    assert k["localities"] == (2, "confirmado") and k["visits"] == (None, "ausente") and k["specimens"] == (None, "ausente")
    assert k["positive"] == (1, "confirmado") and k["not_informed"] == (2, "confirmado") and k["without_capture"][1] == "ausente"
    c = {r.key: r for r in C.chart(records, C.Filters(locality="vila a"), "exam", "total").collect()}
    assert (c["vila a"].positivo, c["vila a"].total, c["sitio b"].total) == (1, 3, 2)
    assert [(r.key, r.records, r.captures) for r in C.localities(records).collect()] == [("sitio b", 3, 2), ("vila a", 6, 3)]
    assert pairs(C.species_facet(records), "value", "count") == [("Triatoma brasiliensis", 3), ("Panstrongylus lutzi", 1)]
    page = C.record_page(records, page=1, size=3).collect()
    assert [r.rid for r in page] == ["f8", "f7", "f6"] and C.record_total(records).first().total == 6
    assert C.record_page(records, C.Filters(text="LÚTZI")).count() == 1
    placed = records.withColumns({"lat": F.lit(-4.0), "lng": F.lit(-40.0)})
    assert C.map_features(placed, C.Filters(layers=("captura",), species=("Panstrongylus lutzi",))).count() == 1


def test_fields(spark):
    one = lambda text, e: spark.createDataFrame([(text,)], "v string").select(e.alias("r")).first().r
    assert one("26/05/26", S.survey_date("v"))[:] == (dt.date(2026, 5, 26), True)
    assert one("31.02.2026", S.survey_date("v"))[:] == (None, False)
    assert one("2026-07-01T10:00", S.survey_date("v"))[:] == (dt.date(2026, 7, 1), True) and one("", S.survey_date("v"))[:] == (None, True)
    assert one("01/01/1980", S.survey_date("v")).valid is False
    assert one("Negaivo", S.exam_result("v"))[:] == ("negativo", True) and one("xyz", S.exam_result("v"))[:] == ("nao_informado", False)
    assert one("Não reagente", S.exam_result("v")).value == "negativo" and one("Sem captura", S.search_result("v")).value == "sem_captura"
    assert one("INTRA ou PERI", S.environment("v")) == "intra_peri" and one("Pit 3", S.channel("v")) == "pit"
    assert one("Ninfa e Macho", S.stage_and_sex("v"))[:] == ("Ninfa e adulto", "Macho")
    assert one("P. Lutzi P.", S.species_of("v")) == "Panstrongylus lutzi"
    assert one("Vila Holanda cod 0001 Início", S.clean_locality("v")) == "Vila Holanda"
    assert one("Caiçara 00066 Final", S.clean_locality("v")) == "Caiçara" and one("Caiçara 00066 Final", S.has_end_marker("v"))
