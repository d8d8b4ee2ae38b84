import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.plans import campaign as C
from tablelens.plans import survey_import as I
from tablelens.plans.versions import VersionError, Versions
from tablelens.sources.geo_files import read_kml
from tablelens.sources.sinks import records_export, shareable, write_kml


def data(d):
    return "<ExtendedData>" + "".join(f'<Data name="{k}"><value>{v}</value></Data>' for k, v in d.items()) + "</ExtendedData>"


def pt(x, y):
    return f"<Point><coordinates>{x},{y},0</coordinates></Point>"


def poly(x, y, w):
    ring = " ".join(f"{a},{b},0" for a, b in [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)])
    return f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon>"


def mark(name, body):
    return f"<Placemark><name>{name}</name>{body}</Placemark>"


CAPTURE = {
    "Localidade": "Vila Alfa", "Numero da Residencia": "12", "Data de Captura": "30/06/26", "Campanha_Captura ou PIT": "PIT", "INTRA ou PERI": "INTRA",
    "Ninfa_Macho ou Femea": "Femea", "Resultado do Exame a Fresco": "Positivo", "Data do exame": "26/05/26", "Morador": "Fulano", "Obs": "nota",
}
DOC = f"""<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Folder><name>Localidades</name>{mark("Vila Alfa cod 0001 Início", data({"Quantidade de Imoveis": "40"}) + pt(-40.9, -4.4))}{mark("Vila Alfa cod 0001 Final", pt(-40.9, -4.41))}{mark("Luminosa", pt(-40.8, -4.4))}</Folder>
<Folder><name>Area das Localidades</name>{mark("Vila Alfa", poly(-40.95, -4.45, 0.1))}{mark("Sítio Beta", poly(-40.7, -4.3, 0.05))}{mark("Serra(Sede)", poly(-41.2, -4.6, 0.05))}</Folder>
<Folder><name>Coleta</name>
{mark("T. Brasilensis", data(CAPTURE) + pt(-40.9001, -4.4001))}
{mark("P. Lutzi P.", data({"Localidade": "SITIO BETA", "Data de Captura": "27/07/2026", "Campanha_Captura ou PIT": "Captura", "INTRA ou PERI": "PERI", "Ninfa_Macho ou Femea": "Ninfa", "Resultado do Exame a Fresco": "Negaivo"}) + pt(-40.68, -4.28))}
{mark("Outro", data({"Localidade": "Sede", "INTRA ou PERI": "INTRA e PERI", "Ninfa_Macho ou Femea": "Macho e Femea"}) + pt(-41.19, -4.59))}
{mark("Sem local", pt(-40.92, -4.42))}
</Folder>
<Folder><name>Positivos</name>{mark("Triatominio", data({"Localidade": "Vila Alfa", "Numero da Residencia": "12", "Campanha_Captura ou PIT": "PIT", "Ninfa_Macho ou Femea": "Femea", "Resultado do Exame a Fresco": "Positivo"}) + pt(-40.9001, -4.4001))}</Folder>
<Folder><name>Limite</name>{mark("Limite do município", poly(-41.5, -5, 1.5))}</Folder>
<Folder><name>pits</name>{mark("PIT 01", data({"Nome do PIT": "SETOR", "Endereço Completo": "Rua 1"}) + pt(-10, 40))}</Folder>
<Folder><name>Rotas</name>{mark("Rota", "<LineString><coordinates>-40.9,-4.4 -40.8,-4.3</coordinates></LineString>")}</Folder>
</Document></kml>"""


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("kml") / "x.kml"
    p.write_text(DOC)
    return I.normalise(read_kml(spark, str(p), lenient=True))


def test_records(done):
    rows = {r["index"]: r for r in done.records.collect()}
    by = lambda name: next(r for r in rows.values() if r.name == name)
    a, b, c, lost, copy = by("T. Brasilensis"), by("P. Lutzi P."), by("Outro"), by("Sem local"), by("Triatominio")
    assert (a.type, a.visit_date, a.exam_date, a.exam_result, a.channel, a.environment, a.stage, a.sex, a.property_ref, a.species, a.locality_raw) == (
        "captura", dt.date(2026, 6, 30), dt.date(2026, 5, 26), "positivo", "pit", "intra", "Adulto", "Fêmea", "12", "Triatoma brasiliensis", "Vila Alfa",
    )
    assert (b.exam_result, b.stage, b.species, b.locality_raw, b.search_result) == ("negativo", "Ninfa", "Panstrongylus lutzi", "Sítio Beta", "com_captura")
    assert (c.exam_result, c.environment, c.sex, c.locality_raw, c.locality_how) == ("nao_informado", "intra_peri", "Macho e Fêmea", "Serra(Sede)", "partial")
    assert lost.locality_raw == "Vila Alfa" and copy.duplicate_of == a["index"]
    assert by("Luminosa").type == "outro" and by("Limite do município").is_boundary and by("Rota").type == "rota"
    assert by("Vila Alfa cod 0001 Início").property_count == 40 and by("Vila Alfa cod 0001 Início").locality_key == "vila alfa"
    codes = {(r["index"], r["code"]) for r in done.issues.collect()}
    for r, code in [(a, "exame_antes_da_captura"), (b, "resultado_exame_corrigido"), (c, "localidade_corrigida"), (lost, "localidade_por_geometria"), (copy, "possivel_duplicata"), (by("PIT 01"), "fora_da_area")]:
        assert (r["index"], code) in codes


def test_reports(done):
    rep = {(r["section"], r["item"]): r["n"] for r in I.import_report(done).collect()}
    assert rep[("type", "captura")] == 5 and rep[("type", "localidade")] == 5 and rep[("geometry", "Polygon")] == 4
    assert rep[("field_dropped", "Morador")] == 1 and rep[("field_unmapped", "Obs")] == 1 and ("field_seen", "resultado_exame") in rep
    groups = done.duplicates.collect()
    assert len(groups) == 1 and groups[0].cross_folder and groups[0].copies == 2
    checks = {(r.name, r.problem) for r in I.pending_checks(done).collect()}
    assert ("T. Brasilensis", "exam_before_capture") in checks and ("Outro", "without_exam_result") in checks and ("Sem local", "without_species") in checks
    assert {r.code for r in I.issue_counts(done).collect()} >= {"fora_da_area", "possivel_duplicata"}
    out = shareable(done.records, done.duplicates)
    assert out.count() == done.records.count() - 1 and not {"address", "property_ref", "source_id", "raw"} & set(out.columns)


def test_versions_and_round_trip(spark, done, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    records = done.records.drop("raw", "issues")
    first = v.stage(records, "x.kml")
    bad = v.stage(None, "bad.kml", ["sem_registros"])
    assert v.active().isEmpty() and {r.import_id: r.status for r in v.status().collect()} == {1: "staged", 2: "failed"}
    with pytest.raises(VersionError, match="is_failed"):
        v.activate(bad)
    assert v.activate(first, exclude_repeats=True) == 1
    assert v.active_records().count() == records.count() - 1
    v.remap(bad, records.limit(3))
    assert v.activate(bad) == 2 and v.active_records().count() == 3
    v.restore(first)
    assert v.active().first().import_id == first and v.active().count() == 1
    third = v.stage(records, "y.kml")
    v.discard(third)
    with pytest.raises(VersionError, match="is_discarded"):
        v.activate(third)
    visit = v.add_visit("vila alfa", "vila alfa", dt.date(2026, 8, 1), "sem_captura")
    assert v.visits().first().locality_raw == "Vila Alfa"
    assert C.kpis(v.records()).where("indicator = 'without_capture'").first().value == 1
    v.void_visit(visit)
    assert v.visits().isEmpty() and v.records().count() == records.count() - 1

    export = records_export(v.records(), "x.kml", 1, "2026-08-01")
    assert export.columns[0] == "origem" and export.where("resultado_exame = 'Positivo'").count() == 1
    folders = write_kml(v.records(), str(tmp_path / "out"))
    back = None
    for f in folders:
        part = read_kml(spark, f, lenient=True).withColumn("folder_path", F.array(F.lit(f.rsplit("/", 1)[1])))
        back = part if back is None else back.unionByName(part)
    again = I.normalise(back).records
    want = C.by_locality(v.records()).select("key", "positivo", "negativo", "total").collect()
    assert sorted(map(tuple, C.by_locality(again.withColumn("origin", F.lit("arquivo"))).select("key", "positivo", "negativo", "total").collect())) == sorted(map(tuple, want))


def test_records_are_numbered_over_ranges(spark):
    """Equal to a plain count per file, in the order of names and positions, however the rows are dealt."""
    places = [("b", [0, i]) for i in range(700)] + [("a", [1, 0, i]) for i in range(40)] + [("c d", [0, 0]), ("a", [0, 3])]
    marks = spark.createDataFrame([(f, p, f"{f}{p}") for f, p in places], "file string, position array<int>, name string").repartition(5)
    numbered = I.numbered(marks)
    got = {r["name"]: r["index"] for r in numbered.collect()}
    want = {}
    for number, file in enumerate(sorted({f for f, _ in places})):
        for at, place in enumerate(sorted(p for f, p in places if f == file)):
            want[f"{file}{place}"] = (number << 32) + at
    assert got == want and numbered.columns == ["file", "position", "name", "index"]
    assert "Window" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert I.numbered(marks.limit(0)).count() == 0
