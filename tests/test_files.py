import json

import pytest
from pyspark.sql import functions as F

from tablelens.sources import files as S
from tablelens.sources import geo_files as G
from tablelens.sources import sinks as K


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_delimited(spark, tmp_path):
    p = put(tmp_path, "a.csv", 'nome;valor;;nome\n"a;b"; 1,5 ;x;y\n;;;\nçã;2;;z\n', "windows-1252")
    df = S.read_delimited(spark, p)
    assert df.columns == ["nome", "valor", "Coluna 3", "nome (2)"]
    assert [r[:] for r in df.collect()] == [("a;b", "1,5", "x", "y"), ("çã", "2", None, "z")]
    assert S.text_encodings(spark, p).first().encoding == "windows-1252"
    for text, want in [("a\tb\n1\t2\n", "\t"), ("a,b\n1,2\n", ","), ("a|b|c\n1|2|3\n", "|"), ("solo\nx\n", ","), ('"a,b";c\n"1,2";3\n', ";")]:
        assert S.separators(spark, put(tmp_path, "s.txt", text)).first().separator == want
    q = put(tmp_path, "q.csv", 'a,b\n"x\ny",1\n')
    assert [r[:] for r in S.read_delimited(spark, q).collect()] == [("x\ny", "1")]
    raw = spark.createDataFrame([("a", None), (None, None), ("b", "c")], "x string, y string")
    assert S.read_stats(raw, kept=1).first()[:] == (3, 1, 1)


def test_json(spark, tmp_path):
    p = put(tmp_path, "l.json", json.dumps([{"a": 1, "b": {"c": 2}}, {"a": None, "b": None, "d": " x "}]))
    df = S.read_json_tables(spark, p, "t")["t"]
    assert {r.a: (r.b, r.d) for r in df.collect()} == {1: ('{"c":2}', None), None: (None, "x")}
    p = put(tmp_path, "o.json", json.dumps({"x": [{"k": 1}], "y": [{"k": 2}, {"k": 3}], "meta": "m"}))
    assert {n: d.count() for n, d in S.read_json_tables(spark, p).items()} == {"x": 1, "y": 2}
    assert [r.valor for r in S.read_json_tables(spark, put(tmp_path, "v.json", "[1, 2]"))["data"].collect()] == ["1", "2"]
    assert S.read_json_tables(spark, put(tmp_path, "s.json", '{"a": 5}'))["data"].first().a == 5


def test_parquet_and_facts(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0, [1]), (float("nan"), None)], "v double, l array<int>").coalesce(1).write.parquet(p)
    assert {(r.v, r.l) for r in S.read_parquet(spark, p).collect()} == {(1.0, "[1]"), (None, None)}
    f = S.file_facts(spark, put(tmp_path, "f.txt", "abc")).first()
    assert f.bytes == 3 and f.sha256.startswith("ba7816bf")
    one = spark.range(2)
    tables, facts = S.merge_sources({"a.csv": {"t": one}, "b.xlsx": {"x": one, "y": one}, "a.txt": {"t": one}})
    assert list(tables) == ["a", "b › x", "b › y", "a (2)"] and facts.count() == 4


def test_safe_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5.5, "-3,2"), ("ok", None, "@x")], "a string, b double, c string")
    assert [r[:] for r in K.safe_cells(df).collect()] == [("'=1+1", "-5.5", "-3,2"), ("ok", None, "'@x")]
    assert K.safe_cells(df, strict=True).first()[:] == ("'=1+1", "'-5.5", "'-3,2")
    out = str(tmp_path / "out")
    K.write_csv(df, out)
    back = S.read_delimited(spark, out)
    assert {r[:] for r in back.collect()} == {("'=1+1", "-5.5", "-3,2"), ("ok", None, "'@x")}


def test_geojson(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"n": "a", "v": 1.5}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
            {"type": "Feature", "properties": {"n": "b"}, "geometry": {"type": "Point", "coordinates": ["x"]}},
            {"type": "Feature", "properties": None, "geometry": None},
        ],
    }
    df = G.read_geojson(spark, put(tmp_path, "g.json", json.dumps(doc)))
    rows = {r.position: r for r in df.collect()}
    assert rows[1].v == 1.5 and rows[1].geometry.points == [[1.0, 2.0]]
    assert rows[2].geometry is None and rows[2].geometry_problem == "malformed" and rows[3].geometry_problem is None
    bare = G.read_geojson(spark, put(tmp_path, "b.json", '{"type":"Point","coordinates":[3,4],"crs":{"type":"name","properties":{"name":"EPSG:31984"}}}'))
    assert bare.first().geometry.points == [[3.0, 4.0]] and bare.first().geometry_problem == "crs"
    table = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "n string, x double, y double")
    out = str(tmp_path / "lines")
    K.write_geojson(table, out, lon="x", lat="y")
    back = G.read_geojson(spark, out, one_per_line=True).collect()
    assert [(r.n, r.geometry.points) for r in back] == [("a", [[1.0, 2.0]])]


KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>d</name>
<Placemark><name>solto</name><Point><coordinates>-40,-4,0</coordinates></Point></Placemark>
<Folder><name>A</name>
 <Placemark id="p1"><name>um</name><description><![CDATA[<table><tr><td>Cor</td><td>azul &amp; verde</td></tr></table>Outro: 5]]></description>
  <ExtendedData><Data name="Localidade"><value>Vila</value></Data><SchemaData><SimpleData name="k">v</SimpleData></SchemaData></ExtendedData>
  <Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,4 0,0</coordinates></LinearRing></outerBoundaryIs>
  <innerBoundaryIs><LinearRing><coordinates>0,0 2,0 2,2 0,2 0,0</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
 <Folder><name>B</name><Placemark><name>dois</name><MultiGeometry><Point><coordinates>1,1</coordinates></Point><Point><coordinates>2,2</coordinates></Point></MultiGeometry></Placemark></Folder>
</Folder></Document></kml>"""


def test_kml(spark, tmp_path):
    df = G.read_kml(spark, put(tmp_path, "k.kml", KML))
    rows = {r.name: r for r in df.withColumn("described", G.merged_fields("fields", G.description_fields("description"))).collect()}
    assert set(rows) == {"solto", "um", "dois"}
    assert rows["solto"].folder_path == [] and rows["dois"].folder_path == ["A", "B"]
    assert rows["um"].source_id == "p1" and len(rows["um"].geometry.polys[0]) == 2
    assert {(f.key, f.value) for f in rows["um"].described} == {("Localidade", "Vila"), ("k", "v"), ("Cor", "azul & verde"), ("Outro", "5")}
    assert rows["dois"].geometry.type == "MultiPoint"
    order = [r.name for r in df.orderBy("position").collect()]
    assert order == ["solto", "um", "dois"]
    table = G.kml_table(df)
    assert {"nome", "pasta", "Localidade", "k", "geometry"} <= set(table.columns)
    with pytest.raises(ValueError):
        G.read_kml(spark, put(tmp_path, "d.kml", "<!DOCTYPE x><kml></kml>"))


def test_broken_geo_files_do_not_vanish(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    good = "<kml><Document><Placemark><name>a</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>"
    put(folder, "good.kml", good)
    assert G.read_kml(spark, str(folder)).count() == 1
    put(folder, "cut.kml", good[: len(good) // 2])
    with pytest.raises(Exception):  # Spark's own error, or ours for a file without a document
        G.read_kml(spark, str(folder))
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}}'
    rows = G.read_geojson(spark, put(tmp_path, "cut.geojson", text)).collect()
    assert [r.geometry_problem for r in rows] == ["malformed"]
    assert [r.geometry_problem for r in G.read_geojson(spark, put(tmp_path, "whole.geojson", text + "]}")).collect()] == [None]


def test_files_with_different_headers_meet_by_name(spark, tmp_path):
    folder = tmp_path / "several files"
    folder.mkdir()
    put(folder, "a.csv", "id;nome\n1;x\n")
    put(folder, "b.csv", "nome,id,extra\ny,2,z\n")
    rows = S.read_delimited(spark, str(folder)).select("id", "nome", "extra").collect()
    assert sorted(map(tuple, rows), key=repr) == [("1", "x", None), ("2", "y", "z")]


def _odd_features():
    """Strings with braces, brackets, quotes, backslashes and the name of the list itself; nested lists; empty parts."""
    texts = ['}', '{', '"features":[', 'a\\', '\\"}', ']}', '}{', 'é}ü', '', '\\\\"features\\": [', 'x}","features":[{']
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    return [
        {"type": "Feature", "properties": {"n": i, "t": t, "features": [{"x": [t]}], "o": {}}, "geometry": shape if i % 2 else {"type": "Point", "coordinates": [i, 1]}}
        for i, t in enumerate(texts * 20)
    ]


def test_collections_are_read_by_many_tasks(spark, tmp_path):
    features = _odd_features()
    before = {"type": "FeatureCollection", "list": [{"features": [{"a": 1}]}, {}], "crs": {"type": "name", "properties": {"name": "EPSG:31984"}}}
    whole = {
        "compact": json.dumps({**before, "features": features}, separators=(",", ":"), ensure_ascii=False),
        "wide": "﻿" + json.dumps({"features": features, **before, "bbox": [1, 2]}, indent=2) + "\n",
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, text in whole.items():
            path = put(tmp_path, f"{name}.json", text)
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
            rows = {r.position: r for r in G.geojson_features(spark, path).collect()}
            assert sorted(rows) == list(range(1, len(features) + 1))
            for i, f in enumerate(features):
                r = rows[i + 1]
                assert not r.broken and r.crs == "EPSG:31984"
                assert json.loads(r.properties) == f["properties"] and json.loads(r.geometry_json) == f["geometry"]
            body = text.strip()
            cut = G.geojson_features(spark, put(tmp_path, f"{name}-cut.json", body[:-1])).collect()
            assert [r.broken for r in cut] == [True]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_collections(spark, tmp_path):
    read = lambda text: [(r.position, r.broken, r.geometry_json) for r in G.geojson_features(spark, put(tmp_path, "odd.json", text)).orderBy("position").collect()]
    point = '{"type":"Point","coordinates":[1,2]}'
    assert read('{"type":"FeatureCollection","features":[]}') == []
    assert read('{"features" : [ ] , "type":"FeatureCollection"}\n') == []
    assert read("") == [] and read(" \n") == []
    assert read(point) == [(1, False, point)]
    assert read('{"type":"Feature","properties":{},"geometry":' + point + "}") == [(1, False, point)]
    good = '{"type":"Feature","properties":{},"geometry":' + point + "}"
    assert read('{"type":"FeatureCollection","features":[' + good + ',{"a":},' + good + "]}") == [(1, False, point), (2, True, None), (3, False, point)]
    assert [b for _, b, _ in read('{"type":"FeatureCollection","features":[' + good + ", nonsense]}")] == [False, True]


def test_types_of_many_json_files_come_from_many_tasks(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.json").write_text('{"x": [{"a": %d}],\n "y": [{"b": %s}]}' % (i, "1.5" if i == 17 else "2"))
    context = spark.sparkContext
    context.setJobGroup("json-types", "types")
    found = S.read_json_tables(spark, str(tmp_path))
    context.setJobGroup("json-rows", "rows")
    track = context.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("json-types") for s in track.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    assert {n: d.count() for n, d in found.items()} == {"x": 20, "y": 20}
    assert found["y"].schema["b"].dataType.simpleString() == "double" and found["x"].schema["a"].dataType.simpleString() == "bigint"


def test_json_that_is_not_utf8_is_still_read(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"x": [{"a": "é"}]}', encoding="utf-16-be")
    assert [r.a for r in S.read_json_tables(spark, str(tmp_path))["x"].collect()] == ["é"]


def test_lines_meet_their_split_where_they_are(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n3;4\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = S.read_cells(spark, str(tmp_path))
        assert "BroadcastHashJoin" in cells._jdf.queryExecution().executedPlan().toString()
        assert cells.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
