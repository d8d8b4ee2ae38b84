import json
import random

import pytest
from pyspark.sql import functions as F

from tablelens.functions import geometry as G
from tablelens.operators import spatial as S


def geo(spark, *shapes):
    rows = [(i, json.dumps(s) if s else None) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, j string").withColumn("g", G.from_geojson("j"))


def sq(a, b, hole=None):
    ring = lambda x, y: [[x, x], [y, x], [y, y], [x, y], [x, x]]
    return {"type": "Polygon", "coordinates": [ring(a, b)] + ([ring(*hole)] if hole else [])}


def test_shapes(spark):
    df = geo(
        spark,
        sq(0, 4, (0, 2)),
        {"type": "LineString", "coordinates": [[0, 0], [10, 0], [10, 10]]},
        {"type": "MultiPoint", "coordinates": [[0, 0, 5], [2, 4, 5]]},
        {"type": "Polygon", "coordinates": "x"},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, sq(0, 2)]},
        {"type": "Point", "coordinates": [1]},
    )
    r = {x.id: x for x in df.select("id", "g", G.area("g").alias("a"), G.centroid("g").alias("c"), G.bbox("g").alias("b")).collect()}
    assert r[0].a == 12 and r[0].c == [pytest.approx(28 / 12), pytest.approx(28 / 12)]
    assert r[1].c == [7.5, 2.5] and r[1].b[:] == (0, 0, 10, 10)
    assert r[2].c == [1, 2] and r[3].g is None and r[5].g is None
    assert r[4].c == [1, 1] and len(r[4].g.points) == 1
    back = df.select("id", G.to_geojson("g").alias("t")).where("id < 2").collect()
    assert json.loads(back[0].t) == sq(0, 4, (0, 2)) and json.loads(back[1].t)["type"] == "LineString"


def test_validation(spark):
    df = geo(
        spark,
        {"type": "Point", "coordinates": [0, 0]},
        {"type": "Point", "coordinates": [500000, 9000000]},
        {"type": "Point", "coordinates": [200, 10]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]},
        sq(0, 1),
    )
    got = [r.p for r in df.orderBy("id").select(G.validate("g").alias("p")).collect()]
    assert got == [["point_at_zero"], ["projected"], ["out_of_range"], ["short_ring"], ["open_ring"], []]


def test_counts(spark):
    polys = geo(spark, sq(0, 2), sq(4, 6), sq(10, 14, (10, 12)), None)
    pts = spark.createDataFrame([(1.0, 1.0), (1.5, 0.5), (5.0, 5.0), (9.0, 9.0), (11.0, 11.0), (13.0, 13.0), (None, None)], "lon double, lat double")
    got = {r.id: r.points for r in S.count_points(polys, "id", "g", pts).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: None}
    assert S.point_coverage(polys, "id", "g", pts).first()[:] == (4, 2, 1)


def test_join_equals_brute_force(spark):
    rnd = random.Random(1)
    shapes = []
    for _ in range(60):
        x, y, w = rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.choice([0.3, 1, 7, 30])
        shapes.append((x, y, w))
    polys = geo(spark, *[{"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]} for x, y, w in shapes])
    points = [(i, rnd.uniform(-25, 55), rnd.uniform(-25, 55)) for i in range(400)]
    df = spark.createDataFrame(points, "pid int, lon double, lat double")
    want = {(i, p) for p, px, py in points for i, (x, y, w) in enumerate(shapes) if x < px < x + w and y < py < y + w}
    got = {(r.polygon, r.pid) for r in S.points_in_polygons(polys, "id", "g", df).collect()}
    assert got == want
    first = {r.pid: r.polygon for r in S.first_polygon(polys, "id", "g", "id", df, "pid").collect()}
    assert first == {p: min(i for i, q in want if q == p) for p in {q for _, q in want}}


def test_survey_point_and_distance(spark):
    df = geo(spark, sq(0, 2), {"type": "LineString", "coordinates": [[0, 0], [1, 1], [5, 5]]})
    got = [r.p for r in df.orderBy("id").select(G.survey_point("g").alias("p")).collect()]
    assert got == [[1.0, 1.0], [1.0, 1.0]]
    d = spark.range(1).select(G.metres_apart(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.001)).alias("d"), G.metres_apart(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert d.d == pytest.approx(111) and d.n == 0
    r = geo(spark, {"type": "Point", "coordinates": [1.123456789, -2.5]}).select(G.rounded("g", 2).alias("r")).first().r
    assert r.points == [[1.12, -2.5]]


def test_notes_parse_every_row_once(spark):
    from tablelens.operators import maps as M

    texts = ['{"type":"Point","coordinates":[0,0]}', '{"type":"Curve"}', None, '{"type":"Point","coordinates":[5,5]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", G.from_geojson("text").alias("g"))
    notes = M.geometry_notes(M.attach_geometry(rows, "g", "id"))
    assert {r.code: r.n for r in notes.collect()} == {"point_at_zero": 1, "without_geometry": 2}
    assert "Union" not in notes._jdf.queryExecution().optimizedPlan().toString()


def test_first_polygon_in_rounds(spark, monkeypatch):
    """A point that one round finds is not tried again; points with equal or no id are one."""
    ring = lambda a, w: '{"type":"Polygon","coordinates":[[[%s,0],[%s,0],[%s,4],[%s,4],[%s,0]]]}' % (a, a + w, a + w, a, a)
    areas = spark.createDataFrame([("z", 1, ring(0, 9)), ("b", 2, ring(2, 3)), ("a", 2, ring(2, 3)), ("c", None, ring(7, 1)), ("e", 9, ring(0, 12))], "id string, o int, text string")
    areas = areas.select("id", "o", G.from_geojson("text").alias("g"))
    points = spark.createDataFrame([(1, 3.0, 1.0), (2, 7.5, 1.0), (3, 20.0, 1.0), (4, 8.5, 2.0), (5, 10.0, 1.0), (None, 10.0, 1.0), (None, 7.5, 1.0)], "k int, lon double, lat double")
    sizes, keep = [], S.points_in_polygons
    monkeypatch.setattr(S, "points_in_polygons", lambda p, i, g, left: sizes.append(left.count()) or keep(p, i, g, left))
    for first, some in ((256, [7]), (1, [7, 4, 2])):
        sizes.clear()
        monkeypatch.setattr(S, "FIRST_ROUND", first)
        monkeypatch.setattr(S, "ROUND_GROWTH", 2)
        assert {r.k: r.polygon for r in S.first_polygon(areas, "id", "g", "o", points, "k").collect()} == {1: "z", 2: "c", 4: "z", 5: "e", None: "c"}
        assert sizes[:2] == some[:2]
