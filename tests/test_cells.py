"""Cell tables out of delimited files, and points in crowded cells."""

import random

import pytest
from pyspark.sql import functions as F

from tablelens.functions import geometry as G
from tablelens.operators import spatial as S
from tablelens.operators.grids import block_texts, block_values, blocks
from tablelens.sources.files import read_cells


def cells(spark, path, **options):
    return sorted((r.row, r.col, r.text) for r in read_cells(spark, str(path), **options).collect())


def test_cells_of_quotes_blank_lines_and_encodings(spark, tmp_path):
    text = '﻿Título da folha\r\n\r\na;b;c\r\n"x;1";" y ""z"" ";\r\n;; 3 \r\n"open;q;r\r\nn"o;"";w\r\n'
    want = [(0, 0, "Título da folha"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c"), (3, 0, "x;1"), (3, 1, 'y "z"'), (4, 2, "3"), (5, 0, "open;q;r"), (6, 0, 'n"o'), (6, 2, "w")]
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert cells(spark, tmp_path / "a.csv", separator=";") == want
    (tmp_path / "b.csv").write_bytes(text.lstrip("﻿").encode("windows-1252"))
    assert cells(spark, tmp_path / "b.csv", separator=";") == want
    (tmp_path / "c.csv").write_text("a|b\tc\n1|2\t3\n")
    assert cells(spark, tmp_path / "c.csv") == [(0, 0, "a|b"), (0, 1, "c"), (1, 0, "1|2"), (1, 1, "3")]
    assert cells(spark, tmp_path / "c.csv", separator="|")[1] == (0, 1, "b\tc")
    (tmp_path / "d.csv").write_text("\n\n")
    assert cells(spark, tmp_path / "d.csv") == []


def test_lines_are_numbered_over_splits(spark, tmp_path):
    pick = random.Random(1)
    for name in "xy":
        (tmp_path / f"{name}.csv").write_text("\n".join(f"{n},{'w' * pick.randint(0, 9)}" if n % 10 else "" for n in range(3_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = read_cells(spark, str(tmp_path)).where("col = 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2 * 2_700 and all(str(r.row) == r.text for r in got) and len({r.sheet_id for r in got}) == 2


def test_blocks_of_a_text_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Relatório;;\n\nAno;Casos;Obs\n2020;3;a\n2021;4;b\n\nNota de rodapé\n\nMes;N;X\n1;5;\n2;6;z\n")
    got = read_cells(spark, str(tmp_path))
    assert [(r.block, r.kind) for r in blocks(got).orderBy("block").collect()] == [(1, "context"), (2, "table"), (3, "context"), (4, "table")]
    assert {r.text for r in block_texts(got).collect()} == {"Relatório", "Nota de rodapé"}
    values = {(r.block, r.row, r.name): r.text for r in block_values(got).collect()}
    assert values[2, 3, "Casos"] == "3" and values[4, 10, "X"] == "z" and len(values) == 11


@pytest.mark.parametrize("spots", [100_000, 50])
def test_a_crowded_cell_is_split_and_counts_stay(spark, monkeypatch, spots):
    monkeypatch.setattr(S._matches, "__defaults__", (spots,))
    ring = lambda x, y, w: f'{{"type":"Polygon","coordinates":[[[{x},{y}],[{x + w},{y}],[{x + w},{y + w}],[{x},{y + w}],[{x},{y}]]]}}'
    squares = [(i, float(i), 0.0, 0.9) for i in range(20)] + [(90, 0.1, 0.1, 0.5), (91, -50.0, -50.0, 60.0)]
    areas = spark.createDataFrame([(i, ring(x, y, w)) for i, x, y, w in squares], "id long, json string").withColumn("geometry", G.from_geojson("json"))
    pick = random.Random(3)
    places = [(pick.uniform(0, 1), pick.uniform(0, 1)) for _ in range(1_000)] + [(pick.uniform(-60, 60), pick.uniform(-60, 60)) for _ in range(500)]
    out = S.count_points(areas, "id", "geometry", spark.createDataFrame(places, "lon double, lat double"))
    want = {i: sum(x < a < x + w and y < b < y + w for a, b in places) for i, x, y, w in squares}
    assert {r.id: r.points for r in out.collect()} == want


def test_a_geometry_is_parsed_once(spark):
    areas = spark.range(3).withColumn("json", F.lit('{"type":"Point","coordinates":[1,2]}')).withColumn("geometry", G.from_geojson("json"))
    points = spark.range(5).select(F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    plan = S.points_in_polygons(areas.union(areas), "id", "geometry", points)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_no_round_without_points(spark, monkeypatch):
    ring = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'
    areas = spark.range(600).withColumn("geometry", G.from_geojson(F.lit(ring)))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.25, 0.75)], "p long, lon double, lat double")
    rounds, met = [], S.points_in_polygons
    monkeypatch.setattr(S, "points_in_polygons", lambda *a, **k: rounds.append(1) or met(*a, **k))
    assert {(r.p, r.id) for r in S.first_polygon(areas, "id", "geometry", "id", points, "p").withColumnRenamed("polygon", "id").collect()} == {(1, 0), (2, 0)}
    assert len(rounds) == 1


def test_cells_are_not_sent_through_the_driver(spark, monkeypatch):
    # few bytes of polygons make any number of cells, which Spark takes for few as well
    x, y = (F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")
    corner = lambda a, b: F.array(x + 9.5 * a, y + 9.5 * b)
    ring = F.to_json(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    areas = spark.range(35).withColumn("geometry", G.from_geojson(F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))))
    points = spark.range(4_000).select((F.col("id") % 80 / 5 + 0.1).alias("lon"), (F.col("id") % 50 / 4 + 0.1).alias("lat"))
    plans, cut = [], S.cut_lineage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    out = S.count_points(areas, "id", "geometry", points)
    assert not [p for p in [*plans, plan(out)] if "Broadcast" in p]
    at = [(n % 80 / 5 + 0.1, n % 50 / 4 + 0.1) for n in range(4_000)]
    want = {i: sum(i % 7 < a < i % 7 + 9.5 and i % 5 < b < i % 5 + 9.5 for a, b in at) for i in range(35)}
    assert {r.id: r.points for r in out.collect()} == want


@pytest.mark.parametrize("few", [64, 2])
def test_cells_inside_a_polygon_count_as_a_whole(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    pick = random.Random(8)
    # a ring with a hole, a slanted triangle, two that overlap it, and places on edges and corners
    hole = '{"type":"Polygon","coordinates":[[[0,0],[16,0],[16,16],[0,16],[0,0]],[[4,4],[12,4],[12,12],[4,12],[4,4]]]}'
    shapes = [hole, '{"type":"Polygon","coordinates":[[[-20,-7],[21,3],[2,19],[-20,-7]]]}', '{"type":"Polygon","coordinates":[[[1,1],[2,1],[2,2],[1,2],[1,1]]]}']
    areas = spark.createDataFrame(list(enumerate(shapes)), "id long, json string").withColumn("geometry", G.from_geojson("json"))
    places = [(pick.uniform(-25, 25), pick.uniform(-25, 25)) for _ in range(3_000)] + [(float(x), float(y)) for x in range(-2, 18) for y in range(-2, 18)]
    points = spark.createDataFrame(places + places[:500], "lon double, lat double")
    pairs = S.points_in_polygons(areas, "id", "geometry", points)
    want = {r.polygon: r.n for r in pairs.groupBy("polygon").agg(F.count(F.lit(1)).alias("n")).collect()}
    tested, test = [], S._matches
    monkeypatch.setattr(S, "_matches", lambda cells, *a: tested.append(test(cells, *a)) or tested[-1])
    assert {r.id: r.points for r in S.count_points(areas, "id", "geometry", points).collect()} == want
    assert tested[0].count() < pairs.select("polygon", "lon", "lat").distinct().count()
    inside = pairs.select("lon", "lat").distinct().join(points, ["lon", "lat"]).count()
    assert S.point_coverage(areas, "id", "geometry", points).first()[:] == (inside, len(places) + 500 - inside, 0)
