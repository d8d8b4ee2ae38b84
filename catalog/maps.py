"""Geometry and maps on positions taken from the tables."""

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from tablelens.functions import geometry as G
from tablelens.operators import maps as M
from tablelens.operators import spatial as S

# supplier squares and order positions on one plane of degrees
SQUARE_SQL = """sq as (select s_suppkey as id, (s_suppkey * 37 % 340) - 170.0 as x, (s_suppkey * 17 % 150) - 75.0 as y, 0.5 + s_nationkey as w from supplier),
  pt as (select o_orderkey as k, case when o_orderkey % 100 = 0 then null else (o_custkey * 7 % 3600) / 10.0 - 180.03 end as lon, (o_orderkey * 13 % 1900) / 10.0 - 95.02 as lat from orders) """


def squares(spark, d):
    # few bytes make many shapes to parse, so rows are dealt by number
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        F.col("s_suppkey").alias("id"),
        ((F.col("s_suppkey") * 37) % 340 - 170.0).alias("x"),
        ((F.col("s_suppkey") * 17) % 150 - 75.0).alias("y"),
        (F.col("s_nationkey") + 0.5).alias("w"),
    )
    n = {c: F.col(c).cast("double") for c in "xyw"}
    corner = lambda a, b: F.array(n["x"] + n["w"] * a, n["y"] + n["w"] * b)
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}"))
    return s.select("id", *[n[c].alias(c) for c in "xyw"], text.alias("json")).withColumn("geometry", G.from_geojson("json"))


def positions(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderkey") % 100 != 0, ((F.col("o_custkey") * 7) % 3600) / 10.0 - 180.03).cast("double").alias("lon"),
        (((F.col("o_orderkey") * 13) % 1900) / 10.0 - 95.02).cast("double").alias("lat"),
    )


_INSIDE = "lon > x and lon < x + w and lat > y and lat < y + w and abs(lat) <= 90 and abs(lon) <= 180"


@query("spatial_count", "JOI-09", "with " + SQUARE_SQL + f"select id, (select count(*) from pt where {_INSIDE}) as points from sq")
def _(spark, d):
    return S.count_points(squares(spark, d), "id", "geometry", positions(spark, d)).select("id", "points")


@query(
    "spatial_coverage", "JOI-09",
    "with " + SQUARE_SQL + f""", v as (select coalesce(abs(lat) <= 90 and abs(lon) <= 180, false) as ok, exists (select 1 from sq where {_INSIDE}) as hit from pt)
    select count(*) filter (where ok and hit) as inside, count(*) filter (where ok and not hit) as outside, count(*) filter (where not ok) as invalid from v""",
)
def _(spark, d):
    return S.point_coverage(squares(spark, d), "id", "geometry", positions(spark, d))


@query("spatial_first", "JOI-10", "with " + SQUARE_SQL + f"select k, min(id) as polygon from pt join sq on {_INSIDE} group by 1")
def _(spark, d):
    return S.first_polygon(squares(spark, d), "id", "geometry", "id", positions(spark, d), "k")


@query(
    "geo_measures", "GEO-01 GEO-02 GEO-03",
    "with " + SQUARE_SQL + "select id, 'Polygon' as kind, round((w * w)::double, 6) as area, round(x + w / 2, 6) as cx, round(y + w / 2, 6) as cy, round(x::double, 6) as min_lon, round((y + w)::double, 6) as max_lat from sq",
)
def _(spark, d):
    c, b = G.centroid("geometry"), G.bbox("geometry")
    out = squares(spark, d).select(
        "id", F.col("geometry.type").alias("kind"), G.area("geometry").alias("area"), c[0].alias("cx"), c[1].alias("cy"), b["min_lon"].alias("min_lon"), b["max_lat"].alias("max_lat")
    )
    return rounded(out, 6, "area", "cx", "cy", "min_lon", "max_lat")


@query("geo_contains", "GEO-04", "with " + SQUARE_SQL + "select id, w > 5 as inside from sq")
def _(spark, d):
    return squares(spark, d).select("id", G.contains("geometry", F.col("x") + 5, F.col("y") + 0.1).alias("inside"))


@query(
    "geo_validate", "GEO-05 GEO-06",
    """with p as (select c_custkey, case c_custkey % 5 when 0 then 'point_at_zero' when 1 then 'projected' when 2 then 'out_of_range' when 3 then 'short_ring' end as code from customer)
    select code, count(*) as n from p where code is not null group by 1 union all select 'without_geometry', count(*) from p where code is null having count(*) > 0""",
)
def _(spark, d):
    k = F.col("c_custkey")
    # few bytes make much text to parse, so rows are dealt by number
    keys = table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    json = (
        F.when(k % 5 == 0, '{"type":"Point","coordinates":[0,0]}')
        .when(k % 5 == 1, F.concat(F.lit('{"type":"Point","coordinates":[500000.5,'), (k + 2000).cast("string"), F.lit("]}")))
        .when(k % 5 == 2, F.concat(F.lit('{"type":"LineString","coordinates":[[0,1],[200,'), (k % 90).cast("string"), F.lit("]]}")))
        .when(k % 5 == 3, '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}')
        .otherwise(F.concat(F.lit('{"type":"Curve","coordinates":['), k.cast("string"), F.lit("]}")))
    )
    rows = keys.select("c_custkey", G.from_geojson(json).alias("geometry"))
    return M.geometry_notes(M.attach_geometry(rows, "geometry", "c_custkey"))


@query(
    "geo_attach", "GEO-06",
    "with " + SQUARE_SQL + "select concat('g', id) as shape_id, round(y + w / 2, 6) as latitude, round(x + w / 2, 6) as longitude, 'Polygon' as geometry_type from sq",
)
def _(spark, d):
    out = M.attach_geometry(squares(spark, d).select("id", "geometry"), "geometry", "id")
    return rounded(out, 6, "latitude", "longitude").select("shape_id", "latitude", "longitude", "geometry_type")


_BREAKS = """with v as (select list_sort(list({c})) as a, count(*) as n from {t} where {c} is not null),
  b as (select i, case when (i * n) % 5 = 0 then (a[i * n // 5] + a[i * n // 5 + 1]) / 2 else a[cast(floor(i * n / 5.0) as bigint) + 1] end as q, a, n from v, unnest([1, 2, 3, 4]) u(i)),
  k as (select distinct q from b where q > a[1] and q < a[n]) """


@query("geo_breaks", "GEO-07", _BREAKS.format(c="s_acctbal", t="supplier") + "select round(q, 6) as q from k")
def _(spark, d):
    return rounded(M.class_breaks(table(spark, d, "supplier"), "s_acctbal").select(F.explode("breaks").alias("q")), 6, "q")


@query("geo_breaks_repeated", "GEO-07", _BREAKS.format(c="l_quantity", t="lineitem") + "select q from k")
def _(spark, d):
    return M.class_breaks(table(spark, d, "lineitem"), "l_quantity").select(F.explode("breaks").alias("q"))


@query("geo_classes", "GEO-07", _BREAKS.format(c="c_acctbal", t="customer") + "select c_custkey, (select count(*) from k where q < c_acctbal)::int as class from customer")
def _(spark, d):
    return M.classified(table(spark, d, "customer"), "c_acctbal").select("c_custkey", "class")


@query(
    "geo_grid", "GEO-08",
    """select floor(embedding[1] * 100 / 2.0) * 2.0 as lon, floor(embedding[2] * 100 / 2.0) * 2.0 as lat, count(*) as n from embeddings group by 1, 2""",
)
def _(spark, d):
    e = table(spark, d, "embeddings").select((F.col("embedding")[0] * 100).alias("lon"), (F.col("embedding")[1] * 100).alias("lat"))
    return M.grid_counts(e, "lon", "lat", 2.0)


@query("geo_auto_grid", "GEO-08", """with e as (select embedding[1]::double as x, embedding[2]::double as y from embeddings),
    r as (select greatest(max(x) - min(x), max(y) - min(y)) / 20 as raw from e), b as (select raw, pow(10, floor(log10(raw))) as p from r),
    c as (select case when raw <= p then p when raw <= 2 * p then 2 * p when raw <= 5 * p then 5 * p else 10 * p end as cell from b)
    select count(*) as cells, sum(n)::bigint as points from (select floor(x / cell), floor(y / cell), count(*) as n from e, c group by 1, 2)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return M.auto_grid(e, "x", "y").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"))


@query(
    "geo_legend", "GEO-10",
    """with x as (select case when c_custkey % 7 = 0 then null else c_acctbal end as v from customer), """ + _BREAKS.format(c="v", t="x").replace("with ", "", 1)
    + """, t as (select v, (select count(*) from k where q < v)::int as class from x)
    select case when v is null then null else class end as class, count(*) as n from t group by 1""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    return M.legend(c, "v").select("class", "n")


@query(
    "geo_coverage", "GEO-11",
    "with " + SQUARE_SQL + "select count(*) as rows, count(*) filter (where id % 3 = 0 and x + w <= 180 and y + w <= 90) as drawn, count(*) filter (where id % 3 <> 0) as without_geometry, count(*) filter (where id % 3 = 0 and (x + w > 180 or y + w > 90)) as invalid from sq",
)
def _(spark, d):
    rows = squares(spark, d).select(F.when(F.col("id") % 3 == 0, F.col("geometry")).alias("geometry"))
    return M.coverage(rows, "geometry")


@query(
    "geo_flows", "GEO-13",
    "with " + SQUARE_SQL + "select k, case when lon is null or abs(lon) > 180 or abs(lat) > 90 then null when k % 3 = 0 then 'Point' else 'LineString' end as kind from pt",
)
def _(spark, d):
    p = positions(spark, d)
    same = F.col("k") % 3 == 0
    rows = p.select(
        "k", F.col("lat").alias("lat_origem"), F.col("lon").alias("lon_origem"),
        F.when(same, F.col("lat")).otherwise(F.lit(10.0)).alias("lat_destino"), F.when(same, F.col("lon")).otherwise(F.lit(20.0)).alias("lon_destino"),
    )
    return M.with_flows(rows).select("k", F.col("flow.type").alias("kind"))


@query("geo_origin_destination", "GEO-13", "select o_orderstatus as origin, o_orderpriority as destination, count(*) as n, round(sum(o_totalprice::decimal(18,2))::double, 2) as weight from orders group by 1, 2")
def _(spark, d):
    return rounded(M.origin_destination(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), 2, "weight")


@query(
    "geo_territory", "GEO-14",
    _BREAKS.format(c="s_acctbal", t="supplier") + """select s_name as unit, 'Polygon' as geometry_type, s_acctbal as value, (select count(*) from k where q < s_acctbal)::int as class
    from supplier order by s_acctbal desc nulls last, s_name limit 30""",
)
def _(spark, d):
    rows = squares(spark, d).select("id", "geometry").join(table(spark, d, "supplier"), F.col("id") == F.col("s_suppkey"))
    return M.territory(rows, "s_name", "s_acctbal", "geometry", limit=30).select("unit", "geometry_type", "value", "class")


@query("geo_survey_point", "GEO-15", "with " + SQUARE_SQL + "select id, round(x + w / 2, 6) as lon, round(y + w / 2, 6) as lat from sq")
def _(spark, d):
    p = G.survey_point("geometry")
    return rounded(squares(spark, d).select("id", p[0].alias("lon"), p[1].alias("lat")), 6, "lon", "lat")


@query("geo_distance", "GEO-16", "with " + SQUARE_SQL + "select k, round(coalesce(sqrt(pow((lat - 1) * 111000, 2) + pow((lon - 2) * 111000 * cos(radians(lat)), 2)), 0), 3) as metres from pt")
def _(spark, d):
    m = G.metres_apart(F.col("lat"), F.col("lon"), F.lit(1.0), F.lit(2.0))
    return rounded(positions(spark, d).select("k", m.alias("metres")), 3, "metres")


@query("geo_plausible", "GEO-17", "with " + SQUARE_SQL + "select lon between -75 and -30 and lat between -35 and 6 as plausible, count(*) as n from pt group by 1")
def _(spark, d):
    return positions(spark, d).groupBy(G.in_plausible_area(F.col("lon"), F.col("lat")).alias("plausible")).agg(F.count(F.lit(1)).alias("n"))


@query("geo_rounded", "GEO-18", "with " + SQUARE_SQL + "select id, floor(x * 10 + 0.5) / 10 as lon, floor((y + w) * 10 + 0.5) / 10 as lat from sq")
def _(spark, d):
    g = F.col("g")
    rows = squares(spark, d).select("id", G.rounded("geometry", 1).alias("g"))
    return rows.select("id", g["polys"][0][0][0][0].alias("lon"), g["polys"][0][0][2][1].alias("lat"))
