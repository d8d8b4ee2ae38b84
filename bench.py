"""Headline timings: one JSON line. Results are fully computed and thrown away (``noop``).

"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "win_variation", "prf_lineitem", "prf_outliers", "role_orders", "join_analysis_n1", "join_left", "spatial_count", "agg_sum", "agg_median", "agg_pivot",
    "agg_hist", "win_pareto", "prf_relations", "fn_number_br", "flt_text_search", "src_roundtrip_csv", "cam_facets", "cam_by_locality", "lnk_similar", "lnk_resolve",
    "lnk_duplicates", "geo_classes", "grid_repeated",
]


def shapes(spark, times: int) -> dict[str, float]:
    from pyspark.sql import functions as F

    from tablelens.functions.geometry import from_geojson
    from tablelens.operators import joins, profile, spatial
    from tablelens.session import scratch_path
    from tablelens.sources.files import read_delimited

    took = {}

    def timed(name, make):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[f"{name}_x{times}"] = round(time.perf_counter() - start, 3)
        print(name, times, took[f"{name}_x{times}"], file=sys.stderr, flush=True)

    def kept(frame, name):
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.parquet(path)

    i = F.col("id")
    text = lambda c: c.cast("string")
    table = spark.range(300_000 * times).select(
        text(i).alias("id"), F.concat(F.lit("U"), text(i % 27)).alias("uf"), F.concat(F.lit("Nome "), text(i % 5000)).alias("nome"),
        F.concat(text(i % 900), F.lit(","), F.lpad(text(i % 100), 2, "0")).alias("valor"), F.concat(text(i % 100), F.lit("%")).alias("taxa"),
        F.date_format(F.date_add(F.lit("2020-01-01"), (i % 1500).cast("int")), "yyyy-MM-dd").alias("data"),
        *[text(i % k).alias(n) for n, k in zip("abcdef", (2, 3, 5, 7, 11, 13))],
    )
    path = scratch_path(spark, "bench-csv")
    table.write.option("header", True).option("sep", ";").csv(path)
    timed("csv_read", lambda: read_delimited(spark, path))
    part = kept(table.where(i < 200_000 * times), "bench-profile")
    timed("profile", lambda: profile.profile(part))
    left = kept(spark.range(200_000 * times).select(text(i % (5000 * times)).alias("k"), i.alias("v")), "bench-left")
    right = kept(spark.range(5000 * times).select(text(i).alias("k"), i.alias("w")), "bench-right")
    timed("join_analysis", lambda: joins.analyze_join(left, right, "k", "k"))
    timed("left_join", lambda: joins.join_tables(left, right, "k", "k"))
    n = 5000 * times
    x, y = (i % 100) * 0.1 + F.floor(i / 5000) * 10 % 170, F.floor(i % 5000 / 100) * 0.1
    corner = lambda a, b: F.array((x + a).cast("double"), (y + b).cast("double"))
    ring = F.array(corner(0, 0), corner(0.08, 0), corner(0.08, 0.08), corner(0, 0.08), corner(0, 0))
    shape = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}"))
    areas = kept(spark.range(n).select(i.alias("id"), from_geojson(shape).alias("geometry")), "bench-areas")
    points = kept(spark.range(10_000 * times).select(((i * 37 % 500) / 100).alias("lon"), ((i * 91 % 1000) / 100).alias("lat")), "bench-points")
    timed("points_in_polygons", lambda: spatial.count_points(areas, "id", "geometry", points))
    return took


def main() -> None:
    from catalog import REGISTRY
    from tablelens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"},
    )
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not part of any query
    if sys.argv[1:2] == ["shapes"]:
        took = {}
        for times in map(int, sys.argv[2:] or ["1", "10", "100"]):
            took |= shapes(spark, times)
        spark.stop()
        print(json.dumps({"metric": "baseline_shapes_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}))
        return
    took = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
