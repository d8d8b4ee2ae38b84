"""Compare every registered query with its SQL on one scale: row count, columns, values."""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            f = float(v)
            return "~" if f != f else repr(round(f, 9) + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, entry, sf_dir):
    t = time.time()
    df = entry.run(spark, sf_dir)
    got, cols = normal([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - t
    if entry.sql is None:
        return "rows", f"{len(got)} rows", took
    res = con.execute(entry.sql)
    names = [x[0] for x in res.description]
    want, wcols = normal(res.fetchall(), names)
    if cols != wcols:
        return "FAIL", f"columns {cols} vs {wcols}", took
    if len(got) != len(want):
        return "FAIL", f"{len(got)} rows vs {len(want)}: {got[:2]} {want[:2]}", took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return "FAIL", f"{len(bad)} rows differ, e.g. {bad[0]}", took
    return "ok", f"{len(got)} rows", took


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--only", default="")
    a = args.parse_args()
    from catalog import REGISTRY
    from tablelens.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    failed = 0
    for name, entry in REGISTRY.items():
        if a.only and not any(name.startswith(x) for x in a.only.split(",")):
            continue
        try:
            state, note, took = compare(spark, con, entry, a.sf)
        except Exception as e:  # noqa: BLE001
            state, note, took = "ERROR", str(e)[:600], 0.0
        failed += state in ("FAIL", "ERROR")
        print(f"{state:5} {name:32} {took:6.2f}s {note}", flush=True)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
