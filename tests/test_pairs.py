"""Pairs and triples of columns: against plain counting, and the number of scans."""

import random

import numpy as np
import pytest

from tablelens.operators.aggregate import best_correlation
from tablelens.operators.pairs import pair_fits, pair_moments, triple_misses
from tablelens.operators.quality import relations


@pytest.fixture(scope="module")
def table():
    pick = random.Random(5)
    rows = []
    for _ in range(700):
        whole, part = pick.randint(0, 50), pick.randint(0, 30)
        rows.append([None if pick.random() < 0.1 else v for v in (float(whole), float(part), part / whole * 100 if whole else None, 1e9 + pick.gauss(0, 1), 7.0, pick.gauss(0, 5), None)])
    return rows


def scans(spark, run):
    """Jobs that read the table, told by a counter in the scan."""
    before = spark.sparkContext.statusTracker()
    group = f"scan-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(before.getJobIdsForGroup(group))


def test_moments_fits_and_misses(spark, table):
    frame = spark.createDataFrame(table, ", ".join(f"c{i} double" for i in range(7))).repartition(5)
    x = np.array([[np.nan if v is None else v for v in r] for r in table])
    for r in pair_moments(frame).collect():
        a, b = x[:, r.i], x[:, r.j]
        known = ~np.isnan(a) & ~np.isnan(b)
        assert r.n == known.sum()
        if r.n:
            assert np.isclose(r.sxy / r.n - r.sx * r.sy / r.n**2, np.mean((a[known] - a[known].mean()) * (b[known] - b[known].mean())), rtol=1e-6, atol=1e-6)
    for r in pair_fits(frame).collect():
        usable = ~np.isnan(x[:, r.a]) & ~np.isnan(x[:, r.b]) & (x[:, r.b] != 0)
        assert (r.both, r.fits) == (usable.sum(), (usable & (x[:, r.a] <= x[:, r.b])).sum())
    triples = [(p, a, b) for p in range(7) for a in range(7) for b in range(7) if len({p, a, b}) == 3]
    for r in triple_misses(frame, triples, 0.1, 0.005).collect():
        p, a, b = (x[:, k] for k in triples[r.t])
        usable = ~np.isnan(p) & ~np.isnan(a) & ~np.isnan(b) & (b != 0)
        with np.errstate(all="ignore"):
            off = (a > b) | (np.abs(a / b * 100 - p) > np.maximum(0.1, np.abs(p) * 0.005))
        assert (r.n, r.bad) == (usable.sum(), (usable & off).sum())


def test_relations_and_correlation_take_few_jobs_for_many_columns(spark, table, tmp_path):
    wide = [r + [random.Random(i).gauss(0, 1) for i in range(40 * k, 40 * k + 40)] for k, r in enumerate(table)]
    names = ["whole", "part", "taxa", "far", "flat", "noise", "none"] + [f"w{i}" for i in range(40)]
    spark.createDataFrame(wide, ", ".join(f"{n} double" for n in names)).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    found, jobs = scans(spark, lambda: relations(frame, names).collect())
    assert ("taxa", "part", "whole") in {(r.p, r.a, r.b) for r in found} and jobs <= 12
    best, jobs = scans(spark, lambda: best_correlation(frame.selectExpr("*", "far * 2 as twice"), [*names, "twice"]).collect())
    assert [(r.a, r.b) for r in best] == [("far", "twice")] and best[0].r == pytest.approx(1) and jobs <= 6


def test_a_flat_column_has_no_correlation(spark):
    frame = spark.createDataFrame([(0.1, float(i), None if i % 2 else 3.3 + (i == 0)) for i in range(50)], "a double, b double, c double")
    assert best_correlation(frame, ["a", "b"]).count() == 0 and best_correlation(frame, ["a"]).count() == 0
