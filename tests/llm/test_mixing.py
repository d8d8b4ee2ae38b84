from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablelens.llm.mixing import apportion, cycle_weights, mix_sources, mixed_documents

from . import brute


def targets(sizes):
    """The shares as the rule says: by weight, bounded, the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("shard_docs", [512, 10])
def test_mix_follows_targets(docs, shard_docs):
    rows = mix_sources(docs, shard_docs=shard_docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(brute.words(r.text))
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 * (2 + (shard_docs < 512) * 10), s
    again = mix_sources(docs.repartition(3), shard_docs=shard_docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixed_documents_hold_what_the_plan_takes(docs, no_docs):
    plan, made = mix_sources(docs), mixed_documents(docs)
    assert made.columns == docs.columns
    words = Counter()
    for r in made.collect():
        words[r.doc_id] += len(brute.words(r.text))
    taken = Counter()
    for r in plan.collect():
        taken[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert mixed_documents(no_docs).count() == 0 and mix_sources(no_docs).count() == 0


@pytest.mark.parametrize("shard_docs", [512, 3])
def test_repeated_rows_and_ids_are_written_as_planned(spark, shard_docs):
    """One id in many rows, with equal and other texts; null ids; rows that repeat in everything but a column of their own."""
    rows = [(7, f"w{i % 5} " * (60 + i % 3), "a", i) for i in range(40)] + [(None, "p q r s t " * 8, "a", i) for i in range(30)] + [(i, "x y z " * 9, "b", i) for i in range(200, 230)]
    rows += [(None, f"n{i} m", None, 0) for i in range(20)] + [(9, "all the same " * 7, "b", 1)] * 25
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(4)
    plan, made = mix_sources(frame, shard_docs=shard_docs), mixed_documents(frame, shard_docs=shard_docs).collect()
    assert plan.count() == len(rows)
    want, got, per_row = Counter(), Counter(), Counter()
    for r in plan.collect():
        want[r.doc_id, r.source] += r.taken
    for r in made:
        n = len(brute.words(r.text))
        got[r.doc_id, r.source] += n
        per_row[r.doc_id, r.source, r.extra] += n
    assert got == Counter({k: v for k, v in want.items() if v})
    sizes = Counter()
    for i, t, s, x in rows:
        sizes[i, s, x] += len(t.split())
    assert all(n <= 3 * sizes[k] for k, n in per_row.items())
    again = mixed_documents(frame.repartition(2), shard_docs=shard_docs).collect()
    assert sorted(map(repr, made)) == sorted(map(repr, again))


def test_a_source_without_words_gets_nothing(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z " * 50, "b"), (4, "p q " * 10, None)]
    got = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].target == 0 and got[1].taken == got[2].taken == 0
    assert got[4].target == pytest.approx(170 / 3) and got[3].target == pytest.approx(340 / 3)
    only = spark.createDataFrame(rows[:2], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(only).collect()] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 999])
def test_apportion_is_highest_quotients(spark, seats):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 24.0, "f": 0.0, "g": 700.0}
    most = {k: 400 for k in weights} | {"b": 9, "g": 180}
    ranked = sorted(((-w / (2 * j + 1), k, j) for k, w in weights.items() for j in range(most[k])))
    want = Counter(k for _, k, _ in ranked[:seats])
    table = spark.createDataFrame([("x", k, w, most[k]) for k, w in weights.items()], "grp string, name string, w double, most long")
    got = {r.name: r.quota for r in apportion(table, ["grp"], "name", F.col("w"), F.lit(seats), F.col("most")).collect()}
    if seats <= 100:  # bounds far from the weights' proportion are outside what the operator promises
        assert got == {k: want[k] for k in weights}
    assert sum(got.values()) <= seats


def test_weights_follow_code_points(spark):
    rows = [("aé", 1), ("aZ", 1), ("n", 1), ("a\U0001f600", 1), ("a～", 1)]
    got = {r._key: r.weight for r in cycle_weights(spark.createDataFrame(rows, "_key string, source_size long")).collect()}
    assert got == {"aZ": 5, "aé": 2, "a～": 1, "a\U0001f600": 5, "n": 2}
