import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm.components import LINKS, components
from tablelens.llm.exact_dedup import deduplicated, exact_dedup
from tablelens.llm.simhash import close_links, fingerprint, near_duplicates, representatives
from tablelens.llm.substring_dedup import substring_dedup

from . import brute


def as_tuples(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("width, group", [(13, 512), (13, 7), (2, 11), (1, 3)])
def test_substring_matches_brute_force(docs, sample, width, group):
    got = as_tuples(substring_dedup(docs, window=width, group_docs=group), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(brute.substring(sample, width), key=repr)


def test_substring_intervals_are_maximal_and_empty_table_is_empty(docs, no_docs):
    for row in substring_dedup(docs, group_docs=9).collect():
        spans = [tuple(s) for s in row.removed]
        assert sum(b - a for a, b in spans) == row.n_removed
        assert all(b - a >= 13 for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert substring_dedup(no_docs).count() == 0


def exact_expected(sample):
    content = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in sample:
        groups.setdefault(content(t), []).append(i)
    out = []
    for i, t in sample:
        g = groups[content(t)]
        out.append((i, brute.least(g), len(g), i == brute.least(g), hashlib.sha256(content(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_matches_brute_force(docs, sample):
    got = exact_dedup(docs).withColumn("sha", F.lower(F.hex("digest")))
    assert as_tuples(got, "doc_id", "keep_id", "group_size", "kept", "sha") == exact_expected(sample)


def test_exact_never_joins_different_texts_of_one_digest(docs, sample):
    """With a digest that nearly always collides the groups are the same."""
    got = exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary"))
    assert as_tuples(got, "doc_id", "keep_id", "group_size", "kept") == sorted([r[:4] for r in exact_expected(sample)], key=repr)


def test_exact_keeps_whole_rows(docs, no_docs, sample):
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in exact_expected(sample) if r[3])
    assert deduplicated(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


def near_expected(sample):
    prints = [brute.fingerprint(t) for _, t in sample]
    groups = brute.reach(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    return sorted([(i, f, brute.least([sample[k][0] for k in g])) for (i, _), f, g in zip(sample, prints, groups)], key=repr)


def unsigned(rows):
    return sorted([(i, f % 2**64, c) for i, f, c in rows], key=repr)


@pytest.mark.parametrize("cell", [8192, 3])
def test_simhash_matches_brute_force(docs, sample, cell):
    assert unsigned(as_tuples(near_duplicates(docs, cell=cell), "doc_id", "fp", "component_id")) == near_expected(sample)


def test_simhash_fingerprints_agree_on_odd_texts():
    for text in [None, "", " ", "A", "É É É É é", "a b c", "a b c d", "a b c d e", "İ ß \x85 \x1c x\x00y", "Z " * 70_000]:
        assert fingerprint(text) == brute.fingerprint(text)


def test_simhash_representatives(docs, no_docs, sample):
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, c in near_expected(sample) if i == c)
    assert representatives(no_docs).count() == 0


def test_close_links_of_a_dense_group_stay_few(spark):
    """Two thousand fingerprints around one centre: all connected, with far fewer links than pairs."""
    pick = np.random.default_rng(3)
    prints = {0}
    while len(prints) < 2000:
        prints.add(int(sum(1 << int(b) for b in pick.choice(63, 3, replace=False))))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = close_links(frame, cell=500).distinct().collect()
    assert len(links) < 40 * len(prints)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert found.select("component").distinct().count() == 1 and found.count() == len(prints)


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(5, 5), (None, 3), (9, 2), (9, 2), (2, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(1000, 1100)]}, 9: 2, 2: 2}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_have_tasks_by_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1300)] + [(k, 500) for k in range(600, 620)]
    want = {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(1000, 1300)]}, **{k: 500 for k in [500, *range(600, 620)]}}
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        for per_task, most in ((LINKS, 2), (100, 8)):
            found = components(spark.createDataFrame(links, "a long, b long"), per_task=per_task)
            assert {r.node: r.component for r in found.collect()} == want
            assert found.rdd.getNumPartitions() <= most
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
