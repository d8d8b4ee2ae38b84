import random

import numpy as np
import pytest

from tablelens.llm.similar_texts import LEVELS, levelled_links, long_fingerprint, parity, plan_blocks, prefix, shingle_hashes, similar_representatives, wide_apart, wide_parity

from . import brute


def alike(a, b):
    a, b = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    return len(a & b) / len(a | b) if a and b else 0.0


def representatives_of(rows):
    groups = brute.reach(len(rows), lambda i, j: rows[i][1] is not None and brute.words(rows[i][1]) and alike(rows[i][1], rows[j][1]) >= 0.8)
    out = []
    for n, g in enumerate(groups):
        i, text = rows[n]
        if not brute.words(text):
            out.append(rows[n])
        elif len(g) == 1:
            out.append(rows[n])
        else:
            known = [rows[k][0] for k in g if rows[k][0] is not None]
            if i == (min(known) if known else None):
                out.append(rows[n])
    return out


def changed(pick, words, share):
    return [pick.choice("abcdefgh") * 3 if pick.random() < share else w for w in words]


@pytest.mark.parametrize("cell", [8_192, 7])
def test_the_smallest_of_each_group_stays(spark, cell):
    pick = random.Random(4)
    prose = lambda n: [f"w{pick.randrange(4_000)}" for _ in range(n)]
    rows, i = [], 0
    for _ in range(40):
        base = prose(pick.choice([3, 30, 200, 900]))
        for _ in range(pick.choice([1, 1, 2, 12])):
            rows.append((i := i + 1, " ".join(changed(pick, base, pick.choice([0, 0.004, 0.02])))))
    rows += [(i + 1 + k, t) for k, t in enumerate(["", None, " ", "\t\n", "one", "ONE", "one two", "One  two", "é È", "é è"])]
    rows += [(None, rows[3][1]), (None, " ".join(prose(50))), (None, None), (9_000, " ".join(prose(60)))]
    rows += [rows[-1], rows[0]]
    order = rows[:]
    pick.shuffle(order)
    frame = spark.createDataFrame([(*r, "f", "n", "k") for r in order], "doc_id long, text string, fp string, node string, _mark string").repartition(4)
    out = similar_representatives(frame, cell=cell)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = sorted(representatives_of(rows), key=repr)
    # a row that repeats in id and text stays as often as it is there
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.05 * len(rows)
    assert similar_representatives(frame.limit(0)).count() == 0


def test_recall_by_similarity(spark):
    """At least nine in ten of the pairs at each similarity from 0.8 on, and none below it."""
    pick = random.Random(2)
    pairs = []
    for share in (0.004, 0.008, 0.012, 0.016, 0.02, 0.024, 0.028):
        for _ in range(60):
            base = [f"w{pick.randrange(50_000)}" for _ in range(pick.choice([60, 150, 400]))]
            pairs.append((" ".join(base), " ".join(changed(pick, base, share))))
    frame = spark.createDataFrame([(2 * k + side, t) for k, p in enumerate(pairs) for side, t in enumerate(p)], "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in similar_representatives(frame).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    found = {}
    for k, (a, b) in enumerate(pairs):
        s = alike(a, b)
        assert s >= 0.8 or 2 * k + 1 in kept
        if s >= 0.8:
            found.setdefault(min(int(s * 20), 19), []).append(2 * k + 1 not in kept)
    assert {16, 17, 18, 19} <= set(found) and all(np.mean(x) >= 0.9 for x in found.values() if len(x) >= 20)


def test_blocks_and_levels():
    for texts in (1, 1_000, 10**6, 10**10):
        places, most = plan_blocks(texts, 0.8)
        assert 2 ** places.shape[1] >= texts and 100 < most < 110 and all(len(set(p)) == len(p) for p in places.tolist())
    pick = np.random.default_rng(1)
    base = long_fingerprint(shingle_hashes("a b c d e f g h i"))
    fps = np.packbits(np.stack([np.where(pick.random(512) < pick.choice([0.01, 0.1, 0.3]), 1 - base, base) for _ in range(40)]), axis=1, bitorder="little").view(np.uint64)
    links = levelled_links(fps, 100)
    away = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    assert all(away(i, j) == d <= 100 for i, j, d in links)
    for level in range(1, LEVELS + 1):
        within = 100 * level // LEVELS
        near = {(i, j) for i, j, d in links if d <= within} | {(j, i) for i, j, d in links if d <= within}
        assert brute.reach(40, lambda i, j: (i, j) in near) == brute.reach(40, lambda i, j: away(i, j) <= within)


@pytest.mark.parametrize("cell", [8_192, 5])
def test_no_pair_at_the_threshold_is_left_out(spark, monkeypatch, cell):
    """Just at the least similarity every pair is found, with a passage that most texts have, in groups of any size, and by chains."""
    monkeypatch.setattr("tablelens.llm.similar_texts.CHUNK", 5_000)
    monkeypatch.setattr("tablelens.llm.similar_texts.SMALL", 6)
    pick = random.Random(6)
    words = lambda n: [f"w{pick.randrange(50_000)}" for _ in range(n)]
    line, texts = words(40), ["one", "ONE", "a b c d e f", "a b c d e g"]
    for k in range(150):
        base = words(pick.choice([20, 60, 150, 400])) + (line if k % 3 else [])
        texts.append(" ".join(base))
        texts += [" ".join(changed(pick, base, pick.choice([0.018, 0.021, 0.024]))) for _ in range(2)]
        texts.append(" ".join(base + words(round(len(base) * pick.choice([0.22, 0.24, 0.26])))))
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    groups = brute.reach(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar_representatives(frame, cell=cell).collect()) == sorted({min(g) for g in groups})


def test_similar_sets_share_an_element_of_their_prefixes():
    pick = np.random.default_rng(3)
    for _ in range(300):
        n = int(pick.integers(1, 200))
        base = pick.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[pick.integers(0, n // 8 + 1) : n + pick.integers(0, n // 8 + 1)])
        late = np.unique(pick.choice(base, n // 2))
        both, differ = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        maps = [np.frombuffer(parity(x), np.uint64) for x in (a, b)]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= differ
        if both >= 0.8 * (both + differ):
            places = pick.permutation(len(late)) + 1
            assert len(np.intersect1d(prefix(a, 0.8, (late, places)), prefix(b, 0.8, (late, places))))


def test_wide_maps_never_differ_more_than_the_sets():
    pick = np.random.default_rng(8)
    for n, m in ((1_025, 1_300), (2_000, 2_100), (5_000, 4_000), (9_000, 1_100), (900, 1_100)):
        base = pick.integers(0, 2**63, n + m).astype(np.uint64)
        for a, b in ((np.unique(base[:n]), np.unique(base[n:])), (np.unique(base[:n]), np.unique(base[n // 10 : n // 10 + m]))):
            apart, limit = wide_apart(wide_parity(a), wide_parity(b)), (len(a) + len(b)) / 9
            assert apart <= len(np.setxor1d(a, b))
            assert apart > limit or min(n, m) <= max(1_024, 0.8 * max(n, m)) or len(np.setxor1d(a, b)) <= 1.5 * limit
