import math
import random
import zlib

import numpy as np
import pytest

from tablelens.llm.embeddings import close_vectors
from tablelens.llm.toxicity import Model, Rates, clean_documents, coordinates, learn, score_toxicity

from . import brute


@pytest.fixture(scope="module")
def marked(spark):
    pick = random.Random(11)
    plain = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(400)]
    rude = ["blimpish", "grottle", "snarfing", "vexolent"]
    rows, labels = [], []
    for i in range(1500):
        w = [pick.choice(plain) for _ in range(pick.randint(5, 60))]
        toxic = int(pick.random() < 0.2)
        for _ in range(pick.randint(1, 3) if toxic else 0):
            w.insert(pick.randrange(len(w)), pick.choice(rude) + pick.choice(["", "s", "ly"]))
        rows.append((i, " ".join(w), "l"))
        labels.append((i, toxic, 0))
    rows += [(None, "grottle snarfing", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "grottle " * 9000, None), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 0), (7, None, 1), (8, 0, 0)], "doc_id long, toxic int, quality int")


def test_held_out_toxicity(marked):
    docs, labels = marked
    truth = {r.doc_id: r.toxic for r in labels.dropna().collect()}
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in unseen]
    assert len(right) > 200 and np.mean(right) > 0.97
    odd = {r.doc_id: r for r in rows}
    assert odd[None].predicted == 1 and odd[5002].predicted == 1 and odd[5000].score == odd[5001].score < 0.5


def test_labels_of_held_out_rows_are_never_learned(marked):
    docs, labels = marked
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic", "quality")
    one, two = ({(r.doc_id, r.score) for r in score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_clean_documents_stay_whole(marked, no_docs):
    docs, labels = marked
    scores = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    kept = clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}
    assert clean_documents(no_docs, labels).count() == 0
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


def test_coordinates_are_distinct_and_never_the_bias():
    for text in [None, "", "a", "a b", "a b c a b c", "É " * 1000]:
        x = coordinates(text)
        assert len(set(x.tolist())) == len(x) and (x > 0).all() and (x < 2**20).all()


# ------------------------------------------------------------------ embeddings


def vector_expected(rows):
    good = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        scaled = np.array(v, float) / max(map(abs, v)) if ok else None
        good.append(scaled / np.linalg.norm(scaled) if ok else None)
    link = lambda i, j: good[i] is not None and good[j] is not None and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9
    groups = brute.reach(len(rows), link)
    return [(i, sum(link(k, j) for j in range(len(rows)) if j != k), brute.least([rows[j][0] for j in g])) for k, ((i, _), g) in enumerate(zip(rows, groups))]


@pytest.mark.parametrize("cell", [2048, 16])
def test_vectors_match_brute_force(spark, cell):
    pick = np.random.default_rng(9)
    rows = [(10 * i, pick.standard_normal(24).tolist()) for i in range(150)]
    for i in range(120):
        base = np.array(rows[i % 12][1])
        rows.append((5 + 10 * i, (base + 0.12 * pick.standard_normal(24) * (1 + i % 3)).tolist()))
    rows += [(9001, rows[0][1]), (9002, [3 * x for x in rows[0][1]]), (9003, None), (9004, []), (9005, [0.0] * 24), (9006, [float("nan")] * 24), (9007, [float("inf")] + [1.0] * 23)]
    rows += [(9008, [None] + [1.0] * 23), (9009, rows[1][1][:5]), (9010, rows[1][1][:5]), (None, rows[2][1]), (9011, [1e200 * x for x in rows[3][1]]), rows[4], rows[4]]
    frame = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id long, embedding array<double>, kept string, label int").repartition(5)
    got = [(r.vec_id, r.n_links, r.component_id) for r in close_vectors(frame, cell=cell).collect()]
    want = vector_expected([(i, v) for i, v in rows])
    assert len(got) == len(want)
    found, total = sum(n for _, n, _ in got), sum(n for _, n, _ in want)
    assert total > 500 and 0.9 * total <= found <= total
    allowed = {}
    for i, n, c in want:
        allowed.setdefault(i, []).append((n, c))
    assert all(n <= max(a for a, _ in allowed[i]) for i, n, _ in got)
    if found == total:
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_an_empty_table_of_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert close_vectors(frame).count() == 0
    alone = spark.createDataFrame([(1, None, 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, close_vectors(alone).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_on_given_vectors(spark):
    """All given vectors, and for every second one a copy with noise, whose cosine is 0.87 to 1; the index has the query's own number of pivots."""
    pick = np.random.default_rng(7)
    given = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], float)
    given /= np.linalg.norm(given, axis=1, keepdims=True)
    noise = pick.standard_normal(given[::2].shape) / np.sqrt(given.shape[1])
    vectors = np.concatenate((given, given[::2] + noise * pick.uniform(0, 0.55, (len(noise), 1))))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.concatenate([(units[at : at + 1_024] @ units.T >= 0.9).sum(axis=1) - 1 for at in range(0, len(units), 1_024)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in close_vectors(frame).collect()}
    found = np.array([got[i] for i in range(len(vectors))])
    assert want.sum() > 1_000 and (found <= want).all() and found.sum() >= 0.9 * want.sum()
    print("recall", found.sum() / want.sum())


def test_recall_of_a_second_vector_length(spark):
    """Vectors of the less common length meet by fixed directions instead of pivots of their own."""
    pick = np.random.default_rng(5)
    common, base = pick.standard_normal((400, 16)), pick.standard_normal((60, 24))
    other = base[pick.integers(0, len(base), 300)] + pick.standard_normal((300, 24)) * 0.15
    rows = [(i, v.tolist()) for i, v in enumerate([*common, *other])]
    units = other / np.linalg.norm(other, axis=1, keepdims=True)
    want = (units @ units.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in close_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = [got[400 + i] for i in range(300)]
    assert want.sum() > 500 and all(a <= b for a, b in zip(found, want)) and sum(found) >= 0.9 * want.sum()


def test_learning_equals_plain_ftrl():
    """Weights of the same rows from dictionaries and one coordinate at a time."""
    pick = random.Random(21)
    rows = [np.array(sorted(pick.sample(range(1, 200), pick.randint(0, 30))), np.int32) for _ in range(300)]
    labels = np.array([float(pick.random() < 0.3 + 0.4 * (5 in r)) for r in rows])
    rates, prior = Rates(), -0.7
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= rates.l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * rates.l1) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(rates.passes):
        for row, label in zip(rows, labels):
            here = {i: weight(i) for i in [0, *row.tolist()]}
            gradient = 1.0 / (1.0 + math.exp(-(prior + sum(here.values())))) - label
            for i, w in here.items():
                old = n.get(i, 0.0)
                n[i] = old + gradient * gradient
                z[i] = z.get(i, 0.0) + gradient - (math.sqrt(n[i]) - math.sqrt(old)) / rates.alpha * w
    got, squares = learn(rows, labels, prior, rates, 8)
    assert any(weight(i) for i in range(1, 200))
    assert all(abs(got[i] - weight(i)) < 1e-9 and abs(squares[i] - n.get(i, 0.0)) < 1e-9 for i in range(200))
    texts = ["", "a b c", "b c d e f"]
    w = np.zeros(256)
    w[np.arange(200)] = got[:200]
    at = np.flatnonzero(w)
    score = Model(prior, at, w[at], 8).scorer()
    for text in texts:
        total = prior + w[0] + sum(w[i] for i in coordinates(text, 8).tolist())
        assert abs(score(text) - 1.0 / (1.0 + math.exp(-total))) < 1e-9
