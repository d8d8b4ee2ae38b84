import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablelens.llm.lexical_search import accumulate, lexical_search, terms
from tablelens.llm.queries import QUERIES, SQL
from tablelens.llm.vantage_tree import Search, cosines, grow, lengths, nearest_vectors, scaled
from tests.llm.brute import LETTERS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score string, rank string, id string"


def plain_terms(text):
    return TERM.findall((text or "").translate(LETTERS))


def plain_search(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    many, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in plain_terms(text)}
        scores = []
        for i, c, n in counts:
            m = 50 + 50 * n * many // total
            score = sum(math.floor(1000 * math.log((2.0 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


def items_of(sample):
    pick = random.Random(8)
    texts = [t for _, t in sample if t and len(t) < 2_000]
    rows = [(k, " ".join(pick.sample(pick.choice(texts).split(), 1) * 2) + " " + pick.choice(texts)[: pick.randint(1, 80)].upper()) for k in range(30)]
    return rows + [(3, "zz unknown A"), (31, None), (32, ""), (33, "no-such-word"), (None, texts[0]), (None, texts[1]), rows[0], (34, " ".join(texts))]


def test_terms_are_cut_anywhere_alike(monkeypatch):
    pick = random.Random(1)
    for _ in range(300):
        text = "".join(pick.choice("aZ9é 　ß漢 -_.\n\x00\x7f") for _ in range(pick.randint(0, 60)))
        want = [t.encode() for t in plain_terms(text)]
        for piece in (1, 5, 1 << 20):
            monkeypatch.setattr("tablelens.llm.lexical_search.PIECE", piece)
            assert [t for part in terms(text) for t in part] == want


def test_the_limit_on_accumulators_loses_nothing():
    pick, saved = np.random.default_rng(3), 0
    for _ in range(200):
        size, top = 60, 5
        lists = [(np.sort(pick.choice(size, n, replace=False)), pick.integers(1, 5, n) * scale) for n, scale in ((4, 40), (9, 20), (30, 3), (55, 1))]
        whole = np.zeros(size, np.int64)
        for at, value in lists:
            whole[at] += value
        floor = int(np.sort(whole)[-top]) if pick.random() < 0.3 else 0
        found, scores = accumulate(lists, size, top, floor)
        assert (scores == whole[found]).all()
        order = np.lexsort((np.arange(size), -whole))[:top]
        assert set(order) <= set(found)
        saved += np.count_nonzero(whole) - len(found)
    assert saved > 1_000


@pytest.mark.parametrize("options", [{}, {"block": 200, "shard": 40, "top": 3}])
def test_search_as_by_hand(spark, sample, docs, options):
    items = items_of(sample)
    frame = spark.createDataFrame([(*r, "d", "s", "r", "i") for r in items], ITEMS).repartition(3)
    out = lexical_search(docs, frame, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_search(sample, items, options.get("top", 50)), key=repr)


def test_search_of_and_in_nothing(spark, docs, no_docs):
    frame = spark.createDataFrame([(1, "a b", "", "", "", "")], ITEMS)
    assert lexical_search(no_docs, frame).count() == 0
    assert lexical_search(docs, frame.limit(0)).count() == 0
    assert lexical_search(docs.filter("text is null"), frame).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, place string, v string, score string, id string"


def plain_nearest(rows, every=50, top=5):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (i, a) in enumerate(good):
        if i is None or i % every:
            continue
        near = []
        for c, (j, b) in enumerate(good):
            if c != q and len(a) == len(b):
                x, y = scaled(a[None]), scaled(b[None])
                near.append((-cosines(x, y, lengths(x), lengths(y))[0], j is None, j or 0))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(near)[:top])]
    return out


def vector_rows():
    pick = random.Random(6)
    base = [[pick.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, [x + pick.gauss(0, 0.1) for x in pick.choice(base)]) for i in range(400)]
    rows += [(1_000 + i, base[0]) for i in range(30)] + [(2_000 + i, [1.0, float(i), 2.0]) for i in range(1, 60)]
    rows += [(50_000, base[0]), (50_050, [2 * x for x in base[0]]), (50_100, [1e200, 1e199, 0.0]), (50_150, [1e-200, 1e-201, 0.0]), (50_200, [5.0])]
    rows += [(100, None), (150, []), (200, [0.0] * 12), (250, [None] * 12), (300, [float("nan")] * 12), (350, [float("inf")] * 12), (None, base[0]), (None, base[1]), rows[0], rows[50], rows[50]]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 40, "queries": 3}])
def test_nearest_as_by_hand(spark, options):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 1, "p", "v", "s", "i") for i, v in rows], VECTORS).repartition(5)
    out = nearest_vectors(frame, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(plain_nearest(rows), key=repr)


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_vectors(empty).count() == 0
    assert nearest_vectors(spark.createDataFrame([(50, [1.0])], empty.schema)).count() == 0
    two = nearest_vectors(spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.0, -1.0])], empty.schema))
    assert [tuple(r) for r in two.collect()] == [(50, 1, 1, 0.0)]


def test_pruning_by_factor():
    """Factor one finds all and judges fewer pairs than there are; larger factors judge fewer still and keep their bound."""
    pick = np.random.default_rng(2)
    points = pick.standard_normal((3_000, 3))
    queries = pick.standard_normal((40, 3))
    order, nodes, radii = grow(points / lengths(points)[:, None], 16)
    nodes[:, 2] = np.where(nodes[:, 2] >= 0, np.argsort(order)[nodes[:, 2]], -1)
    held, judged, distances = points[order], [], []
    for factor in (1.0, 2.0, 8.0):
        search = Search(held, nodes, radii, np.arange(len(held)))
        score, place = search.find(queries, np.full(len(queries), -1.0), 5, factor)
        judged.append(search.judged)
        distances.append(np.sqrt(np.maximum(0, 2 - 2 * score)))
        if factor == 1.0:
            want = np.sort((queries / lengths(queries)[:, None]) @ (held / lengths(held)[:, None]).T, axis=1)[:, ::-1][:, :5]
            assert np.allclose(score, want, atol=1e-12)
        assert (distances[-1] <= distances[0] * factor + 1e-6).all()
    assert judged[0] < 0.2 * len(points) * len(queries) and judged[0] > judged[1] > judged[2]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_nearest_vectors"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = sorted(con.execute(SQL[name]).fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)
