import itertools
import random

from pyspark.sql import functions as F

from tablelens.functions.values import name_key
from tablelens.operators import duplicates as D
from tablelens.operators import linkage as L
from tablelens.operators.recipe import merge_with


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_similar_spellings(spark):
    words = ["Sertão", "Sertao", "SERTÃO", "Tianguá", "Tiangua"]
    df = spark.createDataFrame([(words[i % 5],) for i in range(40)] + [("Sertao",), ("!!",), ("??",)], "cidade string")
    got = L.similar_spellings(df, ["cidade"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.value)
    assert sorted(map(sorted, groups.values())) == [["SERTÃO", "Sertao", "Sertão"], ["Tiangua", "Tianguá"]]
    assert {r.suggested for r in got if r.component == "sertao"} == {"Sertao"}
    merged = merge_with(df, "cidade", L.similar_spellings(df, ["cidade"]).select(F.col("value").alias("spelling"), "suggested"))
    assert merged.where("cidade = 'Sertao'").count() == 25


def test_components_match_brute_force(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 7))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    parent = {w: w for w in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(words, 2):
        if len(a) >= 5 and len(b) >= 5 and lev(a, b) <= 1:
            parent[find(a)] = find(b)
    want = {}
    for w in words:
        want.setdefault(find(w), set()).add(w)
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    got = {}
    for r in L.similar_spellings(df, ["w"]).collect():
        got.setdefault(r.component, set()).add(r.value)
    assert sorted(map(sorted, got.values())) == want


def test_similar_names(spark):
    df = spark.createDataFrame([("Vila Alfa",), ("Vila Alfas",), ("Vila Alta",), ("Outra",)], "n string").withColumn("k", name_key("n"))
    got = {tuple(sorted(r[:])) for r in L.similar_names(df, "k", "n").collect()}
    assert got == {("Vila Alfa", "Vila Alfas"), ("Vila Alfa", "Vila Alta")}


def test_resolve(spark):
    ref = spark.createDataFrame([("Sítio Beta",), ("Serra(Sede)",), ("Vila Alfa",), ("Vila Alfo",), ("Lagoa do Mato Grande",)], "name string")
    names = ["SITIO BETA", "Sede", "Vila Alfx", "Sitio Bet", "Lagao do Mato Grand", "Nova", "apelido", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.name: (r.resolved, r.how) for r in L.resolve_names(df, "n", ref, aliases={"Apelido": "Vila Alfa"}).collect()}
    assert got == {
        "SITIO BETA": ("Sítio Beta", "exact"),
        "Sede": ("Serra(Sede)", "partial"),
        "Vila Alfx": ("Vila Alfx", "new"),
        "Sitio Bet": ("Sítio Beta", "similar"),
        "Lagao do Mato Grand": ("Lagoa do Mato Grande", "similar"),
        "Nova": ("Nova", "new"),
        "apelido": ("Vila Alfa", "alias"),
    }


def test_duplicates_match_sequential_greedy(spark):
    import math

    rnd = random.Random(11)
    rows = []
    for i in range(220):
        pick = lambda vals, p=0.35: None if rnd.random() < p else rnd.choice(vals)
        placed = rnd.random() > 0.2
        rows.append((
            i, rnd.choice(["x", "y"]), pick(["l1", "l2"], 0.2), pick(["p1", "p2"]), pick(["2024-01-01", "2024-01-02"]), pick(["s", "t"]),
            -4.0 + rnd.randint(0, 9) * 0.00012 if placed else None, -40.0 + rnd.randint(0, 3) * 0.00015 if placed else None,
        ))
    rows += [(1000 + i, "x", "l1", "p1", "2024-01-01", "s", -4.0, -40.0) for i in range(30)]
    cols = "idx int, type string, loc string, prop string, day string, sex string, lat double, lng double"
    df = spark.createDataFrame(rows, cols)
    filled = lambda r: sum(x is not None for x in r[3:6])
    order = sorted(rows, key=lambda r: (-filled(r), r[0]))

    def ok(a, b):
        if a[1] != b[1] or a[2] != b[2]:
            return False
        if any(x and y and x != y for x, y in zip(a[3:6], b[3:6])):
            return False
        if None in (a[6], b[6]):
            return True
        dy, dx = (a[6] - b[6]) * 111000, (a[7] - b[7]) * 111000 * math.cos(a[6] * math.pi / 180)
        return math.hypot(dy, dx) <= 25

    primaries, want = [], {}
    for r in order:
        p = next((p for p in primaries if ok(p, r)), None)
        if p is None:
            primaries.append(r)
        else:
            want[r[0]] = p[0]
    dup = D.find_duplicates(df, "idx", D.completeness(["prop", "day", "sex"]), ["type", "loc"], ["prop", "day", "sex"])
    got = {r.idx: r.duplicate_of for r in dup.collect()}
    assert got == want and len(primaries) > 10
    by_rounds = D.find_duplicates(df, "idx", D.completeness(["prop", "day", "sex"]), ["type", "loc"], ["prop", "day", "sex"], settled=7)
    assert {r.idx: r.duplicate_of for r in by_rounds.collect()} == want
    groups = D.duplicate_groups(dup, df, "idx", "type").collect()
    assert sum(g.copies - 1 for g in groups) == len(want) and not any(g.cross_folder for g in groups)


def test_a_chain_of_neighbours_takes_few_rounds(spark, monkeypatch):
    """Each record is near the one before it only; every second one is a duplicate of its predecessor."""
    cols = "idx int, type string, day string, lat double, lng double"
    chain = spark.createDataFrame([(i, "x", "2024-01-01", -4.0 + i * 0.00018, -40.0) for i in range(1_000)], cols)
    rounds = []
    keep = D._decided
    monkeypatch.setattr(D, "_decided", lambda *a: rounds.append(1) or keep(*a))
    want = {i: i - 1 for i in range(1, 1_000, 2)}
    for settled, most in ((1_000, 1), (100, 12)):
        rounds.clear()
        got = D.find_duplicates(chain, "idx", F.lit(0), ["type"], ["day"], settled=settled)
        assert {r.idx: r.duplicate_of for r in got.collect()} == want
        assert len(rounds) <= most


def test_duplicates_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "idx int, type string, day string, lat double, lng double")
    assert D.find_duplicates(empty, "idx", F.lit(0), ["type"], ["day"]).count() == 0


def test_every_close_pair_shares_a_segment_and_tokens_do_not_grow(spark):
    import random

    from tablelens.operators import linkage as L

    pick = random.Random(12)
    pairs = []
    for _ in range(600):
        n = pick.randint(5, 30)
        ref = "".join(pick.choice("abc ") for _ in range(n))
        edits = 2 if n < 12 else 3
        key = list(ref)
        for _ in range(edits):
            at, kind = pick.randrange(len(key) + 1), pick.randrange(3)
            key[at : at + (kind > 0)] = [] if kind == 1 else [pick.choice("abcd")]
        pairs.append((ref, "".join(key), edits))
    frame = spark.createDataFrame(pairs, "ref string, key string, edits int")
    for edits in (2, 3):
        rows = frame.where(f"edits = {edits} and length(ref) > {edits}")
        shared = F.size(F.array_intersect(L.segment_tokens(F.col("ref"), edits), L.probe_tokens(F.col("key"), edits)))
        assert rows.where(shared == 0).count() == 0
    sizes = [spark.range(1).select(F.size(L.probe_tokens(F.lit("abcdefghij" * k), 3)).alias("n")).first().n for k in (2, 4, 8)]
    assert max(sizes) <= 196


def test_a_large_block_is_decided_by_areas(spark, monkeypatch):
    """Groups of records far apart need neither keys nor rounds, however many share a block; ties between areas do not arise."""
    cols = "idx int, type string, day string, lat double, lng double"
    spread = spark.createDataFrame([(i, "x", f"2024-01-{1 + i % 3:02d}", -4.0 - (i % 60) * 0.01, -40.0) for i in range(1_200)], cols)
    monkeypatch.setattr(D, "_by_rounds", lambda *a: 1 / 0)
    spots = spread.withColumn("lng", F.col("lng") + F.col("idx") * 1e-9)  # no two records are equal
    got = {r.idx: r.duplicate_of for r in D.find_duplicates(spots, "idx", F.lit(0), ["type"], ["day"], settled=50).collect()}
    assert got == {i: i % 60 for i in range(60, 1_200)}


def test_areas_join_over_cell_borders_and_not_across_blocks(spark):
    import random

    pick = random.Random(5)
    rows = [(i, pick.choice("xy"), pick.choice(["a", "b", None]), -4.0 + pick.randrange(40) * 0.0002, -40.0 + pick.randrange(20) * 0.0002) for i in range(500)]
    df = spark.createDataFrame(rows, "idx int, type string, day string, lat double, lng double")
    found = [{r.idx: r.duplicate_of for r in D.find_duplicates(df, "idx", F.lit(0), ["type"], ["day"], settled=n).collect()} for n in (1_000, 20)]
    assert found[0] == found[1] and len(found[0]) > 50
