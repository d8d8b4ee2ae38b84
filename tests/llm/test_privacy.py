import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tablelens.llm.pii import base_spans, personal_data, risky_terms, sanitised, term_key

from . import brute

TEXTS = [
    "a@b.c%d@e.f@g.h x@y.z", "1 " * 3000, "9" * 9000 + "@" + "a" * 9000, None, "", "4111 1111 1111 1111, +1 (499) 555-6503 300.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.1",
    "😀 é@x.y 4111-1111-1111-1111é", "+1+2 345 678 901 2345", "1.2.3.4@host.example.org", "+" * 500, "4111  1111 1111 1111",
]


def test_base_spans_match_brute_force(spark, no_docs):
    pick = random.Random(3)
    pool = "0123456789  --..++()@ab%é😀"
    rows = list(enumerate(TEXTS + ["".join(pick.choice(pool) for _ in range(pick.randint(0, 80))) for _ in range(1500)]))
    rows += [rows[5], (None, "me@here.org"), (None, None)]
    frame = spark.createDataFrame([(i, t, "b", "a") for i, t in rows], "doc_id long, text string, base string, added string").repartition(4)
    got = sorted(((r.doc_id, r.text, [(s.kind, s.start, s.end) for s in r.base]) for r in personal_data(frame).collect()), key=repr)
    assert got == sorted(((i, t or "", brute.private(t)) for i, t in rows), key=repr)
    assert personal_data(no_docs).count() == 0


def test_disclosing_terms_follow_the_counts(spark):
    """A name that only occurs beside one address gives it away; a common word beside it does not."""
    common = ["the", "and", "with", "from", "over"]
    pick = random.Random(8)
    rows = [(i, " ".join(pick.choice(common) for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, f"the zephyrine writes from zed@mail.org and over {pick.choice(common)}") for i in range(5)]
    rows += [(2000 + i, f"kappish with only{i}@mail.org") for i in range(5)]
    rows += [(3000, "zephyrine far away from the address"), (1001, rows[201][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in personal_data(frame).withColumn("safe", sanitised()).collect()}
    text = dict(rows)
    terms = {i: {text[i][s.start : s.end] for s in r.added} for i, r in out.items()}
    assert all(terms[1000 + i] == {"zephyrine", "writes"} for i in range(5))
    assert all(not terms[i] for i in terms if not 1000 <= i < 1005)  # other entities are too rare, and the term is only marked beside its entity
    safe = {r.doc_id: r.safe for r in out.values()}
    assert "zed@mail.org" not in safe[1000] and "zephyrine" not in safe[1000] and "[EMAIL]" in safe[1000]
    assert safe[3000] == text[3000] and safe[2000] == "kappish with [EMAIL]"


def test_entities_of_one_document_are_judged(spark):
    """A rare word beside an address of one document is generalised; the same word in many documents is not."""
    rows = [(i, "the letter of the day goes to nobody") for i in range(300)] + [(500, "the letter of quillonby to una@post.org"), (501, "the letter to ovid@post.org")]
    out = {r.doc_id: {rows_text[s.start : s.end]: s.kind for s in r.added} for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for rows_text in [r.text]}
    assert out[500] == {"quillonby": "generalise"}
    assert all(not found for i, found in out.items() if i != 500)


def test_context_is_the_whole_text(spark):
    """Counts are of whole texts: far words, short words and words with digits reveal an entity as near ones do."""
    far = " ".join(["the"] * 60)
    rows = [(i, f"the day {far}") for i in range(300)] + [(500 + i, f"zu case77b {far} {'quillonby' if i else far} to una@post.org") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    risky = risky_terms(docs, base_spans(docs).filter("size(base) > 0"))
    term = {r.term: r.word for r in spark.createDataFrame([(w,) for w in ("zu", "case77b", "quillonby", "the", "una", "post", "org", "to")], "word string").select("word", term_key(F.col("word")).alias("term")).collect()}
    got = {(r._id, term[r.term]) for r in risky.collect()}
    assert {w for _, w in got} == {"zu", "case77b", "quillonby", "una", "post", "org", "to"}
    assert {i for i, w in got if w == "case77b"} == {500 + i for i in range(6)} and {i for i, w in got if w == "quillonby"} == {501 + i for i in range(5)}


def test_all_places_in_the_text_are_marked(spark):
    """A revealing name goes wherever it stands in a document with its entity, also in other cases and far away; words of the address itself stay base."""
    far = " ".join(["the"] * 90)
    rows = [(i, f"the day {far} to una") for i in range(300)] + [(500 + i, f"Quillonby, {far} una@post.org {far} QUILLONBY\U0001f600quillonby") for i in range(6)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string")
    out = [r for r in personal_data(docs).withColumn("safe", sanitised()).collect() if r.doc_id >= 500]
    assert len(out) == 7
    for r in out:
        assert [r.text[s.start : s.end] for s in r.added] == ["Quillonby", "QUILLONBY", "quillonby"]
        assert r.safe == f", {far} [EMAIL] {far} \U0001f600" and [s.kind for s in r.base] == ["email"]


def plain_added(rows):
    """Counts, shares and places by hand, in the order of rows."""
    key = lambda kind, value: (kind, value.lower())
    word = re.compile(r"[^\W_]+")
    base = [brute.private(t) for _, t in rows]
    entities = [{key(k, t[a:b]) for k, a, b in found} for (_, t), found in zip(rows, base)]
    terms = [{m[0].lower() for m in word.finditer(t or "")} for _, t in rows]
    c_e, c_t, c_te = Counter(e for x in entities for e in x), Counter(t for x in terms for t in x), Counter((e, t) for x, y in zip(entities, terms) for e in x for t in y)
    assert all(n <= min(c_e[e], c_t[t]) for (e, t), n in c_te.items())
    out = []
    for (_, text), found, held in zip(rows, base, entities):
        kinds = {}
        for m in word.finditer(text or ""):
            term = m[0].lower()
            for e in held:
                rate = c_e[e] / len(rows)
                share = math.log((c_te[e, term] + rate) / (c_t[term] + 1) / rate) / -math.log(rate)
                if share >= 0.8:
                    kinds[term] = "remove" if share >= 0.95 or kinds.get(term) == "remove" else "generalise"
        out.append(sorted((kinds[m[0].lower()], *m.span()) for m in word.finditer(text or "") if m[0].lower() in kinds and not any(a < m.end() and b > m.start() for _, a, b in found)))
    return out


def test_terms_as_by_hand(spark):
    """Shared and lone entities and terms, several in a text, rows that repeat, null ids, one id for several texts."""
    pick = random.Random(9)
    words, people = [f"w{i}x" for i in range(300)], [f"p{i}@mail.org" for i in range(25)]
    rows = []
    for i in range(400):
        said = [pick.choice(words) for _ in range(pick.randint(0, 25))] + [pick.choice(people) for _ in range(pick.choice([0, 0, 1, 2]))]
        said += [f"near{p[1:].split('@')[0]}" for p in said if "@" in p and pick.random() < 0.8] + [f"lone{i}", f"own{i}@post.org"] * (i % 17 == 0)
        pick.shuffle(said)
        rows.append((None if i % 60 == 1 else i % 350, " ".join(said)))
    rows += [rows[0]] * 9 + [rows[17]] * 2 + [rows[61]] * 4 + [(900, "zephyrine zed@far.org")] * 3 + [(901, "zephyrine"), (902, "only zed@far.org"), (903, None), (904, "")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted(((i, t or "", x) for (i, t), x in zip(rows, plain_added(rows))), key=repr)
    assert sum(len(x) for *_, x in want) > 100
    assert sorted(((r.doc_id, r.text, sorted((s.kind, s.start, s.end) for s in r.added)) for r in got), key=repr) == want


def test_a_long_text_with_many_spans(spark):
    """200,000 words and 20,000 addresses in one text end in a bounded time, and every lone word is found."""
    long = " ".join(f"w{i}" if i % 10 else f"u{i // 10}@post.org" for i in range(200_000))
    rows = [(1, long)] + [(i, "the day") for i in range(2, 4_000)]
    out = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "size(base) as b", "size(added) as a").collect()
    assert {r.doc_id: (r.b, r.a) for r in out if r.b}[1] == (20_000, 180_000)
