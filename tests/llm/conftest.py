import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, _row string, digest string"


@pytest.fixture(scope="session")
def sample():
    """Texts with copies, near copies, shared passages, nulls, blanks, ties, repeated rows and long runs."""
    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [prose(pick.randint(1, 90)) for _ in range(60)]
    texts += [prose(8) + " " + passage + " " + prose(5) for _ in range(8)] + [base] * 12
    for _ in range(12):
        w = base.split(" ")
        w[pick.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += ["", None, " ", "\t\n \x0b", " a  b", " a b", " a\tb", "A B C", "a b c", "x" * 30_000, "no\xa0break\x85here \x1cyes", prose(5_000)]
    pick.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5], (None, base), (None, prose(30)), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, sample):
    """The sample as a table with further columns, some of them named like the operators' own."""
    rows = [(i, t, None if n % 7 == 0 else "en", None if n % 11 == 0 else f"s{n % 4 if n % 3 else 0}", len(t or ""), "k", "z", "r", "d") for n, (i, t) in enumerate(sample)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
