import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tablelens.llm import sentencepiece_table, token_counts
from tablelens.llm.bpe_arrays import MergeTable, merge_all
from tablelens.llm.queries_tokens import encoded
from tablelens.llm.sentencepiece_table import PieceModel, encode_documents
from tablelens.llm.token_counts import WordCounter, count_tokens

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    pick = random.Random(1)
    pool = "aAbéßİΣσ ▁  \t\n<0x0A>|endoftext|><s></s>12'sll日本語ﬁé\x85 \x1c\x1d😀̇Å"
    fixed = ["", " ", "   ", "▁", "<|endoftext|>", "a<|startoftext|>b", "ab'll", "ΑΣ ΣΑΣ", "a" * 34, "x" * 9000, "ab" * 3000, "\x00a", " leading", "trailing "]
    return fixed + ["".join(pick.choice(pool) for _ in range(pick.randint(1, 60))) for _ in range(800)]


def test_sentencepiece_agrees_with_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    ids, decoded = PieceModel(PIECES).encode(texts)
    for text, own, out in zip(texts, ids, decoded):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert own.tolist() == want and out == library.decode(want), text


def test_token_counts_agree_with_the_library():
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    assert WordCounter(WORDS).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_counts_as_in_the_library():
    """Alone, in a word and before combining marks; and texts from all of Unicode."""
    library, own, pick = Tokenizer.from_file(WORDS), WordCounter(WORDS), random.Random(3)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b {c} {c}\u0316\u0301x" for c in points] + ["".join(pick.choice(points) for _ in range(pick.randint(1, 30))) for _ in range(20_000)]
    latin = points[:0x260]
    texts += ["".join(pick.choice(latin) for _ in range(pick.randint(1, 30))) for _ in range(20_000)]
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        assert own.count(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_tables_start_anew_without_changing_results(monkeypatch):
    texts = odd_texts()[:200]
    want, counts = PieceModel(PIECES).encode(texts), WordCounter(WORDS).count(texts)
    for module in (sentencepiece_table, token_counts):
        monkeypatch.setattr(module, "REMEMBERED", 20)
        monkeypatch.setattr(module, "TOGETHER", 10)
    got = PieceModel(PIECES).encode(texts)
    assert [x.tolist() for x in got[0]] == [x.tolist() for x in want[0]] and got[1] == want[1]
    assert WordCounter(WORDS).count(texts) == counts


def test_merging_in_step_equals_merging_one_by_one():
    pick = random.Random(7)
    table = {(0, 0): (0, 3), (0, 1): (1, 4), (3, 3): (2, 5), (4, 2): (3, 6), (2, 2): (4, 7), (6, 7): (5, 8)}
    arrays = MergeTable(*(np.array(x) for x in zip(*((a, b, r, m) for (a, b), (r, m) in table.items()))))

    def single(s):
        s = list(s)
        while True:
            found = [(table[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in table]
            if not found:
                return s
            _, i = min(found)
            s[i : i + 2] = [table[s[i], s[i + 1]][1]]

    rows = [[pick.randrange(3) for _ in range(pick.randint(1, 15))] for _ in range(500)] + [[0] * 1000]
    flat, counts = merge_all(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]), arrays)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [single(r) for r in rows]


def test_queries_over_rows(docs, no_docs, sample):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in sample:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted(map(tuple, encoded(docs).collect()), key=repr) == sorted(want, key=repr)
    words = Tokenizer.from_file(WORDS)
    counts = [len(e.ids) for e in words.encode_batch([t or "" for _, t in sample], add_special_tokens=False)]
    want = [(i, len((t or "").encode()), n, n > 50) for (i, t), n in zip(sample, counts)]
    assert sorted(map(tuple, count_tokens(docs, WORDS, limit=50).collect()), key=repr) == sorted(want, key=repr)
    assert encode_documents(no_docs, PIECES).count() == 0 and count_tokens(no_docs, WORDS).count() == 0
