"""The queries and the pipeline on the smallest scale: against SQL, the brute-force versions and the libraries."""

import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tablelens.llm.mixing import mix_sources
from tablelens.llm.queries import QUERIES, SQL
from tablelens.llm.similar_texts import shingle_hashes
from tablelens.llm.toxicity import score_toxicity
from tools.check_oracles import TABLES, normal

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert normal(map(tuple, df.collect()), df.columns) == normal(want.fetchall(), names)


def test_all_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [brute.fingerprint(t) for _, t in rows]
    groups = brute.reach(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = {i: (f"{f:016x}", min(rows[k][0] for k in g)) for (i, _), f, g in zip(rows, prints, groups)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, SF).collect()}
    assert got == want


def test_stages_one_by_one(spark, tmp_path):
    """Every stage on what the stage before kept, against plain code."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r.doc_id for r in made.collect())
        assert made.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        if name == "toxicity":
            bad = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
            assert ids == sorted(i for i, _ in before if i not in bad)
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(" ".join(brute.words(f"x{t}x")), i)
            assert ids == sorted(first.values())
        elif name == "simhash_near_dedup":
            sets = [set(shingle_hashes(t).tolist()) for _, t in before]
            groups = brute.reach(len(before), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            want = {min(before[k][0] for k in g) for g in groups}
            assert len(ids) == len(set(ids)) and want <= set(ids) and len(want) < len(before)
            assert len(ids) - len(want) <= 0.1 * (len(before) - len(want))
        elif name == "mix_sources":
            taken = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
            words = {}
            for r in made.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text))
            assert words == {i: n for i, n in taken.items() if n}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = []
            for i, t in before:
                x = library.encode(t or "", add_bos=True, add_eos=True)
                want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()))
            assert sorted(map(tuple, made.collect())) == sorted(want)
        docs = made
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, SF).collect())) == sorted(map(tuple, docs.collect()))
