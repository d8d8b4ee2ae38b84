"""A corpus pipeline: toxic documents go, copies go, one of each near-duplicate group stays, sources are mixed, tokens are made.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that the stage before kept.
``run`` writes each result as Parquet into the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.exact_dedup import deduplicated
from tablelens.llm.mixing import mixed_documents
from tablelens.llm.queries_tokens import encoded
from tablelens.llm.similar_texts import similar_representatives
from tablelens.llm.toxicity import clean_documents
from tablelens.session import configure, scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from ``labels`` as far as they are for documents of this table."""
    return clean_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a five-word-shingle similarity of 0.8 or more, found by their fingerprints, the one with the smallest id stays."""
    return similar_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where a shard's last block ends inside a document, that copy is cut there."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of the mix."""
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("sentencepiece", tokens)]

#: A trained classifier and a tokenizer are not SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
