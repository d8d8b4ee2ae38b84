"""The query that finds near-duplicates among ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.embeddings import close_vectors
from tablelens.llm.registry import query


@query("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_vectors(read_table(spark, sf_dir, "embeddings"))
