"""The query that scores toxicity of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.registry import query
from tablelens.llm.toxicity import score_toxicity


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
