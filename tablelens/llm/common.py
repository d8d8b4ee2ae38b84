"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes handed to a Python worker at a time; whole long texts stay together, so the bytes bound the memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_SHIPPED: set[str] = set()


def batched(spark: SparkSession) -> SparkSession:
    """Before Python runs in tasks: Arrow batches for workers with a few hundred MB, and this package's code on every executor."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tablelens-code-"), "tablelens"), "zip", root, "tablelens")
        context.addPyFile(made)  # Spark copies the code from the driver; no data goes this way
        _SHIPPED.add(context.applicationId)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed(*values: Column) -> Column:
    """A non-negative 32-bit number from the MD5 of the values joined by ``/``; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(v.cast("string"), F.lit("~")) for v in values])), 1, 8), 16, 10).cast("long")


def packed(docs: DataFrame) -> Column:
    """A whole row as one value, so that helper columns never meet a column of the same name."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")
