"""Exact deduplication by skew-safe combining, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import SPACE, packed
from tablelens.session import cut_lineage

SALTS = 64


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    salts: int = SALTS, content: Callable[[Column], Column] = normalised, digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are combined three times, each time by digest *and* full content: within a task (the partial
    aggregate), then per digest and salt, then over the salts. A group of any size thus reaches one task as
    at most one row per salt and task, and no list of members is ever built. Rows find their group again by
    digest alone where all of a digest's texts were found equal, and by digest and content otherwise, so
    colliding digests never join different texts.

    A null text equals an empty one. Of equal texts the smallest id stays; null ids come last, and a group
    of null ids only has a null ``keep_id`` and keeps its rows. Rows that repeat both id and text are the
    same document: each counts in ``group_size`` and each gets the same answer. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), content(F.col(text_col)).alias("_content"))
    rows = rows.withColumn("_digest", digest(F.col("_content")))
    salted = (
        rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_content")
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    groups = salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # by digest without the texts: small, read twice, and the texts' shuffles are over once it is written
    settled = cut_lineage(
        groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents"), F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    )
    answer = [F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("digest")]
    alone = settled.filter("_contents = 1").drop("_contents")
    out = rows.drop("_content").join(alone, "_digest").select(F.col("_id").alias(id_col), *answer)
    clashing = settled.filter("_contents > 1").select("_digest")
    if clashing.isEmpty():
        return out
    told_apart = groups.join(clashing, "_digest", "left_semi")
    return out.unionByName(rows.join(told_apart, ["_digest", "_content"]).select(F.col("_id").alias(id_col), *answer))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows with a null id stay when their group has no other id."""
    kept = exact_dedup(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    mark = options.get("digest", sha256_bytes)(options.get("content", normalised)(F.col(text_col)))
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), mark.alias("_digest"))
    on = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    return rows.join(kept.hint("shuffle_hash"), on, "left_semi").select("_row.*")
