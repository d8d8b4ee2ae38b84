"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.llm.common import WORD, hashed, packed
from tablelens.session import cut_lineage

BLOCK_TOKENS = 16
EPOCHS = 3
SHARD_DOCS = 512
#: From about FOLD * SHARD_DOCS^2 rows on there are as many shards as the root of FOLD times the rows.
FOLD = 128


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to a table with one row per source (``_key``, ``source_size``, ``weight``).

    All targets together are all sizes together, shared by weight; a target stops at ``epochs`` times its
    source's size and the excess is shared again. Sources reach their bound in the order of bound over
    weight, so running sums in that order settle all rounds at once. The table is one row per source.
    """
    limit = F.col("source_size") * epochs
    everything = W.partitionBy()
    before = W.orderBy("_ratio", "_key").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("_limit", limit.cast("double"))
        .withColumn("_ratio", F.coalesce(F.try_divide(F.col("_limit"), F.col("weight").cast("double")), F.lit(float("inf"))))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything).cast("double"))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_rest_weight", F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("double"))
        .withColumn("_bound", F.coalesce(F.try_divide(F.col("_rest"), F.col("_rest_weight")) >= F.col("_ratio"), F.lit(False)))
        .withColumn("_bound_sum", F.coalesce(F.sum(F.when(F.col("_bound"), F.col("_limit"))).over(everything), F.lit(0.0)))
        .withColumn("_bound_weight", F.coalesce(F.sum(F.when(F.col("_bound"), F.col("weight"))).over(everything), F.lit(0)).cast("double"))
    )
    level = F.try_divide(F.col("_total") - F.col("_bound_sum"), F.col("_weights") - F.col("_bound_weight"))
    target = F.when(F.col("_bound"), F.col("_limit")).otherwise(F.coalesce(F.col("weight").cast("double") * level, F.lit(0.0)))
    return ranked.withColumn("target", target).drop("_limit", "_ratio", "_total", "_weights", "_rest", "_rest_weight", "_bound", "_bound_sum", "_bound_weight")


def apportion(table: DataFrame, group: list[str], member: str, weight: Column, seats: Column, most: Column) -> DataFrame:
    """Adds ``quota``: whole seats per member by highest quotients weight / (2 k + 1), ``most`` at most.

    Rounding at the average divisor comes within half a seat per member of the number of seats, so only the
    quotients near it are listed and ranked: about two for an average member and more for a heavier one.
    Everything below is certain. Ties go to the member that sorts first. ``weight`` in proportion to
    ``most`` or below it, as here, keeps the bounded members within the listed quotients too.
    """
    mine = W.partitionBy(*group)
    near = (
        table.withColumn("_w", weight.cast("double")).withColumn("_most", most.cast("long"))
        .withColumn("_sum", F.sum("_w").over(mine)).withColumn("_members", F.count(F.lit(1)).over(mine))
        .withColumn("_seats", F.least(seats.cast("long"), F.sum("_most").over(mine)))
        .withColumn("_fair", F.coalesce(F.floor(F.try_divide(F.col("_w") * F.col("_seats"), F.col("_sum")) + 0.5), F.lit(0)).cast("long"))
        .withColumn("_reach", (F.lit(4) + F.ceil(F.coalesce(F.try_divide(F.col("_w") * F.col("_members") * 2, F.col("_sum")), F.lit(0.0)))).cast("long"))
        .withColumn("_sure", F.greatest(F.lit(0), F.least(F.col("_most"), F.col("_fair")) - F.col("_reach")))
        .withColumn("_last", F.least(F.col("_most"), F.col("_fair") + F.col("_reach")))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(mine))
    )
    listed = near.filter("_last > _sure").withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1)))
    best = W.partitionBy(*group).orderBy(F.desc("_q"), F.col(member), F.col("_k"))
    won = (
        listed.withColumn("_q", F.col("_w") / (2 * F.col("_k") + 1)).withColumn("_rank", F.row_number().over(best))
        .filter("_rank <= _open").groupBy(*group, member).agg(F.count(F.lit(1)).alias("_won"))
    )
    return near.join(won, [*group, member], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_w", "_most", "_sum", "_members", "_seats", "_fair", "_reach", "_sure", "_last", "_open", "_won")


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by the sources' order (code points, null last), repeating. One row per source."""
    place = F.row_number().over(W.orderBy("_key")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))


def _plan(docs: DataFrame, weigh, id_col: str, text_col: str, source_col: str, block_tokens: int, epochs: int, seed: int, shard_docs: int) -> DataFrame:
    """One row per group of rows with equal id, source and text: its place in its shard's line and what the shard takes.

    Rows of a group stand one after another, ``_n`` of them; so a null or repeated id, however common, is few rows here.
    """
    total = docs.count()
    shards = max(1, min(-(-total // shard_docs), math.ceil(math.sqrt(FOLD * total))))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(source_col))).alias("_key"),
        words_in(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("_text_hash"),
    )
    rows = rows.groupBy("_id", "_key", "size", "_text_hash").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hashed(F.lit(seed), F.col("_id")))
    rows = rows.withColumn("_shard", F.col("_h") % shards)
    blocks = F.when(F.col("_z") > 0, F.greatest(F.lit(1), F.floor(F.col("_z") / block_tokens + 0.5))).otherwise(0).cast("long")
    dealt = cut_lineage(rows.groupBy("_key", "_shard").agg(F.sum(F.col("size") * F.col("_n")).alias("_z")).withColumn("_blocks", blocks))
    sources = dealt.groupBy("_key").agg(F.sum("_z").alias("source_size"), F.sum("_blocks").alias("_source_blocks"))
    sources = target_sizes(weigh(sources), epochs)
    seats = F.floor(F.sum("source_size").over(W.partitionBy()) / block_tokens + 0.5)
    sources = apportion(sources, [], "_key", F.col("target"), seats, F.col("_source_blocks") * epochs).withColumnRenamed("quota", "_source_quota")
    quotas = apportion(
        dealt.join(sources.select("_key", "source_size", "target", "_source_quota"), "_key"), ["_key"], "_shard",
        F.col("_z"), F.col("_source_quota"), F.col("_blocks") * epochs,
    )
    edge = lambda k: F.floor(k * F.col("_z") / F.col("_blocks"))
    whole = F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(0).cast("long")
    start = F.when(F.col("_blocks") > 0, hashed(F.lit(seed), F.col("_key"), F.col("_shard")) % F.greatest("_blocks", F.lit(1))).otherwise(0)
    quotas = quotas.withColumn("copies", whole).withColumn("_more", F.col("quota") - F.col("copies") * F.col("_blocks")).withColumn("_u", start)
    has = F.col("_blocks") > 0
    quotas = quotas.select(
        F.col("_key").alias("_qkey"), F.col("_shard").alias("_qshard"), "source_size", "target", "copies",
        F.when(has, edge(F.col("_u"))).otherwise(0).cast("long").alias("_a1"), F.when(has, edge(F.least(F.col("_u") + F.col("_more"), F.col("_blocks")))).otherwise(0).cast("long").alias("_b1"),
        F.when(has, edge(F.greatest(F.col("_u") + F.col("_more") - F.col("_blocks"), F.lit(0)))).otherwise(0).cast("long").alias("_b2"),
    )
    line = W.partitionBy("_key", "_shard").orderBy("_h", "_id", "size", "_text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_s", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(line), F.lit(0)))
    return placed.join(quotas, (F.col("_key") == F.col("_qkey")) & (F.col("_shard") == F.col("_qshard"))).drop("_qkey", "_qshard", "_h", "_shard")


def _takings(number: Column) -> dict[str, Column]:
    """What is taken of the row with this number (from 0) in its group, besides whole copies."""
    at = F.col("_s") + number * F.col("size")
    within = lambda place: F.least(F.greatest(F.col(place) - at, F.lit(0)), F.col("size"))
    return {"from_1": within("_a1"), "to_1": within("_b1"), "from_2": F.lit(0).cast("long"), "to_2": within("_b2")}


def mix_sources(
    docs: DataFrame, weigh=cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    block_tokens: int = BLOCK_TOKENS, epochs: int = EPOCHS, seed: int = 42, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """What the mix takes of every row: ``id_col, source, size, source_size, target, taken, copies, from_1, to_1, from_2, to_2``.

    A source's documents are dealt by a seeded hash to shards of about ``shard_docs`` rows. Beyond ``FOLD * shard_docs ** 2`` rows
    shards grow as the root of the table, so that neither a shard's line nor a source's ranking of shards gets long. All words make
    blocks of ``block_tokens``; the blocks of the mix go to sources by highest quotients of their targets
    and a source's blocks to its shards by highest quotients of their sizes. A shard lines its documents up
    by the seeded hash, cuts the line into equal blocks, takes every block ``quota // blocks`` times and
    once more the ``quota % blocks`` blocks that follow a seeded place, cyclically; at most two or three
    documents per shard are cut. ``copies`` counts whole takings, ``from_i``/``to_i`` are the words of the
    further, partial or whole one. Nothing is drawn at random at run time, so reruns agree.

    ``weigh`` adds ``weight`` to the table of sources (``_key``, ``source_size``). Null texts have size 0 and
    are taken 0 times; a null source is a source of its own; null ids hash alike and share a shard; rows that
    repeat id, source and text are lined up one after another and counted once until the end. A source whose size is below half a block may get nothing.
    """
    placed = _plan(docs, weigh, id_col, text_col, source_col, block_tokens, epochs, seed, shard_docs)
    placed = placed.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return placed.withColumns(_takings(F.col("_number"))).select(
        F.col("_id").alias(id_col), F.when(F.col("_key") != "n", F.substr(F.col("_key"), F.lit(2))).alias("source"), "size", "source_size", "target",
        (F.col("copies") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2")).alias("taken"), "copies", "from_1", "to_1", "from_2", "to_2",
    )


def mixed_documents(
    docs: DataFrame, weigh=cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    block_tokens: int = BLOCK_TOKENS, epochs: int = EPOCHS, seed: int = 42, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns. A cut copy holds its taken words joined by one space; a text without words is not in it.

    Rows with equal id, source and text are numbered, in the order of their other columns, and each gets what the plan takes of its number; null ids
    and null sources are ids and sources like others. Only rows that repeat in all three meet for that.
    """
    plan = _plan(docs, weigh, id_col, text_col, source_col, block_tokens, epochs, seed, shard_docs)
    last = F.col("_s") + F.col("_n") * F.col("size")
    taken = (F.col("copies") > 0) | (F.least("_b1", last) > F.greatest("_a1", "_s")) | (F.col("_b2") > F.col("_s"))
    plan = plan.filter((F.col("size") > 0) & taken).withColumnsRenamed({"_id": "_pid", "_key": "_pkey", "_text_hash": "_phash"})
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(source_col)))
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_text_hash"))
    rows = rows.join(plan, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_key") == F.col("_pkey")) & (F.col("_text_hash") == F.col("_phash"))).drop("_pid", "_pkey", "_phash")
    others = [F.col("_row").getField(c).cast("string") for c in docs.columns if c != text_col]
    number = F.row_number().over(W.partitionBy("_id", "_key", "_text_hash").orderBy(*others)) - 1
    rows = rows.filter("_n = 1").withColumn("_number", F.lit(0)).unionByName(rows.filter("_n > 1").withColumn("_number", number))
    rows = rows.withColumns(_takings(F.col("_number")))
    extra = F.col("to_1") - F.col("from_1") + F.col("to_2")
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("to_2").cast("int")), F.slice(words, (F.col("from_1") + 1).cast("int"), (F.col("to_1") - F.col("from_1")).cast("int"))), " ")
    times = F.col("copies") + F.when(extra > 0, 1).otherwise(0)
    rows = rows.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    cut = (F.col("_copy") > F.col("copies")) & (extra < F.col("size"))
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    out = own | {text_col: F.when(cut, part).otherwise(F.col("_text"))}
    if "n_chars" in own:
        out["n_chars"] = F.when(cut, F.char_length(part).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[value.alias(c) for c, value in out.items()])
