"""Spellings and names that probably mean the same thing.

Two keys are one edit apart exactly when they agree after masking the same position (one letter
replaced), or when dropping one letter of the longer gives the shorter. Both are equality tests on
derived tokens, so no pairs are enumerated: each token links its members to one hub, and hubs are
closed transitively by connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import name_key
from tablelens.session import cut_lineage

_MASKED = "transform(sequence(1, length(key)), i -> concat('m', i, ':', substring(key, 1, i - 1), '?', substring(key, i + 1)))"
_SHORTER = "transform(sequence(1, length(key)), i -> concat(substring(key, 1, i - 1), substring(key, i + 1)))"


def one_edit_links(keys: DataFrame, min_length: int = 5) -> DataFrame:
    """``(column, a, b)`` links between distinct keys; linked keys are at most one edit from a hub.

    A masked token can hold no more keys than the alphabet has letters, and a dropped-letter token
    no more than alphabet times length, so the groups stay small whatever the data.
    """
    long_enough = keys.where(F.length("key") >= min_length).select("column", "key").distinct()
    masked = long_enough.select("column", "key", F.explode(F.expr(_MASKED)).alias("token"))
    hubs = masked.groupBy("column", "token").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    replaced = masked.join(hubs, ["column", "token"]).where("key <> hub").select("column", F.col("key").alias("a"), F.col("hub").alias("b"))
    shorter = long_enough.select("column", F.col("key").alias("a"), F.explode(F.array_distinct(F.expr(_SHORTER))).alias("b"))
    dropped = shorter.join(long_enough.select("column", F.col("key").alias("b")), ["column", "b"]).select("column", "a", "b")
    return replaced.unionByName(dropped).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(column, key, component)``: the smallest key reachable over the links.

    Every round takes the smallest label among neighbours and then jumps to the label of that
    label, so long chains close in few rounds. Rounds end when nothing changes.
    """
    both = links.unionByName(links.select("column", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.select("column", F.col("a").alias("key")).distinct().withColumn("component", F.col("key")))
    while True:
        near = (
            both.join(labels.select("column", F.col("key").alias("b"), F.col("component").alias("offer")), ["column", "b"])
            .groupBy("column", F.col("a").alias("key"))
            .agg(F.min("offer").alias("offer"))
        )
        stepped = labels.join(near, ["column", "key"], "left").select(
            "column", "key", F.least("component", F.coalesce("offer", "component")).alias("step"), F.col("component").alias("old")
        )
        jump = stepped.select("column", F.col("key").alias("step"), F.col("step").alias("far"))
        moved = cut_lineage(
            stepped.join(jump, ["column", "step"], "left").select(
                "column", "key", F.least("step", F.coalesce("far", "step")).alias("component"), "old"
            )
        )
        changed = moved.where("component <> old").limit(1).count()
        labels = moved.drop("old")
        if not changed:
            return labels


def similar_spellings(df: DataFrame, columns: list[str], min_length: int = 5) -> DataFrame:
    """``(column, component, value, n, suggested)`` for every group of two or more spellings.

    Equal name keys belong together, and so do keys of five letters or more within one edit, as
    far as such links reach. The most frequent spelling is suggested. Values without any letter or
    digit are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(pairs)).where("trim(value) <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("key", name_key("value")).where("key <> ''")
    joined = components(one_edit_links(keyed.select("column", "key"), min_length))
    placed = keyed.join(joined, ["column", "key"], "left").withColumn("component", F.coalesce("component", "key"))
    best = placed.groupBy("column", "component").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("suggested"),
    )
    return placed.join(best.where("spellings > 1"), ["column", "component"]).select("column", "component", "value", "n", "suggested")


def similar_names(names: DataFrame, key: str, name: str, min_length: int = 6) -> DataFrame:
    """Pairs of different known names whose keys are at most one edit apart: ``(a, b)``."""
    known = names.where(F.length(key) >= min_length).groupBy(F.col(key).alias("key")).agg(F.min(name).alias("name"))
    masked = known.select("key", "name", F.explode(F.expr(_MASKED)).alias("token"))
    short = known.select("key", "name", F.explode(F.array_distinct(F.expr(_SHORTER))).alias("token"))
    # a masked token holds at most one key per letter of the alphabet, so its pairs are bounded
    swap = masked.alias("x").join(masked.alias("y"), "token").where("x.key < y.key").select(F.col("x.key").alias("ka"), F.col("y.key").alias("kb"))
    drop = short.join(known.select(F.col("key").alias("token")), "token").select(
        F.least("key", "token").alias("ka"), F.greatest("key", "token").alias("kb")
    )
    pairs = swap.unionByName(drop).distinct()
    a, b = known.select(F.col("key").alias("ka"), F.col("name").alias("a")), known.select(F.col("key").alias("kb"), F.col("name").alias("b"))
    return pairs.join(a, "ka").join(b, "kb").select("a", "b")


# ------------------------------------------------------------------ reference lists

def segment_tokens(key: Column, edits: int) -> Column:
    """The segments of a reference key, ``edits + 1`` of nearly equal length: (length, number, text)."""
    n, parts = F.length(key), edits + 1
    edge = lambda i: F.floor(F.lit(i) * n / parts).cast("int")
    return F.array(*[F.struct(n.alias("length"), F.lit(i).alias("no"), F.substr(key, edge(i) + 1, edge(i + 1) - edge(i)).alias("text")) for i in range(parts)])


def probe_tokens(key: Column, edits: int) -> Column:
    """Where the segments of any reference within ``edits`` edits can stand in a key: (length, number, text).

    One of ``edits + 1`` segments survives that many edits, and at a place shifted by ``edits`` at most. The
    number of tokens depends on the edits only, not on the length of the key.
    """
    parts = edits + 1
    lengths = F.filter(F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda d: F.length(key) + d), lambda n: n >= parts)

    def of_length(n: Column) -> Column:
        edge = lambda i: F.floor(F.lit(i) * n / parts).cast("int")

        def of_segment(i: int) -> Column:
            size = edge(i + 1) - edge(i)
            starts = F.filter(F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda d: edge(i) + d), lambda p: (p >= 0) & (p + size <= F.length(key)))
            return F.transform(starts, lambda p: F.struct(n.alias("length"), F.lit(i).alias("no"), F.substr(key, p + 1, size).alias("text")))

        return F.concat(*[of_segment(i) for i in range(parts)])

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def resolve_names(
    names: DataFrame, name: str, reference: DataFrame, ref_name: str = "name", aliases: dict[str, str] | None = None
) -> DataFrame:
    """``(name, key, resolved, how)`` for every distinct name against a reference list.

    Tried in order: equal key, user alias, the single nearest reference within 2 edits (3 from 14
    letters on), the single reference that contains all longer words, else new. Candidates for
    the edit distance share a segment that the edits cannot all have touched.
    """
    alias = {k: v for k, v in (aliases or {}).items()}
    wanted = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("_nk", name_key("name"))
    if alias:
        table = names.sparkSession.createDataFrame(list(alias.items()), "a string, target string").select(
            name_key("a").alias("_nk"), "target"
        )
        wanted = wanted.join(F.broadcast(table.groupBy("_nk").agg(F.min("target").alias("target"))), "_nk", "left")
    else:
        wanted = wanted.withColumn("target", F.lit(None).cast("string"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wanted = wanted.select(
        "name", F.col("target").isNotNull().alias("aliased"), tidy(F.coalesce("target", "name")).alias("shown")
    ).withColumn("key", name_key("shown"))
    known = (
        reference.select(tidy(F.col(ref_name)).alias("ref"))
        .withColumn("ref_key", name_key("ref"))
        .where("ref_key <> ''")
        .groupBy("ref_key")
        .agg(F.min("ref").alias("ref"))
    )
    # what several steps below start from is made once
    known = cut_lineage(known)
    exact = cut_lineage(wanted.join(known, wanted.key == known.ref_key, "left"))
    found = exact.where("ref_key is not null").select(
        "name", F.col("ref_key").alias("key"), F.col("ref").alias("resolved"), F.when(F.col("aliased"), "alias").otherwise("exact").alias("how")
    )
    open_names = exact.where("ref_key is null").select("name", "key", "shown")
    limit = F.when(F.length("key") >= 14, 3).otherwise(2)

    # nearest: candidates share one segment of the reference, the exact distance decides
    parts = []
    keys = open_names.select("key").distinct().where(F.length("key") >= 5)
    for edits, cond in ((2, "length(key) < 14"), (3, "length(key) >= 14")):
        left = keys.where(cond).withColumn("token", F.explode(probe_tokens(F.col("key"), edits)))
        right = known.select("ref_key", F.explode(segment_tokens(F.col("ref_key"), edits)).alias("token")).where(F.length("ref_key") > edits)
        parts.append(left.join(right, "token").select("key", "ref_key").distinct())
    scored = parts[0].unionByName(parts[1]).withColumn("d", F.levenshtein("key", "ref_key")).where(F.col("d") <= limit)
    closest = scored.groupBy("key").agg(F.min_by(F.struct("ref_key", "d"), F.struct("d", "ref_key")).alias("m"), F.min("d").alias("d"))
    ties = scored.join(closest.select("key", F.col("d").alias("best")), "key").where("d = best").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    near = closest.join(ties.where("c = 1"), "key").select("key", F.col("m.ref_key").alias("near_key"))
    after_near = cut_lineage(open_names.join(near, "key", "left"))
    found_near = after_near.where("near_key is not null").join(known, F.col("near_key") == F.col("ref_key")).select(
        "name", F.col("ref_key").alias("key"), F.col("ref").alias("resolved"), F.lit("similar").alias("how")
    )

    # partial: every longer word of the name is a word of exactly one reference
    rest = after_near.where("near_key is null").select("name", "key", "shown")
    words = F.filter(F.split("key", " "), lambda t: F.length(t) >= 3)
    lookup = rest.select("key").distinct().withColumn("words", F.array_distinct(words)).where(F.size("words") > 0)
    ref_words = known.select("ref_key", F.explode(F.array_distinct(F.split("ref_key", " "))).alias("word"))
    # the rarest word of a name leads to its references, the others only confirm
    commonness = ref_words.groupBy("word").agg(F.count(F.lit(1)).alias("refs"))
    rare = (
        lookup.select("key", "words", F.explode("words").alias("word"))
        .join(commonness, "word", "left")
        .groupBy("key", "words")
        .agg(F.min_by("word", F.struct(F.coalesce("refs", F.lit(0)).alias("refs"), F.col("word"))).alias("word"))
    )
    holds = rare.join(ref_words, "word").where(F.size(F.array_except("words", F.split("ref_key", " "))) == 0)
    single = holds.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("ref_key").alias("hit")).where("c = 1")
    last = rest.join(single, "key", "left").join(known, F.col("hit") == F.col("ref_key"), "left")
    found_rest = last.select(
        "name",
        F.coalesce("ref_key", "key").alias("key"),
        F.coalesce("ref", "shown").alias("resolved"),
        F.when(F.col("ref_key").isNotNull(), "partial").otherwise("new").alias("how"),
    )
    return found.unionByName(found_near).unionByName(found_rest)
