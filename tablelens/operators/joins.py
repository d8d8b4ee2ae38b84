"""Joins on a text key, explained before they are run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import join_key, quoted, without_leading_zeros


class JoinBlocked(ValueError):
    """A join that must not be run; ``args[0]`` lists the codes."""


@dataclass(frozen=True)
class JoinSpec:
    left: str
    right: str
    left_key: str
    right_key: str
    how: str = "left"


def key_counts(df: DataFrame, key: str, out: str) -> DataFrame:
    return _counts_with_null(df, key, out).where("key is not null")


def _counts_with_null(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per key, the rows without one as a group of their own."""
    return df.select(join_key(df, key).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias(out))


def analyze_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """One row: cardinality, matched and lost rows on both sides, and the size of the result.

    Each side is read once, for its rows per key; a null key meets no other. The join itself is never built.
    """
    l, r, known = F.col("l"), F.col("r"), F.col("key").isNotNull()
    both = (l > 0) & (r > 0)
    counts = _counts_with_null(left, left_key, "l").join(_counts_with_null(right, right_key, "r"), "key", "full")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    c = F.col
    out = counts.select("key", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")).agg(
        total(F.when(both, l)).alias("matched"),
        total(F.when(known & (r == 0), l)).alias("lost_left"),
        total(F.when(known & (l == 0), r)).alias("unmatched_right"),
        total(F.when(both, l * r)).alias("pairs"),
        F.coalesce(F.max(F.when(both, l)), F.lit(1)).alias("max_left_per_right"),
        F.coalesce(F.max(F.when(both, r)), F.lit(1)).alias("max_right_per_left"),
        total(l).alias("left_rows"),
        total(r).alias("right_rows"),
        total(F.when(~known, l)).alias("null_left"),
        total(F.when(~known, r)).alias("null_right"),
    )
    unmatched_left = c("lost_left") + c("null_left")
    many_left, many_right = c("max_left_per_right") > 1, c("max_right_per_left") > 1
    cardinality = (
        F.when(many_left & many_right, "N:N").when(many_left, "N:1").when(many_right, "1:N").otherwise("1:1")
    )
    return out.select(
        cardinality.alias("cardinality"),
        "left_rows",
        "right_rows",
        "matched",
        unmatched_left.alias("unmatched_left"),
        "unmatched_right",
        "null_left",
        "null_right",
        (c("pairs") + (unmatched_left if how == "left" else F.lit(0))).alias("result_rows"),
        "max_left_per_right",
        "max_right_per_left",
    )


def unmatched_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys that exist on one side only: ``(side, key, n)``."""
    l, r = key_counts(left, left_key, "n"), key_counts(right, right_key, "n")
    lost = lambda a, b, side: a.join(b, "key", "left_anti").select(F.lit(side).alias("side"), "key", "n")
    return lost(l, r, "left").unionByName(lost(r, l, "right"))


def repeated_keys(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    found = key_counts(df, key, "n").where("n > 1").orderBy(F.col("n").desc(), "key")
    return found.limit(top) if top else found


def fan_out(analysis: DataFrame, left_profile: DataFrame, right_profile: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Numeric columns a sum would inflate after the join, with the largest repetition."""
    numeric = lambda p, key: p.where(F.col("type").isin("number", "integer") & (F.col("column") != key))
    spread = lambda p, key, side, name: numeric(p, key).select(
        F.lit(side).alias("side"), "column", analysis.select(name).scalar().alias("repeats")
    )
    found = spread(right_profile, right_key, "right", "max_left_per_right").unionByName(
        spread(left_profile, left_key, "left", "max_right_per_left")
    )
    return found.where("repeats > 1")


def join_warnings(analysis: DataFrame) -> DataFrame:
    """Codes of what to read before confirming."""
    c = F.col
    codes = F.array_compact(
        F.array(
            F.when(c("cardinality") == "N:N", "many_to_many"),
            F.when(c("matched") == 0, "no_match"),
            F.when((c("matched") > 0) & (F.try_divide("unmatched_left", F.greatest(F.lit(1), c("left_rows"))) >= 0.3), "many_lost"),
        )
    )
    return analysis.select(F.explode(codes).alias("code"))


def leading_zero_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Unmatched keys of both sides that differ by leading zeros only; nothing is corrected."""
    lost = unmatched_keys(left, right, left_key, right_key).withColumn("bare", without_leading_zeros("key"))
    l = lost.where("side = 'left'").select("bare", F.col("key").alias("left_key"))
    r = lost.where("side = 'right'").select("bare", F.col("key").alias("right_key"))
    return l.join(r, "bare").where("left_key <> right_key").select("left_key", "right_key")


def blockers(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, long_left: bool = False, long_right: bool = False
) -> list[str]:
    """Structural reasons against a join, known without reading data."""
    found = []
    if long_left:
        found.append("left_is_long_table")
    if long_right:
        found.append("right_is_long_table")
    if left_key not in left.columns:
        found.append(f"missing_left_key:{left_key}")
    if right_key not in right.columns:
        found.append(f"missing_right_key:{right_key}")
    return found


def _renamed(left: list[str], right: list[str], right_name: str) -> dict[str, str]:
    used, names = set(left), {}
    for c in right:
        n, i = (f"{c} ({right_name})" if c in used else c), 2
        while n in used:
            n, i = f"{c} ({right_name} {i})", i + 1
        used.add(n)
        names[c] = n
    return names


def join_tables(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", right_name: str = "right"
) -> DataFrame:
    """Left or inner join; the right key is not repeated and clashing names get the table name.

    Rows without a key match nothing; they go round the join and are added to its result, so they
    are never shuffled. A hot key is left to adaptive skew handling, which splits it without
    changing the result.
    """
    stop = blockers(left, right, left_key, right_key)
    if stop:
        raise JoinBlocked(stop)
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join: {how}")
    names = _renamed(left.columns, [c for c in right.columns if c != right_key], right_name)
    r = right.select(join_key(right, right_key).alias("_right_key"), *[quoted(c).alias(n) for c, n in names.items()]).where("_right_key is not null")
    keyed = left.withColumn("_left_key", join_key(left, left_key))
    matched = keyed.where("_left_key is not null").join(r, F.col("_left_key") == F.col("_right_key"), how).drop("_left_key", "_right_key")
    if how == "inner":
        return matched
    return matched.unionByName(keyed.where("_left_key is null").drop("_left_key"), allowMissingColumns=True)


def apply_joins(tables: dict[str, DataFrame], specs: list[JoinSpec], shaped: set[str] = frozenset()) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Rebuild joins from their recipes; what cannot be rebuilt is listed with the reason.

    A table in ``shaped`` carries one shape per row, so a join that would repeat its rows is refused.
    """
    out, dropped = dict(tables), []
    for s in specs:
        name = f"{s.left} + {s.right}"
        missing = [t for t in (s.left, s.right) if t not in out]
        if missing:
            dropped.append((name, f"missing_table:{missing[0]}"))
            continue
        l, r = out[s.left], out[s.right]
        stop = blockers(l, r, s.left_key, s.right_key)
        if not stop and s.left in shaped:
            sizes = analyze_join(l, r, s.left_key, s.right_key, s.how).first()
            if sizes.result_rows > sizes.left_rows:
                stop = ["repeats_shapes"]
        if stop:
            dropped.append((name, ",".join(stop)))
            continue
        out[name] = join_tables(l, r, s.left_key, s.right_key, s.how, s.right)
    return out, dropped


def known_spelling(rows: DataFrame, name: str, key: Column, known: DataFrame) -> DataFrame:
    """Use the spelling already in use for a key, if there is one. ``known``: ``(key, name)``."""
    spellings = known.where("key is not null").groupBy("key").agg(F.min("name").alias("_known"))
    order = rows.columns
    return (
        rows.withColumn("_key", key)
        .join(spellings, F.col("_key") == F.col("key"), "left")
        .withColumn(name, F.coalesce("_known", quoted(name)))
        .withColumn("is_new", F.col("_known").isNull())
        .select(*[quoted(c) for c in order], "is_new")
    )
