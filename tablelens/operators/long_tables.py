"""Statistics of long tables: period x entity x indicator x situation x subgroup -> Total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.values import number_of, text_of
from tablelens.operators.aggregate import where_lists

# every way to hide one letter of a word
_MASKS = "transform(sequence(1, length({0})), i -> concat(substring({0}, 1, i - 1), '*', substring({0}, i + 1)))"


@dataclass(frozen=True)
class LongSpec:
    """Which columns of a long table play which part."""

    period: str
    entity: str
    value: str = "Total"
    label: str | None = None
    situation: str | None = None
    subgroup: str | None = None


def _sum_where(situation: Column, names: list[str], value: Column) -> Column:
    return F.coalesce(F.sum(F.when(situation.isin(names), value)), F.lit(0.0))


def rate_options(situations: list[str]) -> list[dict]:
    """The two usual rate definitions available among the situation names."""

    def named(stem: str) -> list[str]:
        folded = [(s, s.lower()) for s in situations]
        return [s for s, low in folded if stem in low and "critério" not in low and "criterio" not in low]

    confirmed, discarded, notified = named("confirmad"), named("descartad"), named("notificad")
    options = []
    if confirmed and discarded:
        options.append({"name": "concluded", "numerator": confirmed, "denominator": confirmed + discarded})
    if confirmed and notified:
        options.append({"name": "notified", "numerator": confirmed, "denominator": notified})
    return options


def rate_by_label(
    df: DataFrame,
    x: str,
    situation: str,
    numerator: list[str],
    denominator: list[str],
    value: str = "Total",
    scope: dict[str, list[str]] | None = None,
    numbers: str = "br",
) -> DataFrame:
    """Numerator sum over denominator sum per label, in percent.

    A label needs one filled denominator cell and a positive denominator, otherwise no data.
    """
    rows = df.where(where_lists(df, scope))
    v, s = number_of(rows, value, numbers), text_of(rows, situation)
    sums = (
        rows.select(text_of(rows, x).alias("label"), s.alias("s"), v.alias("v"))
        .where("label is not null")
        .groupBy("label")
        .agg(_sum_where(F.col("s"), numerator, F.col("v")).alias("num"), _sum_where(F.col("s"), denominator, F.col("v")).alias("den"))
    )
    return sums.select("label", F.when(F.col("den") > 0, F.col("num") / F.col("den") * 100).alias("value"))


def funnel(
    df: DataFrame,
    situation: str,
    stages: list[tuple[str, list[str]]],
    value: str = "Total",
    scope: dict[str, list[str]] | None = None,
    numbers: str = "br",
) -> DataFrame:
    """Sum per ordered stage and its percentage of the stage before."""
    rows = df.where(where_lists(df, scope))
    v, s = number_of(rows, value, numbers), text_of(rows, situation)
    sums = rows.select(s.alias("s"), v.alias("v")).agg(
        *[_sum_where(F.col("s"), names, F.col("v")).alias(f"s{i}") for i, (_, names) in enumerate(stages)]
    )
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("stage"),
                F.col(f"s{i}").alias("value"),
                (
                    F.try_divide(F.col(f"s{i}"), F.nullif(F.col(f"s{i - 1}"), F.lit(0.0))) * 100
                    if i
                    else F.lit(None).cast("double")
                ).alias("of_previous"),
            )
            for i, (name, _) in enumerate(stages)
        ]
    )
    return sums.select(F.inline(table))


def bubbles(
    df: DataFrame,
    entity: str,
    situation: str,
    volume: list[str],
    numerator: list[str],
    denominator: list[str],
    size: list[str],
    value: str = "Total",
    scope: dict[str, list[str]] | None = None,
    numbers: str = "br",
) -> DataFrame:
    """Volume, rate and size per entity; entities without a rate or a volume drop out."""
    rows = df.where(where_lists(df, scope))
    v, s = number_of(rows, value, numbers), text_of(rows, situation)
    cells = rows.select(text_of(rows, entity).alias("entity"), s.alias("s"), v.alias("v"))
    sums = cells.groupBy("entity").agg(
        _sum_where(F.col("s"), volume, F.col("v")).alias("volume"),
        _sum_where(F.col("s"), numerator, F.col("v")).alias("num"),
        _sum_where(F.col("s"), denominator, F.col("v")).alias("den"),
        _sum_where(F.col("s"), size, F.col("v")).alias("size"),
    )
    return sums.where("den > 0 and volume > 0").select("entity", "volume", (F.col("num") / F.col("den") * 100).alias("rate"), "size")


def sums_by(df: DataFrame, column: str, value: str = "Total", numbers: str = "br") -> DataFrame:
    rows = df.select(text_of(df, column).alias("label"), number_of(df, value, numbers).alias("v")).dropna()
    return rows.groupBy("label").agg(F.sum("v").alias("value"))


def dominant(df: DataFrame, spec: LongSpec, numbers: str = "br") -> DataFrame:
    """One row: the situation with the largest sum and, within it, the largest subgroup."""
    v = number_of(df, spec.value, numbers)
    s = text_of(df, spec.situation) if spec.situation else F.lit(None).cast("string")
    g = text_of(df, spec.subgroup) if spec.subgroup else F.lit(None).cast("string")
    cells = df.select(s.alias("situation"), g.alias("subgroup"), v.alias("v")).where("v is not null")
    pairs = cells.groupBy("situation", "subgroup").agg(F.sum("v").alias("value"))
    tops = pairs.where("situation is not null").groupBy("situation").agg(F.sum("value").alias("value"))
    # equal sums: the first name wins
    main = tops.orderBy(F.col("value").desc(), "situation").limit(1)
    inside = pairs.where("subgroup is not null")
    if spec.situation:
        inside = inside.join(F.broadcast(main.select("situation")), "situation", "left_semi")
    sub = inside.groupBy("subgroup").agg(F.sum("value").alias("value")).orderBy(F.col("value").desc(), "subgroup").limit(1)
    one = df.sparkSession.range(1)
    return one.select(
        main.select("situation").scalar().alias("main_situation"), sub.select("subgroup").scalar().alias("main_subgroup")
    )


def long_kpis(df: DataFrame, spec: LongSpec, numbers: str = "br") -> DataFrame:
    """Total, top entity, peak period, shares of the other situations, periods x entities.

    Rows ``(position, kpi, label, value, share)``.
    """
    facts = dominant(df, spec, numbers).first()  # two names
    main_s, main_g = facts.main_situation, facts.main_subgroup
    v = number_of(df, spec.value, numbers)
    null_text = F.lit(None).cast("string")
    rows = df.select(
        text_of(df, spec.period).alias("period"),
        text_of(df, spec.entity).alias("entity"),
        (text_of(df, spec.situation) if spec.situation else null_text).alias("situation"),
        (text_of(df, spec.subgroup) if spec.subgroup else null_text).alias("subgroup"),
        v.alias("v"),
    )
    main = F.lit(True)
    if main_s is not None:
        main = main & F.coalesce(F.col("situation") == main_s, F.lit(False))
    if main_g is not None:
        main = main & F.coalesce(F.col("subgroup") == main_g, F.lit(False))
    cells = rows.groupBy("period", "entity", "situation", "subgroup").agg(F.sum("v").alias("v"))

    def best(column: str) -> DataFrame:
        sums = cells.where(main & F.col("v").isNotNull()).groupBy(F.col(column).alias("label")).agg(F.sum("v").alias("value"))
        return sums.orderBy(F.col("value").desc(), "label").limit(1)

    def row(position: int, kpi: str, frame: DataFrame, label: Column, value: Column, share: Column | None = None) -> DataFrame:
        return frame.select(
            F.lit(position).alias("position"),
            F.lit(kpi).alias("kpi"),
            label.cast("string").alias("label"),
            value.cast("double").alias("value"),
            (share if share is not None else F.lit(None).cast("double")).alias("share"),
        )

    total = cells.where(main).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    name = " ".join(x for x in (main_s or "Total", main_g) if x)
    out = row(1, "total", total, F.lit(name), F.col("value"))
    out = out.unionByName(row(2, "top_entity", best("entity"), F.col("label"), F.col("value")))
    out = out.unionByName(row(3, "peak_period", best("period"), F.col("label"), F.col("value")))
    if main_s is not None:
        scope = F.col("subgroup").isNull() | (F.col("subgroup") == F.lit(main_g))
        sums = cells.where(F.coalesce(scope, F.lit(False)) & F.col("v").isNotNull()).groupBy("situation").agg(F.sum("v").alias("value"))
        base = sums.where(F.col("situation") == main_s).select(F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.lit(1.0))).scalar()
        others = (
            sums.where(F.col("situation") != main_s)
            .orderBy(F.col("value").desc(), "situation")
            .withColumn("share", F.col("value") / F.coalesce(base, F.lit(1.0)) * 100)
        )
        out = out.unionByName(row(4, "situation", others, F.col("situation"), F.col("value"), F.col("share")))
    spread = cells.agg(F.count_distinct("period").alias("p"), F.count_distinct("entity").alias("e"))
    out = out.unionByName(row(5, "periods", spread, F.lit("periods"), F.col("p")))
    return out.unionByName(row(6, "entities", spread, F.lit("entities"), F.col("e")))


def emptiness(df: DataFrame, spec: LongSpec) -> DataFrame:
    """Entity and period cells that are wholly (``empty``) or partly (``partial``) without values."""
    cells = df.groupBy(text_of(df, spec.entity).alias("entity"), text_of(df, spec.period).alias("period")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col(f"`{spec.value}`").isNull()).alias("missing")
    )
    return cells.where("missing > 0").withColumn("kind", F.when(F.col("missing") == F.col("cells"), "empty").otherwise("partial"))


def one_letter_apart(names: DataFrame, column: str, min_length: int = 4) -> DataFrame:
    """Pairs of names of equal length that differ in exactly one letter, as star pairs.

    Names are matched on what is left when one position is masked, so every candidate pair
    already differs in that position only; each mask links its names to the smallest one.
    """
    distinct = names.select(F.col(column).alias("name")).dropna().distinct().withColumn("low", F.lower("name"))
    masked = distinct.where(F.length("low") >= min_length).select("name", "low", F.explode(F.expr(_MASKS.format("low"))).alias("mask"))
    hubs = masked.groupBy("mask").agg(F.min(F.struct("low", "name")).alias("hub"), F.count_distinct("low").alias("n")).where("n > 1")
    return (
        masked.join(hubs, "mask")
        .where(F.col("low") != F.col("hub.low"))
        .select(F.col("hub.name").alias("a"), F.col("name").alias("b"))
        .distinct()
    )


def near_subgroup_labels(df: DataFrame, spec: LongSpec) -> DataFrame:
    """Indicator labels whose last word is one letter away from a known subgroup."""
    groups = df.select(F.col(f"`{spec.subgroup}`").alias("subgroup")).dropna().distinct().withColumn("low", F.lower("subgroup"))
    labels = df.select(F.col(f"`{spec.label}`").alias("label")).dropna().distinct()
    words = labels.select("label", F.split("label", r"\s+").alias("w")).where(F.size("w") >= 2)
    last = words.select("label", F.lower(F.element_at("w", -1)).alias("last")).join(
        groups.select(F.col("low").alias("last")), "last", "left_anti"
    )
    left = last.where("length(last) > 0").select("label", F.explode(F.expr(_MASKS.format("last"))).alias("mask"))
    right = groups.select("subgroup", F.explode(F.expr(_MASKS.format("low"))).alias("mask"))
    return left.join(right, "mask").groupBy("label").agg(F.min("subgroup").alias("subgroup"))
