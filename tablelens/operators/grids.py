"""Tables out of form sheets.

Input is a long cell table ``(sheet_id, row, col, text)`` with whole-number rows and columns; many
sheets are handled at once. One sheet is bounded by its file format (1,048,576 rows of 16,384
columns), and everything that follows a row order works on one line per row, not on cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.ranks import chunked_running_sum
from tablelens.functions.values import clean_cell, parse_number, quoted, trimmed
from tablelens.session import cut_lineage

KEY = ["sheet_id"]


def filled_cells(cells: DataFrame) -> DataFrame:
    return cells.select("sheet_id", "row", "col", clean_cell("text").alias("text")).where("text is not null")


# ------------------------------------------------------------------ blocks


def blocks(cells: DataFrame) -> DataFrame:
    """``(sheet_id, block, first_row, last_row, header_row, rows, width, kind)``.

    Blank rows end a block. The header is the first row with 60 % of the fill of the fullest row.
    Blocks of fewer than three rows (from the header on) or three cells are ``context``.
    """
    rows = filled_cells(cells).groupBy("sheet_id", "row").agg(F.count(F.lit(1)).alias("filled"))
    # a block starts where the row above holds nothing: an equality test, no ordering needed
    above = rows.select("sheet_id", (F.col("row") + 1).alias("row"), F.lit(0).alias("start"))
    started = rows.join(above, ["sheet_id", "row"], "left").withColumn("start", F.coalesce("start", F.lit(1)))
    numbered = chunked_running_sum(started, KEY, "row", "start", "block")
    widest = numbered.groupBy("sheet_id", "block").agg(F.max("filled").alias("width"))
    header = (
        numbered.join(widest, ["sheet_id", "block"])
        .groupBy("sheet_id", "block", "width")
        .agg(
            F.min("row").alias("first_row"),
            F.max("row").alias("last_row"),
            F.min(F.when(F.col("filled") >= F.ceil(F.col("width") * V.HEADER_SHARE), F.col("row"))).alias("header_row"),
        )
    )
    size = F.col("last_row") - F.col("first_row") + 1
    body = F.col("last_row") - F.col("header_row") + 1
    return header.select(
        "sheet_id",
        "block",
        "first_row",
        "last_row",
        "header_row",
        size.alias("rows"),
        "width",
        F.when((size < 3) | (F.col("width") < 3) | (body < 3), "context").otherwise("table").alias("kind"),
    )


def _in_blocks(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells with their block: each row of a block is listed once and met by equality."""
    spans = found.select("sheet_id", "block", "header_row", "kind", F.explode(F.sequence("first_row", "last_row")).alias("row"))
    return filled_cells(cells).join(spans, ["sheet_id", "row"])


def block_texts(cells: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Titles above headers and the texts of context blocks: ``(sheet_id, block, row, col, text, part)``."""
    placed = _in_blocks(cells, found if found is not None else blocks(cells))
    title = (F.col("kind") == "table") & (F.col("row") < F.col("header_row"))
    return placed.where(title | (F.col("kind") == "context")).select(
        "sheet_id", "block", "row", "col", "text", F.when(title, "title").otherwise("context").alias("part")
    )


def sentence_case(c: Column) -> Column:
    """Upper-case words to lower case where they are long or connect others; first letter upper."""
    letters = lambda w: F.regexp_replace(w, r"[^\p{L}]", "")
    lowered = lambda w: F.when(
        (w == F.upper(w)) & (F.lower(letters(w)).isin(V.SMALL_WORDS) | (F.length(letters(w)) > 4)), F.lower(w)
    ).otherwise(w)
    text = F.concat_ws(" ", F.transform(F.split(trimmed(c), r"\s+"), lowered))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def block_headers(cells: DataFrame, found: DataFrame | None = None, numbers: str = "br") -> DataFrame:
    """``(sheet_id, block, col, position, name, data_from)`` of every table block.

    A second header row is recognised when it holds only text above mostly numeric columns; then
    the names read "Group — Column" with the group carried to the right.
    """
    found = (found if found is not None else blocks(cells)).where("kind = 'table'")
    placed = _in_blocks(cells, found).where("row >= header_row").withColumn("is_num", parse_number("text", numbers).isNotNull())
    second = F.col("row") == F.col("header_row") + 1
    by_col = placed.groupBy("sheet_id", "block", "header_row", "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("text"))).alias("upper"),
        F.max(F.when(second, F.col("text"))).alias("lower"),
        F.coalesce(F.bool_or(second & F.col("is_num")), F.lit(False)).alias("lower_num"),
        F.count_if(F.col("row") > F.col("header_row") + 1).alias("below"),
        F.count_if((F.col("row") > F.col("header_row") + 1) & F.col("is_num")).alias("below_num"),
        F.max("row").alias("last"),
    )
    texts = F.count_if(F.col("lower").isNotNull())
    above_numbers = F.count_if(
        F.col("lower").isNotNull() & (F.col("below") > 0) & (F.col("below_num") >= F.col("below") * V.HEADER_SHARE)
    )
    double = by_col.groupBy("sheet_id", "block").agg(
        (
            (F.max("last") - F.min("header_row") + 1 >= 4)
            & ~F.bool_or("lower_num")
            & (texts >= 2)
            & (above_numbers >= F.ceil(texts * V.HEADER_SHARE))
        ).alias("double")
    )
    across = Window.partitionBy("sheet_id", "block").orderBy("col")  # one line per column of a sheet
    named = by_col.join(double, ["sheet_id", "block"]).withColumns(
        {"carried": F.last("upper", ignorenulls=True).over(across), "position": F.row_number().over(across)}
    )
    group = F.coalesce("upper", F.when(F.col("lower").isNotNull(), F.col("carried")))
    both = group.isNotNull() & F.col("lower").isNotNull() & (F.lower(group) != F.lower("lower"))
    joined = F.when(both, F.concat(sentence_case(group), F.lit(" — "), F.col("lower"))).otherwise(F.coalesce("lower", "upper"))
    base = F.coalesce(F.when(F.col("double"), joined).otherwise(F.col("upper")), F.concat(F.lit("Coluna "), F.col("position").cast("string")))
    repeat = F.row_number().over(Window.partitionBy("sheet_id", "block", "base").orderBy("col"))
    return (
        named.withColumn("base", base)
        .withColumn("name", F.when(repeat > 1, F.concat("base", F.lit(" ("), repeat.cast("string"), F.lit(")"))).otherwise(F.col("base")))
        .select(
            "sheet_id",
            "block",
            "col",
            "position",
            "name",
            (F.col("header_row") + F.when(F.col("double"), 2).otherwise(1)).alias("data_from"),
        )
    )


def block_values(cells: DataFrame, numbers: str = "br") -> DataFrame:
    """Data cells of every table block: ``(sheet_id, block, row, name, text)``."""
    found = blocks(cells)
    heads = block_headers(cells, found, numbers)
    placed = _in_blocks(cells, found.where("kind = 'table'"))
    return placed.join(heads, ["sheet_id", "block", "col"]).where("row >= data_from").select("sheet_id", "block", "row", "name", "text")


# ------------------------------------------------------------------ repeated blocks to a long table


def _fixed_header(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.HEADER_SPELLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(c)), c)


def _fixed_period(c: Column) -> Column:
    shouted = (F.length(c) > 3) & (c == F.upper(c)) & c.rlike("[A-ZÀ-Ý]")
    return F.when(shouted, F.concat(F.substring(c, 1, 1), F.lower(F.substr(c, F.lit(2))))).otherwise(c)


def repeated_blocks(cells: DataFrame, numbers: str = "br") -> DataFrame:
    """Sheets with one header repeated over several blocks as one long table.

    ``(sheet_id, period_name, entity_name, row, period, entity, indicator, situation, subgroup,
    Total)``. Blank cells stay without data; entities without any value are dropped; sheets
    without a repeated header give no rows.
    """
    full = filled_cells(cells).withColumn("num", parse_number("text", numbers))
    ordered = F.array_sort(F.collect_list(F.struct("col", "text", F.col("num").isNotNull().alias("is_num"))))
    # one line per row, sheet width at most; read by every step below
    lines = cut_lineage(full.groupBy("sheet_id", "row").agg(ordered.alias("cells")))
    rest = F.slice("cells", 2, F.size("cells") - 1)
    heads = (
        lines.where(F.size("cells") >= 4)
        .withColumn("rest", rest)
        .where(~F.exists("rest", lambda c: c["is_num"]))
        .withColumn("signature", F.concat_ws("|", F.transform("rest", lambda c: c["text"])))
    )
    counts = heads.groupBy("sheet_id", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    best = (
        counts.groupBy("sheet_id")
        .agg(F.min_by(F.struct("signature", "n", "first"), F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("b"))
        .where("b.n >= 2")
        .select("sheet_id", "b.*")
    )
    repeated = heads.join(best.select("sheet_id", "signature"), ["sheet_id", "signature"], "left_semi")
    layout = repeated.join(best.select("sheet_id", F.col("first").alias("row")), ["sheet_id", "row"], "left_semi").select(
        "sheet_id",
        F.col("cells")[0]["col"].alias("col0"),
        _fixed_header(F.col("cells")[0]["text"]).alias("entity_name"),
        F.transform("rest", lambda c: F.struct(c["col"].alias("col"), c["text"].alias("entity"))).alias("columns"),
    )

    # sections follow each other down the sheet
    down = Window.partitionBy("sheet_id").orderBy("row")
    flow = (
        lines.join(layout, "sheet_id", "left_semi")
        .join(repeated.select("sheet_id", "row", F.lit(True).alias("is_head")), ["sheet_id", "row"], "left")
        .withColumns({"above_row": F.lag("row").over(down), "above": F.lag("cells").over(down)})
        .withColumn("head_before", F.max(F.when(F.col("is_head"), F.col("row"))).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    )
    usable = (
        F.col("above_row").isNotNull() & (F.size("above") <= 2) & (F.coalesce("head_before", F.lit(-1)) < F.col("above_row"))
    )
    first, second = F.get("above", F.lit(0))["text"], F.get("above", F.lit(1))["text"]
    matched = first.rlike(V.PERIOD_LINE)
    key_word = F.regexp_extract(first, V.PERIOD_LINE, 1)
    sections = (
        flow.where("is_head")
        .withColumn("number", F.row_number().over(down))
        .select(
            "sheet_id",
            F.col("row").alias("head"),
            F.when(usable, F.col("above_row")).alias("period_row"),
            F.when(usable & (F.size("above") == 2), F.regexp_replace(first, r"[:：]\s*$", ""))
            .when(usable & matched, F.concat(F.upper(F.substring(key_word, 1, 1)), F.lower(F.substr(key_word, F.lit(2)))))
            .otherwise("Período")
            .alias("period_key"),
            F.when(usable & (F.size("above") == 2), second)
            .when(usable & matched, F.regexp_extract(first, V.PERIOD_LINE, 2))
            .when(usable, first)
            .otherwise(F.concat(F.lit("Bloco "), F.col("number").cast("string")))
            .alias("period"),
        )
    )
    names = sections.groupBy("sheet_id").agg(_fixed_header(F.min_by("period_key", "head")).alias("period_name"))
    data = (
        flow.withColumn("is_head", F.coalesce("is_head", F.lit(False)))
        .where("not is_head and head_before is not null")
        .join(sections.select("sheet_id", F.col("period_row").alias("row")).dropna(), ["sheet_id", "row"], "left_anti")
        .join(sections.select("sheet_id", F.col("head").alias("head_before"), "period"), ["sheet_id", "head_before"])
        .join(layout, "sheet_id")
    )
    text_at = lambda col: F.get(F.filter("cells", lambda c: c["col"] == col), F.lit(0))["text"]
    kept = data.withColumn("indicator", text_at(F.col("col0"))).where(
        F.col("indicator").isNotNull() & F.exists("columns", lambda k: F.exists("cells", lambda c: c["col"] == k["col"]))
    )
    long = kept.select(
        "sheet_id", "row", "entity_name", _fixed_period(F.col("period")).alias("period"), "indicator", "cells", F.inline("columns")
    ).select(
        "sheet_id", "row", "col", "entity_name", "period", "entity", "indicator", parse_number(text_at(F.col("col")), numbers).alias("Total")
    )
    long = cut_lineage(long)
    alive = long.groupBy("sheet_id", "entity").agg(F.count("Total").alias("n")).where("n > 0")
    long = long.join(alive.drop("n"), ["sheet_id", "entity"], "left_semi").join(names, "sheet_id")
    parts = split_labels(long.select("sheet_id", F.col("indicator").alias("label")))
    return long.join(parts.withColumnRenamed("label", "indicator"), ["sheet_id", "indicator"], "left").select(
        "sheet_id", "period_name", "entity_name", "row", "period", "entity", "indicator", "situation", "subgroup", "Total"
    )


def split_labels(labels: DataFrame, min_labels: int = 3, min_words: int = 2) -> DataFrame:
    """``(sheet_id, label, situation, subgroup)`` when last words recur in several labels.

    A last word counts when it ends at least ``min_labels`` labels; at least ``min_words`` such
    words are needed, otherwise situation and subgroup have no data.
    """
    words = F.split(F.col("label"), r"\s+")
    distinct = labels.select("sheet_id", "label").distinct().withColumns(
        {"many": F.size(words) >= 2, "last": F.element_at(words, -1), "head": F.concat_ws(" ", F.slice(words, 1, F.size(words) - 1))}
    )
    common = distinct.where("many").groupBy("sheet_id", "last").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_labels)
    ready = common.groupBy("sheet_id").agg((F.count(F.lit(1)) >= min_words).alias("split"))
    tagged = distinct.join(common, ["sheet_id", "last"], "left").join(ready, "sheet_id", "left")
    split = F.coalesce("split", F.lit(False))
    ends = F.col("many") & F.col("n").isNotNull()
    return tagged.select(
        "sheet_id",
        "label",
        F.when(split, F.when(ends, F.col("head")).otherwise(F.col("label"))).alias("situation"),
        F.when(split & ends, F.col("last")).alias("subgroup"),
    )


# ------------------------------------------------------------------ tables with the same keys side by side


def _signature(df: DataFrame, key: str) -> tuple | None:
    k = trimmed(quoted(key).cast("string"))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.nullif(k, F.lit(""))).alias("d"),
        F.bit_xor(F.xxhash64(k)).alias("x"),
        F.sum(F.xxhash64(k).cast("decimal(38,0)")).alias("s"),
    ).first()
    return (row.n, row.x, row.s) if row.n >= 2 and row.n == row.d else None


def align_tables(tables: dict[str, DataFrame], key: str) -> tuple[DataFrame | None, list[str]]:
    """The largest group of tables with exactly the same keys, one row per key, as one wide table.

    Column names used twice get the table name in front; a constant label column is kept once.
    """
    groups: dict[tuple, list[str]] = {}
    for name, df in tables.items():
        mark = _signature(df, key) if key in df.columns else None
        if mark:
            groups.setdefault(mark, []).append(name)
    members = max(groups.values(), key=len, default=[])
    keyed = lambda n: tables[n].select(trimmed(quoted(key).cast("string")).alias(key), *[quoted(c) for c in tables[n].columns if c != key])
    # equal fingerprints are confirmed on the keys themselves
    members = [n for n in members if n == members[0] or keyed(n).join(keyed(members[0]), key, "left_anti").isEmpty()]
    if len(members) < 2:
        return None, []
    tail = lambda c: c.split(" — ")[-1].strip().lower()
    uses: dict[str, int] = {}
    for n in members:
        for c in tables[n].columns:
            if c != key:
                uses[tail(c)] = uses.get(tail(c), 0) + 1
    taken, constants, parts = [key], set(), []
    for n in members:
        frame, chosen = keyed(n), {}
        text = [f.name for f in frame.schema.fields if f.name != key and f.dataType.simpleString() == "string"]
        probe = frame.agg(
            *[
                F.struct(
                    F.count_distinct(quoted(c)).alias("d"),
                    F.count_if(quoted(c).isNull()).alias("e"),
                    F.count(F.regexp_replace(quoted(c), ",", ".").try_cast("double")).alias("n"),
                ).alias(f"t{i}")
                for i, c in enumerate(text)
            ]
        ).first() if text else []
        fixed = {c for i, c in enumerate(text) if probe[i].d == 1 and probe[i].e == 0 and probe[i].n == 0}
        for c in frame.columns:
            if c == key or (c in fixed and c in constants):
                continue
            if c in fixed:
                constants.add(c)
            base = f"{n} — {c}" if uses[tail(c)] > 1 and " — " not in c else c
            label, i = base, 2
            while label in taken:
                label, i = f"{base} ({i})", i + 1
            taken.append(label)
            chosen[c] = label
        parts.append(frame.select(key, *[quoted(c).alias(a) for c, a in chosen.items()]))
    return reduce(lambda a, b: a.join(b, key, "left"), parts), members
