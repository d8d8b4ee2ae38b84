"""Delimited text, JSON and Parquet, with the file facts a report needs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.values import clean_cell, finite, quoted, trimmed

SEPARATORS = [";", "\t", "|", ","]
SEPARATOR_SHARE = 0.6


def unique_names(names: list[str | None]) -> list[str]:
    """Blank names become ``Coluna i``, repeated ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names, 1):
        base = (raw or "").strip() or f"Coluna {i}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base} ({seen[base]})")
    return out


def clean_cells(df: DataFrame) -> DataFrame:
    """Trim every text cell; an empty one is no data."""
    return df.select(
        *[
            (clean_cell(quoted(f.name)) if isinstance(f.dataType, T.StringType) else quoted(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _blank_row(df: DataFrame) -> Column:
    return F.coalesce(*[quoted(c).cast("string") for c in df.columns]).isNull()


def read_stats(df: DataFrame, kept: int | None = None) -> DataFrame:
    """One row: rows read, blank rows to drop and rows past an optional limit."""
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(_blank_row(df)).alias("blank_rows")).withColumn(
        "past_limit",
        F.lit(0).cast("bigint") if kept is None else F.greatest(F.lit(0), F.col("rows_read") - F.col("blank_rows") - kept),
    )


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.where(~_blank_row(df))


# ------------------------------------------------------------------ delimited text


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start, at, value)``: lines with the byte where their split starts and a number that rises by one within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def text_facts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, encoding, separator, broken_quotes, header)`` of every file, from one scan and one aggregate; a
    second scan fetches the headers.

    UTF-8 when every line is valid, else Windows-1252. For each separator all lines with text are counted by
    how often they hold it outside quotes; the winner has one count in most lines, and more columns and a
    larger share of agreeing lines score higher. ``broken_quotes``: some line has an odd number of quotes, so
    a cell goes over several lines. ``header`` is the first line with text.
    """
    lines = _lines(spark, path)
    # the pattern is only tried where there is a quote, and all that is kept per count is a number
    bare = F.when(F.contains("value", F.lit('"')), F.regexp_replace("value", '"[^"]*("|$)', "")).otherwise(F.col("value"))
    lines = lines.withColumn("bare", bare).withColumn("text", F.length(trimmed("value")) > 0)
    times = lambda s: (F.length("bare") - F.length(F.replace("bare", F.lit(s)))).cast("int")
    odd = F.contains("value", F.lit('"')) & ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    per_count = lines.groupBy("file", "start", *[F.when(F.col("text"), times(s)).alias(f"t{i}") for i, s in enumerate(SEPARATORS)]).agg(
        F.count_if("text").alias("n"),
        F.count_if(~F.is_valid_utf8("value")).alias("invalid"),
        F.count_if(odd).alias("odd"),
        F.min(F.when(F.col("text"), F.col("at"))).alias("at"),
    )
    # few rows per split from here on: one per combination of counts
    per_count = per_count.withColumn("first", F.struct("start", "at"))
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("separator"), F.col(f"t{i}").alias("times")) for i, s in enumerate(SEPARATORS)])
    sums = [F.sum(c).alias(c) for c in ("n", "invalid", "odd")] + [F.min(F.when(F.col("n") > 0, F.col("first"))).alias("first")]
    groups = per_count.select("file", "n", "invalid", "odd", "first", F.inline(kinds)).groupBy("file", "rank", "separator", "times").agg(*sums)
    # of equally common counts the one that comes first in the file
    common = F.min_by(F.struct("times", "n"), F.when((F.col("times") > 0) & (F.col("n") > 0), F.struct((-F.col("n")).alias("m"), "first"))).alias("mode")
    ranked = groups.groupBy("file", "rank", "separator").agg(common, *sums)
    share = F.col("mode.n") / F.col("n")
    score = F.when(share >= SEPARATOR_SHARE, F.struct((F.col("mode.times") * share * share).alias("score"), (-F.col("rank")).alias("r")))
    whole = ranked.groupBy("file").agg(
        F.max_by("separator", score).alias("separator"), (F.max("invalid") == 0).alias("valid"), (F.max("odd") > 0).alias("broken_quotes"), F.min("first").alias("first"))
    opening = whole.select(
        F.col("file").alias("_file"), F.col("first.start").alias("_start"), F.col("first.at").alias("_at"),
        F.when(F.col("valid"), "UTF-8").otherwise("windows-1252").alias("encoding"), F.coalesce("separator", F.lit(",")).alias("separator"), "broken_quotes")
    found = (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")) & (F.col("at") == F.col("_at"))
    return opening.join(_lines(spark, path), found, "left").select(F.col("_file").alias("file"), "encoding", "separator", "broken_quotes", F.col("value").alias("header"))


def text_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(file, encoding)``: UTF-8 when every line is valid, else Windows-1252."""
    return text_facts(spark, path).select("file", "encoding")


def separators(spark: SparkSession, path: str) -> DataFrame:
    """``(file, separator)`` chosen from all lines of each file."""
    return text_facts(spark, path).select("file", "separator")


def read_delimited(
    spark: SparkSession, path: str | list[str], separator: str | None = None, encoding: str | None = None, multiline: bool | None = None
) -> DataFrame:
    """Text cells of delimited files with a header row; cells trimmed, blank rows left out.

    Separator, encoding and header are found per file, in one scan. Files that agree in all of them are read
    together; several kinds make one table by column name, where a file without a column has no data in it
    (``with_source`` on the parts tells which). Files stay splittable unless a quoted cell holds a line break.
    """
    facts = text_facts(spark, path)
    known = {"separator": separator, "encoding": encoding, "broken_quotes": multiline}
    facts = facts.withColumns({k: F.lit(v) for k, v in known.items() if v is not None})
    kinds = facts.where("header is not null").groupBy("separator", "encoding", "broken_quotes", "header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = []
    for kind in kinds.orderBy("files").collect():  # one row per kind of file
        options = {"sep": kind.separator, "encoding": kind.encoding, "quote": '"', "escape": '"', "multiLine": kind.broken_quotes}
        files = [unquote(f) for f in kind.files]  # the metadata column holds them as URIs
        first = spark.read.options(**options).csv(files[:1], header=False).first()
        raw = list(first)
        raw[0] = (raw[0] or "").lstrip("\ufeff")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(raw))])
        rows = spark.read.options(**options).schema(schema).csv(files, header=True)
        parts.append(drop_blank_rows(clean_cells(rows.toDF(*unique_names(raw)))))
    return stack_files(parts) if parts else spark.createDataFrame([], T.StructType([]))


def read_cells(spark: SparkSession, path: str | list[str], separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """Delimited files as cell tables ``(sheet_id, row, col, text)``, for files with titles, several blocks or two header lines.

    A file is a sheet; rows and columns count from 0, blank lines count too, empty cells have no row. ``blocks``, ``block_headers`` and
    ``block_values`` take it from there. Files stay splittable: lines are numbered within their split, and a split's first line follows from the
    numbers of lines of the splits before it. Separator and encoding are found per file unless given.
    Cells are trimmed; quoted ones may hold separators and doubled quotes, but a line break always ends a row. A mark of byte order is left out.
    """
    lines = _lines(spark, path)
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).select(F.col("file").alias("_file"), F.col("start").alias("_start"), "offset")
    facts = text_facts(spark, path).select(F.col("file").alias("_ffile"), "separator", "encoding")
    facts = facts.withColumns({k: F.lit(v) for k, v in {"separator": separator, "encoding": encoding}.items() if v is not None})
    splits = splits.join(facts, F.col("_file") == F.col("_ffile")).drop("_ffile")
    # one row per split; a join by split would bring all its lines into one task
    numbered = lines.join(F.broadcast(splits), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    row = (F.col("at") + F.col("offset")).cast("int")
    text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "windows-1252"))
    text = F.when(row == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    # without a quote a plain split will do; one pattern per separator, as there are only so many
    def cells_by(mark: str) -> Column:
        one = "\\t" if mark == "\t" else "\\" + mark
        pattern = rf'(?:^|{one})(\s*+"(?:[^"]|"")*+"?+[^{one}]*+|[^{one}]*+)'
        bare = lambda c: F.when(F.startswith(trimmed(c), F.lit('"')), F.replace(F.regexp_replace(trimmed(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
        return F.when(F.contains("line", F.lit('"')), F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), bare)).otherwise(F.split("line", one, -1))

    cells = F.coalesce(*[F.when(F.col("separator") == mark, cells_by(mark)) for mark in ([separator] if separator else SEPARATORS)])
    placed = numbered.select(F.col("file").alias("sheet_id"), row.alias("row"), text.alias("line"), "separator").where(F.length(trimmed("line")) > 0)
    placed = placed.select("sheet_id", "row", F.posexplode(cells).alias("col", "raw"))
    return placed.select("sheet_id", "row", "col", clean_cell("raw").alias("text")).where("text is not null")


# ------------------------------------------------------------------ JSON


def flatten_cells(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, binary as a marker, non-finite numbers as no data."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.when(c.isNotNull(), F.lit("[binário]"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _whole_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as one record each. Types come from all whole texts, which are dealt out by their number, as Spark's own scan for
    types packs any number of small files into one task. Texts that are no JSON as UTF-8 are left to that scan."""
    texts = spark.read.text(path, wholetext=True).select("value")
    schema = spark.read.json(texts.rdd.map(lambda r: r.value)).schema
    if not schema.names or "_corrupt_record" in schema.names:
        return spark.read.json(path, multiLine=True)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_tables(spark: SparkSession, path: str, name: str = "data", lines: bool = False) -> dict[str, DataFrame]:
    """Tables of a JSON file: a list of records, an object of lists, or one object.

    ``lines`` reads one record per line, which Spark can split.
    """
    if lines:
        return {name: flatten_cells(clean_cells(spark.read.json(path)))}
    lead = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").first()
    start = lead.v if lead else ""
    if start.startswith("[") and not start[1:].lstrip()[:1] in ("", "{", "]"):
        values = F.explode(F.from_json("value", "array<string>")).alias("valor")
        return {name: clean_cells(spark.read.text(path, wholetext=True).select(values))}
    df = _whole_json(spark, path)
    is_list = lambda f: isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    lists = [f.name for f in df.schema.fields if is_list(f)]
    if start.startswith("[") or not lists:
        return {name: flatten_cells(clean_cells(df))}
    return {n: flatten_cells(clean_cells(df.select(F.inline(quoted(n))))) for n in lists}


# ------------------------------------------------------------------ Parquet


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with cells a profile can read; columns and filters still reach the scan."""
    return flatten_cells(spark.read.parquet(path))


# ------------------------------------------------------------------ provenance


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256, modified)`` per file. A file is one cell while it is hashed, so each must stay below 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified")
    )


def with_source(df: DataFrame, path_column: str = "source_file") -> DataFrame:
    """The file every row came from; directly after a read."""
    return df.withColumn(path_column, F.col("_metadata.file_path"))


def merge_sources(sources: dict[str, dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of several files under unique names, and rows and columns per source.

    A file with one table gives its own name, otherwise ``file › table``.
    """
    tables: dict[str, DataFrame] = {}
    facts = []
    for file, found in sources.items():
        base = file.rsplit(".", 1)[0] if "." in file else file
        for table, df in found.items():
            wanted = base if len(found) == 1 else f"{base} › {table}"
            name, i = wanted, 2
            while name in tables:
                name, i = f"{wanted} ({i})", i + 1
            tables[name] = df
            facts.append(
                df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(file).alias("file"), F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
                )
            )
    return tables, reduce(DataFrame.unionByName, facts)


def stack_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of several files in one table; absent columns have no data."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
