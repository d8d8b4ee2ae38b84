"""Whole GeoJSON collections, read by many tasks and cut into their features.

A collection needs no line breaks, so lines do not split it. The text is read in pieces that end at a closing brace, which Spark finds
from any byte of a file. Whether a piece starts inside a string and how deep it lies follow from running sums: within a split by a
window, over the splits of a file by a table of one row per split. Features are what lies at depth two of the list ``features``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import cut_lineage

SPLIT = ["file", "start"]
#: The key of the feature list and the bracket after it.
LIST = r'(?<!\\)"features"\s*:\s*\['
HEAD, REST = rf"(?s)^(.*?){LIST}", rf"(?s)^.*?{LIST}(.*)$"
#: At depth two, a closing bracket before any string or opening one ends the list.
END = r'(?s)^([^{\["\]]*)\]'


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``at`` rises within a split, which is all it is used for."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _times(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _quotes(text: Column) -> Column:
    """Quotes that open or close a string; an escape never lies over the end of a piece, as ``\\}`` is none."""
    return _times(F.regexp_replace(text, r"(?s)\\.", ""), '"')


def _net(text: Column, in_string: Column) -> Column:
    """Brackets opened less square ones closed, outside of strings."""
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    outside = F.regexp_replace(F.concat(F.when(in_string, F.lit('"')).otherwise(F.lit("")), bare), r'"[^"]*(?:"|$)', "")
    return _times(outside, r"[\[{]") - _times(outside, r"\]")


def _carried(per_split: DataFrame, **sums: Column | str) -> DataFrame:
    """Sums over the splits of a file before each split; one row per split."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``in_string`` and ``depth`` at their start and ``ends`` (the brace after it is one) and ``after``, the depth then."""
    line = Window.partitionBy(*SPLIT).orderBy("at")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.withColumn("quotes", _quotes(F.col("value")))
    run = run.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # the change of depth if the split starts outside of a string, and if it starts inside of one
    closed = lambda flip: F.when((F.col("odd") + flip + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    for flip in (0, 1):
        run = run.withColumn(f"d{flip}", _net(F.col("value"), (F.col("odd") + flip) % 2 == 1) - closed(flip))
    totals = run.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    # the last piece of a file stands without a brace where pieces and braces are a byte longer than the file (two shorter, with a byte order mark)
    every = Window.partitionBy("file")
    carry = _carried(totals.withColumn("bytes", F.sum("bytes").over(every)), q="quotes").withColumn("flip", (F.col("q") % 2).cast("int"))
    carry = _carried(carry, base=F.when(F.col("flip") == 0, F.col("d0")).otherwise(F.col("d1"))).select(*SPLIT, "flip", "base", "bytes")
    known = run.join(carry, SPLIT)
    step = F.when(F.col("flip") == 0, F.col("d0")).otherwise(F.col("d1"))
    known = known.withColumn("step", step).withColumn("depth", F.col("base") + F.coalesce(F.sum("step").over(before), F.lit(0)))
    inside = (F.col("odd") + F.col("flip")) % 2 == 1
    ends = (F.col("odd") + F.col("flip") + F.col("quotes")) % 2 == 0
    return known.select(*SPLIT, (F.col("bytes") - F.col("size")).alias("over"), "at", "value", inside.alias("in_string"), "depth", ends.alias("ends"), (F.col("depth") + F.col("step")).alias("after"))


def collection_parts(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(file, frame)`` and ``(file, position, feature)`` of GeoJSON files.

    ``frame`` is the text of a file without the elements of its list of features; a file without one is all frame. It ends as the
    file does, so a file that ends too early has a frame that is no JSON. Elements of the list that are no objects stay as text in the feature after them,
    or are a feature of their own at the end of the list; nothing is left out. Text without anything has no row.
    A feature and a frame are one value each; everything else is spread over splits. The placed pieces are written once and used by all steps after.
    """
    placed = cut_lineage(_placed(_pieces(spark, path)))
    head, rest = F.regexp_extract("value", HEAD, 1), F.regexp_extract("value", REST, 1)
    opens = ~F.col("in_string") & (F.col("depth") <= 1) & F.col("value").rlike(LIST)
    opens = opens & (F.col("depth") + _net(head, F.col("in_string")) == 1)
    marked = placed.withColumns({"place": F.struct("start", "at"), "opens": opens})
    shown = F.when(F.col("opens"), rest).when((F.col("depth") == 2) & ~F.col("in_string"), F.col("value"))
    marked = marked.withColumn("closes", F.coalesce(shown.rlike(END), F.lit(False)))
    # one closing place per list of objects at depth two, so a file has few
    ends = marked.where("opens or closes").groupBy("file").agg(
        F.min(F.when(F.col("opens"), F.col("place"))).alias("opened"), F.array_sort(F.collect_list(F.when(F.col("closes"), F.col("place")))).alias("closes")
    )
    bounds = ends.select("file", "opened", F.get(F.filter("closes", lambda c: c >= F.col("opened")), F.lit(0)).alias("closed"))
    both = marked.drop("opens", "closes").join(bounds, "file", "left")
    opening, closing = F.coalesce(F.col("place") == F.col("opened"), F.lit(False)), F.coalesce(F.col("place") == F.col("closed"), F.lit(False))
    listed = F.coalesce(F.col("place") >= F.col("opened"), F.lit(False)) & F.coalesce(F.col("place") <= F.col("closed"), F.lit(True))
    text = F.when(opening, rest).otherwise(F.col("value"))
    both = both.withColumns({"listed": listed, "opening": opening, "closing": closing, "text": text})
    # features: numbered by the ends before them
    inner = both.where("listed").withColumn("done", (F.col("ends") & (F.col("after") == 2) & ~F.col("closing")).cast("int"))
    before = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(inner.groupBy(*SPLIT).agg(F.sum("done").alias("n")), base="n").select(*SPLIT, F.col("base").alias("_base"))
    inner = inner.withColumn("done", F.coalesce(F.sum("done").over(before), F.lit(0))).join(carry, SPLIT)
    part = F.when(F.col("closing"), F.regexp_extract("text", END, 1)).otherwise(F.concat("text", F.lit("}")))
    inner = inner.select("file", (F.col("_base") + F.col("done") + 1).alias("position"), F.struct("place", part.alias("part")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["part"]), "")
    features = inner.groupBy("file", "position").agg(F.regexp_replace(joined, r"^[\s,]+|\s+$", "").alias("feature")).where("feature <> ''")
    # the frame: what is before and after the list
    lead = F.when(F.col("opening"), F.substring(F.col("value"), F.lit(1), F.length("value") - F.length(rest))).otherwise(F.lit(""))
    tail = F.when(F.col("closing"), F.regexp_replace("text", END, "]")).otherwise(F.when(F.col("listed"), F.lit("")).otherwise(F.col("value")))
    brace = F.when(F.col("listed") & ~F.col("closing"), F.lit("")).otherwise(F.lit("}"))
    outer = both.where("not listed or opening or closing").select("file", "over", F.struct("place", F.concat(lead, tail, brace).alias("part")).alias("piece"))
    frames = outer.groupBy("file").agg(joined.alias("frame"), F.max("over").alias("over"))
    cut = F.regexp_replace("frame", r"\}$", "")
    ended = F.when(F.col("over").isin(1, -2), cut).when(F.col("over").isin(0, -3), F.col("frame"))
    packed = F.when(F.try_parse_json("frame").isNotNull(), F.col("frame")).otherwise(cut)  # compressed files do not tell
    frames = frames.select("file", F.coalesce(ended, packed).alias("frame"))
    return frames.where(F.col("frame").rlike(r"\S")), features
