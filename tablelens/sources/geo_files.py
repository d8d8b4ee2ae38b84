"""GeoJSON and KML as tables with a geometry column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.geometry import (
    empty_list,
    from_geojson,
    kml_positions,
    kml_positions_lenient,
    make_parts,
)
from tablelens.functions.values import field_key, let
from tablelens.session import cut_lineage
from tablelens.sources.geojson_parts import collection_parts

WGS84 = "(?i)CRS84|4326"


# ------------------------------------------------------------------ GeoJSON


def _json_type(variant_type: str) -> str:
    """Column types for from_json out of a variant schema; mixed and empty columns read as text."""
    t = re.sub(r"\bOBJECT<", "STRUCT<", variant_type)
    t = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", t)
    return re.sub(r"\b(VARIANT|VOID)\b", "STRING", t)


def _collection_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, crs, feature, broken)``: the features of whole collections, or the text of a file that is none."""
    frames, features = collection_parts(spark, path)
    top = F.from_json("frame", "type string, crs struct<properties:struct<name:string>>")
    files = frames.withColumns({"broken": F.try_parse_json("frame").isNull(), "top": top}).select(
        "file", "frame", "broken", F.col("top.crs.properties.name").alias("crs"), (F.col("top.type") == "FeatureCollection").alias("collection")
    )
    alone = F.col("broken") | ~F.coalesce("collection", F.lit(False))
    single = files.where(alone).select("file", F.lit(0).cast("bigint").alias("at"), "crs", F.col("frame").alias("feature"), "broken")
    many = features.join(files.where(~alone).select("file", "crs"), "file")
    return single.unionByName(many.select("file", (F.col("position") - 1).alias("at"), "crs", "feature", F.try_parse_json("feature").isNull().alias("broken")))


def geojson_features(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """``(file, position, crs, properties, geometry_json, broken)`` as JSON text, one row per feature or broken text.

    Collections, single features and bare geometries are accepted, and a collection is read by many tasks (``geojson_parts``). A feature that is no
    JSON is a broken row; a file that ends too early is one broken row. ``one_per_line`` reads a feature per line.
    """
    if one_per_line:
        docs = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
        docs = docs.where("trim(value) <> ''").withColumn("broken", F.try_parse_json("value").isNull())
        crs = F.from_json("value", "crs struct<properties:struct<name:string>>")["crs"]["properties"]["name"]
        rows = docs.select("file", "at", crs.alias("crs"), F.col("value").alias("feature"), "broken")
    else:
        rows = _collection_rows(spark, path)
    kind = F.get_json_object("feature", "$.type")
    bare = F.coalesce(kind != "Feature", F.lit(True)) & F.get_json_object("feature", "$.geometry").isNull()
    return rows.select(
        "file",
        (F.col("at") + 1).cast("bigint").alias("position"),
        "crs",
        F.when(~bare & ~F.col("broken"), F.get_json_object("feature", "$.properties")).alias("properties"),
        F.when(~F.col("broken"), F.when(bare, F.col("feature")).otherwise(F.get_json_object("feature", "$.geometry"))).alias("geometry_json"),
        "broken",
    )


def read_geojson(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Properties as columns plus ``position``, ``geometry`` and ``geometry_problem``.

    A malformed geometry keeps its row with an empty shape and the problem ``malformed``, and so does a text
    that is no JSON, such as a file that ends too early; a declared system other than WGS84 is reported as ``crs``.
    """
    rows = geojson_features(spark, path, one_per_line)
    rows = rows if one_per_line else cut_lineage(rows)  # both the columns and the rows come from it
    schema = rows.agg(F.schema_of_variant_agg(F.try_parse_json("properties")).alias("s")).first().s
    shape = from_geojson("geometry_json")
    foreign = F.col("crs").isNotNull() & ~F.col("crs").rlike(WGS84)
    base = rows.withColumn("geometry", shape).withColumn(
        "geometry_problem",
        F.when(F.col("broken") | (F.col("geometry_json").isNotNull() & F.col("geometry").isNull()), "malformed").when(foreign, "crs"),
    )
    keep = ["position", "geometry", "geometry_problem"]
    if not schema or not schema.upper().startswith("OBJECT<") or schema.upper() == "OBJECT<>":
        return base.select(*keep)
    props = F.from_json("properties", _json_type(schema))
    return base.withColumn("_p", props).select("_p.*", *keep)


# ------------------------------------------------------------------ KML

_GEOMETRY = """
  Point: array<struct<coordinates: string>>,
  LineString: array<struct<coordinates: string>>,
  Polygon: array<struct<
    outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>,
    innerBoundaryIs: array<struct<LinearRing: struct<coordinates: string>>>>>"""

def _multi(depth: int) -> str:
    """A geometry collection with ``depth`` further ones inside each other."""
    inner = f", MultiGeometry: array<{_multi(depth - 1)}>" if depth else ""
    return f"struct<{_GEOMETRY}{inner}>"


def _placemark(multi: int) -> str:
    nested = f", MultiGeometry: array<{_multi(multi - 1)}>" if multi else ""
    return f"""struct<
  _id: string,
  name: string,
  description: string,
  TimeStamp: struct<when: string>,
  TimeSpan: struct<begin: string>,
  ExtendedData: struct<
    Data: array<struct<_name: string, value: string>>,
    SchemaData: array<struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>>,
  {_GEOMETRY}{nested}
>"""


def _folder(depth: int, placemark: str) -> str:
    inner = f", Folder: array<{_folder(depth - 1, placemark)}>" if depth else ""
    return f"struct<name: string, Placemark: array<{placemark}>{inner}>"


def _placemarks(node: Column, path: Column, place: Column, depth: int, placemark: str) -> Column:
    """Placemarks of a container and of its folders with their folder path, as one array."""
    here = F.transform(
        node["Placemark"], lambda pm, i: F.struct(F.concat(place, F.array(F.lit(0), i)).alias("place"), path.alias("path"), pm.alias("pm"))
    )
    here = F.coalesce(here, empty_list(f"array<struct<place:array<int>,path:array<string>,pm:{placemark}>>"))
    if not depth:
        return here
    name = lambda sub: F.coalesce(F.nullif(F.trim(sub["name"]), F.lit("")), F.lit("(sem nome)"))
    below = F.flatten(
        F.transform(
            node["Folder"],
            lambda sub, i: _placemarks(sub, F.concat(path, F.array(name(sub))), F.concat(place, F.array(F.lit(1), i)), depth - 1, placemark),
        )
    )
    return F.when(node["Folder"].isNull(), here).otherwise(F.concat(here, below))


def _member_geometries(node: Column, positions) -> tuple[Column, Column, Column]:
    points = F.filter(
        F.transform(F.coalesce(node["Point"], empty_list("array<struct<coordinates:string>>")), lambda p: F.get(positions(p["coordinates"]), F.lit(0))),
        lambda p: p.isNotNull(),
    )
    lines = F.filter(
        F.transform(F.coalesce(node["LineString"], empty_list("array<struct<coordinates:string>>")), lambda l: positions(l["coordinates"])),
        lambda l: F.coalesce(F.size(l) > 0, F.lit(False)),
    )
    ring_type = "struct<LinearRing:struct<coordinates:string>>"
    polygons = F.filter(
        F.transform(
            F.coalesce(node["Polygon"], empty_list(f"array<struct<outerBoundaryIs:{ring_type},innerBoundaryIs:array<{ring_type}>>>")),
            lambda g: F.filter(
                F.concat(
                    F.array(positions(g["outerBoundaryIs"]["LinearRing"]["coordinates"])),
                    F.transform(
                        F.coalesce(g["innerBoundaryIs"], empty_list(f"array<{ring_type}>")), lambda h: positions(h["LinearRing"]["coordinates"])
                    ),
                ),
                # a broken outer ring stays as a marker and drops the polygon below
                lambda r, i: (i == 0) | F.coalesce(F.size(r) > 0, F.lit(False)),
            ),
        ),
        lambda g: F.coalesce(F.size(F.get(g, F.lit(0))) > 0, F.lit(False)),
    )
    return points, lines, polygons


def _inside(collections: Column, kind: str) -> Column:
    return F.flatten(F.transform(collections, lambda m: F.coalesce(m["MultiGeometry"], empty_list(kind))))


def _placemark_parts(pm: Column, positions, multi: int) -> Column:
    levels, node = [], F.array(pm)
    for depth in range(multi, 0, -1):  # the collections of one level of all collections above it
        node = _inside(node, f"array<{_multi(depth - 1)}>")
        levels.append(node)

    def gather(i: int) -> Column:
        member = lambda m: _member_geometries(m, positions)[i]
        return F.concat(_member_geometries(pm, positions)[i], *[F.flatten(F.transform(level, member)) for level in levels])

    def typed(g: Column) -> Column:
        np_, nl, ng = F.size(g["points"]), F.size(g["lines"]), F.size(g["polys"])
        n = np_ + nl + ng
        kind = (
            F.when((n == 1) & (np_ == 1), "Point")
            .when((n == 1) & (nl == 1), "LineString")
            .when(n == 1, "Polygon")
            .when(np_ == n, "MultiPoint")
            .when(nl == n, "MultiLineString")
            .when(ng == n, "MultiPolygon")
            .otherwise("GeometryCollection")
        )
        return F.when(n > 0, make_parts(kind, g["points"], g["lines"], g["polys"]))

    return let(F.struct(gather(0).alias("points"), gather(1).alias("lines"), gather(2).alias("polys")), typed)


def _fields(pm: Column) -> Column:
    data = F.transform(
        F.coalesce(pm["ExtendedData"]["Data"], empty_list("array<struct<_name:string,value:string>>")),
        lambda d: F.struct(F.trim(d["_name"]).alias("key"), F.trim(F.coalesce(d["value"], F.lit(""))).alias("value")),
    )
    simple = F.transform(
        F.flatten(
            F.transform(
                F.coalesce(pm["ExtendedData"]["SchemaData"], empty_list("array<struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>")),
                lambda s: F.coalesce(s["SimpleData"], empty_list("array<struct<_name:string,_VALUE:string>>")),
            )
        ),
        lambda s: F.struct(F.trim(s["_name"]).alias("key"), F.trim(F.coalesce(s["_VALUE"], F.lit(""))).alias("value")),
    )
    return first_per_key(F.filter(F.concat(data, simple), lambda f: F.coalesce(f["key"], F.lit("")) != ""))


def first_per_key(pairs: Column) -> Column:
    """Key/value pairs with only the first value of every key."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)


def _nesting(text: Column, tag: str) -> Column:
    """How deep a tag is nested in itself; tags in comments can only make it larger."""
    turns = F.regexp_extract_all(text, F.lit(rf"<(/?)(?:\w+:)?{tag}\b(?![^>]*/>)"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, closing: Column) -> Column:
        now = s["now"] + F.when(closing == "/", -1).otherwise(1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(turns, start, step, lambda s: s["most"])


def read_kml(spark: SparkSession, path: str | list[str], lenient: bool = False) -> DataFrame:
    """One row per placemark of KML files, in document order.

    ``(file, position, name, folder_path, description, fields, timestamp, source_id, geometry)``.
    One pass over the text finds how deep folders and geometry collections go, so that all are followed. A
    file is one unit of work. ``lenient`` leaves out malformed coordinates instead of the whole part. Files with a
    DOCTYPE and files that are not well formed are refused.
    """
    texts = spark.read.text(path, wholetext=True)
    facts = texts.agg(
        F.coalesce(F.bool_or(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)")), F.lit(False)).alias("banned"),
        F.coalesce(F.max(_nesting(F.col("value"), "Folder")), F.lit(0)).alias("depth"),
        F.coalesce(F.max(_nesting(F.col("value"), "MultiGeometry")), F.lit(0)).alias("multi"),
    ).first()
    if facts.banned:
        raise ValueError("DOCTYPE is not accepted")
    depth, multi = max(1, facts.depth), facts.multi
    placemark = _placemark(multi)
    body = f"Placemark array<{placemark}>, Folder array<{_folder(depth - 1, placemark)}>"
    container = f"struct<Placemark: array<{placemark}>, Folder: array<{_folder(depth - 1, placemark)}>>"
    doc = spark.read.format("xml").option("rowTag", "kml").option("mode", "FAILFAST").schema(f"Document array<{container}>, {body}").load(path)
    # a file that ends too early gives no document and no error of its own
    whole = doc.select(F.col("_metadata.file_path").alias("file")).distinct()
    lost = texts.select(F.col("_metadata.file_path").alias("file")).join(whole, "file", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"not a whole KML document: {', '.join(r.file for r in lost)}")
    none = empty_list("array<string>")
    root = _placemarks(F.struct("Placemark", "Folder"), none, F.array(F.lit(0)), depth, placemark)
    inside = F.flatten(F.transform("Document", lambda d, i: _placemarks(d, none, F.array(F.lit(1), i), depth, placemark)))
    found = F.when(F.col("Document").isNull(), root).otherwise(F.concat(root, inside))
    marks = doc.select(F.col("_metadata.file_path").alias("file"), F.inline(found))
    positions = kml_positions_lenient if lenient else kml_positions
    pm = F.col("pm")
    return marks.select(
        "file",
        F.col("place").alias("position"),
        F.trim(F.coalesce("pm.name", F.lit(""))).alias("name"),
        F.col("path").alias("folder_path"),
        F.coalesce("pm.description", F.lit("")).alias("description"),
        _fields(pm).alias("fields"),
        F.coalesce("pm.TimeStamp.when", "pm.TimeSpan.begin").alias("timestamp"),
        F.col("pm._id").alias("source_id"),
        _placemark_parts(pm, positions, multi).alias("geometry"),
    )


def kml_table(marks: DataFrame) -> DataFrame:
    """Placemarks as a plain table: name, folder, plain description, one column per field."""
    keys = [r.k for r in marks.select(F.explode("fields.key").alias("k")).distinct().orderBy("k").collect()]  # one per column
    by_key = F.map_from_entries("fields")
    plain = F.trim(F.regexp_replace(F.regexp_replace("description", "<[^>]+>", " "), r"\s+", " "))
    return marks.select(
        "file",
        "position",
        F.nullif("name", F.lit("")).alias("nome"),
        F.nullif(F.concat_ws(" / ", "folder_path"), F.lit("")).alias("pasta"),
        F.nullif(plain, F.lit("")).alias("descricao"),
        *[F.nullif(F.try_element_at(by_key, F.lit(k)), F.lit("")).alias(k) for k in keys],
        "geometry",
    )


# ------------------------------------------------------------------ key/value pairs in descriptions

def _decoded(c: Column) -> Column:
    for name, char in V.HTML_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(c, "<[^>]+>", " ")), r"\s+", " "))


def description_fields(html: Column | str) -> Column:
    """``array<struct<key, value>>`` from two-cell table rows, then from ``key: value`` lines."""
    text = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    keys, vals = F.regexp_extract_all(text, F.lit(V.DESCRIPTION_ROW), F.lit(1)), F.regexp_extract_all(text, F.lit(V.DESCRIPTION_ROW), F.lit(2))
    rows = F.transform(
        F.arrays_zip(keys.alias("k"), vals.alias("v")), lambda p: F.struct(_stripped(p["k"]).alias("key"), _stripped(p["v"]).alias("value"))
    )
    plain = _decoded(F.regexp_replace(F.regexp_replace(text, V.DESCRIPTION_BLOCK_END, "\n"), "<[^>]+>", " "))
    lines = F.filter(F.split(plain, r"\n+"), lambda x: x.rlike(V.DESCRIPTION_LINE))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(x, V.DESCRIPTION_LINE, 1), r"\s+", " ")).alias("key"),
            F.trim(F.regexp_extract(x, V.DESCRIPTION_LINE, 2)).alias("value"),
        ),
    )
    return first_per_key(F.filter(F.concat(rows, pairs), lambda p: p["key"] != ""))


def merged_fields(structured: Column | str, described: Column) -> Column:
    """Structured pairs first; a described pair is kept only when its key is not there already."""
    s = F.col(structured) if isinstance(structured, str) else structured
    taken = F.transform(s, lambda p: field_key(p["key"]))
    return F.concat(s, F.filter(described, lambda p: ~F.array_contains(taken, field_key(p["key"]))))
