"""Files for other programs: safe CSV, GeoJSON, KML and the shareable extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import vocabulary as V
from tablelens.functions.geometry import point, rounded, to_geojson
from tablelens.functions.values import is_temporal, number_of, quoted, round_half_up, text_of

FORMULA_START = r"^[=+\-@\t\r]"
SIGNED_NUMBER = r"^[+-]?\d+([.,]\d+)?$"


def neutral_text(c: Column, strict: bool = False) -> Column:
    """A leading quote where a spreadsheet would run the text as a formula.

    Signed numbers stay numbers unless ``strict``.
    """
    risky = c.rlike(FORMULA_START)
    if not strict:
        risky = risky & ~c.rlike(SIGNED_NUMBER)
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def safe_cells(df: DataFrame, strict: bool = False) -> DataFrame:
    """Every cell as the text that goes into the file."""
    out = []
    for f in df.schema.fields:
        if is_temporal(f.dataType) and not strict:
            c = F.date_format(quoted(f.name), "yyyy-MM-dd")
        else:
            c = text_of(df, f.name)
            if strict or isinstance(f.dataType, T.StringType):
                c = neutral_text(c, strict)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, separator: str = ";", strict: bool = False, mode: str = "errorifexists") -> None:
    options = {"sep": separator, "header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    safe_cells(df, strict).write.mode(mode).options(**options).csv(path)


def _labelled(c: str, table: dict[str, str], otherwise: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col(c)), otherwise if otherwise is not None else F.lit(None).cast("string"))


def records_export(records: DataFrame, source: str, version: int | None, activated: str | None, restricted: bool = False) -> DataFrame:
    """Survey records with readable codes in the fixed column order of the export."""
    from_file = F.col("origin") == "arquivo"
    searched, exam = F.col("type").isin("captura", "visita"), F.col("type") == "captura"
    have = lambda name: F.col(name) if name in records.columns else F.lit(None).cast("string")
    out = records.select(
        _labelled("origin", V.EXPORT_LABELS).alias("origem"),
        F.when(from_file, F.lit(source)).otherwise("registro manual").alias("arquivo_origem"),
        F.when(from_file, F.lit(version).cast("string")).alias("versao"),
        F.when(from_file, F.lit(activated).cast("string")).alias("data_do_arquivo"),
        _labelled("type", {k: V.EXPORT_LABELS[k] for k in ("visita", "captura", "pit")}, F.col("type")).alias("tipo"),
        F.col("name").alias("nome"),
        F.col("locality_raw").alias("localidade"),
        F.col("visit_date").cast("string").alias("data_visita"),
        F.col("exam_date").cast("string").alias("data_exame"),
        F.when(searched, _labelled("search_result", V.EXPORT_LABELS)).alias("resultado_busca"),
        F.when(exam, _labelled("exam_result", V.EXPORT_LABELS)).alias("resultado_exame"),
        F.col("triatomine_count").alias("quantidade"),
        F.col("stage").alias("fase"),
        F.col("sex").alias("sexo"),
        F.col("species").alias("especie"),
        _labelled("channel", V.EXPORT_CHANNELS).alias("origem_captura"),
        _labelled("environment", V.EXPORT_ENVIRONMENTS).alias("ambiente"),
        have("property_ref").alias("imovel"),
        F.col("pit_ref").alias("pit"),
        F.col("lat").alias("latitude"),
        F.col("lng").alias("longitude"),
        F.when(F.col("duplicate_of").isNotNull(), "sim").alias("possivel_duplicata"),
        *([have("address").alias("endereco")] if restricted else []),
    )
    return safe_cells(out, strict=True)


def kpi_export(kpis: DataFrame) -> DataFrame:
    """Indicators with value, status, unit and note."""
    return safe_cells(kpis.select("indicator", "value", "status", "unit", "note"), strict=True)


# ------------------------------------------------------------------ GeoJSON


def geojson_lines(df: DataFrame, geometry: str | None = None, lon: str | None = None, lat: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """One feature per line as text; rows with neither a shape nor a valid point are left out."""
    shape = quoted(geometry) if geometry else F.lit(None)
    if lon and lat:
        x, y = number_of(df, lon), number_of(df, lat)
        spot = F.when((F.abs(x) <= 180) & (F.abs(y) <= 90), point(x, y))
        shape = F.coalesce(quoted(geometry), spot) if geometry else spot
    left_out = {n for n in (geometry, lon, lat, *skip) if n}
    props = [quoted(c) for c in df.columns if c not in left_out]
    body = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    text = F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), to_geojson(shape), F.lit("}"))
    return df.where(shape.isNotNull()).select(text.alias("value"))


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    geojson_lines(df, **options).write.mode(mode).text(path)


# ------------------------------------------------------------------ KML


def _br_date(c: str) -> Column:
    return F.date_format(F.col(c).cast("date"), "dd/MM/yyyy")


def _marks(df: DataFrame, name: Column, fields: dict[str, Column], geometry: Column) -> DataFrame:
    data = F.array(
        *[F.struct(F.lit(k).alias("_name"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in fields.items()]
    )
    columns = [name.alias("name")]
    if fields:
        columns.append(F.struct(data.alias("Data")).alias("ExtendedData"))
    return df.select(*columns, geometry)


def _point_tag() -> Column:
    text = F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"), F.lit("0"))
    return F.struct(text.alias("coordinates")).alias("Point")


def kml_frames(records: DataFrame) -> dict[str, DataFrame]:
    """Placemark frames per folder, with the field names the import understands and nothing restricted."""
    placed = records.where("lat is not null and lng is not null")
    stage, sex = F.lower(F.coalesce("stage", F.lit(""))), F.lower(F.coalesce("sex", F.lit("")))
    parts = F.array_compact(
        F.array(
            F.when(stage.contains("ninfa"), "Ninfa"),
            F.when(sex.contains("macho"), "Macho"),
            F.when(sex.rlike("f[eê]mea"), "Fêmea"),
        )
    )
    joined = F.when(F.size(parts) > 2, F.concat(parts[0], F.lit(", "), F.concat_ws(" e ", F.slice(parts, 2, 2)))).otherwise(F.concat_ws(" e ", parts))
    captures = _marks(
        placed.where("type = 'captura'"),
        F.coalesce("species", "name", F.lit("Triatomíneo")),
        {
            "Localidade": F.col("locality_raw"),
            "Data de Captura": _br_date("visit_date"),
            "Campanha_Captura ou PIT": _labelled("channel", {"pit": "Pit", "captura": "Captura"}),
            "INTRA ou PERI": _labelled("environment", V.KML_ENVIRONMENT_LABELS),
            "Ninfa_Macho ou Femea": joined,
            "Resultado do Exame a Fresco": _labelled("exam_result", V.KML_EXAM_LABELS),
            "Data do exame": _br_date("exam_date"),
            "Quantidade": F.col("triatomine_count"),
        },
        _point_tag(),
    )
    visits = _marks(
        placed.where("type = 'visita'"),
        F.coalesce("name", F.lit("Visita")),
        {
            "Localidade": F.col("locality_raw"),
            "Data": _br_date("visit_date"),
            "Resultado da busca": _labelled("search_result", {k: V.EXPORT_LABELS[k] for k in ("sem_captura", "com_captura")}),
        },
        _point_tag(),
    )
    posts = _marks(
        placed.where("type = 'pit'"), F.coalesce("name", F.lit("PIT")), {"Nome do PIT": F.col("pit_ref"), "Localidade": F.col("locality_raw")}, _point_tag()
    )
    ring = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"), F.lit("0"))), " ")
    shapes = records.where("type = 'localidade' and size(geometry.polys) > 0")

    def polygon(rings: Column) -> Column:
        holes = F.transform(
            F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.struct(F.struct(ring(r).alias("coordinates")).alias("LinearRing"))
        )
        return F.struct(
            F.struct(F.struct(ring(rings[0]).alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs"), holes.alias("innerBoundaryIs")
        )

    # every polygon of an area, one or many
    polygons = F.struct(F.transform(F.col("geometry")["polys"], polygon).alias("Polygon")).alias("MultiGeometry")
    areas = _marks(shapes, F.coalesce("name", "locality_raw", F.lit("")), {}, polygons)
    return {"Coleta": captures, "Visitas": visits, "pits": posts, "Area das Localidades": areas}


def write_kml(records: DataFrame, path: str, mode: str = "errorifexists") -> list[str]:
    """One folder of KML files per kind of record; every part file is a document of its own."""
    written = []
    for folder, frame in kml_frames(records).items():
        target = f"{path.rstrip('/')}/{folder}"
        frame.write.mode(mode).format("xml").option("rootTag", 'kml xmlns="http://www.opengis.net/kml/2.2"').option("rowTag", "Placemark").option(
            "declaration", 'version="1.0" encoding="UTF-8"'
        ).save(target)
        written.append(target)
    return written


# ------------------------------------------------------------------ shareable extract

RESTRICTED = ("address", "property_ref", "source_id", "raw")


def shareable(records: DataFrame, groups: DataFrame | None = None, drop_duplicates: bool | None = None, digits: int = 5) -> DataFrame:
    """Records without restricted columns and with rounded coordinates.

    Unless told otherwise, copies are left out only when there are any and every group of copies
    spans folders (``groups`` as given by the duplicate step).
    """
    drop = F.lit(bool(drop_duplicates))
    if drop_duplicates is None:
        drop = F.lit(False) if groups is None else groups.agg(F.coalesce(F.bool_and("cross_folder"), F.lit(False))).scalar()
    kept = records.withColumn("_drop", drop).where(~(F.col("_drop") & F.col("duplicate_of").isNotNull())).drop("_drop")
    out = kept.drop(*RESTRICTED)
    for c in ("lat", "lng"):
        out = out.withColumn(c, round_half_up(c, digits))
    if "pit_ref" in out.columns:
        out = out.withColumn("pit_ref", F.when(F.col("type") == "pit", F.col("pit_ref")))
    if "geometry" in out.columns:
        out = out.withColumn("geometry", rounded("geometry", digits))
    return out
