"""From placemarks to normalised survey records, issues and an import report.

Nothing is corrected silently: every interpretation leaves an issue on its record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import survey_fields as S
from tablelens.functions import vocabulary as V
from tablelens.functions.geometry import in_plausible_area, survey_point
from tablelens.functions.values import field_key, leading_count, name_key
from tablelens.operators.duplicates import completeness, duplicate_groups, find_duplicates
from tablelens.operators.linkage import resolve_names, similar_names
from tablelens.operators.spatial import first_polygon
from tablelens.operators.tables import number_rows
from tablelens.session import cut_lineage
from tablelens.sources.geo_files import description_fields, merged_fields

ISSUE = "struct<severity:string,code:string>"
RECORD_TYPES_WITH_PLACE = ("captura", "visita", "pit")
DUPLICATE_BLOCK = ["type", "locality_key"]
DUPLICATE_ATTRIBUTES = [
    "property_ref", "visit_date", "sex", "stage", "channel", "environment", "species", "source_id", "_exam",
]


@dataclass(frozen=True)
class Mapping:
    """User decisions: field labels, folder types, locality spellings and the names of the whole area."""

    fields: dict[str, str] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)
    locality_aliases: dict[str, str] = field(default_factory=dict)
    boundary_places: tuple[str, ...] = ()


@dataclass(frozen=True)
class Imported:
    records: DataFrame
    issues: DataFrame
    duplicates: DataFrame
    similar_localities: DataFrame


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _issue(cond: Column, severity: str, code: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def numbered(marks: DataFrame) -> DataFrame:
    """``index``: the number of the file, in the order of names, times 2 ** 32, plus the place of a record in its file.

    Records are sorted in ranges of (file, position), so a large file is many tasks and no window holds a file.
    """
    placed = number_rows(marks, ["file", "position"], "_place")
    files = number_rows(placed.groupBy("file").agg(F.min("_place").alias("_first_place")), ["file"], "_file_no")
    index = F.col("_file_no") * F.lit(1 << 32) + F.col("_place") - F.col("_first_place")
    return placed.join(files, "file").withColumn("index", index).drop("_place", "_first_place", "_file_no")


def _folder_choice(mapping: Mapping) -> Column:
    """The type the user gave to the folder path or, innermost first, to one of its folders."""
    if not mapping.folders:
        return F.lit(None).cast("string")
    import unicodedata

    def plain(text: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())

    table = F.create_map(*[F.lit(x) for k, v in mapping.folders.items() for x in (plain(k), v)])
    full = F.try_element_at(table, name_key(F.concat_ws(" / ", "folder_path")))
    each = F.array_compact(F.transform("folder_path", lambda f: F.try_element_at(table, name_key(f))))
    return F.coalesce(full, F.try_element_at(each, F.lit(-1)))


def classify(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Adds ``type``: user choice, then geometry, then folder names, then the fields present."""
    kind = F.col("_first")
    filled = lambda *names: F.coalesce(*[_blank(S.canonical_value("_fields", n)) for n in names]).isNotNull()
    specimen = filled("resultado_exame", "quantidade", "fase_sexo", "especie", "canal")
    guess = S.folder_type("folder_path")
    inferred = (
        F.when(kind == "LineString", "rota")
        .when(kind == "Polygon", F.when(guess == "localidade", "localidade").otherwise("area"))
        .when((guess == "pit") & specimen, "captura")
        .when(guess.isNotNull(), guess)
        .when(specimen, "captura")
        .when(filled("pit"), "pit")
        .when(filled("resultado_busca"), "visita")
        .otherwise("outro")
    )
    return rows.withColumn("type", F.coalesce(_folder_choice(mapping), inferred))


def _mark_reference_points(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Unmarked points of a folder whose points mostly carry start/end marks are reference points."""
    marked = S.has_end_marker("name")
    point = F.col("_first") == "Point"
    per_folder = (
        rows.where(point & (S.folder_type("folder_path") == "localidade"))
        .groupBy("file", F.concat_ws(" / ", "folder_path").alias("_folder"))
        .agg((F.avg(marked.cast("int")) >= 0.5).alias("_convention"))
    )
    joined = rows.withColumn("_folder", F.concat_ws(" / ", "folder_path")).join(per_folder, ["file", "_folder"], "left")
    apart = F.lit(not mapping.folders) & (F.col("type") == "localidade") & point & F.coalesce("_convention", F.lit(False)) & ~marked
    return joined.withColumns({"_reference": apart, "type": F.when(apart, "outro").otherwise(F.col("type"))}).drop("_convention")


def _first_geometry(g: Column) -> tuple[Column, Column]:
    """Kind and parts of the first geometry of a record; further ones are not kept."""
    from tablelens.functions.geometry import make_parts

    kind = F.when(F.size(g["points"]) > 0, "Point").when(F.size(g["lines"]) > 0, "LineString").when(F.size(g["polys"]) > 0, "Polygon")
    one = F.when(
        kind.isNotNull(),
        make_parts(
            kind,
            F.when(kind == "Point", F.slice(g["points"], 1, 1)).otherwise(F.slice(g["points"], 1, 0)),
            F.when(kind == "LineString", F.slice(g["lines"], 1, 1)).otherwise(F.slice(g["lines"], 1, 0)),
            F.when(kind == "Polygon", F.slice(g["polys"], 1, 1)).otherwise(F.slice(g["polys"], 1, 0)),
        ),
    )
    return kind, one


def normalise(marks: DataFrame, mapping: Mapping = Mapping()) -> Imported:
    """Normalised records of placemarks read with ``read_kml(..., lenient=True)``."""
    described = merged_fields("fields", description_fields("description"))
    kind, one = _first_geometry(F.col("geometry"))
    parts = F.size("geometry.points") + F.size("geometry.lines") + F.size("geometry.polys")
    read = marks.withColumns(
        {"_fields": S.canonical_fields(described, mapping.fields), "_first": kind, "_several": F.coalesce(parts, F.lit(0)) > 1, "_one": one}
    )
    # the files are read and their fields named once, before ranges of them are sampled and sorted
    rows = cut_lineage(numbered(cut_lineage(read.drop("description", "fields", "geometry"))))
    rows = _mark_reference_points(classify(rows, mapping), mapping)
    value = lambda canon: S.canonical_value("_fields", canon)
    rows = rows.withColumns(
        {
            "_spot": survey_point("_one"),
            "_visit_text": F.coalesce(value("data_visita"), F.col("timestamp")),
            "_exam_text": value("resultado_exame"),
            "_search_text": value("resultado_busca"),
            "_count_text": value("quantidade"),
            "_channel_text": value("canal"),
            "_place_text": _blank(value("localidade")),
        }
    ).withColumns(
        {
            "_visit": S.survey_date("_visit_text"),
            "_exam_day": S.survey_date(value("data_exame")),
            "_exam_read": S.exam_result("_exam_text"),
            "_search_read": S.search_result("_search_text"),
            "_mix": S.stage_and_sex(value("fase_sexo")),
            "_named_species": F.when(
                (F.col("type") == "captura") & _blank(value("especie")).isNull() & (F.col("name") != ""), S.species_of("name")
            ),
        }
    )
    capture, visited = F.col("type") == "captura", F.col("type").isin("captura", "visita")
    search = (
        F.when(~visited, V.NOT_INFORMED)
        .when(capture & (F.col("_search_read.value") == V.NOT_INFORMED), "com_captura")
        .otherwise(F.col("_search_read.value"))
    )
    own_name = F.when(F.col("_first") == "Point", S.clean_locality("name")).otherwise(F.col("name"))
    from_folder = S.place_folder("folder_path")
    with_place = F.col("type").isin(*RECORD_TYPES_WITH_PLACE)
    place = F.when(F.col("type") == "localidade", F.coalesce("_place_text", _blank(own_name))).otherwise(
        F.coalesce("_place_text", F.when(with_place, from_folder))
    )
    lon, lat = F.get("_spot", F.lit(0)), F.get("_spot", F.lit(1))
    exam_key = field_key(F.coalesce("_exam_text", F.lit("")))
    corrected = (
        F.col("_exam_read.recognized")
        & (exam_key != "")
        & ~exam_key.isin("positivo", "negativo", "pendente")
        & (F.col("_exam_read.value") != V.NOT_INFORMED)
        & (F.levenshtein(exam_key, F.col("_exam_read.value"), 1) >= 0)
    )
    count = leading_count("_count_text")
    issues = F.array_compact(
        F.array(
            _issue(F.col("_first").isNull(), "aviso", "sem_coordenadas"),
            _issue(F.col("_several"), "info", "multiplas_geometrias"),
            _issue(F.col("_reference"), "info", "ponto_de_referencia"),
            _issue(lon.isNotNull() & ~in_plausible_area(lon, lat), "aviso", "fora_da_area"),
            _issue(~F.col("_visit.valid"), "aviso", "data_invalida"),
            _issue(~F.col("_exam_day.valid"), "aviso", "data_invalida"),
            _issue(F.col("_exam_day.date") < F.col("_visit.date"), "aviso", "exame_antes_da_captura"),
            _issue(~F.col("_exam_read.recognized"), "aviso", "resultado_exame_desconhecido"),
            _issue(corrected, "info", "resultado_exame_corrigido"),
            _issue(~F.col("_search_read.recognized"), "aviso", "resultado_busca_desconhecido"),
            _issue(capture & (F.col("_search_read.value") == "sem_captura"), "aviso", "captura_contraditoria"),
            _issue((F.col("type") != "localidade") & F.col("_place_text").isNull() & with_place & from_folder.isNotNull(), "info", "localidade_pela_pasta"),
            _issue(_blank(F.col("_count_text")).isNotNull() & count.isNull(), "aviso", "quantidade_invalida"),
            _issue(_blank(F.col("_channel_text")).isNotNull() & S.channel("_channel_text").isNull(), "info", "canal_desconhecido"),
            _issue(F.col("_named_species").isNotNull(), "info", "especie_pelo_nome"),
        )
    )
    outline = lambda c: S.is_boundary_name(c, mapping.boundary_places)
    records = rows.select(
        "file",
        "index",
        F.coalesce(_blank(value("id_origem")), "source_id").alias("source_id"),
        "type",
        "name",
        "folder_path",
        place.alias("_place"),
        ((F.col("type") != "localidade") & place.isNotNull()).alias("_from_record"),
        F.col("_one").alias("geometry"),
        F.col("_first").alias("geometry_type"),
        lat.alias("lat"),
        lon.alias("lng"),
        F.col("_visit.date").alias("visit_date"),
        F.col("_exam_day.date").alias("exam_date"),
        search.alias("search_result"),
        F.when(capture, F.col("_exam_read.value")).otherwise(V.NOT_INFORMED).alias("exam_result"),
        count.alias("triatomine_count"),
        F.coalesce(_blank(value("fase")), "_mix.stage").alias("stage"),
        F.coalesce(_blank(value("sexo")), "_mix.sex").alias("sex"),
        F.coalesce(_blank(value("especie")), "_named_species").alias("species"),
        _blank(value("imovel")).alias("property_ref"),
        _blank(value("pit")).alias("pit_ref"),
        F.when(F.col("type") == "localidade", leading_count(value("qtd_imoveis"))).alias("property_count"),
        _blank(F.trim(value("zona"))).alias("zone"),
        S.channel("_channel_text").alias("channel"),
        S.environment(value("ambiente")).alias("environment"),
        _blank(value("endereco")).alias("address"),
        (
            (F.col("type") == "area")
            & (outline(F.col("name")) | F.exists("folder_path", outline))
        ).alias("is_boundary"),
        F.col("_fields").alias("raw"),
        issues.alias("issues"),
    )
    records = cut_lineage(records)
    records = cut_lineage(_with_places(records, mapping))
    found = cut_lineage(_duplicates(records))
    records = records.join(found, "index", "left").withColumn(
        "issues", F.concat("issues", F.array_compact(F.array(_issue(F.col("duplicate_of").isNotNull(), "aviso", "possivel_duplicata"))))
    )
    log = records.select("index", F.inline("issues"))
    names = records.where("locality_key <> ''").groupBy("locality_key").agg(F.min("locality_raw").alias("name"))
    return Imported(records, log, duplicate_groups(found, records.withColumn("_path", F.concat_ws(" / ", "folder_path")), "index", "_path"), similar_names(names, "locality_key", "name"))


def _with_places(records: DataFrame, mapping: Mapping) -> DataFrame:
    """Locality key and name: against the mapped localities, else by the position of the point."""
    named = records.where("_place is not null")
    polygons = records.where("type = 'localidade' and geometry_type = 'Polygon' and _place is not null")
    has_polygons = not polygons.limit(1).isEmpty()
    reference = (polygons if has_polygons else named.where("type = 'localidade'")).select(F.col("_place").alias("name"))
    resolved = resolve_names(named, "_place", _aliased(reference, mapping), aliases=mapping.locality_aliases)
    # the names are resolved once: areas, points and records below all come from them
    resolved = cut_lineage(resolved.select(F.col("name").alias("_place"), F.col("key").alias("locality_key"), F.col("resolved").alias("locality_raw"), "how"))
    out = records.join(resolved, "_place", "left").withColumn("locality_key", _blank(F.col("locality_key")))
    if has_polygons:
        known = out.where("type = 'localidade' and geometry_type = 'Polygon' and locality_key is not null").select(
            F.struct("locality_key", "locality_raw").alias("place"), "index", "geometry"
        )
        lost = out.where(F.col("locality_key").isNull() & (F.col("geometry_type") == "Point") & F.col("type").isin(*RECORD_TYPES_WITH_PLACE))
        hits = first_polygon(known, "place", "geometry", "index", lost, "index", "lng", "lat").select("index", F.col("polygon").alias("_hit"))
        out = out.join(hits, "index", "left")
    else:
        out = out.withColumn("_hit", F.lit(None).cast("struct<locality_key:string,locality_raw:string>"))
    out = out.withColumns(
        {"locality_key": F.coalesce("locality_key", "_hit.locality_key"), "locality_raw": F.coalesce("locality_raw", "_hit.locality_raw")}
    )
    needs = F.col("type").isin(*RECORD_TYPES_WITH_PLACE)
    unknown = (F.col("how") == "new") & F.col("_from_record") & F.lit(has_polygons)
    extra = F.array_compact(
        F.array(
            _issue(F.col("how").isin("similar", "partial", "alias"), "info", "localidade_corrigida"),
            _issue(unknown, "aviso", "localidade_nao_reconhecida"),
            _issue(F.col("_hit").isNotNull(), "info", "localidade_por_geometria"),
            _issue(F.col("locality_key").isNull() & needs, "aviso", "localidade_nao_reconhecida"),
        )
    )
    return out.withColumn("issues", F.concat("issues", extra)).withColumnRenamed("how", "locality_how").drop("_place", "_from_record", "_hit")


def _aliased(reference: DataFrame, mapping: Mapping) -> DataFrame:
    if not mapping.locality_aliases:
        return reference
    table = reference.sparkSession.createDataFrame(list(mapping.locality_aliases.items()), "a string, target string")
    table = table.groupBy(name_key("a").alias("_k")).agg(F.min("target").alias("target"))
    return reference.withColumn("_k", name_key("name")).join(F.broadcast(table), "_k", "left").select(F.coalesce("target", "name").alias("name"))


def _duplicates(records: DataFrame) -> DataFrame:
    rows = records.where(
        F.col("type").isin("captura", "visita")
        & (F.col("lat").isNotNull() | F.coalesce("property_ref", F.col("visit_date").cast("string"), "source_id").isNotNull())
    ).withColumn("_exam", F.when(F.col("exam_result") != V.NOT_INFORMED, F.col("exam_result")))
    score = completeness(["visit_date", "exam_date", "source_id", "species", "stage", "channel", "environment", "_exam"])
    return find_duplicates(rows, "index", score, DUPLICATE_BLOCK, DUPLICATE_ATTRIBUTES)


# ------------------------------------------------------------------ reports


def import_report(done: Imported) -> DataFrame:
    """Counts of an import as rows ``(section, item, n)``."""
    r = done.records
    row = lambda frame, section: frame.select(F.lit(section).alias("section"), F.col("item").cast("string").alias("item"), F.col("n").cast("bigint").alias("n"))
    count = F.count(F.lit(1)).alias("n")
    out = row(r.groupBy(F.col("type").alias("item")).agg(count), "type")
    out = out.unionByName(row(r.groupBy(F.coalesce("geometry_type", F.lit("none")).alias("item")).agg(count), "geometry"))
    out = out.unionByName(row(r.where("locality_key <> ''").agg(F.lit("localities").alias("item"), F.count_distinct("locality_key").alias("n")), "localities"))
    fields = r.select("index", F.explode("raw").alias("f"))
    seen = fields.where("f.canon is not null and f.canon <> 'ignorar' and f.value <> ''").groupBy(F.col("f.canon").alias("item")).agg(F.count_distinct("index").alias("n"))
    out = out.unionByName(row(seen, "field_seen"))
    unmapped = fields.where("f.canon is null and not f.personal and f.value <> ''").groupBy(F.col("f.key").alias("item")).agg(count)
    out = out.unionByName(row(unmapped, "field_unmapped"))
    out = out.unionByName(row(fields.where("f.personal").groupBy(F.col("f.key").alias("item")).agg(count), "field_dropped"))
    return out.unionByName(row(done.issues.groupBy(F.concat_ws(":", "severity", "code").alias("item")).agg(count), "issue"))


def source_facts_of(done: Imported) -> DataFrame:
    """What the file carried before any filter, in the shape the indicators expect."""
    has = lambda canon: F.exists("raw", lambda p: F.coalesce((p["canon"] == canon) & (p["value"] != ""), F.lit(False)))
    return done.records.agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in V.RECORD_TYPES],
        F.lit(False).alias("manual"),
        F.coalesce(F.bool_or(has("resultado_busca")), F.lit(False)).alias("search_seen"),
        F.coalesce(F.bool_or(has("resultado_exame")), F.lit(False)).alias("exam_seen"),
    )


def pending_checks(done: Imported, drop_duplicates: bool = False) -> DataFrame:
    """What the owner of the data should check: ``(index, name, locality, visit_date, problem)``."""
    kept = done.records.where("duplicate_of is null") if drop_duplicates else done.records
    codes = F.transform("issues", lambda i: i["code"])
    with_code = lambda c: F.array_contains(codes, c)
    needs = F.col("type").isin(*RECORD_TYPES_WITH_PLACE)
    capture = F.col("type") == "captura"
    exam_seen = source_facts_of(done).select("exam_seen").scalar()
    problems = F.array_compact(
        F.array(
            F.when(with_code("exame_antes_da_captura"), "exam_before_capture"),
            F.when(with_code("localidade_nao_reconhecida") & needs, "unknown_locality"),
            F.when(with_code("data_invalida"), "invalid_date"),
            F.when(with_code("fora_da_area"), "outside_area"),
            F.when(capture & F.col("_exam_seen") & (F.col("exam_result") == V.NOT_INFORMED), "without_exam_result"),
            F.when(capture & F.col("visit_date").isNull() & ~with_code("data_invalida"), "without_capture_date"),
            F.when(capture & F.col("species").isNull(), "without_species"),
        )
    )
    base = kept.withColumn("_exam_seen", exam_seen).withColumn("problem", F.explode(problems))
    listed = base.select("index", F.col("name"), F.col("locality_raw").alias("locality"), "visit_date", "problem")
    drawn = done.records.where("type = 'localidade' and geometry_type = 'Polygon' and locality_key is not null").select("locality_key").distinct()
    flagged = listed.where("problem = 'unknown_locality'").select(F.col("locality").alias("locality_raw")).distinct()
    bare = (
        kept.where(needs & F.col("locality_key").isNotNull())
        .join(drawn, "locality_key", "left_anti")
        .join(flagged, "locality_raw", "left_anti")
        .groupBy("locality_key")
        .agg(F.min("index").alias("index"), F.min("locality_raw").alias("locality"))
    )
    # without any drawn locality there is nothing to miss
    any_drawn = drawn.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    bare = bare.withColumn("_any", any_drawn).where("_any").select(
        "index", F.col("locality").alias("name"), "locality", F.lit(None).cast("date").alias("visit_date"), F.lit("locality_without_area").alias("problem")
    )
    return listed.unionByName(bare)


def issue_counts(done: Imported) -> DataFrame:
    """Warnings and errors by code."""
    return done.issues.where("severity <> 'info'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
