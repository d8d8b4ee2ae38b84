"""Faceted queries over survey records.

Every facet ignores its own filter and honours all others; an indicator whose source never carried
the field is absent, which is not 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.ranks import medians
from tablelens.functions.values import fold, round_half_up
from tablelens.operators.filters import fold_words
from tablelens.operators.tables import page_of

RECORD_SCHEMA = """
  rid string, origin string, type string, name string, locality_key string, locality_raw string, visit_date date, exam_date date,
  search_result string, exam_result string, triatomine_count int, stage string, sex string, species string, lat double, lng double,
  channel string, environment string, property_count int, zone string, pit_ref string, is_boundary boolean, duplicate_of bigint
"""
SEARCH_FIELDS = ("name", "locality_raw", "species")
GEO_TYPES = ("localidade", "area", "rota")


@dataclass(frozen=True)
class Filters:
    start: str | None = None
    end: str | None = None
    locality: str | None = None
    layers: tuple[str, ...] = ()
    search: tuple[str, ...] = ()
    exam: tuple[str, ...] = ()
    channel: tuple[str, ...] = ()
    species: tuple[str, ...] = ()
    environment: tuple[str, ...] = ()
    text: str | None = None

    def without(self, *names: str) -> Filters:
        blank = Filters()
        return replace(self, **{n: getattr(blank, n) for n in names})


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def predicates(f: Filters, search_fields: tuple[str, ...] = SEARCH_FIELDS) -> dict[str, Column]:
    """One condition per active filter, by the name of the filter."""
    out: dict[str, Column] = {}
    if f.start:
        out["start"] = F.col("visit_date") >= F.lit(f.start).cast("date")
    if f.end:
        out["end"] = F.col("visit_date") <= F.lit(f.end).cast("date")
    if f.locality:
        out["locality"] = F.col("locality_key") == f.locality
    lists = {
        "layers": "type", "search": "search_result", "exam": "exam_result",
        "channel": "channel", "species": "species", "environment": "environment",
    }
    for name, column in lists.items():
        if getattr(f, name):
            out[name] = F.col(column).isin(list(getattr(f, name)))
    if f.text:
        words = " ".join(fold_words(f.text.replace("%", "").replace("_", "")))
        cond = F.lit(False)
        for c in search_fields:
            cond = cond | _true(fold(c).contains(words))
        out["text"] = cond
    return out


def select_records(records: DataFrame, f: Filters, search_fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    out = records
    for cond in predicates(f, search_fields).values():
        out = out.where(cond)
    return out


def captures(records: DataFrame, f: Filters) -> DataFrame:
    return select_records(records, f.without("layers")).where("type = 'captura'")


def _is(column: str, value: str) -> Column:
    return _true(F.col(column) == value)


def _exam_counts() -> list[Column]:
    return [*[F.count_if(_is("exam_result", k)).alias(k) for k in V.EXAM_RESULTS], F.count(F.lit(1)).alias("total")]


# ------------------------------------------------------------------ indicators


def source_facts(records: DataFrame) -> DataFrame:
    """What the source carried, from the records alone: one row of flags."""
    seen = lambda cond: _true(F.bool_or(_true(cond)))
    return records.agg(
        *[F.count_if(_is("type", t)).alias(f"n_{t}") for t in V.RECORD_TYPES],
        seen(F.col("origin") == "manual").alias("manual"),
        seen(F.col("search_result").isin("com_captura", "sem_captura") & (F.col("type") == "visita")).alias("search_seen"),
        seen(F.col("exam_result") != V.NOT_INFORMED).alias("exam_seen"),
    )


def kpis(records: DataFrame, f: Filters = Filters(), facts: DataFrame | None = None) -> DataFrame:
    """Ten indicators: ``(position, indicator, value, status, unit, note)``.

    ``facts`` says what the whole source carried before filtering (see ``source_facts``); without
    the field an indicator is ``ausente`` and has no value.
    """
    facts = facts if facts is not None else source_facts(records)
    capture = _is("type", "captura")
    exam = lambda *v: F.count_if(capture & _true(F.col("exam_result").isin(*v)))
    n = select_records(records, f).agg(
        F.count_distinct("locality_key").alias("localities"),
        F.count_if(_is("type", "visita")).alias("visits"),
        F.count_if(_is("search_result", "com_captura")).alias("with_capture"),
        F.count_if(_is("search_result", "sem_captura")).alias("without_capture"),
        exam("positivo").alias("positive"),
        exam("negativo").alias("negative"),
        exam("pendente", "nao_realizado").alias("pending"),
        exam(V.NOT_INFORMED).alias("not_informed"),
        F.count_if(_is("type", "pit")).alias("posts"),
        F.coalesce(F.sum(F.when(capture, F.col("triatomine_count"))), F.lit(0)).alias("specimens"),
        F.count_if(capture & F.col("triatomine_count").isNotNull()).alias("_counted"),
        F.count_if(capture & F.col("triatomine_count").isNull()).alias("_uncounted"),
    )
    flag = lambda name: facts.select(name).scalar()
    has = lambda t: flag(f"n_{t}") > 0
    c, none = F.col, F.lit("")
    known = {
        "localities": ((c("localities") > 0) | has("localidade"), "localidades", none),
        "visits": (has("visita") | flag("manual"), "visitas", none),
        "with_capture": (has("captura") | has("visita") | flag("manual"), "registros", none),
        "without_capture": (flag("search_seen") | flag("manual"), "buscas", none),
        "positive": (flag("exam_seen"), "registros de captura", none),
        "negative": (flag("exam_seen"), "registros de captura", none),
        "pending": (flag("exam_seen"), "registros de captura", none),
        "not_informed": (has("captura"), "registros de captura", none),
        "posts": (has("pit"), "PITs", none),
        "specimens": (c("_counted") > 0, "triatomíneos", F.when(c("_uncounted") > 0, F.concat(F.lit("uncounted:"), c("_uncounted").cast("string"))).otherwise("")),
    }
    tagged = n.withColumns({f"_k_{k}": cond for k, (cond, _, _) in known.items()})
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(k).alias("indicator"),
                F.when(c(f"_k_{k}"), c(k).cast("bigint")).alias("value"),
                F.when(c(f"_k_{k}"), "confirmado").otherwise("ausente").alias("status"),
                F.lit(unit).alias("unit"),
                note.alias("note"),
            )
            for i, (k, (_, unit, note)) in enumerate(known.items())
        ]
    )
    return tagged.select(F.inline(rows))


def summary(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Captures, results, positivity and properties under all filters."""
    n = captures(records, f).agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if(_is("exam_result", "positivo")).alias("positive"),
        F.count_if(_is("exam_result", "negativo")).alias("negative"),
    )
    props = property_counts(records)
    if f.locality:
        props = props.where(F.col("locality_key") == f.locality)
    totals = props.agg(F.sum("properties").alias("p"), F.count(F.lit(1)).alias("l"))
    with_result = F.col("positive") + F.col("negative")
    return n.select(
        "captures",
        with_result.alias("with_result"),
        "positive",
        "negative",
        round_half_up(F.try_divide(F.col("positive") * 100, with_result), 1).alias("positivity"),
        totals.select("p").scalar().alias("properties"),
        totals.select("l").scalar().alias("localities_with_properties"),
    )


def property_counts(records: DataFrame) -> DataFrame:
    """The largest property count of every locality."""
    rows = records.where("type = 'localidade' and locality_key <> '' and property_count is not null")
    return rows.groupBy("locality_key").agg(F.max(F.greatest("property_count", F.lit(0))).alias("properties"))


# ------------------------------------------------------------------ grouped counts


def _locality_key() -> Column:
    return F.coalesce("locality_key", F.lit(""))


def _locality_name() -> Column:
    """A deterministic spelling per locality: the smallest."""
    return F.when(F.col("key") == "", V.NO_LOCALITY).otherwise(F.coalesce("_name", "key"))


def by_locality(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Exam counts, properties and captures per 100 properties; ignores the locality filter."""
    counts = captures(records, f.without("locality")).groupBy(_locality_key().alias("key")).agg(F.min("locality_raw").alias("_name"), *_exam_counts())
    rate = F.when(F.col("properties") != 0, round_half_up(F.try_divide(F.col("total") * 100, F.col("properties")), 1))
    return (
        counts.join(property_counts(records), F.col("key") == F.col("locality_key"), "left")
        .select("key", _locality_name().alias("name"), *V.EXAM_RESULTS, "total", "properties", rate.alias("captures_per_100"))
        .orderBy(F.col("total").desc(), "name")
    )


def by_species(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    counts = captures(records, f.without("species")).groupBy(F.coalesce("species", F.lit(V.UNIDENTIFIED)).alias("species")).agg(*_exam_counts())
    return counts.orderBy(F.col("species") == V.UNIDENTIFIED, F.col("total").desc(), "species")


def timeline(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Seven measures per month; ignores the period filter. Undated captures are left out."""
    rows = captures(records, f.without("start", "end")).where("visit_date is not null")
    positive, negative = _is("exam_result", "positivo"), _is("exam_result", "negativo")
    campaign, post = _is("channel", "captura"), _is("channel", "pit")
    return (
        rows.groupBy(F.date_format("visit_date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("captures"),
            F.count_if(positive).alias("positive"),
            F.count_if(negative).alias("negative"),
            F.count_if(~positive & ~negative).alias("without_result"),
            F.count_if(campaign).alias("campaign"),
            F.count_if(post).alias("post"),
            F.count_if(~campaign & ~post).alias("without_origin"),
        )
        .orderBy("month")
    )


def undated(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    return captures(records, f.without("start", "end")).agg(F.count_if(F.col("visit_date").isNull()).alias("undated"))


def _fixed_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    counts = rows.groupBy(F.coalesce(column, F.lit(V.NOT_INFORMED)).alias("key")).agg(*_exam_counts())
    return counts.orderBy(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("key")))


def by_channel(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    return _fixed_order(captures(records, f.without("channel")), "channel", [*V.CHANNELS, V.NOT_INFORMED])


def by_environment(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    return _fixed_order(captures(records, f.without("environment")), "environment", [*V.ENVIRONMENTS, V.NOT_INFORMED])


def label_flags() -> dict[str, Column]:
    stage, sex = F.lower(F.coalesce("stage", F.lit(""))), F.lower(F.coalesce("sex", F.lit("")))
    return {"Ninfa": stage.contains("ninfa"), "Macho": sex.contains("macho"), "Fêmea": sex.contains("fêmea") | sex.contains("femea")}


def labels(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """How many records carry each label; one record counts in each of its labels."""
    flags = label_flags()
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()]))
    all_labels = F.when(F.size(found) == 0, F.array(F.lit("Não informado"))).otherwise(found)
    counts = captures(records, f).select(F.explode(all_labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    fixed = F.array(*[F.lit(x) for x in ("Fêmea", "Macho", "Ninfa", "Não informado")])
    frame = records.sparkSession.range(1).select(F.posexplode(fixed).alias("position", "label"))
    return frame.join(counts, "label", "left").select("position", "label", F.coalesce("total", F.lit(0)).alias("total")).orderBy("position")


def label_combination() -> Column:
    parts = F.array_compact(F.array(*[F.when(c, n) for n, c in label_flags().items()]))
    n = F.size(parts)
    return (
        F.when(n == 0, "Não informado")
        .when(n == 3, F.concat(F.get(parts, F.lit(0)), F.lit(", "), F.concat_ws(" e ", F.slice(parts, 2, 2))))
        .otherwise(F.concat_ws(" e ", parts))
    )


def combinations(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    counts = captures(records, f).groupBy(label_combination().alias("combination")).agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.col("total").desc(), "combination")


def species_by_environment(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    places = [*V.ENVIRONMENTS, V.NOT_INFORMED]
    env = F.coalesce("environment", F.lit(V.NOT_INFORMED))
    counts = captures(records, f).groupBy(F.coalesce("species", F.lit(V.UNIDENTIFIED)).alias("species")).agg(
        *[F.count_if(env == p).alias(p) for p in places], F.count(F.lit(1)).alias("total")
    )
    return counts.orderBy(F.col("species") == V.UNIDENTIFIED, F.col("total").desc(), "species")


# ------------------------------------------------------------------ time to result


def lag_bucket(days: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (_, low, high) in enumerate(V.LAG_BUCKETS):
        cond = F.lit(True) if low is None else days >= low
        out = out.when(cond if high is None else cond & (days <= high), i)
    return out


def lag_buckets(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Captures per span of days until the exam, every span listed."""
    days = F.datediff("exam_date", "visit_date")
    counts = captures(records, f).where(days.isNotNull()).groupBy(lag_bucket(days).alias("position")).agg(F.count(F.lit(1)).alias("total"))
    frame = records.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(b[0]) for b in V.LAG_BUCKETS])).alias("position", "bucket"))
    return frame.join(counts, "position", "left").select("position", "bucket", F.coalesce("total", F.lit(0)).alias("total")).orderBy("position")


def lag_facts(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Exact median, smallest and largest number of days, and how many dates are missing."""
    rows = captures(records, f)
    days = F.datediff("exam_date", "visit_date")
    freq = rows.select(days.cast("double").alias("d")).where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    facts = rows.agg(
        F.min(days).alias("min_days"),
        F.max(days).alias("max_days"),
        F.count(days).alias("with_both_dates"),
        F.count_if(F.col("exam_date").isNull()).alias("without_exam_date"),
    )
    return facts.withColumn("median_days", medians(freq, [], "d", "n").scalar())


# ------------------------------------------------------------------ origin comparison


def _origin_counts() -> list[Column]:
    campaign, post = _is("channel", "captura"), _is("channel", "pit")
    positive = _is("exam_result", "positivo")
    examined = positive | _is("exam_result", "negativo")
    return [
        F.count_if(campaign).alias("campaign"),
        F.count_if(post).alias("post"),
        F.count_if(~campaign & ~post).alias("without_origin"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(campaign & positive).alias("positive_campaign"),
        F.count_if(post & positive).alias("positive_post"),
        F.count_if(campaign & examined).alias("examined_campaign"),
        F.count_if(post & examined).alias("examined_post"),
    ]


def origin_total(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    return captures(records, f.without("channel")).agg(*_origin_counts())


def origin_by(records: DataFrame, dimension: str, f: Filters = Filters()) -> DataFrame:
    """Origin counts per locality, species or environment; ignores the origin and its own filter."""
    rows = captures(records, f.without("channel", dimension))
    if dimension == "locality":
        counts = rows.groupBy(_locality_key().alias("key")).agg(F.min("locality_raw").alias("_name"), *_origin_counts())
        named = counts.withColumn("name", _locality_name()).drop("_name")
    elif dimension == "species":
        named = rows.groupBy(F.coalesce("species", F.lit(V.UNIDENTIFIED)).alias("key")).agg(*_origin_counts()).withColumn("name", F.col("key"))
    elif dimension == "environment":
        table = F.create_map(*[F.lit(x) for kv in {**V.EXPORT_ENVIRONMENTS, V.NOT_INFORMED: "Não informado"}.items() for x in kv])
        counts = rows.groupBy(F.coalesce("environment", F.lit(V.NOT_INFORMED)).alias("key")).agg(*_origin_counts())
        named = counts.withColumn("name", F.try_element_at(table, F.col("key")))
    else:
        raise ValueError(f"unknown dimension: {dimension}")
    return named.orderBy(F.col("total").desc(), "name")


# ------------------------------------------------------------------ lists and rankings


def service_posts(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Service posts without restricted fields, in natural name order."""
    from tablelens.operators.tables import natural_key

    rows = records.where("type = 'pit'")
    if f.locality:
        rows = rows.where(F.col("locality_key") == f.locality)
    name = F.coalesce("name", F.lit("(sem nome)"))
    return rows.select(
        name.alias("name"), F.col("pit_ref").alias("unit"), "zone", F.col("locality_raw").alias("locality"), "locality_key"
    ).orderBy(natural_key(F.col("name")), "name", "unit")


def positivity_ranking(localities: DataFrame) -> DataFrame:
    """Localities with exams by rate, number of exams and name."""
    n = F.col("positivo") + F.col("negativo")
    return (
        localities.where(n > 0)
        .select("key", "name", n.alias("exams"), round_half_up(F.col("positivo") * 100 / n, 1).alias("rate"))
        .orderBy(F.col("rate").desc(), F.col("exams").desc(), "name")
    )


def coverage_ranking(localities: DataFrame) -> DataFrame:
    return localities.where("captures_per_100 is not null").orderBy(F.col("captures_per_100").desc(), "name")


def month_rows(months: DataFrame) -> DataFrame:
    """The timeline with exams, positivity and the change against the previous listed month."""
    from pyspark.sql import Window

    exams = F.col("positive") + F.col("negative")
    before = F.lag("captures").over(Window.orderBy("month"))
    change = (F.col("captures") - before) * 100 / F.nullif(before, F.lit(0))
    return months.select(
        "*",
        exams.alias("exams"),
        round_half_up(F.try_divide(F.col("positive") * 100, exams), 1).alias("rate"),
        round_half_up(change).alias("variation"),
    )


def chart(records: DataFrame, f: Filters = Filters(), mode: str = "exam", sort: str = "name", hide_empty: bool = False) -> DataFrame:
    """Category counts per locality; ignores the locality and layer filters."""
    column, categories, types = (
        ("search_result", V.SEARCH_RESULTS, ["captura", "visita"]) if mode == "search" else ("exam_result", V.EXAM_RESULTS, ["captura"])
    )
    rows = select_records(records, f.without("layers", "locality")).where(F.col("type").isin(types))
    counts = rows.groupBy(_locality_key().alias("key")).agg(
        F.min("locality_raw").alias("_here"), *[F.count_if(_is(column, c)).alias(c) for c in categories], F.count(F.lit(1)).alias("total")
    )
    known = (
        records.where(F.col("locality_key").isNotNull() & F.col("type").isin("localidade", "captura", "visita", "pit"))
        .groupBy(F.col("locality_key").alias("key"))
        .agg(F.min("locality_raw").alias("_known"))
    )
    joined = counts.join(known, "key", "left" if hide_empty else "full")
    out = joined.select(
        "key",
        F.when(F.col("key") == "", V.NO_LOCALITY).otherwise(F.coalesce("_known", "_here", "key")).alias("name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in [*categories, "total"]],
    )
    by_name = [F.col("key") == "", F.lower("name")]
    return out.orderBy(*([F.col("total").desc(), *by_name] if sort == "total" else by_name))


def localities(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    rows = select_records(records, f.without("locality", "layers", "text")).where("locality_key is not null")
    capture = _is("type", "captura")
    return (
        rows.groupBy(F.col("locality_key").alias("key"))
        .agg(
            F.coalesce(F.min("locality_raw"), F.min("locality_key")).alias("name"),
            F.count(F.lit(1)).alias("records"),
            F.count_if(capture).alias("captures"),
            F.count_if(_is("type", "visita")).alias("visits"),
            F.count_if(capture & _is("exam_result", "positivo")).alias("positive"),
            F.count_if(capture & _is("exam_result", "negativo")).alias("negative"),
        )
        .orderBy(F.lower("name"))
    )


def map_features(records: DataFrame, f: Filters = Filters(), limit: int | None = None) -> DataFrame:
    """Rows to draw: shapes follow the layer filter only, points all but locality and text."""
    from tablelens.functions.geometry import point

    shape_ok = F.col("type").isin(list(f.layers)) if f.layers else F.lit(True)
    is_shape = F.col("type").isin(*GEO_TYPES)
    point_ok = F.lit(True)
    for cond in predicates(f.without("locality", "text")).values():
        point_ok = point_ok & _true(cond)
    spot = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), point("lng", "lat"))
    shape = F.coalesce("geometry", spot) if "geometry" in records.columns else spot
    columns = [
        "rid", "origin", "type", "name", "locality_key", "locality_raw", "visit_date", "search_result", "exam_result",
        "triatomine_count", "species", "channel", "environment", "is_boundary",
    ]
    out = records.where((is_shape & shape_ok) | (~is_shape & point_ok)).select(*columns, shape.alias("geometry")).where("geometry is not null")
    return out.limit(limit) if limit else out


def species_facet(records: DataFrame) -> DataFrame:
    rows = records.where("type = 'captura' and species is not null")
    return rows.groupBy(F.col("species").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value")


SORTABLE = (
    "channel", "environment", "type", "name", "locality_raw", "visit_date", "search_result", "exam_result",
    "triatomine_count", "species", "origin",
)


def record_page(
    records: DataFrame, f: Filters = Filters(), page: int = 1, size: int = 25, sort: str = "visit_date", descending: bool = True
) -> DataFrame:
    """One page of records, empty sort values last, equal ones by id; deep pages do not sort what comes before."""
    column = F.col(sort if sort in SORTABLE else "visit_date")
    rows = select_records(records, f if f.layers else replace(f, layers=("captura", "visita", "pit")))
    return page_of(rows, column, F.col("rid"), page, size, descending)


def record_total(records: DataFrame, f: Filters = Filters()) -> DataFrame:
    rows = select_records(records, f if f.layers else replace(f, layers=("captura", "visita", "pit")))
    return rows.agg(F.count(F.lit(1)).alias("total"))


FACETS = {
    "locality": ("locality", "locality_key"),
    "species": ("species", "species"),
    "channel": ("channel", "channel"),
    "environment": ("environment", "environment"),
    "exam": ("exam", "exam_result"),
    "search": ("search", "search_result"),
    "month": (("start", "end"), None),
}


def facets(records: DataFrame, f: Filters = Filters(), dimensions: tuple[str, ...] = tuple(FACETS)) -> DataFrame:
    """Capture counts of all facets in one scan: ``(facet, value, total)``.

    Each row is tested once per filter; a facet counts it when every filter but its own holds.
    """
    tests = predicates(f.without("layers"))
    rows = records.where("type = 'captura'").withColumns({f"_t_{n}": _true(c) for n, c in tests.items()})
    offers = []
    for d in dimensions:
        own, column = FACETS[d]
        own = (own,) if isinstance(own, str) else own
        ok = F.lit(True)
        for n in tests:
            if n not in own:
                ok = ok & F.col(f"_t_{n}")
        value = F.col(column) if column else F.date_format("visit_date", "yyyy-MM")
        offers.append(F.when(ok, F.struct(F.lit(d).alias("facet"), value.alias("value"))))
    return rows.select(F.inline(F.array_compact(F.array(*offers)))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("total"))
