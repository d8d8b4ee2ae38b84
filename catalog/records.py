"""Faceted queries over survey records derived from documents and labels."""

from pyspark.sql import functions as F

from catalog.base import RECORDS_SQL, query, survey_records, table
from tablelens.functions import survey_fields as S
from tablelens.functions import vocabulary as V
from tablelens.operators import diff as D
from tablelens.plans import campaign as C
from tablelens.session import scratch_path
from tablelens.plans.versions import Versions
from tablelens.sources import sinks as K

FILTERS = C.Filters(start="2026-02-01", end="2026-12-31", species=("especie en", "especie fr"), channel=("captura", "pit"))
F_SQL = {
    "period": "visit_date >= date '2026-02-01' and visit_date <= date '2026-12-31'",
    "species": "species in ('especie en', 'especie fr')",
    "channel": "channel in ('captura', 'pit')",
}


def cond(*skip):
    return " and ".join(v for k, v in F_SQL.items() if k not in skip) or "true"


EXAMS = ", ".join(f"count(*) filter (where exam_result = '{e}') as {e}" for e in V.EXAM_RESULTS) + ", count(*) as total"


@query("flt_records", "FLT-07", RECORDS_SQL + f"select rid from rec where {cond()} and contains(strip_accents(lower(name)), 'registro 1')")
def _(spark, d):
    f = C.Filters(start="2026-02-01", end="2026-12-31", species=FILTERS.species, channel=FILTERS.channel, text="REGÍSTRO 1%")
    return C.select_records(survey_records(spark, d), f, ("name",)).select("rid")


@query(
    "cam_unified", "CAM-01 SET-01",
    RECORDS_SQL + """select origin, count(*) as n from rec where duplicate_of is null group by 1 union all select 'manual', count(*) from labels where quality = 0""",
)
def _(spark, d):
    manual = table(spark, d, "labels").where("quality = 0").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("rid"), F.lit("manual").alias("origin"), F.lit("visita").alias("type")
    )
    kept = survey_records(spark, d).where("duplicate_of is null")
    return D.union_all(kept, manual).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cam_kpis", "CAM-02",
    RECORDS_SQL + f""", r as (select * from rec where {cond()}), k as (select count(distinct locality_key) as localities, count(*) filter (where type = 'visita') as visits,
      count(*) filter (where search_result = 'com_captura') as with_capture, count(*) filter (where search_result = 'sem_captura') as without_capture,
      count(*) filter (where type = 'captura' and exam_result = 'positivo') as positive, count(*) filter (where type = 'captura' and exam_result = 'negativo') as negative,
      count(*) filter (where type = 'captura' and exam_result in ('pendente', 'nao_realizado')) as pending, count(*) filter (where type = 'captura' and exam_result = 'nao_informado') as not_informed,
      count(*) filter (where type = 'pit') as posts, coalesce(sum(triatomine_count) filter (where type = 'captura'), 0)::bigint as specimens from r)
    select unnest(['localities','visits','with_capture','without_capture','positive','negative','pending','not_informed','posts','specimens']) as indicator,
      unnest([localities, visits, with_capture, without_capture, positive, negative, pending, not_informed, posts, specimens]) as value, 'confirmado' as status from k""",
)
def _(spark, d):
    return C.kpis(survey_records(spark, d), FILTERS).select("indicator", "value", "status")


@query(
    "cam_kpis_absent", "CAM-02",
    RECORDS_SQL + """select unnest(['localities','visits','with_capture','without_capture','positive','negative','pending','not_informed','posts','specimens']) as indicator,
      unnest([count(distinct locality_key), null, null, null, null, null, null, null, count(*), null]) as value,
      unnest(['confirmado','ausente','ausente','ausente','ausente','ausente','ausente','ausente','confirmado','ausente']) as status from rec where type = 'pit'""",
)
def _(spark, d):
    posts = survey_records(spark, d).where("type = 'pit'").withColumn("exam_result", F.lit("nao_informado"))
    return C.kpis(posts).select("indicator", "value", "status")


_CHART = RECORDS_SQL + """, c as (select coalesce(locality_key, '') as key, {cats}, count(*) as total from rec where type in ({types}) and {cond} group by 1),
  known as (select locality_key as key, min(locality_raw) as name from rec where locality_key is not null and type in ('localidade','captura','visita','pit') group by 1)
  select key, case when key = '' then '(sem localidade)' else name end as name, {out}, coalesce(total, 0) as total from c full join known using (key)"""


def _chart_sql(column, values, types):
    cats = ", ".join(f"count(*) filter (where {column} = '{v}') as {v}" for v in values)
    return _CHART.format(cats=cats, types=types, cond=cond(), out=", ".join(f"coalesce({v}, 0) as {v}" for v in values))


@query("cam_by_group_exam", "CAM-03", _chart_sql("exam_result", V.EXAM_RESULTS, "'captura'"))
def _(spark, d):
    return C.chart(survey_records(spark, d), FILTERS, "exam", "total")


@query("cam_by_group_search", "CAM-03", _chart_sql("search_result", V.SEARCH_RESULTS, "'captura','visita'"))
def _(spark, d):
    return C.chart(survey_records(spark, d), FILTERS, "search")


@query(
    "cam_localities", "CAM-04",
    RECORDS_SQL + f"""select locality_key as key, min(locality_raw) as name, count(*) as records, count(*) filter (where type = 'captura') as captures, count(*) filter (where type = 'visita') as visits,
      count(*) filter (where type = 'captura' and exam_result = 'positivo') as positive, count(*) filter (where type = 'captura' and exam_result = 'negativo') as negative
    from rec where locality_key is not null and {cond()} group by 1""",
)
def _(spark, d):
    return C.localities(survey_records(spark, d), FILTERS)


@query("cam_map", "CAM-05", RECORDS_SQL + f"select rid, type, lng as lon, lat from rec where type = 'localidade' or ({cond()} and type not in ('localidade','area','rota'))")
def _(spark, d):
    g = F.col("geometry")["points"][0]
    return C.map_features(survey_records(spark, d), FILTERS).select("rid", "type", g[0].alias("lon"), g[1].alias("lat"))


@query("cam_facets_species", "CAM-06", RECORDS_SQL + "select species as value, count(*) as count from cap where species is not null group by 1")
def _(spark, d):
    return C.species_facet(survey_records(spark, d))


@query(
    "cam_summary", "CAM-07",
    RECORDS_SQL + f""", r as (select * from cap where {cond()}), p as (select locality_key, max(property_count) as m from rec where type = 'localidade' and locality_key is not null and property_count is not null group by 1)
    select count(*) as captures, count(*) filter (where exam_result in ('positivo','negativo')) as with_result, count(*) filter (where exam_result = 'positivo') as positive,
      count(*) filter (where exam_result = 'negativo') as negative,
      floor(count(*) filter (where exam_result = 'positivo') * 1000.0 / count(*) filter (where exam_result in ('positivo','negativo')) + 0.5) / 10 as positivity,
      (select sum(m)::bigint from p) as properties, (select count(*) from p) as localities_with_properties from r""",
)
def _(spark, d):
    return C.summary(survey_records(spark, d), FILTERS)


_BY_LOCALITY = RECORDS_SQL + f""", p as (select locality_key as key, max(property_count) as properties from rec where type = 'localidade' and locality_key is not null and property_count is not null group by 1),
  b as (select coalesce(locality_key, '') as key, min(locality_raw) as n0, {EXAMS} from cap where {cond()} group by 1),
  loc as (select key, case when key = '' then '(sem localidade)' else n0 end as name, b.* exclude (key, n0), properties,
    case when properties <> 0 then floor(total * 1000.0 / properties + 0.5) / 10 end as captures_per_100 from b left join p using (key)) """


@query("cam_by_locality", "CAM-08", _BY_LOCALITY + "select * from loc")
def _(spark, d):
    return C.by_locality(survey_records(spark, d), FILTERS)


@query("cam_species", "CAM-09", RECORDS_SQL + f"select coalesce(species, 'Não identificada') as species, {EXAMS} from cap where {cond('species')} group by 1")
def _(spark, d):
    return C.by_species(survey_records(spark, d), FILTERS)


_TIMELINE = RECORDS_SQL + f""", tl as (select strftime(visit_date, '%Y-%m') as month, count(*) as captures, count(*) filter (where exam_result = 'positivo') as positive,
    count(*) filter (where exam_result = 'negativo') as negative, count(*) filter (where exam_result not in ('positivo','negativo')) as without_result,
    count(*) filter (where channel = 'captura') as campaign, count(*) filter (where channel = 'pit') as post, count(*) filter (where channel is null) as without_origin
  from cap where visit_date is not null and {cond('period')} group by 1) """


@query("cam_timeline", "CAM-10", _TIMELINE + "select * from tl")
def _(spark, d):
    return C.timeline(survey_records(spark, d), FILTERS)


@query("cam_undated", "CAM-10", RECORDS_SQL + f"select count(*) as undated from cap where visit_date is null and {cond('period')}")
def _(spark, d):
    return C.undated(survey_records(spark, d), FILTERS)


@query(
    "cam_month_rows", "WIN-01 CAM-10",
    _TIMELINE + """select *, positive + negative as exams, floor(positive * 1000.0 / nullif(positive + negative, 0) + 0.5) / 10 as rate,
      floor((captures - lag(captures) over (order by month)) * 100.0 / lag(captures) over (order by month) + 0.5) as variation from tl""",
)
def _(spark, d):
    return C.month_rows(C.timeline(survey_records(spark, d), FILTERS))


@query("cam_by_channel", "CAM-11", RECORDS_SQL + f"select coalesce(channel, 'nao_informado') as key, {EXAMS} from cap where {cond('channel')} group by 1")
def _(spark, d):
    return C.by_channel(survey_records(spark, d), FILTERS)


@query("cam_by_environment", "CAM-11", RECORDS_SQL + f"select coalesce(environment, 'nao_informado') as key, {EXAMS} from cap where {cond()} group by 1")
def _(spark, d):
    return C.by_environment(survey_records(spark, d), FILTERS)


@query(
    "cam_labels", "CAM-12",
    RECORDS_SQL + f""", r as (select coalesce(contains(lower(stage), 'ninfa'), false) as a, coalesce(contains(lower(sex), 'macho'), false) as b, coalesce(contains(lower(sex), 'fêmea'), false) as c from cap where {cond()})
    select 0 as position, 'Fêmea' as label, count(*) filter (where c) as total from r union all select 1, 'Macho', count(*) filter (where b) from r
    union all select 2, 'Ninfa', count(*) filter (where a) from r union all select 3, 'Não informado', count(*) filter (where not (a or b or c)) from r""",
)
def _(spark, d):
    return C.labels(survey_records(spark, d), FILTERS)


@query(
    "cam_combinations", "CAM-13",
    RECORDS_SQL + f"""select case when stage like 'Ninfa%' and sex = 'Macho e Fêmea' then 'Ninfa, Macho e Fêmea' when stage = 'Ninfa' then 'Ninfa' when sex = 'Macho e Fêmea' then 'Macho e Fêmea'
      when sex = 'Fêmea' then 'Fêmea' else 'Não informado' end as combination, count(*) as total from cap where {cond()} group by 1""",
)
def _(spark, d):
    return C.combinations(survey_records(spark, d), FILTERS)


@query(
    "cam_matrix", "CAM-14",
    RECORDS_SQL + f"""select coalesce(species, 'Não identificada') as species, count(*) filter (where environment = 'intra') as intra, count(*) filter (where environment = 'peri') as peri,
      count(*) filter (where environment = 'intra_peri') as intra_peri, count(*) filter (where environment is null) as nao_informado, count(*) as total from cap where {cond()} group by 1""",
)
def _(spark, d):
    return C.species_by_environment(survey_records(spark, d), FILTERS)


@query(
    "cam_lag_buckets", "CAM-15",
    RECORDS_SQL + """, x as (select date_diff('day', visit_date, exam_date) as d from cap where visit_date is not null and exam_date is not null),
    b as (select unnest(range(0, 7))::int as position, unnest(['Exame antes da captura (conferir)','0 a 7 dias','8 a 14 dias','15 a 21 dias','22 a 28 dias','29 a 35 dias','Mais de 35 dias']) as bucket)
    select position, bucket, (select count(*) from x where case when d < 0 then 0 when d <= 7 then 1 when d <= 14 then 2 when d <= 21 then 3 when d <= 28 then 4 when d <= 35 then 5 else 6 end = position) as total from b""",
)
def _(spark, d):
    return C.lag_buckets(survey_records(spark, d))


@query(
    "cam_lag_facts", "CAM-15 FN-22",
    RECORDS_SQL + """, x as (select date_diff('day', visit_date, exam_date) as d, exam_date from cap)
    select min(d)::int as min_days, max(d)::int as max_days, count(d) as with_both_dates, count(*) filter (where exam_date is null) as without_exam_date, median(d)::double as median_days from x""",
)
def _(spark, d):
    return C.lag_facts(survey_records(spark, d))


_ORIGIN = """count(*) filter (where channel = 'captura') as campaign, count(*) filter (where channel = 'pit') as post, count(*) filter (where channel is null) as without_origin, count(*) as total,
  count(*) filter (where channel = 'captura' and exam_result = 'positivo') as positive_campaign, count(*) filter (where channel = 'pit' and exam_result = 'positivo') as positive_post,
  count(*) filter (where channel = 'captura' and exam_result in ('positivo','negativo')) as examined_campaign, count(*) filter (where channel = 'pit' and exam_result in ('positivo','negativo')) as examined_post"""


@query("cam_origin_total", "CAM-16", RECORDS_SQL + f"select {_ORIGIN} from cap where {cond('channel')}")
def _(spark, d):
    return C.origin_total(survey_records(spark, d), FILTERS)


_KEYS = {
    "locality": ("coalesce(locality_key, '')", "case when locality_key is null then '(sem localidade)' else min(locality_raw) end", cond("channel"), "locality_key"),
    "species": ("coalesce(species, 'Não identificada')", "coalesce(species, 'Não identificada')", cond("channel", "species"), "species"),
    "environment": (
        "coalesce(environment, 'nao_informado')",
        "case environment when 'intra' then 'Intradomicílio' when 'peri' then 'Peridomicílio' when 'intra_peri' then 'Intra e peridomicílio' else 'Não informado' end",
        cond("channel"), "environment",
    ),
}
for _dim, (_k, _n, _c, _g) in _KEYS.items():
    query(f"cam_origin_by_{_dim}", "CAM-16", RECORDS_SQL + f"select {_k} as key, {_n} as name, {_ORIGIN} from cap where {_c} group by {_g}")(
        lambda spark, d, _dim=_dim: C.origin_by(survey_records(spark, d), _dim, FILTERS)
    )


@query("cam_posts", "CAM-17", RECORDS_SQL + "select name, pit_ref as unit, zone, locality_raw as locality, locality_key from rec where type = 'pit'")
def _(spark, d):
    return C.service_posts(survey_records(spark, d))


@query("cam_positivity", "CAM-18", _BY_LOCALITY + "select key, name, positivo + negativo as exams, floor(positivo * 1000.0 / (positivo + negativo) + 0.5) / 10 as rate from loc where positivo + negativo > 0")
def _(spark, d):
    return C.positivity_ranking(C.by_locality(survey_records(spark, d), FILTERS))


@query("cam_coverage", "CAM-19", _BY_LOCALITY + "select key, captures_per_100 from loc where captures_per_100 is not null")
def _(spark, d):
    return C.coverage_ranking(C.by_locality(survey_records(spark, d), FILTERS)).select("key", "captures_per_100")


_ALL_FACETS = [
    ("locality", "locality_key", ()), ("species", "species", ("species",)), ("channel", "channel", ("channel",)), ("environment", "environment", ()),
    ("exam", "exam_result", ()), ("search", "search_result", ()), ("month", "strftime(visit_date, '%Y-%m')", ("period",)),
]


@query(
    "cam_facets", "CAM-20",
    RECORDS_SQL + " union all ".join(f"select '{n}' as facet, {c} as value, count(*) as total from cap where {cond(*skip)} group by 2" for n, c, skip in _ALL_FACETS),
)
def _(spark, d):
    return C.facets(survey_records(spark, d), FILTERS)


@query(
    "cam_records_page", "SRT-03",
    RECORDS_SQL + f"select rid, visit_date::varchar as visit_date from rec where type in ('captura','visita','pit') and {cond()} order by visit_date desc nulls last, rid limit 25 offset 25",
)
def _(spark, d):
    page = C.record_page(survey_records(spark, d), FILTERS, page=2, size=25)
    return page.select("rid", F.col("visit_date").cast("string").alias("visit_date"))


@query("cam_records_total", "SRT-03", RECORDS_SQL + f"select count(*) as total from rec where type in ('captura','visita','pit') and {cond()}")
def _(spark, d):
    return C.record_total(survey_records(spark, d), FILTERS)


# ------------------------------------------------------------------ exports


@query(
    "snk_records_export", "SNK-03 SNK-02",
    RECORDS_SQL + """select case type when 'localidade' then 'localidade' when 'captura' then 'Captura' when 'visita' then 'Visita' when 'pit' then 'PIT' end as tipo,
      case when type in ('captura','visita') then case search_result when 'com_captura' then 'Com captura' when 'sem_captura' then 'Sem captura' else 'Não informado' end end as resultado_busca,
      case channel when 'pit' then 'PIT' when 'captura' then 'Captura em campanha' end as origem_captura, case when duplicate_of is not null then 'sim' end as possivel_duplicata,
      count(*) as n, count(*) filter (where lat < 0) as negativas from rec group by 1, 2, 3, 4""",
)
def _(spark, d):
    out = K.records_export(survey_records(spark, d), "x.kml", 1, "2026-08-01")
    return out.groupBy("tipo", "resultado_busca", "origem_captura", "possivel_duplicata").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("latitude").startswith("'-")).alias("negativas")
    )


@query(
    "snk_kpi_export", "SNK-04",
    RECORDS_SQL + """, k as (select count(distinct locality_key) as localities, count(*) filter (where type = 'visita') as visits,
      count(*) filter (where search_result = 'com_captura') as with_capture, count(*) filter (where search_result = 'sem_captura') as without_capture,
      count(*) filter (where type = 'captura' and exam_result = 'positivo') as positive, count(*) filter (where type = 'captura' and exam_result = 'negativo') as negative,
      count(*) filter (where type = 'captura' and exam_result in ('pendente', 'nao_realizado')) as pending, count(*) filter (where type = 'captura' and exam_result = 'nao_informado') as not_informed,
      count(*) filter (where type = 'pit') as posts, coalesce(sum(triatomine_count) filter (where type = 'captura'), 0)::bigint as specimens,
      count(*) filter (where type = 'captura' and triatomine_count is null) as uncounted from rec)
    select unnest(['localities','visits','with_capture','without_capture','positive','negative','pending','not_informed','posts','specimens']) as indicator,
      unnest([localities, visits, with_capture, without_capture, positive, negative, pending, not_informed, posts, specimens])::varchar as value, 'confirmado' as status,
      unnest(['localidades','visitas','registros','buscas','registros de captura','registros de captura','registros de captura','registros de captura','PITs','triatomíneos']) as unit,
      unnest(['','','','','','','','','', case when uncounted > 0 then concat('uncounted:', uncounted) else '' end]) as note from k""",
)
def _(spark, d):
    return K.kpi_export(C.kpis(survey_records(spark, d)))


@query(
    "snk_shareable", "SNK-07",
    RECORDS_SQL + "select rid, floor(lat * 10 + 0.5) / 10 as lat, floor(lng * 10 + 0.5) / 10 as lng, case when type = 'pit' then pit_ref end as pit_ref from rec where duplicate_of is null",
)
def _(spark, d):
    groups = table(spark, d, "region").select((F.col("r_regionkey") >= 0).alias("cross_folder"))
    r = survey_records(spark, d).withColumns({"address": F.lit("rua"), "source_id": F.col("rid")})
    out = K.shareable(r, groups, digits=1)
    assert not {"address", "source_id"} & set(out.columns)
    return out.select("rid", "lat", "lng", "pit_ref")


@query("rec_type_guess", "LNK-07", """select case when doc_id % 4 = 0 then 'captura' when doc_id % 4 = 1 then 'pit' when doc_id % 4 = 2 then 'localidade' end as type, case when doc_id % 4 = 3 then concat('Vila ', lang) end as place, count(*) as n from documents group by all""")
def _(spark, d):
    k = F.col("doc_id") % 4
    last = F.when(k == 0, "Coleta de maio").when(k == 1, "PITs").when(k == 2, "Sítios e Localidades").otherwise(F.concat(F.lit("Vila "), "lang"))
    path = F.array(F.lit("Mapa"), last)
    rows = table(spark, d, "documents").select(S.folder_type(path).alias("type"), F.when(k == 3, S.place_folder(path)).alias("place"))
    return rows.groupBy("type", "place").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ versions


@query(
    "ver_active", "VER-01 VER-02 VER-03 VER-04 VER-05 VER-06 VER-07",
    """select 'active' as part, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' and o_orderkey % 10 <> 0
    union all select 'records', (select count(*) from orders where o_orderdate < timestamp '1996-01-01' and o_orderkey % 10 <> 0) + 1""",
)
def _(spark, d):
    import datetime as dt

    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("index"), "o_orderdate", F.lit("captura").alias("type"), F.col("o_orderstatus").alias("locality_key"), F.col("o_orderstatus").alias("locality_raw"),
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"),
    )
    v = Versions(spark, scratch_path(spark, "versions"))
    first = v.stage(o.where("o_orderdate < timestamp '1996-01-01'"), "a.kml")
    second = v.stage(o.where("o_orderdate >= timestamp '1996-01-01'"), "b.kml")
    failed = v.stage(None, "c.kml", ["sem_registros"])
    v.activate(first, exclude_repeats=True)
    v.remap(failed, o)
    v.discard(failed)
    v.activate(second)
    v.restore(first)
    v.void_visit(v.add_visit("F", "F", dt.date(2026, 1, 1), "sem_captura"))
    v.add_visit("Nova", "nova", dt.date(2026, 1, 2), "com_captura")
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(v.active_records(), "active").unionByName(count(v.records(), "records"))
