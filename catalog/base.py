"""The registry and the frames that several queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` for the operators it exercises."""

    def keep(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"registered twice: {name}")
        REGISTRY[name] = Entry(name, run, sql, tuple(operators.split()))
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ------------------------------------------------------------------ survey records out of documents and labels

_RECORDS = """
  select
    concat('f', doc_id) as rid,
    'arquivo' as origin,
    case doc_id % 10 when 0 then 'localidade' when 1 then 'visita' when 2 then 'pit' else 'captura' end as type,
    concat('Registro ', doc_id % 97) as name,
    case when doc_id % 23 = 5 then null else source end as locality_key,
    case when doc_id % 23 = 5 then null else concat(upper(substring(source, 1, 1)), substring(source, 2)) end as locality_raw,
    case when doc_id % 11 = 0 then null else {visit} end as visit_date,
    case when toxic is null or doc_id % 13 = 1 then null else {exam} end as exam_date,
    case when quality = 1 then 'com_captura' when quality = 0 then 'sem_captura' else 'nao_informado' end as search_result,
    case when toxic = 1 then 'positivo' when toxic = 0 then 'negativo' when doc_id % 7 = 3 then 'pendente' else 'nao_informado' end as exam_result,
    case when doc_id % 3 = 0 then null else cast(doc_id % 5 as int) end as triatomine_count,
    case doc_id % 4 when 0 then 'Ninfa' when 1 then 'Adulto' when 2 then 'Ninfa e adulto' else null end as stage,
    case doc_id % 4 when 1 then 'Fêmea' when 2 then 'Macho e Fêmea' else null end as sex,
    case when doc_id % 9 = 0 then null else concat('especie ', lang) end as species,
    -4.0 - (doc_id % 50) / 100.0 as lat,
    -40.0 - (n_chars % 50) / 100.0 as lng,
    case doc_id % 3 when 0 then 'captura' when 1 then 'pit' else null end as channel,
    case doc_id % 5 when 0 then 'intra' when 1 then 'peri' when 2 then 'intra_peri' else null end as environment,
    case when doc_id % 10 = 0 and doc_id % 20 = 0 then cast(n_chars % 500 as int) else null end as property_count,
    case when doc_id % 2 = 0 then 'Rural' else 'Urbano' end as zone,
    case when doc_id % 10 = 2 then concat('UBS ', doc_id % 6) else null end as pit_ref,
    false as is_boundary,
    case when doc_id % 31 = 0 then doc_id - 1 else null end as duplicate_of
  from {docs} d left join {labels} l using (doc_id)
"""

RECORDS_SQL = "with rec as (" + _RECORDS.format(
    visit="date '2026-01-01' + cast(n_chars % 400 as integer)",
    exam="date '2026-01-01' + cast(n_chars % 400 + doc_id % 50 - 5 as integer)",
    docs="documents",
    labels="labels",
) + "), cap as (select * from rec where type = 'captura') "


def survey_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of every document; documents without a label have no exam result."""
    docs, labels = table(spark, sf_dir, "documents").drop("text"), table(spark, sf_dir, "labels")
    sql = _RECORDS.format(
        visit="date_add(date '2026-01-01', cast(n_chars % 400 as int))",
        exam="date_add(date '2026-01-01', cast(n_chars % 400 + doc_id % 50 - 5 as int))",
        docs="{docs}",
        labels="{labels}",
    )
    return spark.sql(sql, docs=docs, labels=labels).withColumns({"lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double")})


# ------------------------------------------------------------------ a long table out of events

LONG_SQL = """with long as (
  select strftime(ts, '%Y-%m-%d') as period, concat('user ', user_id % 7) as entity,
    case event_type when 'purchase' then 'Confirmados' when 'view' then 'Descartados' when 'click' then 'Notificados'
      when 'error' then 'Em andamento' else 'Outros' end as situation,
    case when event_type = 'signup' then null else concat('grupo ', user_id % 3) end as subgroup,
    case when event_id % 6 = 0 then null else value end as "Total"
  from events) """


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = {"purchase": "Confirmados", "view": "Descartados", "click": "Notificados", "error": "Em andamento"}
    situation = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), "event_type"), F.lit("Outros"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")).alias("entity"),
        situation.alias("situation"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("grupo "), (F.col("user_id") % 3).cast("string"))).alias("subgroup"),
        F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("Total"),
    )
