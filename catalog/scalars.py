"""Cells, keys and survey fields."""

from pyspark.sql import functions as F

from catalog.base import query, table
from tablelens.functions import survey_fields as S
from tablelens.functions import values as X
from tablelens.sources.geo_files import description_fields, merged_fields


def us_text(c):
    return F.format_number(F.col(c), 2)


def br_text(c):
    return F.translate(us_text(c), ",.", ".,")


@query(
    "fn_missing_marker", "FN-01",
    """select o_orderstatus, count(*) filter (where lower(trim(v)) in ('n/d','-','nan','sem dado','não informado')) as markers, count(*) as n
    from (select o_orderstatus, case o_orderkey % 7 when 0 then 'N/D ' when 1 then '-' when 2 then 'NaN' when 3 then 'Sem Dado'
      when 4 then 'Não informado' when 5 then 'nada' else '' end as v from orders) group by 1""",
)
def _(spark, d):
    words = F.array(*[F.lit(w) for w in ("N/D ", "-", "NaN", "Sem Dado", "Não informado", "nada", "")])
    v = F.element_at(words, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(X.is_missing_marker(v)).alias("markers"), F.count(F.lit(1)).alias("n"))


@query("fn_number_br", "FN-02", "select l_orderkey, l_linenumber, round(l_extendedprice, 2) as value from lineitem")
def _(spark, d):
    text = F.concat(F.lit("R$ "), br_text("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.parse_number(text, "br"), 2).alias("value"))


@query("fn_number_us", "FN-02", "select l_orderkey, l_linenumber, round(l_extendedprice, 2) as value from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.parse_number(us_text("l_extendedprice"), "us"), 2).alias("value"))


def _dates(order):
    def run(spark, d):
        pattern = "dd/MM/yyyy" if order == "dmy" else "M/d/yyyy"
        text = F.date_format("o_orderdate", pattern)
        return table(spark, d, "orders").select("o_orderkey", F.date_format(X.parse_date(text, order), "yyyy-MM-dd").alias("day"))

    return run


for _order in ("dmy", "mdy"):
    query(f"fn_date_{_order}", "FN-03", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")(_dates(_order))


@query(
    "fn_locale", "FN-04",
    """select 'dmy' as date_order, 'br' as numbers, false as date_ambiguous,
      count(*) filter (where day(o_orderdate) <= 12) as date_ambiguous_count, false as number_ambiguous, 0::bigint as number_ambiguous_count
    from orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), br_text("o_totalprice").alias("price"))
    return X.infer_locale(rows)


@query("fn_fold", "FN-05", "select doc_id, md5(strip_accents(lower(text))) as folded from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded"))


@query(
    "fn_name_key", "FN-06",
    """select doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) as name_key,
      md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_')) as field_key from documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.name_key("text")).alias("name_key"), F.md5(X.field_key("text")).alias("field_key"))


@query(
    "fn_join_key", "FN-07",
    """select k, count(*) as n from (select cast(cast(l_quantity as bigint) as varchar) as k from lineitem
      union all select cast(l_partkey as varchar) from lineitem) group by k""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("part"))
    keys = li.select(X.join_key(li, "l_quantity").alias("k")).unionAll(li.select(X.join_key(li, "part").alias("k")))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_without_zeros", "FN-08",
    "select c_custkey, cast(c_custkey as varchar) as bare from customer",
)
def _(spark, d):
    digits = F.regexp_extract("c_name", r"#(\d+)$", 1)
    return table(spark, d, "customer").select("c_custkey", X.without_leading_zeros(digits).alias("bare"))


@query(
    "fn_one_edit", "FN-09",
    """select p_brand, count(*) filter (where levenshtein(p_brand, 'Brand#12') <= 1) as near, count(*) as n from part group by 1""",
)
def _(spark, d):
    near = X.within_one_edit("p_brand", F.lit("Brand#12"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_if(near).alias("near"), F.count(F.lit(1)).alias("n"))


@query("fn_month_key", "FN-10", "select strftime(l_shipdate, '%Y-%m') as month, count(*) as n from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(X.month_key("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_quick_periods", "FN-11",
    """with m as (select cast(max(o_orderdate) as date) as e from orders)
    select '30d' as period, strftime(e - 29, '%Y-%m-%d') as from_date, strftime(e, '%Y-%m-%d') as to_date from m
    union all select '90d', strftime(e - 89, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') from m
    union all select '12m', strftime(make_date(year(e) - 1, month(e), 1) + cast(day(e) as integer), '%Y-%m-%d'), strftime(e, '%Y-%m-%d') from m
    union all select 'year', strftime(make_date(year(e), 1, 1), '%Y-%m-%d'), strftime(e, '%Y-%m-%d') from m
    union all select 'previous_year', strftime(make_date(year(e) - 1, 1, 1), '%Y-%m-%d'), strftime(make_date(year(e) - 1, 12, 31), '%Y-%m-%d') from m""",
)
def _(spark, d):
    out = X.quick_periods(table(spark, d, "orders"), "o_orderdate")
    return out.select("period", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"))


@query(
    "fn_survey_date", "FN-13",
    """select o_orderkey, case when o_orderkey % 5 = 3 then null else strftime(o_orderdate, '%Y-%m-%d') end as day, o_orderkey % 5 <> 3 as valid from orders""",
)
def _(spark, d):
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "d/M/yyyy"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "dd.MM.yyyy 'h'"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format("o_orderdate", "'32'-MM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    )
    s = S.survey_date(text)
    return table(spark, d, "orders").select("o_orderkey", s["date"].cast("string").alias("day"), s["valid"].alias("valid"))


@query(
    "fn_leading_count", "FN-14",
    "select p_partkey, case when p_partkey % 2 = 0 then p_size end as n from part",
)
def _(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_size", F.lit(" un"))).otherwise(F.concat("p_size", F.lit("un")))
    return table(spark, d, "part").select("p_partkey", X.leading_count(text).alias("n"))


@query(
    "fn_exam_result", "FN-15",
    """select v as text, case doc_id % 6 when 0 then 'positivo' when 1 then 'negativo' when 2 then 'negativo' when 3 then 'nao_realizado' when 4 then 'nao_informado'
      else 'nao_informado' end as value, doc_id % 6 <> 4 as recognized, count(*) as n
    from (select doc_id, case doc_id % 6 when 0 then 'POSITIVO' when 1 then 'Negaivo' when 2 then 'Não reagente' when 3 then 'Sem exame' when 4 then lang else '' end as v
      from documents) group by all""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    m = F.col("doc_id") % 6
    text = F.when(m == 0, "POSITIVO").when(m == 1, "Negaivo").when(m == 2, "Não reagente").when(m == 3, "Sem exame").when(m == 4, F.col("lang")).otherwise("")
    rows = docs.select(text.alias("text"), S.exam_result(text).alias("r"))
    return rows.groupBy("text", F.col("r.value").alias("value"), F.col("r.recognized").alias("recognized")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_search_result", "FN-16",
    """select case doc_id % 4 when 0 then 'com_captura' when 1 then 'sem_captura' else 'nao_informado' end as value, doc_id % 4 <> 2 as recognized, count(*) as n
    from documents group by all""",
)
def _(spark, d):
    m = F.col("doc_id") % 4
    text = F.when(m == 0, "Com triatomíneo").when(m == 1, "NEGATIVA").when(m == 2, F.col("source"))
    rows = table(spark, d, "documents").select(S.search_result(text).alias("r"))
    return rows.groupBy("r.value", "r.recognized").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_channel_environment_stage", "FN-17",
    """select case doc_id % 3 when 0 then 'pit' when 1 then 'captura' end as channel,
      case doc_id % 4 when 0 then 'intra' when 1 then 'peri' when 2 then 'intra_peri' end as environment,
      case doc_id % 5 when 0 then 'Ninfa' when 1 then 'Adulto' when 2 then 'Ninfa e adulto' when 3 then 'Adulto' end as stage,
      case doc_id % 5 when 1 then 'Macho' when 2 then 'Fêmea' when 3 then 'Macho e Fêmea' end as sex, count(*) as n
    from documents group by all""",
)
def _(spark, d):
    k = F.col("doc_id")
    ch = F.when(k % 3 == 0, "PIT 04").when(k % 3 == 1, "Campanha de maio").otherwise(F.col("lang"))
    en = F.when(k % 4 == 0, "INTRA").when(k % 4 == 1, "Peridomicílio").when(k % 4 == 2, "Intra e Peri").otherwise(F.col("source"))
    ss = F.when(k % 5 == 0, "ninfa").when(k % 5 == 1, "MACHO").when(k % 5 == 2, "Ninfa e Fêmea").when(k % 5 == 3, "Macho/Fêmea").otherwise("")
    mix = S.stage_and_sex(ss)
    rows = table(spark, d, "documents").select(S.channel(ch).alias("channel"), S.environment(en).alias("environment"), mix["stage"].alias("stage"), mix["sex"].alias("sex"))
    return rows.groupBy("channel", "environment", "stage", "sex").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_species", "FN-18",
    """select case doc_id % 5 when 0 then 'Triatoma brasiliensis' when 1 then 'Panstrongylus lutzi' when 2 then 'Triatoma pseudomaculata' when 3 then 'Rhodnius sp.' end as species,
      count(*) as n from documents group by 1""",
)
def _(spark, d):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, "T. Brasilensis").when(k == 1, "P. Lutzi P.").when(k == 2, "T. PSEUDOMACULATA").when(k == 3, "Rodnius").otherwise(F.col("lang"))
    return table(spark, d, "documents").groupBy(S.species_of(text).alias("species")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_canonical_fields", "FN-19",
    """select doc_id, source as localidade, case when doc_id % 2 = 0 then lang else '' end as especie, 1::bigint as personal, 'ignorar' as latitude from documents""",
)
def _(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    raw = F.array(
        pair("Espécie", F.lit("")),
        pair("Povoado", F.col("source")),
        pair("Sítio", F.lit("outro")),
        pair("Telefone", F.lit("1")),
        pair("Latitude", F.lit("2")),
        pair("especie triatomineo", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")),
    )
    rows = table(spark, d, "documents").select("doc_id", S.canonical_fields(raw).alias("f"))
    return rows.select(
        "doc_id",
        S.canonical_value("f", "localidade").alias("localidade"),
        S.canonical_value("f", "especie").alias("especie"),
        F.size(F.filter("f", lambda p: p["personal"])).cast("bigint").alias("personal"),
        F.get(F.filter("f", lambda p: p["key"] == "Latitude"), F.lit(0))["canon"].alias("latitude"),
    )


@query(
    "fn_clean_locality", "FN-20",
    "select p_partkey, p_name as place, p_partkey % 4 < 3 as marked from part",
)
def _(spark, d):
    k, code = F.col("p_partkey") % 4, F.lpad((F.col("p_partkey") % 9999).cast("string"), 5, "0")
    text = (
        F.when(k == 0, F.concat("p_name", F.lit(" cód. "), code, F.lit(" Início")))
        .when(k == 1, F.concat("p_name", F.lit("  "), code, F.lit(" Final - ")))
        .when(k == 2, F.concat("p_name", F.lit(" COD "), code))
        .otherwise(F.col("p_name"))
    )
    tidy = F.regexp_replace(text, r"[\s/\\.,;:–-]+$", "")
    return table(spark, d, "part").select("p_partkey", S.clean_locality(text).alias("place"), S.has_end_marker(tidy).alias("marked"))


@query(
    "fn_description_pairs", "FN-21",
    """select page_id, url as "Endereço", len(html)::varchar as "Tamanho", 'fixo' as estruturado from pages""",
)
def _(spark, d):
    pages = table(spark, d, "pages")
    html = F.concat(
        F.lit("<table><tr><td>Endereço</td><td>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</td></tr></table><p>Tamanho: "),
        F.length("html").cast("string"), F.lit("</p><div>Origem = site</div>"),
    )
    structured = F.array(F.struct(F.lit("ORIGEM").alias("key"), F.lit("fixo").alias("value")))
    fields = F.map_from_entries(merged_fields(structured, description_fields(html)))
    at = lambda k: F.try_element_at(fields, F.lit(k))
    return pages.select("page_id", at("Endereço").alias("Endereço"), at("Tamanho").alias("Tamanho"), F.coalesce(at("Origem"), at("ORIGEM")).alias("estruturado"))


@query("fn_page_pairs", "FN-21")
def _(spark, d):
    """Key/value pairs found in the raw pages, whole texts."""
    pairs = table(spark, d, "pages").select(F.explode(description_fields("html")).alias("p"))
    return pairs.groupBy(X.field_key("p.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_days_between", "FN-22",
    """select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey group by 1""",
)
def _(spark, d):
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.groupBy(X.days_between("l_shipdate", "o_orderdate").cast("bigint").alias("days")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_round_half_up", "FN-23",
    "select l_orderkey, l_linenumber, floor((l_quantity - 26) / 2 + 0.5) as v0, floor((l_quantity - 26) / 8 * 10 + 0.5) / 10 as v1 from lineitem",
)
def _(spark, d):
    q = F.col("l_quantity") - 26
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.round_half_up(q / 2).alias("v0"), X.round_half_up(q / 8, 1).alias("v1"))
