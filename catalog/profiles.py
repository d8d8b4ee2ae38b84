"""Column profiles, roles, quality alerts and headline indicators."""

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from tablelens.operators import aggregate as A
from tablelens.operators import profile as P
from tablelens.operators import quality as Q
from tablelens.operators import roles as R

STAR = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "n", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "n"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "n"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {
        "l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "n", "l_extendedprice": "n",
        "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t",
    },
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "n", "props": "s"},
}


def _type_sql(kind, c):
    if kind in "in":
        return f"case when bool_and({c} = floor({c})) then 'integer' else 'number' end"
    if kind == "t":
        return "'date'"
    return (
        f"case when count(distinct {c}) <= greatest(20.0, count({c}) * 0.05) and count(distinct {c}) < count({c}) then 'category' "
        f"when count(distinct {c}) >= count({c}) * 0.95 and count({c}) > 5 then 'id' "
        f"when count(distinct {c}) <= 60 then 'category' else 'text' end"
    )


def profile_sql(name):
    parts = []
    for c, kind in STAR[name].items():
        num = kind in "in"
        stat = lambda f: f"{f}" if num else "null::double"
        # cells are compared as printed, to the millisecond for times
        seen = f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')" if kind == "t" else c
        parts.append(
            f"select '{c}' as \"column\", {_type_sql(kind, c)} as type, count(*) as \"rows\", count({c}) as filled, count(distinct {seen}) as \"distinct\", "
            f"{stat(f'min({c})::double')} as min, {stat(f'max({c})::double')} as max, {stat(f'round(sum({c}::decimal(18,4))::double, 2)')} as sum, "
            f"{stat(f'round(avg({c}), 4)')} as mean, {stat(f'median({c})::double')} as median, "
            + (f"strftime(min({c}), '%Y-%m-%d') as min_date, strftime(max({c}), '%Y-%m-%d') as max_date" if kind == "t" else "null::varchar as min_date, null::varchar as max_date")
            + f" from {name}"
        )
    return " union all ".join(parts)


def _profile(name):
    def run(spark, d):
        p = P.profile(table(spark, d, name))
        out = p.select(
            "column", "type", "rows", "filled", "distinct", "min", "max", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "median",
            F.date_format("min_date", "yyyy-MM-dd").alias("min_date"), F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
        )
        return out

    return run


for _name in STAR:
    query(f"prf_{_name}", "PRF-01 PRF-06 PRF-07", profile_sql(_name))(_profile(_name))


ROLES = {
    "events": [
        ("event_id", "identifier", None, False), ("ts", "time", None, False), ("user_id", "identifier", None, False),
        ("event_type", "dimension", None, False), ("value", "measure", None, True),
    ],
    "orders": [
        ("o_orderkey", "measure", None, True), ("o_custkey", "measure", None, True), ("o_orderstatus", "dimension", None, False),
        ("o_totalprice", "measure", None, True), ("o_orderdate", "time", None, False), ("o_orderpriority", "dimension", None, False),
    ],
    "lineitem": [
        *[(c, "measure", "count" if c == "l_quantity" else None, True) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        ("l_returnflag", "dimension", None, False), ("l_linestatus", "dimension", None, False), ("l_shipdate", "time", None, False),
    ],
}


def _roles_sql(name):
    lit = lambda v: "null::varchar" if v is None else f"'{v}'"
    return " union all ".join(
        f"select '{c}' as \"column\", '{r}' as role, {lit(u)} as unit, {str(a).lower()} as additive" for c, r, u, a in ROLES[name]
    )


def _roles(name):
    def run(spark, d):
        return R.roles(P.profile(table(spark, d, name), median=False)).select("column", "role", "unit", "additive")

    return run


for _name in ROLES:
    # free text or category depends on how many values repeat
    _props = """ union all select 'props', case when count(distinct props) <= greatest(20.0, count(*) * 0.05) then 'dimension' when count(distinct props) >= count(*) * 0.95 then 'identifier'
      when count(distinct props) <= 60 then 'dimension' else 'text' end, null, false from events"""
    query(f"role_{_name}", "PRF-11", _roles_sql(_name) + (_props if _name == "events" else ""))(_roles(_name))


# ------------------------------------------------------------------ columns made for the special rules


def special_rows(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    months = F.array(*[F.lit(m) for m in ("Janeiro", "fevereiro", "Março", "abr.", "Maio", "JUNHO", "jul", "agosto", "set", "out.", "Novembro", "dez")])
    return o.select(
        F.lpad(k.cast("string"), 9, "0").alias("codigo"),
        F.year("o_orderdate").alias("ano"),
        F.element_at(months, F.month("o_orderdate")).alias("mes"),
        F.concat((k % 100).cast("string"), F.lit("%")).alias("taxa"),
        F.when(k % 4 == 0, "n/d").when(k % 4 == 1, "-").otherwise((k % 10).cast("string")).alias("valor"),
        F.when(k % 50 == 0, "abc").otherwise((k % 1000).cast("string")).alias("medida"),
        F.when(k % 2 == 0, "sim").otherwise("Não").alias("ok"),
        (k % 180 - 90).cast("double").alias("latitude"),
        F.lit(None).cast("string").alias("vazio"),
        F.lit("x").alias("fixo"),
        F.when(k % 3 == 0, F.col("o_orderstatus")).alias("raro"),
    )


SPECIAL = """with s as (select o_orderkey as k, o_orderdate as d from orders), n as (select count(*) as rows from orders)
select * from (values
  ('codigo', 'id', false, false), ('ano', 'category', true, false), ('mes', 'category', true, false), ('taxa', 'integer', false, true),
  ('valor', 'integer', false, false), ('medida', 'integer', false, false), ('ok', 'boolean', false, false), ('latitude', 'lat', false, false),
  ('vazio', 'text', false, false), ('fixo', 'category', false, false), ('raro', 'category', false, false)) t("column", type, period, percent)
join (select 'codigo' as "column", count(*) as filled, 0::bigint as missing_markers, 0::bigint as invalid from s
  union all select 'ano', count(*), 0, 0 from s union all select 'mes', count(*), 0, 0 from s union all select 'taxa', count(*), 0, 0 from s
  union all select 'valor', count(*) filter (where k % 4 > 1), count(*) filter (where k % 4 <= 1), 0 from s
  union all select 'medida', count(*), 0, count(*) filter (where k % 50 = 0) from s
  union all select 'ok', count(*), 0, 0 from s union all select 'latitude', count(*), 0, 0 from s
  union all select 'vazio', 0, 0, 0 union all select 'fixo', count(*), 0, 0 from s
  union all select 'raro', count(*) filter (where k % 3 = 0), 0, 0 from s) using ("column")"""


@query("prf_special_types", "PRF-02 PRF-04 PRF-05 PRF-09 PRF-12", SPECIAL)
def _(spark, d):
    return P.profile(special_rows(spark, d)).select("column", "type", "period", "percent", "filled", "missing_markers", "invalid")


@query(
    "role_special", "PRF-11 PRF-12 PRF-03",
    """select * from (values ('codigo','identifier'), ('ano','time'), ('mes','time'), ('taxa','measure'), ('valor','measure'), ('medida','measure'),
      ('ok','flag'), ('latitude','geo'), ('vazio','text'), ('fixo','dimension'), ('raro','dimension')) t("column", role)""",
)
def _(spark, d):
    return R.roles(P.profile(special_rows(spark, d), median=False)).select("column", "role")


@query("prf_numeric_code", "PRF-03", "select 'cod' as \"column\", 'id' as type, count(*) as filled from orders union all select 'numero', 'integer', count(*) from orders")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("cod"), F.col("o_orderkey").alias("numero"))
    return P.profile(rows).select("column", "type", "filled")


@query("prf_forced_type", "PRF-10", "select 'l_returnflag' as \"column\", 'text' as type, true as manual union all select 'l_linenumber', 'category', true union all select 'l_tax', 'number', false")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_tax")
    return P.profile(rows, forced={"l_returnflag": "text", "l_linenumber": "category"}, median=False).select("column", "type", "manual")


@query(
    "prf_top_values", "PRF-08",
    """select 'p_brand' as "column", p_brand as value, count(*) as n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2""",
)
def _(spark, d):
    return P.top_values(table(spark, d, "part"), ["p_brand", "p_type"])


@query(
    "prf_invalid_values", "PRF-09",
    "select o_orderkey as row, 'abc' as value from orders where o_orderkey % 50 = 0 order by 1 limit 25",
)
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 50 == 0, "abc").otherwise((k % 1000).cast("string")).alias("medida"))
    return P.invalid_values(rows, "medida", "o_orderkey", first=25)


@query(
    "prf_filter_effects", "PRF-14",
    """with v as (select * from lineitem where l_returnflag = 'A')
    select 'l_returnflag' as "column", (select count(*) from lineitem) as filled_full, (select count(*) from v) as filled_view,
      (select count(distinct l_returnflag) from lineitem) as distinct_full, (select count(distinct l_returnflag) from v) as distinct_view
    union all select 'l_suppkey', (select count(*) from lineitem), (select count(*) from v), (select count(distinct l_suppkey) from lineitem), (select count(distinct l_suppkey) from v)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey")
    full, view = (P.profile(x, median=False) for x in (rows, rows.where("l_returnflag = 'A'")))
    return R.filter_effects(full, view).drop("position")


@query(
    "prf_duplicate_rows", "PRF-16",
    """select count(*) as rows, count(*) - (select count(*) from (select distinct l_suppkey, l_quantity, l_tax from lineitem)) as duplicates from lineitem""",
)
def _(spark, d):
    return P.duplicate_rows(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_tax"))


def price_with_spikes(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice")).alias("preco"), "l_quantity"
    )


OUTLIERS = """with x as (select case when l_orderkey % 997 = 0 then l_extendedprice * 100 else l_extendedprice end as preco, l_quantity from lineitem),
q as (select list_sort(list(preco)) as a, list_sort(list(l_quantity)) as b, count(*) as n from x),
f as (select a[1 + cast(floor((n - 1) * 0.25) as bigint)] as a1, a[1 + cast(floor((n - 1) * 0.75) as bigint)] as a3,
  b[1 + cast(floor((n - 1) * 0.25) as bigint)] as b1, b[1 + cast(floor((n - 1) * 0.75) as bigint)] as b3 from q)
select 'preco' as "column", a1 as q1, a3 as q3, (select count(*) from x where preco < a1 - 3 * (a3 - a1) or preco > a3 + 3 * (a3 - a1)) as outliers from f
union all select 'l_quantity', b1, b3, (select count(*) from x where l_quantity < b1 - 3 * (b3 - b1) or l_quantity > b3 + 3 * (b3 - b1)) from f"""


@query("prf_outliers", "PRF-18", OUTLIERS)
def _(spark, d):
    return P.outliers(price_with_spikes(spark, d), ["preco", "l_quantity"])


@query(
    "quality_alerts", "PRF-17",
    """with s as (select o_orderkey as k, o_orderstatus as st from orders)
    select 'warning' as level, 'invalid_numbers' as code, 'medida' as "column", count(*) filter (where k % 50 = 0) as n from s
    union all select 'info', 'missing_markers', 'valor', count(*) filter (where k % 4 <= 1) from s
    union all select 'warning', 'many_missing', 'valor', count(*) filter (where k % 4 <= 1) from s
    union all select 'warning', 'empty_column', 'vazio', count(*) from s
    union all select 'info', 'constant_column', 'fixo', count(*) from s
    union all select 'warning', 'many_missing', 'raro', count(*) filter (where k % 3 <> 0) from s""",
)
def _(spark, d):
    return Q.column_alerts(P.profile(special_rows(spark, d).select("medida", "valor", "vazio", "fixo", "raro"), median=False))


@query(
    "quality_all", "PRF-16 PRF-17 PRF-18",
    """with x as (select case when l_orderkey % 997 = 0 then l_extendedprice * 100 else l_extendedprice end as preco, l_quantity from lineitem)
    select 'warning' as level, 'duplicate_rows' as code, null::varchar as "column", count(*) - (select count(*) from (select distinct * from x)) as n from x
      having count(*) > (select count(*) from (select distinct * from x))
    union all select 'info', 'extreme_values', "column", outliers from (""" + OUTLIERS + ") where outliers > 0",
)
def _(spark, d):
    rows = price_with_spikes(spark, d)
    return Q.quality_alerts(rows, P.profile(rows, median=False))


# ------------------------------------------------------------------ relations


def rate_rows(spark, d):
    li = table(spark, d, "lineitem")
    whole = F.col("l_quantity") + 50
    rate = F.round(F.col("l_quantity") / whole * 100, 2)
    wrong = F.col("l_orderkey") % 100 == 0
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("parte"), whole.alias("todo"), F.when(wrong, rate + 5).otherwise(rate).alias("taxa"), "l_extendedprice"
    )


@query(
    "prf_relations", "PRF-19",
    """select 'taxa' as p, 'parte' as a, 'todo' as b, count(*) as n, count(*) filter (where l_orderkey % 100 = 0) as bad from lineitem""",
)
def _(spark, d):
    return Q.relations(rate_rows(spark, d), ["parte", "todo", "taxa", "l_extendedprice"])


@query(
    "prf_relations_wide", "PRF-19",
    """select 'taxa' as p, 'parte' as a, 'todo' as b, count(*) as n, count(*) filter (where l_orderkey % 100 = 0) as bad from lineitem""",
)
def _(spark, d):
    """Twenty columns, two of them constant; the rate comes last."""
    noise = [(F.hash(F.lit(i), "l_orderkey", "l_linenumber") % 1000 * F.pow(F.lit(-3.0), F.lit(i))).cast("double").alias(f"r{i}") for i in range(15)]
    wide = rate_rows(spark, d).select(F.lit(100.0).alias("cem"), F.lit(1.0).alias("um"), *noise, "parte", "todo", "taxa")
    return Q.relations(wide, wide.columns)


@query(
    "prf_relation_mismatches", "PRF-20",
    "select l_orderkey as row, count(*) as n from lineitem where l_orderkey % 100 = 0 group by 1",
)
def _(spark, d):
    return Q.relation_mismatches(rate_rows(spark, d), "taxa", "parte", "todo", "l_orderkey").groupBy("row").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ indicators


@query(
    "kpi_orders", "PRF-21",
    """select 'rows' as kpi, null::varchar as "column", count(*)::double as value, null::varchar as from_date, null::varchar as to_date from orders
    union all select 'columns', null, 6, null, null
    union all select 'total', 'o_orderkey', sum(o_orderkey), null, null from orders
    union all select 'period', 'o_orderdate', null, strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') from orders
    union all select 'fill_rate', null, 100, null, null""",
)
def _(spark, d):
    k = Q.table_kpis(P.profile(table(spark, d, "orders"), median=False))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return k.select("kpi", "column", "value", day("from_date"), day("to_date"))


@query("kpi_overall_rate", "PRF-22", "select round(sum(case when l_orderkey % 9 <> 0 then l_quantity end) / sum(case when l_orderkey % 9 <> 0 then l_quantity + 50 end) * 100, 6) as rate from lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity")).alias("a"), (F.col("l_quantity") + 50).alias("b"))
    return rounded(Q.overall_rate(rows, "a", "b"), 6, "rate")


YEARS = """with y as (select strftime(l_shipdate, '%Y') as ano, sum(l_quantity) as quantidade, round(sum(l_extendedprice::decimal(18,2))::double, 2) as valor, count(*)::double as linhas
  from lineitem group by 1) """


def yearly(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.date_format("l_shipdate", "yyyy").alias("ano")).agg(
        F.sum("l_quantity").alias("quantidade"), F.round(F.sum("l_extendedprice"), 2).alias("valor"), F.count(F.lit(1)).cast("double").alias("linhas")
    )


@query(
    "kpi_periods", "PRF-23",
    YEARS + """, u as (select ano, unnest(['quantidade', 'valor', 'linhas']) as c, unnest([quantidade, valor, linhas]) as v from y),
    e as (select c, min_by(v, ano) as f, max_by(v, ano) as l, min(ano) as fp, max(ano) as lp from u group by c)
    select fp as first_period, lp as last_period, c as "column", f as first_value, l as last_value, round((l - f) / abs(f) * 100, 6) as change from e where f <> 0""",
)
def _(spark, d):
    return rounded(Q.period_kpis(yearly(spark, d), "ano", ["quantidade", "valor", "linhas"], "ano"), 6, "change")


@query("agg_magnitudes", "AGG-21", """with m as (select 'l_quantity' as c, 1 as p, max(l_quantity) as v from lineitem union all select 'l_extendedprice', 2, max(l_extendedprice) from lineitem
    union all select 'l_discount', 3, max(l_discount) from lineitem union all select 'l_tax', 4, max(l_tax) from lineitem)
    select floor(log10(v))::int::varchar as magnitude, string_agg(c, ',' order by p) as columns from m group by 1""")
def _(spark, d):
    p = P.profile(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), median=False)
    return A.magnitude_groups(p).select("magnitude", F.concat_ws(",", "columns").alias("columns"))
