"""Grouped summaries, series, long tables, filters, metrics, recipes and pages."""

from pyspark.sql import functions as F

from catalog.base import LONG_SQL, long_events, query, rounded, table
from tablelens.operators import aggregate as A
from tablelens.operators import filters as L
from tablelens.operators import long_tables as T
from tablelens.operators import metrics as M
from tablelens.operators import recipe as C
from tablelens.operators import series as Z
from tablelens.operators import tables as P
from tablelens.operators.roles import explore, roles
from tablelens.operators.profile import profile

MONEY = "sum({0}::decimal(18,2))::double"


# ------------------------------------------------------------------ one key

_AGG_SQL = {
    "count": "count(*)::double",
    "sum": f"round({MONEY.format('l_extendedprice')}, 2)",
    "mean": "round(avg(l_extendedprice), 4)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "median": "round(median(l_extendedprice), 6)",
}


def _agg(how):
    digits = {"sum": 2, "mean": 4}.get(how, 6)
    return lambda spark, d: rounded(A.group_values(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", how), digits, "value")


for _how, _sql in _AGG_SQL.items():
    query(f"agg_{_how}", "AGG-01", f"select l_returnflag as label, {_sql} as value from lineitem group by 1")(_agg(_how))


@query("agg_median_by_part", "AGG-01", "select cast(l_suppkey as varchar) as label, median(case when l_quantity < 40 then l_quantity end) as value from lineitem group by 1 having value is not null")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("q"))
    return A.group_values(li, "l_suppkey", "q", "median")


@query("agg_median_epoch", "AGG-01", "select event_type as label, round(median(epoch(ts)), 3) as value from events group by 1")
def _(spark, d):
    """Times as seconds: large numbers that differ little."""
    e = table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6)
    return rounded(A.group_values(e.toDF("event_type", "s"), "event_type", "s", "median"), 3, "value")


@query("agg_ranking", "AGG-02", f"select p_brand as label, round({MONEY.format('p_retailprice')}, 2) as value from part group by 1 order by 2 desc, 1 limit 15")
def _(spark, d):
    return rounded(A.ranking(table(spark, d, "part"), "p_brand", "p_retailprice", "sum", top=15), 2, "value")


@query("agg_source_order", "AGG-03", "select p_brand as label, count(*)::double as value, min(p_partkey) as position from part group by 1")
def _(spark, d):
    return A.in_source_order(table(spark, d, "part"), "p_brand", "p_partkey")


@query(
    "agg_ratio", "AGG-04",
    """select l_returnflag as label, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 6) as value from lineitem
    where l_orderkey % 9 <> 0 group by 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(
        "l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("a"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")).alias("b")
    )
    return rounded(A.ratio_values(rows, "l_returnflag", "a", "b"), 6, "value")


# ------------------------------------------------------------------ two keys

_CROSS = """with r as (select o_orderstatus as x, case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then null else o_orderpriority end as s, o_totalprice as v from orders),
  g as (select x, s, sum(v::decimal(18,2))::double as v from r where s is not null group by all),
  t as (select x, sum(v::decimal(18,2))::double as lv from r group by 1), ss as (select distinct s from g) """


def cross_rows(spark, d):
    low = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return table(spark, d, "orders").select("o_orderstatus", F.when(~low, F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")


@query(
    "agg_pivot", "AGG-05",
    _CROSS + "select t.x as label, ss.s as series, round(g.v, 2) as value, round(lv, 2) as label_value from t cross join ss left join g on g.x = t.x and g.s = ss.s",
)
def _(spark, d):
    return rounded(A.cross_values(cross_rows(spark, d), "o_orderstatus", "o_orderpriority", "o_totalprice", dense=True), 2, "value", "label_value")


@query(
    "agg_pivot_where", "AGG-05 FLT-06",
    """select o_orderstatus as label, count(*)::double as value from orders where (o_orderstatus = 'F' and o_orderpriority = '5-LOW') or o_orderpriority in ('1-URGENT') group by 1""",
)
def _(spark, d):
    return A.cross_values(cross_rows(spark, d), "o_orderstatus", how="count", where={"o_orderpriority": ["1-URGENT", "∅"]}).select("label", "value")


@query("agg_pivot_top", "AGG-05", f"select cast(l_suppkey as varchar) as label, round({MONEY.format('l_quantity')}, 2) as value from lineitem group by 1 order by 2 desc, 1 limit 25")
def _(spark, d):
    return rounded(A.cross_values(table(spark, d, "lineitem"), "l_suppkey", value="l_quantity", top=25), 2, "value").select("label", "value")


@query(
    "agg_pivot_many_series", "AGG-05 AGG-06",
    """with g as (select l_returnflag as x, l_orderkey::varchar as s, sum(l_quantity) as v, count(*) as n from lineitem group by all)
    select x as label, s as series, v as value, sum(v) over (partition by x) as label_value, n, (sum(n) over (partition by x))::bigint as label_total from g""",
)
def _(spark, d):
    """Every order is a series of its own."""
    li = table(spark, d, "lineitem")
    sums = A.cross_values(li, "l_returnflag", "l_orderkey", "l_quantity")
    return sums.join(A.stacked_counts(li, "l_returnflag", "l_orderkey").withColumnRenamed("value", "n"), ["label", "series"])


@query(
    "agg_stacked", "AGG-06",
    """with t as (select p_brand as x, count(*) as n from part group by 1 order by 2 desc, 1 limit 15), s as (select distinct p_type as y from part)
    select x as label, y as series, n as label_total, (select count(*) from part where p_brand = x and p_type = y) as value from t cross join s""",
)
def _(spark, d):
    return A.stacked_counts(table(spark, d, "part"), "p_brand", "p_type", top=15, dense=True)


@query(
    "agg_percent", "AGG-11",
    _CROSS + "select x as label, s as series, round(v / sum(v) over (partition by x) * 100, 6) as share from g",
)
def _(spark, d):
    long = A.cross_values(cross_rows(spark, d), "o_orderstatus", "o_orderpriority", "o_totalprice", dense=True).where("value is not null")
    return rounded(A.percent_of_label(long), 6, "share").select("label", "series", "share")


@query(
    "agg_heatmap", "AGG-12",
    _CROSS + "select t.x as label, ss.s as series, round(g.v, 2) as value, round((select min(v) from g), 2) as low, round((select max(v) from g), 2) as high from t cross join ss left join g on g.x = t.x and g.s = ss.s",
)
def _(spark, d):
    long = A.cross_values(cross_rows(spark, d), "o_orderstatus", "o_orderpriority", "o_totalprice", dense=True)
    return rounded(A.heat_matrix(long), 2, "value", "low", "high").select("label", "series", "value", "low", "high")


# ------------------------------------------------------------------ several columns

_YEARS = """with y as (select strftime(o_orderdate, '%Y') as ano, sum(o_totalprice::decimal(18,2))::double as total,
  sum(case when o_orderstatus = 'F' then o_totalprice::decimal(18,2) end)::double as fechado, count(*)::double as pedidos from orders group by 1) """


def yearly_orders(spark, d):
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("ano")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.sum(closed).cast("double").alias("fechado"), F.count(F.lit(1)).cast("double").alias("pedidos")
    )


@query("agg_compare_columns", "AGG-07", _YEARS + "select ano as label, unnest(['total','fechado','pedidos']) as series, unnest([round(total, 2), round(fechado, 2), pedidos]) as value from y")
def _(spark, d):
    return rounded(A.compare_columns(yearly_orders(spark, d), "ano", ["total", "fechado", "pedidos"]), 2, "value")


@query("agg_part", "AGG-08", _YEARS + "select ano as label, round(fechado, 2) as part, round(total - fechado, 2) as rest from y")
def _(spark, d):
    return rounded(A.part_and_rest(yearly_orders(spark, d), "ano", "fechado", "total"), 2, "part", "rest")


@query("agg_part_row", "AGG-08", _YEARS + "select ano as label, round(fechado, 2) as part, round(total - fechado, 2) as rest from y order by ano offset 1 limit 1")
def _(spark, d):
    return rounded(A.part_and_rest(yearly_orders(spark, d), "ano", "fechado", "total", order_by="ano", row=1), 2, "part", "rest").drop("position")


@query(
    "agg_profile", "AGG-09",
    _YEARS + ", u as (select ano, unnest(['total','fechado','pedidos']) as i, unnest([total, fechado, pedidos]) as v from y) select ano as label, i as indicator, round(v / max(v) over (partition by i) * 100, 6) as value from u",
)
def _(spark, d):
    return rounded(A.indicator_profile(yearly_orders(spark, d), "ano", ["total", "fechado", "pedidos"]), 6, "value")


@query(
    "agg_hist", "AGG-10",
    """with s as (select min(p_retailprice) as lo, max(p_retailprice) as hi, least(12, greatest(4, ceil(sqrt(count(*))))) as bins from part),
    p as (select lo, bins, (hi - lo) / bins as w from s), c as (select least(bins - 1, floor((p_retailprice - lo) / w)) as bin, count(*) as n from part, p group by 1)
    select b::int as bin, round(lo + b * w, 6) as from_value, round(lo + (b + 1) * w, 6) as to_value, coalesce(n, 0) as n
    from p, unnest(range(0, bins::bigint)) r(b) left join c on c.bin = b""",
)
def _(spark, d):
    return rounded(A.histogram(table(spark, d, "part"), "p_retailprice"), 6, "from_value", "to_value")


@query("agg_hist_constant", "AGG-10", "select unnest(range(0, 12))::int as bin, case when unnest(range(0, 12)) = 0 then count(*) else 0 end as n from part")
def _(spark, d):
    return A.histogram(table(spark, d, "part").select(F.lit(7).alias("v")), "v").select("bin", "n")


@query("agg_corr", "AGG-18", "select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem where l_orderkey % 10 <> 3")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 10 != 3, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"))
    return rounded(A.pearson(li, "a", "b"), 6, "r")


@query("agg_corr_constant", "AGG-18", "select count(*) as n, 0.0::double as r from lineitem")
def _(spark, d):
    return A.pearson(table(spark, d, "lineitem").select(F.lit(1.0).alias("a"), "l_extendedprice"), "a", "l_extendedprice")


@query("agg_best_corr", "AGG-19", "select 'l_quantity' as a, 'dobro' as b, count(*) as n, round(corr(l_quantity, l_quantity * 2 + l_linenumber), 6) as r from lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("dobro", F.col("l_quantity") * 2 + F.col("l_linenumber"))
    return rounded(A.best_correlation(li, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "dobro"]), 6, "r")


@query("agg_best_corr_wide", "AGG-19", "select 'w18' as a, 'w19' as b, count(*) as n, round(corr(l_quantity, l_quantity * 2 + l_linenumber), 6) as r from lineitem")
def _(spark, d):
    """Twenty columns; the related pair comes last."""
    noise = [F.hash(F.lit(i), "l_orderkey", "l_linenumber").cast("double").alias(f"w{i}") for i in range(18)]
    li = table(spark, d, "lineitem").select(*noise, F.col("l_quantity").alias("w18"), (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("w19"))
    return rounded(A.best_correlation(li, li.columns), 6, "r")


@query("agg_scatter", "AGG-20", "select l_quantity as x, l_tax as y from lineitem where l_orderkey % 10 <> 3")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_orderkey") % 10 != 3, F.col("l_tax")).alias("t"))
    return A.scatter_points(li, "l_quantity", "t")


@query("agg_explore", "AGG-22", f"select l_returnflag as label, round({MONEY.format('l_quantity')}, 2) as value from lineitem group by 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_shipdate")
    return rounded(explore(li, roles(profile(li, median=False)), "l_returnflag", "l_quantity", "sum"), 2, "value").select("label", "value")


# ------------------------------------------------------------------ series

_GAPS = """with r as (select date_trunc('month', o_orderdate) as m, o_totalprice as v from orders where month(o_orderdate) <> 4),
  g as (select m, {agg} as v from r group by 1),
  s as (select unnest(generate_series((select min(m) from g), (select max(m) from g), interval 1 month)) as m)
select strftime(s.m, '%Y-%m') as label, {out} as value from s left join g on g.m = s.m"""


def gap_rows(spark, d):
    return table(spark, d, "orders").where("month(o_orderdate) <> 4")


def _series(how):
    digits = 4 if how in ("mean", "median") else 2
    return lambda spark, d: rounded(Z.monthly(gap_rows(spark, d), "o_orderdate", "o_totalprice", how), digits, "value")


for _how, (_a, _o) in {
    "sum": (MONEY.format("v"), "round(coalesce(g.v, 0), 2)"),
    "count": ("count(*)::double", "coalesce(g.v, 0)"),
    "mean": ("avg(v)", "round(g.v, 4)"),
    "median": ("median(v)", "round(g.v, 4)"),
    "max": ("max(v)", "round(g.v, 2)"),
}.items():
    query(f"ser_month_{_how}", "AGG-23", _GAPS.format(agg=_a, out=_o))(_series(_how))

_FLAGSHIP = (
    "with x as (" + _GAPS.format(agg=MONEY.format("v"), out="round(coalesce(g.v, 0), 2)") + ") "
    "select label, value, round((value - lag(value) over (order by label)) / nullif(lag(value) over (order by label), 0) * 100, 6) as variation from x"
)


@query("win_variation", "WIN-01 AGG-23", _FLAGSHIP)
def flagship(spark, d):
    months = rounded(Z.monthly(gap_rows(spark, d), "o_orderdate", "o_totalprice", "sum"), 2, "value")
    return rounded(Z.variation(months), 6, "variation")


@query(
    "win_pareto", "WIN-02",
    """with g as (select cast(l_partkey as varchar) as label, sum(l_quantity) as value from lineitem group by 1)
    select value, round(sum(value) over (order by value desc, label rows unbounded preceding) / sum(value) over () * 100, 6) as cumulative from g""",
)
def _(spark, d):
    # which of several equal values comes first is not compared
    return rounded(Z.pareto(A.group_values(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "sum")), 6, "cumulative").select("value", "cumulative")


@query(
    "win_pareto_offset", "WIN-02",
    """select event_id, round(sum(epoch(ts)) over (order by ts desc rows unbounded preceding) / sum(epoch(ts)) over () * 100, 6) as cumulative from events""",
)
def _(spark, d):
    """Times as seconds, all in one bin of the logarithmic scale."""
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("value"))
    return rounded(Z.pareto(e, "event_id"), 6, "cumulative").select("event_id", "cumulative")


@query(
    "win_change", "WIN-03",
    _YEARS + """, u as (select ano, unnest(['total','fechado','pedidos']) as i, unnest([total, fechado, pedidos]) as v from y),
    e as (select i, min_by(v, ano) as f, max_by(v, ano) as l from u group by 1) select i as indicator, round(f, 2) as first, round(l, 2) as last, round((l - f) / abs(f) * 100, 6) as change from e""",
)
def _(spark, d):
    out = A.first_to_last_change(yearly_orders(spark, d), "ano", ["total", "fechado", "pedidos"], "ano")
    return rounded(rounded(out, 2, "first", "last"), 6, "change")


_MEANS = "with x as (" + _GAPS.format(agg="avg(v)", out="round(g.v, 4)") + ") "


@query(
    "win_highlights", "WIN-04",
    _MEANS + """select arg_max(label, value) as max_label, max(value) as max_value, arg_min(label, value) as min_label, min(value) as min_value,
      round(sum(value), 2) as total, min_by(label, label) filter (where value is not null) as first_label, min_by(value, label) filter (where value is not null) as first_value,
      max_by(value, label) filter (where value is not null) as last_value, count(*) filter (where value is null) as gaps from x""",
)
def _(spark, d):
    months = rounded(Z.monthly(gap_rows(spark, d), "o_orderdate", "o_totalprice", "mean"), 4, "value")
    out = Z.highlights(months)
    return rounded(out, 2, "total").select("max_label", "max_value", "min_label", "min_value", "total", "first_label", "first_value", "last_value", "gaps")


@query(
    "win_leading_series", "WIN-04",
    _CROSS + """, p as (select s, sum(v) as total, max(v) as peak, arg_max(x, v) as peak_label, (select count(*) from t) - count(*) as gaps from g group by 1)
    select arg_max(s, total) as series, round(max(total), 2) as total, round(arg_max(peak, total), 2) as peak, arg_max(peak_label, total) as peak_label,
      round(max(total) / sum(total) * 100, 6) as share, sum(gaps)::bigint as gaps from p""",
)
def _(spark, d):
    long = A.cross_values(cross_rows(spark, d), "o_orderstatus", "o_orderpriority", "o_totalprice", dense=True)
    return rounded(rounded(Z.leading_series(long), 2, "total", "peak"), 6, "share")


@query("win_series_changes", "WIN-04", """with g as (select strftime(o_orderdate, '%Y') as y, o_orderpriority as s, count(*)::double as v from orders group by all)
    select s as series, min_by(v, y) as first_value, max_by(v, y) as last_value, round((max_by(v, y) - min_by(v, y)) / min_by(v, y) * 100, 6) as change from g group by 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("y"), "o_orderpriority")
    return rounded(Z.series_changes(A.cross_values(o, "y", "o_orderpriority", how="count", dense=True)), 6, "change")


@query("win_representative", "WIN-05", "select o_custkey, min_by(o_orderpriority, o_orderkey) as o_orderpriority from orders group by 1")
def _(spark, d):
    return Z.representative(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


# ------------------------------------------------------------------ long tables

_CONF, _DONE = ["Confirmados"], ["Confirmados", "Descartados"]


@query(
    "rate_positivity", "AGG-13",
    LONG_SQL + """select period as label, round(case when coalesce(sum("Total") filter (where situation in ('Confirmados','Descartados')), 0) > 0 then
      coalesce(sum("Total") filter (where situation = 'Confirmados'), 0) / sum("Total") filter (where situation in ('Confirmados','Descartados')) * 100 end, 6) as value
    from long where subgroup = 'grupo 1' or subgroup is null group by 1""",
)
def _(spark, d):
    out = T.rate_by_label(long_events(spark, d), "period", "situation", _CONF, _DONE, scope={"subgroup": ["grupo 1", "∅"]})
    return rounded(out, 6, "value")


@query(
    "win_funnel", "AGG-14",
    LONG_SQL + """, s as (select round(sum("Total") filter (where situation = 'Notificados'), 2) as a, round(sum("Total") filter (where situation in ('Confirmados','Descartados')), 2) as b,
      round(sum("Total") filter (where situation = 'Confirmados'), 2) as c from long)
    select 0 as position, 'Notificados' as stage, a as value, null::double as of_previous from s union all select 1, 'Concluídos', b, round(b / a * 100, 4) from s
    union all select 2, 'Confirmados', c, round(c / b * 100, 4) from s""",
)
def _(spark, d):
    out = T.funnel(long_events(spark, d), "situation", [("Notificados", ["Notificados"]), ("Concluídos", _DONE), ("Confirmados", _CONF)])
    return rounded(rounded(out, 2, "value"), 4, "of_previous")


@query(
    "agg_bubble", "AGG-15",
    LONG_SQL + """, s as (select entity, sum("Total") filter (where situation = 'Notificados') as v, sum("Total") filter (where situation = 'Confirmados') as n,
      sum("Total") filter (where situation in ('Confirmados','Descartados')) as dd, sum("Total") filter (where situation = 'Em andamento') as z from long group by 1)
    select entity, round(v, 2) as volume, round(n / dd * 100, 6) as rate, round(z, 2) as size from s""",
)
def _(spark, d):
    out = T.bubbles(long_events(spark, d), "entity", "situation", ["Notificados"], _CONF, _DONE, ["Em andamento"])
    return rounded(rounded(out, 2, "volume", "size"), 6, "rate")


_SPEC = T.LongSpec("period", "entity", situation="situation", subgroup="subgroup")
_MAIN = LONG_SQL + """, ms as (select situation from long group by 1 order by sum("Total") desc, 1 limit 1),
  mg as (select subgroup from long where situation = (select situation from ms) and subgroup is not null group by 1 order by sum("Total") desc, 1 limit 1) """


@query("agg_dominant", "AGG-16", _MAIN + "select (select situation from ms) as main_situation, (select subgroup from mg) as main_subgroup")
def _(spark, d):
    return T.dominant(long_events(spark, d), _SPEC)


@query("agg_sums_by", "AGG-16", LONG_SQL + 'select situation as label, round(sum("Total"), 2) as value from long where "Total" is not null group by 1')
def _(spark, d):
    return rounded(T.sums_by(long_events(spark, d), "situation"), 2, "value")


@query(
    "agg_long_kpis", "AGG-17",
    _MAIN + """, m as (select * from long where situation = (select situation from ms) and ((select subgroup from mg) is null or subgroup = (select subgroup from mg))),
    o as (select situation, sum("Total") as v from long where subgroup is null or subgroup = (select subgroup from mg) group by 1)
    select 'total' as kpi, round(sum("Total"), 2) as value, null::double as share from m
    union all select 'top_entity', round(max(v), 2), null from (select sum("Total") as v from m group by entity)
    union all select 'peak_period', round(max(v), 2), null from (select sum("Total") as v from m group by period)
    union all (select 'situation', round(v, 2), round(v / coalesce((select v from o where situation = (select situation from ms)), 1) * 100, 4) from o where situation <> (select situation from ms))
    union all select 'periods', count(distinct period), null from long union all select 'entities', count(distinct entity), null from long""",
)
def _(spark, d):
    out = T.long_kpis(long_events(spark, d), _SPEC)
    return rounded(rounded(out, 2, "value"), 4, "share").select("kpi", "value", "share")


@query(
    "prf_long_alerts", "PRF-24",
    LONG_SQL + """select entity, period, count(*) as cells, count(*) filter (where "Total" is null) as missing,
      case when count(*) = count(*) filter (where "Total" is null) then 'empty' else 'partial' end as kind from long group by 1, 2 having missing > 0""",
)
def _(spark, d):
    return T.emptiness(long_events(spark, d), _SPEC)


@query(
    "prf_near_names", "PRF-24",
    """with b as (select distinct lower(p_brand) as l, p_brand as n from part) select count(distinct x.n) as names from b x join b y on x.l <> y.l and length(x.l) = length(y.l) and levenshtein(x.l, y.l) = 1""",
)
def _(spark, d):
    pairs = T.one_letter_apart(table(spark, d, "part"), "p_brand")
    return pairs.select(F.explode(F.array("a", "b")).alias("n")).agg(F.count_distinct("n").alias("names"))


# ------------------------------------------------------------------ filters


@query("flt_equals", "FLT-01", "select count(*) as n from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def _(spark, d):
    return L.equals(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}).agg(F.count(F.lit(1)).alias("n"))


@query("flt_equals_empty", "FLT-01", "select count(*) as n from documents left join labels using (doc_id) where quality is null")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return L.equals(rows, {"quality": ""}).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_date_range", "FLT-02",
    "select o_orderstatus, count(*) as n from orders where o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1998-01-01' group by 1",
)
def _(spark, d):
    return L.date_between(table(spark, d, "orders"), "o_orderdate", "1997-03-01", "1997-12-31").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_text_search", "FLT-03",
    """select doc_id from documents where contains(strip_accents(lower(concat_ws(' ', doc_id, text, lang, source, n_chars))), 'de')
      and contains(strip_accents(lower(concat_ws(' ', doc_id, text, lang, source, n_chars))), 'tion')""",
)
def _(spark, d):
    return L.text_search(table(spark, d, "documents"), "DÉ  Tíon").select("doc_id")


@query("flt_any_column", "FLT-04", "select p_partkey from part where contains(p_name, 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring')")
def _(spark, d):
    return L.any_column_contains(table(spark, d, "part"), "RING").select("p_partkey")


@query("flt_label_month", "FLT-05", "select count(*) as n from orders where strftime(o_orderdate, '%Y-%m') = '1996-02'")
def _(spark, d):
    return L.by_label(table(spark, d, "orders"), "o_orderdate", "1996-02", time_axis=True).agg(F.count(F.lit(1)).alias("n"))


@query("flt_label_value", "FLT-05", "select count(*) as n from orders where o_orderstatus = 'P'")
def _(spark, d):
    return L.by_label(table(spark, d, "orders"), "o_orderstatus", "P").agg(F.count(F.lit(1)).alias("n"))


@query("flt_where_none", "FLT-06", "select count(*) as n from documents left join labels using (doc_id) where quality = 1 or quality is null")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.where(A.where_lists(rows, {"quality": ["1", "∅"]})).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ metrics


@query(
    "met_row", "MET-01 MET-02 MET-08",
    """select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 6) as liquido, round(-(l_extendedprice * (1 - l_discount) + l_tax) / l_quantity, 10) as unitario,
      case when l_discount = 0 then null else round(abs(l_tax / l_discount), 6) end as razao, floor(l_tax * 10 + 0.5) / 10 as imposto from lineitem""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    out, skipped = M.add_row_metrics(
        li,
        [
            ("liquido", lambda c: c.num("l_extendedprice") * (1 - c.num("l_discount")) + c.num("l_tax")),
            ("unitario", lambda c: c.div(-c.num("liquido"), c.num("l_quantity"))),
            ("razao", lambda c: F.abs(c.div(c.num("l_tax"), c.num("l_discount")))),
            ("quebrada", lambda c: c.num("não existe")),
            ("imposto", "floor(l_tax * 10 + 0.5) / 10"),
        ],
    )
    assert skipped == ["quebrada"]
    return rounded(rounded(out, 6, "liquido", "razao"), 10, "unitario").select("l_orderkey", "l_linenumber", "liquido", "unitario", "razao", "imposto")


@query("met_div_zero", "MET-01", "select count(*) filter (where l_discount = 0) as without_data, count(*) as n from lineitem")
def _(spark, d):
    out = M.add_row_metric(table(spark, d, "lineitem"), "m", lambda c: c.div(c.num("l_tax"), c.num("l_discount")))
    return out.agg(F.count_if(F.col("m").isNull()).alias("without_data"), F.count(F.lit(1)).alias("n"))


@query(
    "met_aggregates", "MET-03 MET-04 MET-05 MET-06",
    """select round(sum(l_quantity), 2) as soma, round(avg(l_tax), 6) as media, min(l_extendedprice) as menor, max(l_extendedprice) as maior, count(*)::double as linhas,
      round(sum(l_quantity) filter (where l_returnflag = 'A'), 2) as soma_se, count(*) filter (where l_returnflag = 'R')::double as conta_se, null::double as sem_par,
      round(sum(l_quantity) filter (where l_returnflag = 'A') / count(*) filter (where l_returnflag = 'R'), 6) as razao from lineitem""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    metrics = {
        "soma": (lambda c: c.sum("l_quantity"), 2), "media": (lambda c: c.avg("l_tax"), 6), "menor": (lambda c: c.min("l_extendedprice"), 2),
        "maior": (lambda c: c.max("l_extendedprice"), 2), "linhas": (lambda c: c.count(), 0), "soma_se": (lambda c: c.sum_if("l_quantity", "l_returnflag", "A"), 2),
        "conta_se": (lambda c: c.count_if("l_returnflag", "R"), 0), "sem_par": (lambda c: c.sum_if("l_quantity", "l_returnflag", "?"), 2),
        "razao": (lambda c: c.div(c.sum_if("l_quantity", "l_returnflag", "A"), c.count_if("l_returnflag", "R")), 6),
    }
    cells = M.Cells(li)
    return li.agg(*[F.round(m(cells).cast("double"), k).alias(n) for n, (m, k) in metrics.items()])


@query("met_indicator", "MET-06", "select round(sum(l_extendedprice) / sum(l_quantity), 6) as value from lineitem")
def _(spark, d):
    return rounded(M.indicator(table(spark, d, "lineitem"), lambda c: c.div(c.sum("l_extendedprice"), c.sum("l_quantity"))), 6, "value")


# ------------------------------------------------------------------ recipes


@query("prj_rename", "PRJ-01", "select o_orderstatus as situacao, count(*) as n from orders group by 1")
def _(spark, d):
    return C.rename(table(spark, d, "orders"), {"o_orderstatus": "situacao", "não existe": "x"}).groupBy("situacao").agg(F.count(F.lit(1)).alias("n"))


@query("prj_merge", "PRJ-02", "select case when p_brand in ('Brand#1','Brand#2') then 'Brand#12' else p_brand end as p_brand, count(*) as n from part group by 1")
def _(spark, d):
    merged = C.apply_merges(table(spark, d, "part"), {"p_brand": {"Brand#1": "Brand#12", "Brand#2": "Brand#12"}})
    return merged.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("prj_recipe", "PRJ-03 PRJ-01 PRJ-02 MET-08", """select case when o_orderpriority = '5-LOW' then 'baixa' else o_orderpriority end as prioridade, round(sum(o_totalprice * 2), 2) as dobro, 'velha' as dropped
    from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' group by 1""")
def _(spark, d):
    r = C.Recipe(
        renames={"o_orderpriority": "prioridade"},
        merges={"prioridade": {"5-LOW": "baixa"}},
        filters={"o_orderstatus": "F", "velha": "1"},
        date_range=("o_orderdate", "1997-01-01", "1997-12-31"),
        metrics=(("dobro", lambda c: c.num("o_totalprice") * 2),),
        metric_columns={"dobro": ("o_totalprice",)},
    )
    df, dropped = C.apply_recipe(table(spark, d, "orders"), r)
    return df.groupBy("prioridade").agg(F.round(F.sum("dobro"), 2).alias("dobro")).withColumn("dropped", F.lit(dropped[0][1]))


# ------------------------------------------------------------------ pages


@query("tbl_sorted_page", "SRT-01 SRT-02", "select o_orderkey, o_totalprice from (select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as o_totalprice from orders) order by o_totalprice desc nulls last, o_orderkey limit 25 offset 50")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return P.page(P.sort_rows(rows, "o_totalprice", "o_orderkey", descending=True, kind="number"), 3, 25)


@query("tbl_deep_page", "SRT-02", "select o_orderkey, o_totalprice from (select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as o_totalprice from orders) order by o_totalprice desc nulls last, o_orderkey limit 25 offset 8000")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return P.sorted_page(rows, "o_totalprice", "o_orderkey", 321, 25, descending=True, kind="number", direct=1_000)


@query("tbl_natural_sort", "SRT-01", "select p_partkey, p_brand from part order by cast(split_part(p_brand, '#', 2) as int), p_partkey limit 40 offset 40")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand")
    return P.page(P.sort_rows(rows, "p_brand", "p_partkey", kind="text"), 2, 40)


@query("tbl_page_bounds", "SRT-02", "select count(*) as rows, ceil(count(*) / 25.0)::bigint as pages, ceil(count(*) / 25.0)::bigint as page, (ceil(count(*) / 25.0)::bigint - 1) * 25 + 1 as first, count(*) as last from orders")
def _(spark, d):
    return P.page_bounds(table(spark, d, "orders"), 10**9, 25)


@query("tbl_top_k", "SRT-04", "select p_type as label, count(*)::double as value from part where p_type <> 'PROMO' group by 1 order by 2 desc, 1 limit 5")
def _(spark, d):
    groups = A.group_values(table(spark, d, "part"), "p_type")
    return P.top_k(groups, "value", "label", 5, last="PROMO")
