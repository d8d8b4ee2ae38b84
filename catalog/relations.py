"""Joins, version comparison, spelling groups, name resolution and duplicates."""

from pyspark.sql import functions as F

from catalog.base import query, rounded, survey_records, table
from tablelens.functions.values import name_key
from tablelens.operators import diff as D
from tablelens.operators import duplicates as U
from tablelens.operators import joins as J
from tablelens.operators import linkage as L
from tablelens.operators.profile import profile


@query(
    "join_left", "JOI-01",
    """select o_orderkey, c_name, c_mktsegment from (select *, case when o_orderkey % 10 = 0 then null else o_custkey end as k from orders)
    left join customer on k = c_custkey""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("chave"))
    return J.join_tables(o, table(spark, d, "customer"), "chave", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("join_inner", "JOI-02", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderkey % 10 <> 0")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("chave"))
    return J.join_tables(o, table(spark, d, "customer"), "chave", "c_custkey", "inner").select("o_orderkey", "c_name")


@query("join_clashing_names", "JOI-01", "select a.n_nationkey, a.n_name, b.n_name as \"n_name (copia)\", b.n_regionkey as \"n_regionkey (copia)\" from nation a left join nation b on a.n_regionkey = b.n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation")
    out = J.join_tables(n, n, "n_regionkey", "n_nationkey", right_name="copia")
    return out.select("n_nationkey", "n_name", "n_name (copia)", "n_regionkey (copia)")


_ANALYSIS = """with l as (select {lk} as k from {lt}), r as (select {rk} as k from {rt}),
  a as (select k, count(*) as n from l where k is not null group by 1), b as (select k, count(*) as m from r where k is not null group by 1),
  j as (select a.n, b.m from a join b using (k)), s as (select count(*) as rows, count(k) as keyed from l), t as (select count(*) as rows, count(k) as keyed from r)
select case when max(n) > 1 and max(m) > 1 then 'N:N' when max(n) > 1 then 'N:1' when max(m) > 1 then '1:N' else '1:1' end as cardinality,
  (select rows from s) as left_rows, (select rows from t) as right_rows, coalesce(sum(n), 0)::bigint as matched, ((select rows from s) - coalesce(sum(n), 0))::bigint as unmatched_left,
  ((select keyed from t) - coalesce(sum(m), 0))::bigint as unmatched_right, (select rows - keyed from s) as null_left, (select rows - keyed from t) as null_right,
  (coalesce(sum(n * m), 0) + (select rows from s) - coalesce(sum(n), 0))::bigint as result_rows, greatest(1, coalesce(max(n), 1)) as max_left_per_right, greatest(1, coalesce(max(m), 1)) as max_right_per_left from j"""


def _analysis(left, right):
    def run(spark, d):
        (lt, lk), (rt, rk) = left, right
        frame = lambda t, k: table(spark, d, t).selectExpr(f"{k} as k")
        return J.analyze_join(frame(lt, lk), frame(rt, rk), "k", "k")

    return run


for _name, _l, _r in [
    ("n1", ("orders", "case when o_orderkey % 10 = 0 then null else o_custkey end"), ("customer", "c_custkey")),
    ("1n", ("customer", "c_custkey"), ("orders", "o_custkey")),
    ("nn", ("lineitem", "l_suppkey"), ("lineitem", "l_linenumber")),
    ("11", ("supplier", "s_suppkey"), ("nation", "n_nationkey")),
]:
    query(f"join_analysis_{_name}", "JOI-03", _ANALYSIS.format(lt=_l[0], lk=_l[1], rt=_r[0], rk=_r[1]))(_analysis(_l, _r))


@query(
    "join_unmatched", "JOI-04",
    """select 'left' as side, cast(s_suppkey as varchar) as key, count(*) as n from supplier where s_suppkey not in (select n_nationkey from nation) group by 2
    union all select 'right', cast(n_nationkey as varchar), count(*) from nation where n_nationkey not in (select s_suppkey from supplier) group by 2""",
)
def _(spark, d):
    return J.unmatched_keys(table(spark, d, "supplier"), table(spark, d, "nation"), "s_suppkey", "n_nationkey")


@query("join_repeated_keys", "JOI-03", "select cast(o_custkey as varchar) as key, count(*) as n from orders group by 1 having n > 1 order by 2 desc, 1 limit 5")
def _(spark, d):
    return J.repeated_keys(table(spark, d, "orders"), "o_custkey", top=5)


@query(
    "join_fan_out", "JOI-05",
    """with m as (select max(n) as r from (select count(*) as n from orders group by o_custkey)) select 'right' as side, unnest(['c_nationkey', 'c_acctbal']) as "column", r as repeats from m""",
)
def _(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderstatus"), table(spark, d, "customer")
    a = J.analyze_join(o, c, "o_custkey", "c_custkey")
    return J.fan_out(a, profile(o, median=False), profile(c, median=False), "o_custkey", "c_custkey")


@query(
    "join_warnings", "JOI-03",
    """select 'many_to_many' as code from (select 1) where (select count(*) from lineitem) > 0 union all
    select 'many_lost' where (select avg(case when l_suppkey between 1 and 7 then 1.0 else 0 end) from lineitem) <= 0.7""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    return J.join_warnings(J.analyze_join(li, li.select(F.col("l_linenumber").alias("k")), "l_suppkey", "k"))


@query(
    "join_zero_hint", "JOI-06",
    "select cast(s_suppkey as varchar) as left_key, lpad(cast(s_suppkey as varchar), 6, '0') as right_key from supplier where length(cast(s_suppkey as varchar)) < 6",
)
def _(spark, d):
    s = table(spark, d, "supplier")
    padded = s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("k"))
    return J.leading_zero_pairs(s, padded, "s_suppkey", "k")


@query(
    "join_recipes", "JOI-07 JOI-08",
    """select 'o + c' as name, 'ok' as state, count(*) as rows from orders union all select 'o + x', 'missing_table:x', 0 union all select 'c + o', 'repeats_shapes', 0
    union all select 'o + n', 'missing_left_key:k', 0""",
)
def _(spark, d):
    tables = {"o": table(spark, d, "orders"), "c": table(spark, d, "customer"), "n": table(spark, d, "nation")}
    specs = [
        J.JoinSpec("o", "c", "o_custkey", "c_custkey"), J.JoinSpec("o", "x", "o_custkey", "k"),
        J.JoinSpec("c", "o", "c_custkey", "o_custkey"), J.JoinSpec("o", "n", "k", "n_nationkey"),
    ]
    out, dropped = J.apply_joins(tables, specs, shaped={"c"})
    made = out["o + c"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("o + c").alias("name"), F.lit("ok").alias("state"), "rows")
    lost = spark.createDataFrame(dropped, "name string, state string").withColumn("rows", F.lit(0).cast("bigint"))
    return made.unionByName(lost)


@query(
    "join_known_spelling", "JOI-11",
    "select doc_id, case when doc_id % 2 = 0 then concat('SRC', substring(source, 4)) else concat(source, ' novo') end as place, doc_id % 2 = 1 as is_new from documents",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    shouted = F.concat(F.lit("SRC"), F.substr(F.col("source"), F.lit(4)))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit(" novo"))).alias("place"))
    known = docs.select(name_key("source").alias("key"), shouted.alias("name"))
    return J.known_spelling(rows, "place", name_key("place"), known)


# ------------------------------------------------------------------ versions of a table


def _before(spark, d):
    return table(spark, d, "orders").where("o_orderdate < timestamp '1998-01-01'").withColumn("velha", F.lit(1))


def _after(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp '1996-01-01'").withColumn("nova", F.lit("a"))
    return o.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")))


@query("set_union", "SET-01", """select count(*) as n, count(velha) as velha, count(nova) as nova from (select o_orderkey, 1 as velha, null as nova from orders where o_orderdate < timestamp '1998-01-01'
    union all select o_orderkey, null, 'a' from orders where o_orderdate >= timestamp '1996-01-01')""")
def _(spark, d):
    return D.union_all(_before(spark, d), _after(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.count("velha").alias("velha"), F.count("nova").alias("nova"))


@query("set_new_values", "SET-02", "select 'o_orderstatus' as \"column\", 'X' as value, 'new' as change union all select 'o_orderstatus', 'P', 'gone'")
def _(spark, d):
    return D.value_changes(_before(spark, d), _after(spark, d), ["o_orderstatus", "o_orderpriority", "nova"])


@query(
    "set_diff_sums", "SET-03",
    """with b as (select * from orders where o_orderdate < timestamp '1998-01-01'), a as (select * from orders where o_orderdate >= timestamp '1996-01-01')
    select 'o_totalprice' as "column", round((select sum(o_totalprice::decimal(18,2)) from b)::double, 2) as before, round((select sum(o_totalprice::decimal(18,2)) from a)::double, 2) as after
    union all select 'o_orderkey', (select sum(o_orderkey) from b)::double, (select sum(o_orderkey) from a)::double
    union all select 'o_custkey', (select sum(o_custkey) from b)::double, (select sum(o_custkey) from a)::double""",
)
def _(spark, d):
    return rounded(D.changed_sums(_before(spark, d), _after(spark, d), ["o_totalprice", "o_orderkey", "o_custkey"]), 2, "before", "after")


@query(
    "set_diff_shape", "SET-03",
    """select 'rows' as part, null::varchar as item, (select count(*) from orders where o_orderdate < timestamp '1998-01-01') as before,
      (select count(*) from orders where o_orderdate >= timestamp '1996-01-01') as after
    union all select 'added', 'nova', null, null union all select 'removed', 'velha', null, null""",
)
def _(spark, d):
    b, a = _before(spark, d), _after(spark, d)
    none = F.lit(None).cast("bigint")
    rows = D.row_counts(b, a).select(F.lit("rows").alias("part"), F.lit(None).cast("string").alias("item"), "before", "after")
    cols = D.column_changes(b, a).select(F.col("change").alias("part"), F.col("column").alias("item"), none.alias("before"), none.alias("after"))
    return rows.unionByName(cols)


@query(
    "set_compare_versions", "SET-02 SET-03",
    """select 'o_orderstatus' as "column", 'X' as value, 'new' as change union all select 'o_orderstatus', 'P', 'gone'""",
)
def _(spark, d):
    b, a = _before(spark, d), _after(spark, d)
    return D.compare_versions(b, a, profile(b, median=False), profile(a, median=False))["values"]


@query("set_distinct", "SET-04", "select distinct cast(l_suppkey as varchar) as value from lineitem")
def _(spark, d):
    return D.distinct_values(table(spark, d, "lineitem"), "l_suppkey")


# ------------------------------------------------------------------ spellings and names

_SIMILAR = """with recursive v as (select p_brand as value, count(*) as n, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as key from part group by 1),
  e as (select a.key as a, b.key as b from v a join v b on length(a.key) >= 5 and length(b.key) >= 5 and levenshtein(a.key, b.key) <= 1),
  c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a),
  k as (select a as key, min(b) as component from c group by 1), g as (select component, v.value, n from v join k using (key)),
  s as (select component, arg_min(value, -n * 1000 + cast(split_part(value, '#', 2) as int) * 0) as x, max(n) as m, count(*) as c from g group by 1)
select component, value, n, (select min(h.value) from g h where h.component = g.component and h.n = m) as suggested from g join s using (component) where c > 1"""


@query("lnk_similar", "LNK-01", _SIMILAR)
def _(spark, d):
    return L.similar_spellings(table(spark, d, "part"), ["p_brand"]).drop("column")


@query("lnk_similar_long", "LNK-01")
def _(spark, d):
    """Whole columns of free values: customer names differ by one digit and chain together."""
    return L.similar_spellings(table(spark, d, "customer"), ["c_name", "c_mktsegment"]).groupBy("column", "component").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lnk_similar_names", "LNK-02",
    """with v as (select distinct p_brand as n, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as k from part)
    select x.n as a, y.n as b from v x join v y on x.k < y.k and length(x.k) >= 6 and length(y.k) >= 6 and levenshtein(x.k, y.k) <= 1""",
)
def _(spark, d):
    names = table(spark, d, "part").select("p_brand", name_key("p_brand").alias("k"))
    return L.similar_names(names, "k", "p_brand")


@query(
    "lnk_resolve", "LNK-03",
    """select typed as name, segment as resolved, how, count(*) as n from (select c_mktsegment as segment,
      case c_custkey % 4 when 0 then lower(c_mktsegment) when 1 then concat(left(c_mktsegment, 3), substring(c_mktsegment, 5)) when 2 then concat('x', c_mktsegment) else 'OTHER' end as typed,
      case c_custkey % 4 when 0 then 'exact' when 3 then 'new' else 'similar' end as how from customer) group by all having how <> 'new'
    union all select 'OTHER', 'OTHER', 'new', count(*) from customer where c_custkey % 4 = 3""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    typed = (
        F.when(k == 0, F.lower(s)).when(k == 1, F.concat(F.substring(s, 1, 3), F.substr(s, F.lit(5)))).when(k == 2, F.concat(F.lit("x"), s)).otherwise("OTHER")
    )
    rows = c.select(typed.alias("typed"))
    found = L.resolve_names(rows, "typed", c.select("c_mktsegment").distinct(), "c_mktsegment")
    return rows.groupBy(F.col("typed").alias("name")).agg(F.count(F.lit(1)).alias("n")).join(found, "name").select("name", "resolved", "how", "n")


# ------------------------------------------------------------------ duplicates


def doubled_orders(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordem"), F.lit("pedido").alias("tipo"), F.col("o_custkey").alias("cliente"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dia"),
        F.col("o_orderpriority").alias("prioridade"), F.col("o_totalprice").cast("string").alias("valor"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
    )
    copies = o.where("ordem % 5 = 0").withColumns({"ordem": F.col("ordem") + 10**9, "prioridade": F.when(F.col("ordem") % 10 != 0, F.col("prioridade"))})
    return o.unionByName(copies)


@query(
    "lnk_duplicates", "LNK-04 LNK-06",
    """select o_orderkey + 1000000000 as ordem, o_orderkey as duplicate_of from orders where o_orderkey % 5 = 0""",
)
def _(spark, d):
    rows = doubled_orders(spark, d)
    score = U.completeness(["dia", "prioridade", "valor"])
    return U.find_duplicates(rows, "ordem", score, ["tipo", "cliente"], ["dia", "prioridade", "valor"], "lat", "lng")


@query(
    "lnk_duplicate_groups", "LNK-05",
    """select o_orderkey as "primary", 2::bigint as copies, true as cross_folder from orders where o_orderkey % 5 = 0""",
)
def _(spark, d):
    rows = doubled_orders(spark, d).withColumn("pasta", F.when(F.col("ordem") >= 10**9, "b").otherwise("a"))
    dup = U.find_duplicates(rows, "ordem", U.completeness(["dia", "prioridade", "valor"]), ["tipo", "cliente"], ["dia", "prioridade", "valor"], "lat", "lng")
    return U.duplicate_groups(dup, rows, "ordem", "pasta")


@query("lnk_record_duplicates", "LNK-04")
def _(spark, d):
    """Survey records with positions, empty attributes and large groups; whole table."""
    r = survey_records(spark, d).where("type in ('captura', 'visita')").withColumn("ordem", F.substr(F.col("rid"), F.lit(2)).cast("bigint"))
    score = U.completeness(["visit_date", "exam_date", "species", "stage", "channel", "environment"])
    return U.find_duplicates(r, "ordem", score, ["type", "locality_key"], ["visit_date", "sex", "stage", "channel", "environment", "species"])


@query("lnk_completeness", "LNK-06", "select (case when doc_id % 11 = 0 then 0 else 1 end + case when doc_id % 9 = 0 then 0 else 1 end + case when doc_id % 3 = 2 then 0 else 1 end) as score, count(*) as n from documents group by 1")
def _(spark, d):
    score = U.completeness(["visit_date", "species", "channel"])
    return survey_records(spark, d).groupBy(score.cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))
