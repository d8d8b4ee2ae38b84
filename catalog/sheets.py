"""Form sheets: cell tables made of yearly summaries of the orders, one sheet per order status."""

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from tablelens.operators import grids as G
from tablelens.session import cut_lineage, scratch_path
from tablelens.sources.files import read_cells

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_CELLS = """with v as (select o_orderstatus as sheet_id, year(o_orderdate) as ano, o_orderpriority as p, count(*) as n from orders group by all) """


def summary_cells(spark, d):
    """One sheet per status; one block per year with priorities as columns and two indicators as rows.

    A year takes 8 rows: its period line, the header, six indicators and a blank row.
    """
    o = table(spark, d, "orders")
    v = o.groupBy(F.col("o_orderstatus").alias("sheet_id"), F.year("o_orderdate").alias("ano"), F.col("o_orderpriority").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("even")
    )
    base = (F.col("ano") - 1995) * 10
    col = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("p")).cast("int")
    labels = ["Feitos Total", "Abertos Total", "Outros Total", "Feitos Par", "Abertos Par", "Outros Par"]
    value = [F.col("n"), F.col("n") * 2, F.col("n") * 3, F.col("even"), F.col("even") * 2, F.col("even") * 3]
    cell = lambda r, c, t: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), t.cast("string").alias("text"))
    hide = (F.col("ano") == 1997) & (F.col("p") == "3-MEDIUM")
    cells = F.array(
        cell(base, F.lit(0), F.lit("Ano")), cell(base, F.lit(1), F.col("ano")), cell(base + 1, F.lit(0), F.lit("Indicador")), cell(base + 1, col, F.concat(F.lit("P "), F.col("p"))),
        cell(base + 1, F.lit(6), F.lit("Vazia")),
        *[cell(base + 2 + i, F.lit(0), F.lit(t)) for i, t in enumerate(labels)],
        *[cell(base + 2 + i, col, F.when(~hide, x)) for i, x in enumerate(value)],
    )
    return v.select("sheet_id", F.inline(cells)).distinct()


@query(
    "grid_repeated", "GRD-04 GRD-05",
    """with v as (select o_orderstatus as sheet_id, year(o_orderdate)::varchar as period, concat('P ', o_orderpriority) as entity, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as e
      from orders group by all)
    select sheet_id, period, entity, ['Feitos', 'Abertos', 'Outros'][1 + i % 3] as situation, case when i < 3 then 'Total' else 'Par' end as subgroup,
      case when period = '1997' and entity = 'P 3-MEDIUM' then null else case when i < 3 then n else e end * (1 + i % 3) end::double as "Total"
    from v, unnest([0, 1, 2, 3, 4, 5]) u(i)""",
)
def _(spark, d):
    return G.repeated_blocks(summary_cells(spark, d)).select("sheet_id", "period", "entity", "situation", "subgroup", "Total")


@query(
    "grid_blocks", "GRD-01 GRD-02",
    """select o_orderstatus as sheet_id, row_number() over (partition by o_orderstatus order by y) as block, (y - 1995) * 10 as first_row, (y - 1995) * 10 + 7 as last_row, (y - 1995) * 10 + 1 as header_row, 'table' as kind
    from (select distinct o_orderstatus, year(o_orderdate) as y from orders)""",
)
def _(spark, d):
    return G.blocks(summary_cells(spark, d)).select("sheet_id", "block", "first_row", "last_row", "header_row", "kind")


@query(
    "grid_values", "GRD-01 GRD-02 SRC-08 SRC-09",
    """with c as (select o_orderstatus as sheet_id, year(o_orderdate) as y, o_orderpriority as p, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as e from orders group by all)
    select sheet_id, dense_rank() over (partition by sheet_id order by y) as block, i as place, concat('P ', p) as name, cast(case when i < 3 then n else e end * (1 + i % 3) as varchar) as text
    from (select *, unnest(range(0, 6))::int as i from c) where not (y = 1997 and p = '3-MEDIUM')""",
)
def _(spark, d):
    values = G.block_values(summary_cells(spark, d)).where(F.col("name").startswith("P "))
    return values.select("sheet_id", "block", F.pmod(F.col("row") - 2, F.lit(10)).alias("place"), "name", "text")


def double_header_cells(spark, d):
    """One sheet per ship mode letter: group line, column line, one row per year."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sheet_id"), F.year("l_shipdate").alias("ano")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q")
    )
    cell = lambda r, c, t: F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), t.cast("string").alias("text"))
    at = F.col("ano") - 1995 + 2
    cells = F.array(
        cell(F.lit(0), 0, F.lit("PERÍODO")), cell(F.lit(0), 1, F.lit("QUANTIDADES")), cell(F.lit(1), 0, F.lit("Ano")), cell(F.lit(1), 1, F.lit("Linhas")), cell(F.lit(1), 2, F.lit("Peças")),
        cell(at, 0, F.col("ano")), cell(at, 1, F.col("n")), cell(at, 2, F.col("q")),
    )
    return v.select("sheet_id", F.inline(cells)).distinct()


@query(
    "grid_double_header", "GRD-03",
    """select l_returnflag as sheet_id, unnest(['Período — Ano', 'Quantidades — Linhas', 'Quantidades — Peças']) as name,
      unnest([sum(y), sum(n), sum(q)])::double as total from (select l_returnflag, year(l_shipdate) as y, count(*) as n, sum(l_quantity) as q from lineitem group by all) group by 1""",
)
def _(spark, d):
    out = G.block_values(double_header_cells(spark, d))
    return out.groupBy("sheet_id", "name").agg(F.sum(F.col("text").cast("double")).alias("total"))


@query(
    "grid_split_labels", "GRD-05",
    """with l as (select distinct p_type as t, p_brand as b from part), c as (select b from l group by 1 having count(*) >= 3), s as (select count(*) >= 2 as ok from c)
    select 's' as sheet_id, concat(t, ' ', b) as label, case when ok then case when b in (select b from c) then t else concat(t, ' ', b) end end as situation,
      case when ok and b in (select b from c) then b end as subgroup from l, s""",
)
def _(spark, d):
    labels = table(spark, d, "part").select(F.lit("s").alias("sheet_id"), F.concat_ws(" ", "p_type", "p_brand").alias("label"))
    return G.split_labels(labels)


@query(
    "grid_align", "GRD-06",
    """select strftime(o_orderdate, '%Y') as "Ano", sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as "F — pedidos", sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as "O — pedidos" from orders group by 1""",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("Ano", F.date_format("o_orderdate", "yyyy"))
    tables = {s: o.where(F.col("o_orderstatus") == s).groupBy("Ano").agg(F.count(F.lit(1)).alias("pedidos")) for s in ("F", "O")}
    tables["outra"] = o.where("Ano < '1999'").groupBy("Ano").agg(F.count(F.lit(1)).alias("x"))
    return G.align_tables(tables, "Ano")[0]


@query(
    "src_csv_blocks", "SRC-01 GRD-01 GRD-02",
    """with b as (select o_orderstatus as sheet, o_orderkey as k, dense_rank() over (partition by o_orderstatus order by year(o_orderdate)) as block,
      count(*) over (partition by o_orderstatus, year(o_orderdate)) as n from orders)
    select sheet, block, unnest(['Pedido', 'Resto', 'Nota']) as name, unnest([k::varchar, (k * 7 % 1000)::varchar, concat('nº "', k, '"; visto')]) as text from b where n >= 2""",
)
def _(spark, d):
    """One CSV file per order status; a year is a block with a title line, a header line and a line per order, and ends with a blank line."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("k"))
    rows = o.select("s", "y", F.lit(2).alias("part"), "k", F.concat_ws(";", "k", F.col("k") * 7 % 1000, F.concat(F.lit('"nº ""'), "k", F.lit('""; visto"'))).alias("value"))
    frame = o.select("s", "y").distinct().select("s", "y", F.lit(0).cast("long").alias("k"), F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("Pedidos de "), "y").alias("value")), F.struct(F.lit(1).alias("part"), F.lit("Pedido;Resto;Nota").alias("value")),
        F.struct(F.lit(3).alias("part"), F.lit("").alias("value")))))
    lines = rows.unionByName(frame).repartition("s").sortWithinPartitions("s", "y", "part", "k")
    path = scratch_path(spark, "csv-blocks")
    lines.select("s", "value").write.partitionBy("s").text(path)
    values = G.block_values(cut_lineage(read_cells(spark, path)))
    return values.select(F.regexp_extract("sheet_id", "/s=([^/]+)/", 1).alias("sheet"), "block", "name", "text")
