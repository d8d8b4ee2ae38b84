"""Round trips: tables written by the sinks and read back by the sources, in the shared folder."""

from pyspark.sql import functions as F

from catalog.base import RECORDS_SQL, query, survey_records, table
from catalog.maps import squares
from tablelens.functions.geometry import centroid
from tablelens.functions.values import parse_number
from tablelens.plans import survey_import as I
from tablelens.session import scratch_path
from tablelens.sources import files as S
from tablelens.sources import geo_files as G
from tablelens.sources import sinks as K


@query("src_roundtrip_csv", "SRC-01 SRC-02 SRC-03 SNK-01", "select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, round(c_acctbal, 2)::double as balance from customer")
def _(spark, d):
    path = scratch_path(spark, "csv")
    K.write_csv(table(spark, d, "customer"), path)
    back = S.read_delimited(spark, path)
    return back.select("c_custkey", "c_name", "c_mktsegment", F.round(parse_number("c_acctbal"), 2).alias("balance"))


@query("src_csv_headers", "SRC-01 SRC-11", """select c_custkey::varchar as chave, c_name as nome, case when c_custkey % 2 = 0 then c_mktsegment end as segmento, case when c_custkey % 2 = 1 then c_nationkey::varchar end as pais from customer""")
def _(spark, d):
    """Two headers in one folder: columns in another order, and each with one of its own."""
    path = scratch_path(spark, "headers")
    c = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "chave", "c_name": "nome", "c_mktsegment": "segmento", "c_nationkey": "pais"})
    K.write_csv(c.where("chave % 2 = 0").select("chave", "nome", "segmento"), f"{path}/a")
    K.write_csv(c.where("chave % 2 = 1").select("nome", "pais", "chave"), f"{path}/b c")
    return S.read_delimited(spark, [f"{path}/a", f"{path}/b c"]).select("chave", "nome", "segmento", "pais")


@query("src_documents_csv", "SRC-01 SNK-01", "select doc_id::varchar as doc_id, md5(trim(text, ' \t\n\r')) as digest from documents")
def _(spark, d):
    """Whole texts with line breaks, quotes and separators inside cells."""
    path = scratch_path(spark, "csv")
    K.write_csv(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    back = S.read_delimited(spark, path, separator=";")
    return back.select("doc_id", F.md5(F.regexp_replace("text", "^'(?=[=+@-])", "")).alias("digest"))


@query("src_delimiter", "SRC-02", "select ';' as separator, 'UTF-8' as encoding, count(*) > 0 as any from customer")
def _(spark, d):
    path = scratch_path(spark, "csv")
    K.write_csv(table(spark, d, "customer"), path)
    seps = S.separators(spark, path).join(S.text_encodings(spark, path), "file")
    return seps.groupBy("separator", "encoding").agg((F.count(F.lit(1)) > 0).alias("any"))


@query("src_encoding", "SRC-03", "select doc_id::varchar as doc_id, lang from documents")
def _(spark, d):
    path = scratch_path(spark, "latin")
    rows = table(spark, d, "documents").select("doc_id", F.lit("ação é çã").alias("acento"), "lang")
    rows.write.option("header", True).option("sep", ";").option("encoding", "windows-1252").csv(path)
    back = S.read_delimited(spark, path)
    return back.where("acento = 'ação é çã'").select("doc_id", "lang")


@query("src_roundtrip_json", "SRC-04", "select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders")
def _(spark, d):
    path = scratch_path(spark, "json")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    back = S.read_json_tables(spark, path, lines=True)["data"]
    return back.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("src_json_lists", "SRC-04", "select 'customers' as list, count(*) as n, sum(c_custkey)::bigint as keys from customer union all select 'orders', count(*), sum(o_orderkey)::bigint from orders")
def _(spark, d):
    """An object of two lists per fifty customers, each object a file; the lists of all files are one table each."""
    path = scratch_path(spark, "lists")
    group = lambda key: F.floor(F.col(key) / 50).alias("g")
    customers = table(spark, d, "customer").groupBy(group("c_custkey")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))).alias("customers"))
    orders = table(spark, d, "orders").groupBy(group("o_custkey")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("orders"))
    customers.join(orders, "g", "full").repartition("g").write.partitionBy("g").json(path)
    found = S.read_json_tables(spark, path)
    count = lambda n: found[n].agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("bigint")).alias("keys")).select(F.lit(n).alias("list"), "n", "keys")
    return count("customers").unionByName(count("orders"))


@query("src_roundtrip_geojson", "SRC-05 SNK-05 GEO-01", "with " + "sq as (select s_suppkey as id, (s_suppkey * 37 % 340) - 170.0 as x, (s_suppkey * 17 % 150) - 75.0 as y, 0.5 + s_nationkey as w from supplier) select id, round(x + w / 2, 6) as lon, round(y + w / 2, 6) as lat from sq")
def _(spark, d):
    path = scratch_path(spark, "geojson")
    K.write_geojson(squares(spark, d).select("id", "geometry"), path, geometry="geometry")
    c = centroid("geometry")
    return G.read_geojson(spark, path, one_per_line=True).select("id", F.round(c[0], 6).alias("lon"), F.round(c[1], 6).alias("lat"))


@query("src_geojson_collections", "SRC-05", """with sq as (select s_suppkey as id, s_nationkey as nation, (s_suppkey * 37 % 340) - 170.0 as x, (s_suppkey * 17 % 150) - 75.0 as y, 0.5 + s_nationkey as w from supplier)
    select id, nation, row_number() over (partition by nation order by id) as position, 'a}"],{' || s_name as name, round(x + w / 2, 6) as lon, round(y + w / 2, 6) as lat from sq join supplier on s_suppkey = id""")
def _(spark, d):
    """One whole collection per nation, its features in the order of their suppliers, in a single line."""
    from tablelens.functions.geometry import to_geojson

    named = squares(spark, d).select("id", "geometry").join(table(spark, d, "supplier"), F.col("id") == F.col("s_suppkey"))
    properties = F.to_json(F.struct("id", F.col("s_nationkey").alias("nation"), F.concat(F.lit('a}"],{'), "s_name").alias("name")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), to_geojson("geometry"), F.lit("}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))), lambda x: x["f"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    path = scratch_path(spark, "collections")
    named.groupBy("s_nationkey").agg(text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    c = centroid("geometry")
    return G.read_geojson(spark, f"{path}/*/*.txt").select(F.col("id").cast("bigint").alias("id"), F.col("nation").cast("bigint").alias("nation"), "position", "name", F.round(c[0], 6).alias("lon"), F.round(c[1], 6).alias("lat"))


@query("snk_geojson_points", "SNK-05", "select count(*) as n from orders where o_orderkey % 100 <> 0 and abs((o_custkey * 7 % 3600) / 10.0 - 180.03) <= 180 and abs((o_orderkey * 13 % 1900) / 10.0 - 95.02) <= 90")
def _(spark, d):
    from catalog.maps import positions

    return K.geojson_lines(positions(spark, d), lon="lon", lat="lat").agg(F.count(F.lit(1)).alias("n"))


_RECORD_SHAPES = """with rec as (select doc_id % 10 as t, -40.0 - (n_chars % 50) / 100.0 as x, -4.0 - (doc_id % 50) / 100.0 as y from documents) """


@query("src_roundtrip_kml", "SRC-06 SNK-06", _RECORD_SHAPES + """
    select case t when 0 then 'localidade' when 1 then 'visita' when 2 then 'pit' else 'captura' end as type, count(*) as n,
      round(sum(case when t = 0 then x + 0.5 else x end), 4) as lon, round(sum(case when t = 0 then y + 0.5 else y end), 4) as lat from rec group by 1""")
def _(spark, d):
    """Points and areas, the areas of two squares each, written and read back with their places."""
    from tablelens.functions.survey_fields import folder_type

    c = centroid("geometry")
    back = _written_marks(spark, d).select(folder_type("folder_path").alias("type"), c[0].alias("lon"), c[1].alias("lat"))
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lon"), 4).alias("lon"), F.round(F.sum("lat"), 4).alias("lat"))


def _areas(records):
    """Every locality as two unit squares that meet in a corner; the middle of both is half a degree off the record."""
    corner = lambda a, b: F.array(F.col("lng") + a, F.col("lat") + b)
    square = lambda o: F.array(F.array(corner(o, o), corner(o + 1.0, o), corner(o + 1.0, o + 1.0), corner(o, o + 1.0), corner(o, o)))
    shapes = F.struct(F.array(square(-0.5), square(0.5)).alias("polys"))
    return records.withColumn("geometry", F.when(F.col("type") == "localidade", shapes))


def _written_marks(spark, d, **options):
    path = scratch_path(spark, "kml")
    marks = G.read_kml(spark, K.write_kml(_areas(survey_records(spark, d)), path), **options)
    return marks.withColumn("folder_path", F.array(F.regexp_replace(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), "%20", " ")))


@query("src_kml_deep", "SRC-06", "select c_name as nome, concat_ws('/', 'p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7', 'grupo ' || (c_custkey // 50)) as pasta, 3 as pontos from customer")
def _(spark, d):
    """Placemarks eight folders down with collections inside each other, one file per fifty customers."""
    point = lambda k: f"<Point><coordinates>{k},{k}</coordinates></Point>"
    shape = "<MultiGeometry>" + point(1) + "<MultiGeometry>" + point(2) + "<MultiGeometry><MultiGeometry>" + point(3) + "</MultiGeometry></MultiGeometry></MultiGeometry></MultiGeometry>"
    opened = "".join(f"<Folder><name>p{i}</name>" for i in range(1, 8))
    mark = F.concat(F.lit("<Placemark><name>"), "c_name", F.lit(f"</name>{shape}</Placemark>"))
    groups = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("g")).agg(F.array_join(F.collect_list(mark), "").alias("marks"))
    text = F.concat(
        F.lit(f"<kml><Document>{opened}<Folder><name>grupo "), F.col("g").cast("string"), F.lit("</name>"), "marks", F.lit("</Folder>" + "</Folder>" * 7 + "</Document></kml>"),
    )
    path = scratch_path(spark, "deep")
    groups.select("g", text.alias("value")).repartition("g").write.partitionBy("g").text(path)
    marks = G.read_kml(spark, f"{path}/*/*.txt")
    return marks.select(F.col("name").alias("nome"), F.concat_ws("/", "folder_path").alias("pasta"), F.size("geometry.points").alias("pontos"))


_IMPORTED = RECORDS_SQL + """, f as (select type as item, 'type' as section from rec
    union all select case when type = 'localidade' then 'Polygon' else 'Point' end, 'geometry' from rec
    union all select 'data_visita', 'field_seen' from rec where type in ('captura', 'visita') and visit_date is not null
    union all select 'data_exame', 'field_seen' from rec where type = 'captura' and exam_date is not null
    union all select 'canal', 'field_seen' from rec where type = 'captura' and channel is not null
    union all select 'ambiente', 'field_seen' from rec where type = 'captura' and environment is not null
    union all select 'fase_sexo', 'field_seen' from rec where type = 'captura' and (stage ilike '%ninfa%' or sex is not null)
    union all select 'resultado_exame', 'field_seen' from rec where type = 'captura' and exam_result <> 'nao_informado'
    union all select 'quantidade', 'field_seen' from rec where type = 'captura' and triatomine_count is not null
    union all select 'resultado_busca', 'field_seen' from rec where type = 'visita' and search_result <> 'nao_informado'
    union all select 'localidade', 'field_seen' from rec where type <> 'localidade' and locality_raw is not null
    union all select 'pit', 'field_seen' from rec where type = 'pit' and pit_ref is not null
    union all select 'info:multiplas_geometrias', 'issue' from rec where type = 'localidade'
    union all select 'aviso:localidade_nao_reconhecida', 'issue' from rec where type <> 'localidade' and locality_raw is not null
    union all select 'aviso:exame_antes_da_captura', 'issue' from rec where type = 'captura' and exam_date < visit_date) """

#: What depends on places and likeness, which SQL does not compute here.
_GUESSED = ("localities", "aviso:possivel_duplicata", "info:localidade_por_geometria")


@query("rec_import", "LNK-07 LNK-09 LNK-10", _IMPORTED + "select section, item, count(*) as n from f group by all")
def _(spark, d):
    """Every document as a placemark: written as KML, read back, normalised, and counted."""
    return I.import_report(I.normalise(_marks(spark, d))).where(~F.col("item").isin(*_GUESSED))


@query("rec_import_guesses", "LNK-07 LNK-08")
def _(spark, d):
    """Localities, records placed by an area around them, and suspected copies of the same import."""
    return I.import_report(I.normalise(_marks(spark, d))).where(F.col("item").isin(*_GUESSED))


@query(
    "rec_pending", "LNK-11 LNK-09",
    RECORDS_SQL + """, p as (select 'without_exam_result' as problem from cap where exam_result = 'nao_informado' union all select 'without_species' from cap
    union all select 'without_capture_date' from cap where visit_date is null union all select 'exam_before_capture' from cap where exam_date < visit_date
    union all select 'unknown_locality' from rec where type <> 'localidade' and locality_raw is not null) select problem, count(*) as n from p group by 1""",
)
def _(spark, d):
    return I.pending_checks(I.normalise(_marks(spark, d))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _marks(spark, d):
    return _written_marks(spark, d, lenient=True)


@query("src_parquet", "SRC-07", "select vec_id, embedding is not null as has_vector, label from embeddings")
def _(spark, d):
    back = S.read_parquet(spark, f"{d}/embeddings.parquet")
    return back.select("vec_id", F.col("embedding").startswith("[").alias("has_vector"), "label")


@query("src_clean_cells", "SRC-08 SRC-09", "select page_id as \"Coluna 1\", case when page_id % 3 = 0 then null else url end as url, case when page_id % 3 = 0 then null else url end as \"url (2)\" from pages")
def _(spark, d):
    p = table(spark, d, "pages")
    dirty = F.when(F.col("page_id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "url", F.lit("\t")))
    rows = p.select("page_id", dirty.alias("a"), dirty.alias("b"))
    return S.clean_cells(rows.toDF(*S.unique_names(["", "url", " url "])))


@query("src_read_stats", "SRC-10", "select count(*) as rows_read, count(*) filter (where doc_id % 5 = 0) as blank_rows, greatest(0, count(*) - count(*) filter (where doc_id % 5 = 0) - 100) as past_limit from documents")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("a"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("b"))
    return S.read_stats(rows, kept=100)


@query("src_many_files", "SRC-11", "select 'nation' as \"table\", 'nation.csv' as file, count(*) as rows, 3 as columns from nation union all select 'nation (2)', 'nation.json', count(*), 3 from nation union all select 'dados › region', 'dados.xlsx', count(*), 2 from region union all select 'dados › part', 'dados.xlsx', count(*), 6 from part")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    return S.merge_sources({"nation.csv": {"x": t("nation")}, "nation.json": {"x": t("nation")}, "dados.xlsx": {"region": t("region"), "part": t("part")}})[1]


@query("src_stacked", "SRC-11", "select count(*) as n, count(o_orderstatus) as o, count(c_name) as c from (select c_name, null as o_orderstatus from customer union all select null, o_orderstatus from orders)")
def _(spark, d):
    stacked = S.stack_files([table(spark, d, "customer"), table(spark, d, "orders")])
    return stacked.agg(F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("o"), F.count("c_name").alias("c"))


@query("src_file_facts", "SRC-12", """with t as (select c_custkey // 50 as g, string_agg(c_name, chr(10) order by c_custkey) || chr(10) as text from customer group by 1)
    select g, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from t""")
def _(spark, d):
    """One text file per fifty customers, in a folder of its number."""
    path = scratch_path(spark, "facts")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda c: c["c_name"])
    texts = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("g")).agg(F.array_join(lines, "\n").alias("value"))
    texts.repartition("g").write.partitionBy("g").text(path)
    f = S.file_facts(spark, f"{path}/*/*.txt")
    return f.select(F.regexp_extract("file", r"/g=(\d+)/", 1).cast("long").alias("g"), "bytes", "sha256")


@query(
    "snk_csv_safe", "SNK-01",
    """select p_partkey, case p_partkey % 4 when 0 then '''=1+1' when 1 then '-5,25' when 2 then '''-soma' else p_name end as a, (-p_size)::varchar as b from part""",
)
def _(spark, d):
    k = F.col("p_partkey") % 4
    a = F.when(k == 0, "=1+1").when(k == 1, "-5,25").when(k == 2, "-soma").otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", a.alias("a"), (-F.col("p_size")).alias("b"))
    return K.safe_cells(rows).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "a", "b")


@query("snk_csv_strict", "SNK-02", "select p_partkey::varchar as p_partkey, concat('''-', p_size) as b from part where p_size > 0")
def _(spark, d):
    rows = table(spark, d, "part").where("p_size > 0").select("p_partkey", (-F.col("p_size")).alias("b"))
    return K.safe_cells(rows, strict=True)
