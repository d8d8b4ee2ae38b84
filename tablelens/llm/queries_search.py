"""Queries that search: ``documents`` for each item of ``benchmark``, and ``embeddings`` for their nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.lexical_search import lexical_search
from tablelens.llm.registry import query
from tablelens.llm.vantage_tree import nearest_vectors

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_lexical_search", rf"""
with d as (select row_number() over () as place, doc_id, {_TERMS} as ts from documents),
  held as (select place, doc_id, len(ts) as n, ts from d where len(ts) > 0),
  s as (select count(*) as docs, sum(n)::bigint as total from held),
  q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
  tf as (select place, doc_id, n, term, count(*) as tf from (select place, doc_id, n, unnest(ts) as term from held)
    where term in (select term from q) group by place, doc_id, n, term),
  w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, s group by term),
  scored as (select item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score
    from q join tf using (term) join w using (term), s group by item_id, place, doc_id),
  ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op13_nearest_vectors", """
with v as (select vec_id, embedding::double[] as e from embeddings),
  good as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
  pairs as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
    from good q join good c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
  ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"))
