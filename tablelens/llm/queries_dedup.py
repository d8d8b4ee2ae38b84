"""Queries over ``documents`` that find repeats: substring, SimHash and exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import read_table
from tablelens.llm.exact_dedup import exact_dedup
from tablelens.llm.registry import query
from tablelens.llm.simhash import near_duplicates
from tablelens.llm.substring_dedup import substring_dedup


@query("op1_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
  starts as (select doc_id, words, unnest(range(1, greatest(len(words) - 12, 0) + 1)) as p from w),
  win as (select doc_id, p, array_to_string(words[p : p + 12], ' ') as t from starts),
  firsts as (select t, min(doc_id) as lead from win group by t),
  gone as (select distinct doc_id, p + k as spot from win join firsts using (t), (select unnest(range(0, 13)) as k) where doc_id > lead),
  cut as (select doc_id, list(spot) as spots from gone group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(len(spots), 0) as n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: not list_contains(coalesce(spots, []), i)), ' '), '')) as kept_sha256
from w left join cut on w.doc_id = cut.doc_id
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_exact_dedup", r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
