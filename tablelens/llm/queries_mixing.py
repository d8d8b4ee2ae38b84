"""The query that mixes the sources of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.mixing import mix_sources
from tablelens.llm.registry import query

# highest quotients counted out one by one: all seats of all sources are listed and ranked
_MIX_SQL = r"""
with d as (select doc_id, coalesce('a' || source, 'n') as k, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || md5('42/' || coalesce(doc_id::varchar, '~'))[1:8])::bigint as h from documents),
  n as (select greatest(1, (count(*) + 511) // 512) as shards from documents),
  r as (select d.*, h % shards as shard from d, n),
  z as (select k, shard, sum(size)::bigint as z, case when sum(size) > 0 then greatest(1, floor(sum(size) / 16.0 + 0.5))::bigint else 0 end as blocks from r group by all),
  s as (select k, sum(z)::bigint as source_size, sum(blocks)::bigint * 3 as most from z group by k),
  w as (select *, [5, 2, 1][((row_number() over (order by k) - 1) % 3 + 1)::int]::bigint as weight from s),
  o as (select *, source_size * 3.0::double / weight as ratio, (sum(source_size) over ())::double as total, (sum(weight) over ())::double as weights from w),
  b as (select *, (total - coalesce(sum(source_size * 3) over (order by ratio, k rows between unbounded preceding and 1 preceding), 0)::double)
      / (weights - coalesce(sum(weight) over (order by ratio, k rows between unbounded preceding and 1 preceding), 0)::double) >= ratio as bound from o),
  t as (select *, case when bound then source_size * 3.0::double else weight::double * ((total - coalesce(sum(source_size * 3) filter (where bound) over (), 0)::double)
      / (weights - coalesce(sum(weight) filter (where bound) over (), 0)::double)) end as target from b),
  seats as (select k, unnest(range(0, most)) as j, target from t),
  ranked as (select k, row_number() over (order by target / (2 * j + 1) desc, k, j) as place from seats),
  q as (select k, count(*) as quota from ranked where place <= (select floor(sum(source_size) / 16.0 + 0.5) from t) group by k),
  zseats as (select k, shard, z, unnest(range(0, blocks * 3)) as j from z),
  zranked as (select k, shard, row_number() over (partition by k order by z::double / (2 * j + 1) desc, shard, j) as place from zseats),
  zq as (select k, shard, count(*) as quota from zranked join q using (k) where place <= q.quota group by k, shard),
  p as (select z.*, coalesce(zq.quota, 0)::bigint as quota from z left join zq on z.k = zq.k and z.shard = zq.shard),
  c as (select *, case when blocks > 0 then quota // blocks else 0 end as copies, case when blocks > 0 then quota % blocks else 0 end as more,
      case when blocks > 0 then ('0x' || md5('42/' || k || '/' || shard)[1:8])::bigint % blocks else 0 end as u from p),
  e as (select *, case when blocks > 0 then u * z // blocks else 0 end as a1, case when blocks > 0 then least(u + more, blocks) * z // blocks else 0 end as b1,
      case when blocks > 0 then greatest(u + more - blocks, 0) * z // blocks else 0 end as b2 from c),
  l as (select *, coalesce(sum(size) over (partition by k, shard order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as s from r)
select doc_id, size, source_size, target, (copies * size + least(greatest(b1 - s, 0), size) - least(greatest(a1 - s, 0), size) + least(greatest(b2 - s, 0), size))::bigint as taken
from l join e on l.k = e.k and l.shard = e.shard join t on l.k = t.k
"""


@query("op2_mix_sources", _MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
