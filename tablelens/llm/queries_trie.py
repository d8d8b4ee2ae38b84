"""The query that builds the trie of rebuilt ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import read_table
from tablelens.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt
from tablelens.llm.registry import query

# CRC-32 of the decimal number, byte by byte and bit by bit
_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: {_BITS}))"


@query("op12_prefix_trie", f"""
with t as (select conv_id, turn, coalesce(text, '') as x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id
    from conversations where conv_id is not null),
  own as (select conv_id, list(id order by turn nulls first, id) as ids, list(length(x) order by turn nulls first, id) as points, {_CRC} % 6 as h from t group by conv_id),
  r as (select o.conv_id, list_concat(coalesce(b.ids[1 : o.h], []), o.ids[o.h + 1 :]) as ids, list_concat(coalesce(b.points[1 : o.h], []), o.points[o.h + 1 :]) as points
    from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
  m as (select conv_id, ids, points, unnest(range(0, len(ids) + 1)) as depth from r),
  n as (select array_to_string(ids[1 : depth], '') as path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(coalesce(points[depth], 0)) as points,
      coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(ids) = depth), '') as ends from m group by 1, 2),
  k as (select left(path, 64 * (depth - 1)::bigint) as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
  f as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (path, depth)),
  a as (select f.*, unnest(range(0, depth + 1)) as up from f),
  s as (select left(path, 64 * up::bigint) as path, up as depth, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * points)::bigint as saved_tokens from a group by 1, 2)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) as ends_sha256
from f join s using (path, depth) left join f p on p.depth = f.depth - 1 and p.path = left(f.path, 64 * (f.depth - 1)::bigint)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(ordered_turns(read_table(spark, sf_dir, "conversations"))))
