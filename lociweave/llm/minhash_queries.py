"""Query and SQL twin of MinHash near-deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.minhash import near_duplicates
from lociweave.sources.tables import table


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLE_SQL = {
    "op4_minhash_near_dedup": r"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, case when len(w) > 0 then 1 else 0 end) + 1)) as i from words)),
sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
common as materialized (
  select a.doc_id as x, b.doc_id as y, count(*) as n_shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by all),
links as materialized (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * n_shared >= 75 * (p.n + q.n - n_shared)),
sides as materialized (select x as a, y as b from links union all select y, x from links),
reach(doc_id, seen) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, s.b from reach r join sides s on s.a = r.seen where s.b < r.doc_id or s.b > r.doc_id),
roots as (select doc_id, min(seen) as component_id from reach group by 1)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d join roots r using (doc_id) left join sizes s using (doc_id)
"""
}
