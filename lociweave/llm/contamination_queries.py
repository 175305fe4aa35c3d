"""Query and SQL twin of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.contamination import WIDTH, contaminated
from lociweave.sources.tables import table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and which items these are."""
    out = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLE_SQL = {
    "op11_decontamination": f"""
with d as materialized (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}'), []) as w from documents),
b as materialized (
  select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') as w from benchmark where text is not null),
wanted as materialized (
  select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as x
  from (select item_id, w, least({WIDTH}, len(w)) as k, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) as s from b where len(w) > 0)),
lengths as (select distinct k from wanted),
runs as (
  select doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') as x
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, lengths where len(w) >= k)),
hits as materialized (select doc_id, s, r.k, item_id from runs r join wanted v on r.k = v.k and r.x = v.x),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from (select distinct doc_id, s, k from hits)) group by 1),
named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join named using (doc_id)"""
}
