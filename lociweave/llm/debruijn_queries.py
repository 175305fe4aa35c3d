"""Query and SQL twin of substring deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.debruijn import SPAN, deduplicated
from lociweave.sources.tables import table


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Removes every repeated passage of 20 words or more from all documents but the first that has it."""
    return deduplicated(table(spark, folder, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE_SQL = {
    "op6_substring_dedup": rf"""
with words as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as materialized (
  select doc_id, i, md5(array_to_string(w[i:i + {SPAN - 1}], ' ')) as s
  from (select doc_id, w, unnest(range(1, len(w) - {SPAN} + 2)) as i from words where len(w) >= {SPAN})),
later as materialized (
  select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from windows) where k > 1),
gone as materialized (select distinct doc_id, p from (select doc_id, unnest(range(i, i + {SPAN})) as p from later)),
places as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from places anti join gone using (doc_id, p) group by 1),
lost as (select doc_id, count(*) as n from gone group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id) left join lost using (doc_id)
"""
}
