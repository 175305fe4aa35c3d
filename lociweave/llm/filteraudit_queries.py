"""Query and SQL twin of the filter interaction audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.filteraudit import filter_audit
from lociweave.sources.tables import table


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All orders of five filters, step by step, over all documents."""
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
#: Applies every order to every document, one step after the other.
ORACLE_SQL = {
    "op13_filter_audit": r"""
with w as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
m as (
  select doc_id, part, case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when min(doc_id) over (partition by text) < doc_id then 'E' else '' end as failed
  from w),
mark as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
d as materialized (select part, failed, coalesce(good, false) as good, coalesce(toxic, false) as toxic from m left join mark using (doc_id)),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as materialized (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as materialized (select filter_order, step, filter_order[step] as f, filter_order[1:step - 1] as before from (select filter_order, unnest(range(1, 6)) as step from orders)),
seen as (
  select part, filter_order, step, f, contains(failed, f) as fails, list_has_any(string_split(before, ''), string_split(failed, '')) and before <> '' and failed <> '' as gone,
         failed = f as only_this, good, toxic from d, steps),
counted as (
  select part, filter_order, step::integer as step, f, count(*) filter (not gone and not fails) as kept, count(*) filter (not gone and fails) as removed,
         count(*) filter (gone and fails) as redundant, count(*) filter (only_this) as unique_fails,
         count(*) filter (not gone and fails and good) as good_lost, count(*) filter (not gone and fails and toxic) as toxic_lost
  from seen group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from counted"""
}
