"""Query and SQL twin of mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.mixing import GAIN, KEEP_SHARE, MARGINS, MOST_ROUNDS, NONE, OTHER_TOPIC, PATIENCE, POWERS, TOLERANCE, TOPICS, WORD, mixed
from lociweave.sources.tables import table


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Keep probabilities and decisions of all documents at the production parameters."""
    return mixed(table(spark, folder, "documents"))


def _sql() -> str:
    """The same rounds in DuckDB, one step after the other, with the same end."""
    whens = " ".join(
        "when " + " or ".join(f"coalesce(contains(text, '{mark}'), false)" for mark in marks) + f" then '{name}'" for name, marks in TOPICS
    )
    aims = ",\n".join(
        f"""aim_{m} as materialized (
  select {m}, {KEEP_SHARE}::double * sum(own) over () * weight / sum(weight) over () as target_{m}
  from (select {m}, own, case when own > 0 then pow(own::double, {POWERS[m]}) else 0.0 end as weight
        from (select {m}, sum(tokens)::bigint as own from cells group by 1)))"""
        for m in MARGINS
    )
    names = "source, lang, topic, tokens, " + ", ".join(f"target_{m}" for m in MARGINS)
    going = f"""n < {MOST_ROUNDS} and (n = 0 or not (lowest[n] <= {TOLERANCE!r} or n > {PATIENCE} and lowest[n] > lowest[n - {PATIENCE}] - {GAIN!r}))"""
    step = f"(select {names}, p, n, lowest from rounds where {going})"
    for m in MARGINS:
        step = f"""(select {names}, n, lowest, least(1.0::double, p * case when expected > 0 then target_{m} / expected else 1.0 end) as p
  from (select *, sum(tokens * p) over (partition by {m}) as expected from {step}))"""
    missed = " + ".join(f"abs(target_{m} - sum(tokens * p) over (partition by {m})) / count(*) over (partition by {m})" for m in MARGINS)
    return f"""with recursive rows_in as materialized (
  select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
         case {whens} else '{OTHER_TOPIC}' end as topic,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as n_tokens
  from documents),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from rows_in group by all),
{aims},
rounds as (
  select {names}, {KEEP_SHARE}::double as p, 9.0::double as residual, 0 as n, []::double[] as lowest
  from cells join aim_source using (source) join aim_lang using (lang) join aim_topic using (topic)
  union all
  select {names}, p, residual, n + 1, list_append(lowest, least(residual, coalesce(lowest[n], residual))) from (
    select *, round(sum(missed) over () / sum(tokens) over (), 9) as residual from (select *, {missed} as missed from {step}))),
last as (select * from rounds where n = (select n from rounds order by residual, n limit 1))
select doc_id, source, lang, topic, n_tokens, round(p, 9) as probability,
       ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double < round(p, 9) as kept
from rows_in join last using (source, lang, topic)"""


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL = {"op9_mixing": _sql()}
