"""Query and SQL twin of hard-negative mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.hardnegatives import HIGH, LOW, NEGATIVES, POSITIVES, hard_negatives
from lociweave.llm.topk import quantised
from lociweave.sources.tables import table


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three hard negatives for each of five positives of every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), quantised(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": f"""
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
pairs as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from pairs where same) where k <= {POSITIVES})
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, positive_id, n.vec_id as negative_id, positive_score, n.score as negative_score,
         (row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id))::integer as rank
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
    and {LOW} * positive_score <= 100 * n.score and 100 * n.score <= {HIGH} * positive_score)
where rank <= {NEGATIVES}"""
}
