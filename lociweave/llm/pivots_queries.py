"""Query and SQL twin of embedding near-deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.pivots import near_duplicates
from lociweave.sources.tables import table


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all vectors, whatever their labels."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_duplicates(rows)


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLE_SQL = {
    "op3_embedding_near_dedup": """
with recursive v as materialized (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as materialized (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, seen) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.y from reach r join links l on l.x = r.seen),
roots as (select vec_id, min(seen) as component_id from reach group by 1),
degree as (select x, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from roots left join degree on x = vec_id
"""
}
