"""Query and SQL twin of exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.topk import quantised, top_k
from lociweave.sources.tables import table

K = 20


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("id % 20 = 0"), K)


QUERIES = {"op1_exact_topk": op1_exact_topk}
ORACLE_SQL = {
    "op1_exact_topk": f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
pairs as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from pairs)
where rank <= {K}"""
}
