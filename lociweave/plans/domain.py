"""The genotype domain's tables, derived from the test tables by the same rules in Spark and in DuckDB.

positions are parts, samples are nations, fragments are orders, observations are line items, the dosage matrix is the
embeddings, and founders are regions crossed with positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources.tables import table

BASES = "ACGT"


def _base(number):
    return F.substring(F.lit(BASES), (F.pmod(number, F.lit(4)) + 1).cast("int"), F.lit(1))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """chrom, pos, ref, alt, cm of each site."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col("p_type").alias("chrom"),
        (key + 1).alias("pos"),
        _base(key).alias("ref"),
        _base(key + 1).alias("alt"),
        (key * 0.01).alias("cm"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, generation, sex, ploidy-neutral metadata of each sample."""
    key = F.col("n_nationkey").cast("long")
    return table(spark, folder, "nation").select(
        key.alias("sample_id"),
        (10 + key % 5).cast("double").alias("generation"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "F").otherwise("").alias("sex"),
    )


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """One row per observed base: sample_id, fragment, pos, code (0 ref, 1 alt, 2 other), qual, mapq, strand, ord."""
    # what a read needs is narrow before the join, and orders meet their customers first, so line items are shuffled once
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("fragment"),
        (F.col("l_partkey") + 1).alias("pos"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("code"),
        F.col("l_quantity").cast("int").alias("qual"),
        (60 - F.rint(F.col("l_discount") * 100)).cast("int").alias("mapq"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        F.col("l_extendedprice").alias("ord"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("fragment"), "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("sample_id"))
    owners = orders.join(customers, "o_custkey").select("fragment", "sample_id")
    return lines.join(owners, "fragment").select("sample_id", *lines.columns)


def founders(spark: SparkSession, folder: str) -> DataFrame:
    """pos, founder, alt_prob of five founders."""
    regions = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("founder"))
    sites = table(spark, folder, "part").select("p_partkey")
    # the founders of a panel are few by nature: the panel is one small table for each site
    return sites.join(F.broadcast(regions)).select(
        (F.col("p_partkey") + 1).alias("pos"),
        "founder",
        ((F.pmod(F.col("p_partkey") * (F.col("founder") + 3), F.lit(97)) + 1) / 100.0).alias("alt_prob"),
    )


def pedigree(spark: SparkSession, folder: str) -> DataFrame:
    """child, father, mother over the samples: father floor(i / 2), mother one less, for i of 4 and more."""
    key = F.col("n_nationkey").cast("long")
    father = F.floor(key / 2).cast("long")
    return (
        table(spark, folder, "nation")
        .where(key >= 4)
        .select(key.alias("child"), father.alias("father"), (father - 1).alias("mother"))
    )


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Long dosage matrix: id, variant (from 0), dosage 1 + value held in [0, 2], genotype, fam of each vector."""
    return (
        table(spark, folder, "embeddings")
        .select(F.col("vec_id").alias("id"), F.col("label").alias("fam"), F.posexplode("embedding").alias("variant", "x"))
        .select(
            "id",
            "variant",
            F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 + F.col("x").cast("double"))).alias("dosage"),
            "fam",
        )
        .withColumn("genotype", F.rint(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 + 8 * (F.col("dosage") - 1)))).cast("int"))
    )


#: The same tables as DuckDB common table expressions.
SQL = {
    "positions": """positions as (
  select p_type as chrom, p_partkey + 1 as pos, substr('ACGT', (p_partkey % 4 + 1)::int, 1) as ref,
         substr('ACGT', ((p_partkey + 1) % 4 + 1)::int, 1) as alt, p_partkey * 0.01::double as cm from part)""",
    "samples": """samples as (
  select n_nationkey::bigint as sample_id, (10 + n_nationkey % 5)::double as generation,
         case n_nationkey % 3 when 0 then 'male' when 1 then 'F' else '' end as sex from nation)""",
    "reads": """reads as (
  select c_nationkey::bigint as sample_id, l_orderkey as fragment, l_partkey + 1 as pos,
         case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as code, l_quantity::int as qual,
         (60 - round_even(l_discount * 100, 0))::int as mapq, case l_linestatus when 'F' then '+' else '-' end as strand,
         l_extendedprice as ord
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)""",
    "founders": """founders as (
  select p_partkey + 1 as pos, r_regionkey::bigint as founder,
         ((p_partkey * (r_regionkey + 3)) % 97 + 1) / 100.0::double as alt_prob from part, region)""",
    "pedigree": """pedigree as (
  select n_nationkey::bigint as child, (n_nationkey // 2)::bigint as father, (n_nationkey // 2 - 1)::bigint as mother
  from nation where n_nationkey >= 4)""",
    "matrix": """matrix as (
  select id, variant, dosage, fam, round_even(least(2.0::double, greatest(0.0::double, 1 + 8 * (dosage - 1))), 0)::int as genotype from (
    select vec_id as id, i - 1 as variant, label as fam,
           least(2.0::double, greatest(0.0::double, 1 + embedding[i]::double)) as dosage
    from embeddings, unnest(range(1, len(embedding) + 1)) as t(i)))""",
}


def with_tables(names: str, body: str) -> str:
    """`body` (which may start with further expressions, each followed by a comma) after the named tables."""
    return "with " + ",\n".join(SQL[n] for n in names.split()) + ",\n" + body
