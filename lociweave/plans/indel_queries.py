"""Queries of indel observations from aligned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import indels
from lociweave.sources.tables import table

#: The alignments of made-up reads of 20 bases, chosen by order and line.
CIGARS = ("20M", "8M2I10M", "8M3D12M", "4S16M", "6M1I5M2D8M", "10M1D1I9M")
MIN_QUAL = 6


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """A read for every line item, which starts at its part: fragment, line, chrom, pos, cigar, seq, qual, mapq."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    pick = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(CIGARS))).cast("int")
    # merged by part, narrow line items come out in an order in which the next shuffle packs them well; never broadcast, so that cost grows with the input
    return line.join(part.hint("merge"), line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("fragment"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("chrom"),
        (F.col("l_partkey") + 1).alias("pos"), F.get(F.array(*[F.lit(c) for c in CIGARS]), pick).alias("cigar"),
        F.substring(F.lit("ACGT" * 6), (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int"), F.lit(20)).alias("seq"),
        F.substring(F.lit("5?II+FI-" * 4), (F.pmod("l_partkey", F.lit(8)) + 1).cast("int"), F.lit(20)).alias("qual"),
        (60 - F.rint(F.col("l_discount") * 100)).cast("int").alias("mapq"),
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """A SNP, an insertion of one or two bases or a deletion of one to three for every part."""
    key = F.col("p_partkey")

    def bases(shift, n):
        return F.substring(F.lit("ACGT" * 3), (F.pmod(key + shift, F.lit(4)) + 1).cast("int"), n)

    kind = F.pmod(key, F.lit(3))
    third = F.floor(key / 3)
    added = F.concat(bases(0, F.lit(1)), bases(third, (1 + F.pmod(third, F.lit(2))).cast("int")))
    lost = bases(0, (2 + F.pmod(third, F.lit(3))).cast("int"))
    return table(spark, folder, "part").select(
        F.col("p_type").alias("chrom"), (key + 1).alias("pos"),
        F.when(kind == 2, lost).otherwise(bases(0, F.lit(1))).alias("ref"),
        F.when(kind == 0, bases(1, F.lit(1))).when(kind == 1, added).otherwise(bases(0, F.lit(1))).alias("alt"),
    )


def _observed(spark, folder):
    return indels.observations(alignments(spark, folder), targets(spark, folder), MIN_QUAL)


def q_indel_observations(spark, folder):
    """What every read says about every SNP, insertion and deletion that it reaches."""
    return _observed(spark, folder)


def q_indel_evidence(spark, folder):
    """Counts of reference, alternative and other observations of each site."""
    n = [F.count_if(F.col("code") == c).alias(name) for c, name in enumerate(("n_ref", "n_alt", "n_other"))]
    return _observed(spark, folder).groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("depth"), *n, F.sum("qual").alias("sum_qual"))


QUERIES = {f.__name__: f for f in (q_indel_observations, q_indel_evidence)}

#: The operations of each alignment with the reference and read bases before them.
_OPERATIONS = """(values (0,'M',20,0,0), (1,'M',8,0,0), (1,'I',2,8,8), (1,'M',10,8,10), (2,'M',8,0,0), (2,'D',3,8,8), (2,'M',12,11,8),
  (3,'M',16,0,4), (4,'M',6,0,0), (4,'I',1,6,6), (4,'M',5,6,7), (4,'D',2,11,12), (4,'M',8,13,12), (5,'M',10,0,0), (5,'D',1,10,10),
  (5,'I',1,11,10), (5,'M',9,11,11)) as o(cigar, op, n, r, q)"""
_OBSERVED = f"""with a as (
  select row_number() over () as id, l_orderkey as fragment, l_linenumber as line, p_type as chrom, l_partkey + 1 as start, (l_orderkey + l_linenumber) % 6 as cigar,
         substr(repeat('ACGT', 6), (l_orderkey % 4 + 1)::int, 20) as seq, substr(repeat('5?II+FI-', 4), (l_partkey % 8 + 1)::int, 20) as qual,
         (60 - round_even(l_discount * 100, 0))::int as mapq from lineitem join part on l_partkey = p_partkey),
t as (
  select p_type as chrom, p_partkey + 1 as pos, p_partkey % 3 as kind,
         case when p_partkey % 3 = 2 then substr('ACGTACGTACGT', (p_partkey % 4 + 1)::int, (2 + p_partkey // 3 % 3)::int)
              else substr('ACGT', (p_partkey % 4 + 1)::int, 1) end as ref,
         case p_partkey % 3 when 0 then substr('ACGT', ((p_partkey + 1) % 4 + 1)::int, 1)
              when 1 then substr('ACGT', (p_partkey % 4 + 1)::int, 1) || substr('ACGTACGTACGT', ((p_partkey + p_partkey // 3) % 4 + 1)::int, (1 + p_partkey // 3 % 2)::int)
              else substr('ACGT', (p_partkey % 4 + 1)::int, 1) end as alt from part),
ops as (select * from {_OPERATIONS}),
spans as (select cigar, sum(case when op in ('M', 'D') then n else 0 end) as span from ops group by 1),
aligned as (select cigar, r + k as r, q + k as q from ops, unnest(range(n)) as u(k) where op = 'M'),
pairs as (
  select a.*, t.pos, t.ref, t.alt, t.kind, t.pos - a.start as off, span
  from a join spans using (cigar) join t on a.chrom = t.chrom and t.pos between a.start - 5 and a.start + 25),
snps as (
  select id, fragment, line, chrom, pos, ref, alt, mapq, case substr(seq, (q + 1)::int, 1) when ref then 0 when alt then 1 else 2 end as code,
         ascii(substr(qual, (q + 1)::int, 1)) - 33 as b
  from pairs p join aligned x on p.cigar = x.cigar and p.off = x.r where kind = 0),
events as (
  select id, fragment, line, chrom, pos, ref, alt, mapq,
         case when op = 'I' and substr(seq, (q + 1)::int, n) = substr(alt, 2) or op = 'D' and n = length(ref) - 1 then 1 else 2 end as code,
         list_min(list_transform(range(q, q + case op when 'I' then n + 1 else 2 end), lambda i: ascii(substr(qual, i::int, 1)))) - 33 as b
  from pairs p join ops o on p.cigar = o.cigar and p.off + 1 = o.r and (kind = 1 and op = 'I' or kind = 2 and op = 'D')),
refs as (
  select id, fragment, line, chrom, pos, ref, alt, mapq, 0 as code, min(ascii(substr(qual, (q + 1)::int, 1))) - 33 as b
  from pairs p join aligned x on p.cigar = x.cigar and x.r between p.off and p.off + case kind when 1 then 1 else length(ref) - 1 end
  where kind > 0 and off between 0 and span - 1
  group by all having count(*) = any_value(case kind when 1 then 2 else length(ref) end)),
observed as (
  select * from snps union all select * from events
  union all select * from refs anti join events using (id, chrom, pos, ref, alt)),
kept as (
  select fragment, line, chrom, pos, ref, alt, code::int as code, least(b, mapq)::int as qual from observed where least(b, mapq) >= {MIN_QUAL})
"""

ORACLE_SQL = {
    "q_indel_observations": _OBSERVED + "select * from kept",
    "q_indel_evidence": _OBSERVED + """select chrom, pos, ref, alt, count(*) as depth, count(*) filter (where code = 0) as n_ref,
  count(*) filter (where code = 1) as n_alt, count(*) filter (where code = 2) as n_other, sum(qual)::bigint as sum_qual from kept group by all""",
}
