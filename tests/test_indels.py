"""Observations at SNPs, insertions and deletions against a walk over one read at a time."""

import random
import re

from lociweave.operators import indels
from lociweave.plans import indel_queries

READS = "read int, chrom string, pos long, cigar string, seq string, qual string, mapq int, ref string"
SITES = "chrom string, pos long, ref string, alt string, extra int"


def spoken(read, sites, min_qual, max_indel):
    """All (read, pos, ref, alt, code, qual) of one read, base by base."""
    name, chrom, pos, cigar, seq, qual, mapq, _ = read
    if cigar is None or seq is None:
        return []
    q = [min(ord(c) - 33, mapq) for c in (qual or "?" * len(seq))]
    at, added, lost = {}, [], []
    ref, i = pos, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            at |= {ref + k: i + k for k in range(n)}
            ref, i = ref + n, i + n
        elif op == "I":
            if n <= max_indel and i:
                added.append((ref - 1, seq[i : i + n], min(q[i - 1 : i + n])))
            i += n
        elif op == "D":
            if n <= max_indel:
                lost.append((ref - 1, n, min(q[max(0, i - 1) : i + 1], default=min(30, mapq))))
            ref += n
        elif op == "N":
            ref += n
        elif op == "S":
            i += n
    if i != len(seq):
        return []
    out = []
    for c, p, r, a, _ in sites:
        if c != chrom:
            continue
        if len(r) == len(a):
            if p in at:
                out.append((p, r, a, 0 if seq[at[p]] == r else 1 if seq[at[p]] == a else 2, q[at[p]]))
            continue
        events = [(1 if s == a[len(r) :] else 2, x) for e, s, x in added if e == p + len(r) - 1] if len(a) > len(r) else [(1 if n == len(r) - len(a) else 2, x) for e, n, x in lost if e == p + len(a) - 1]
        span = range(p + len(r) - 1, p + len(r) + 1) if len(a) > len(r) else range(p, p + len(r))
        if events:
            out += [(p, r, a, code, x) for code, x in events]
        elif pos <= p < ref and all(s in at for s in span):
            out.append((p, r, a, 0, min(q[at[s]] for s in span)))
    return [(name, *row) for row in out if row[-1] >= min_qual]


def made(seed, n):
    rng = random.Random(seed)
    sites = {}
    for _ in range(120):
        p, r = rng.randrange(1, 400), rng.choice("ACGT")
        kind = rng.randrange(3)
        a = rng.choice("ACGT".replace(r, "")) if kind == 0 else r + "".join(rng.choices("ACGT", k=rng.randint(1, 3)))
        sites[(p, kind)] = ("1", p, r, a, 7) if kind < 2 else ("1", p, a, r, 7)
    reads = []
    for k in range(n):
        ops, size = [], 0
        if rng.random() < 0.3:
            ops.append((rng.randint(1, 5), "S"))
        for _ in range(rng.randint(1, 5)):
            ops += [(rng.randint(1, 40), rng.choice("M=X")), (rng.randint(1, 4), rng.choice("IDNHP"))]
        ops.append((rng.randint(1, 9), "M"))
        if rng.random() < 0.1:
            ops.insert(0, (2, "D"))
        size = sum(n for n, op in ops if op in "MIS=X")
        qual = None if rng.random() < 0.2 else "".join(chr(33 + rng.randrange(60)) for _ in range(size))
        reads.append((k, "1", rng.randrange(1, 400), "".join(f"{n}{op}" for n, op in ops), "".join(rng.choices("ACGT", k=size)), qual, rng.randrange(5, 60), "x"))
    return reads, list(sites.values())


def test_reads_against_a_walk(spark):
    reads, sites = made(1, 300)
    reads += [(900, "1", 5, None, "ACGT", None, 9, "x"), (901, "1", 5, "9M", "ACGT", None, 9, "x"), (902, None, 5, "4M", "ACGT", None, 9, "x"), (903, "2", 5, "4M", "ACGT", None, 9, None)]
    want = sorted(row for r in reads for row in spoken(r, sites, 10, 2))
    assert {row[4] for row in want} == {0, 1, 2}
    more = sites + sites[:9] + [("1", None, "A", "G", 1), ("1", 7, None, "G", 1), (None, 7, "A", "G", 1), ("1", 8, "A", "A" * 60, 1)]
    usable = [s for s in sites if abs(len(s[2]) - len(s[3])) <= 2]
    want = sorted(row for r in reads for row in spoken(r, usable, 10, 2))
    left, right = spark.createDataFrame(reads, READS), spark.createDataFrame(more, SITES)
    for width in (16, 100, 4096):
        got = indels.observations(left, right, 10, 2, width=width)
        assert got.columns == ["read", "chrom", "pos", "ref", "alt", "code", "qual"]
        assert sorted((r.read, r.pos, r.ref, r.alt, r.code, r.qual) for r in got.collect()) == want
    only = indels.observations(left, right, 10, 2, ref_alt_only=True)
    assert sorted((r.read, r.pos, r.ref, r.alt, r.code, r.qual) for r in only.collect()) == [row for row in want if row[4] < 2]


def test_nothing_to_see(spark):
    reads, sites = made(2, 3)
    left, right = spark.createDataFrame(reads, READS), spark.createDataFrame(sites, SITES)
    assert indels.observations(left.limit(0), right).count() == 0
    assert indels.observations(left, right.limit(0)).count() == 0


def test_pieces_meet_sites_by_one_way_at_all_sizes(spark, folder):
    """Small sites were broadcast, and larger ones sorted with all pieces, so cost leapt with the input: F15, F27."""
    for query in indel_queries.QUERIES.values():
        plan = query(spark, folder)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ShuffledHashJoin") == plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
