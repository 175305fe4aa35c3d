"""What aligned reads say about SNPs, insertions and deletions at given sites, from their CIGARs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.sites import variant_type

#: Width in bases of the bins in which reads and sites meet.
BIN = 256
#: Quality of bases that come without one, as a character and as a number.
UNKNOWN_CHAR, UNKNOWN_QUALITY = "?", 30

#: A matching stretch (at: its first base), or an insertion or deletion (at: its anchor).
_PIECE = "struct<kind:string,at:bigint,bases:string,quals:string,n:int,q:int>"


def _lowest(quals: Column) -> Column:
    """The smallest quality of a string of them (characters sort as qualities do); null for none."""
    return F.when(F.length(quals) > 0, F.ascii(F.array_min(F.split(quals, ""))) - 33)


def walked(reads: DataFrame, max_indel: int = 50) -> DataFrame:
    """Reads with `pieces` and their last reference base `end` instead of cigar, seq and qual.

    A piece of kind `match` is a stretch without gaps in the reference (insertions do not end it). The anchor of an insertion or a
    deletion is the last reference base before it, its quality the lowest of the base before it and the inserted bases, or of the two
    bases around a deletion. Longer events than `max_indel`, and insertions before a read's first base, move the cursors but are no
    pieces. Reads without a CIGAR, or whose sequence has another length than it says, give no row; qualities that are missing are 30.
    The fold copies its list once an operation, which is meant for reads of up to some thousand of them.
    """
    parts = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\d+", 0).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))
    seq, qual = F.col("_seq"), F.col("_qual")
    none = F.array().cast(f"array<{_PIECE}>")
    start = F.struct(F.col("pos").cast("long").alias("ref"), F.lit(0).alias("read"), none.alias("runs"), none.alias("events"))

    def piece(kind, at, bases=None, quals=None, n=None, q=None):
        return F.struct(*[F.lit(x) if x is None or isinstance(x, str) else x for x in (kind, at, bases, quals, n, q)]).cast(_PIECE)

    def step(acc, o):
        n, op, ref, read, runs, events = o["n"], o["op"], acc["ref"], acc["read"], acc["runs"], acc["events"]
        both = op.isin("M", "=", "X")
        bases, quals = F.substring(seq, read + 1, n), F.substring(qual, read + 1, n)
        last = F.element_at(runs, -1)
        goes_on = (F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["at"] + F.length(F.get(runs, F.size(runs) - 1)["bases"]) == ref)
        longer = piece("match", last["at"], F.concat(last["bases"], bases), F.concat(last["quals"], quals))
        grown = F.when(goes_on, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(piece("match", ref, bases, quals))))
        inserted = piece("insertion", ref - 1, bases, None, n, _lowest(F.substring(qual, read, n + 1)))
        around = F.substring(qual, F.greatest(read, F.lit(1)), F.when(read > 0, 2).otherwise(1))
        deleted = piece("deletion", ref - 1, None, None, n, F.coalesce(_lowest(around), F.lit(UNKNOWN_QUALITY)))
        return F.struct(
            (ref + F.when(both | op.isin("D", "N"), n).otherwise(0)).alias("ref"),
            (read + F.when(both | op.isin("I", "S"), n).otherwise(0)).alias("read"),
            F.when(both & (n > 0), grown).otherwise(runs).alias("runs"),
            F.when((op == "I") & (n <= max_indel) & (read >= 1), F.concat(events, F.array(inserted)))
            .when((op == "D") & (n <= max_indel), F.concat(events, F.array(deleted))).otherwise(events).alias("events"),
        )

    known = F.col("qual").isNotNull() & (F.length("qual") == F.length("seq"))
    rows = reads.where("cigar is not null and seq is not null and pos is not null")
    rows = rows.withColumn("_seq", F.upper("seq")).withColumn("_qual", F.when(known, F.col("qual")).otherwise(F.repeat(F.lit(UNKNOWN_CHAR), F.length("seq"))))
    # a generator is evaluated once, however many of its fields are asked for
    rows = rows.withColumn("_walk", F.explode(F.array(F.aggregate(ops, start, step)))).where(F.col("_walk.read") == F.length("_seq"))
    keep = [c for c in reads.columns if c not in ("cigar", "seq", "qual")]
    return rows.select(*keep, (F.col("_walk.ref") - 1).alias("end"), F.concat("_walk.runs", "_walk.events").alias("pieces"))


def target_bins(targets: DataFrame, max_indel: int = 50, width: int = BIN) -> DataFrame:
    """The usable sites with their kind, the base `key` they are found at (a SNP's base, an indel's anchor), its bin, and the bases first to last that a read of the reference allele matches.

    Usable are SNPs, and insertions and deletions of 1 to `max_indel` bases; repeated sites count once, nulls never.
    """
    sites = targets.where("chrom is not null and pos is not null and ref is not null and alt is not null")
    sites = sites.select("chrom", F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct()
    sites = sites.withColumn("kind", variant_type(F.col("ref"), F.col("alt"))).withColumn("change", F.abs(F.length("alt") - F.length("ref")))
    sites = sites.where((F.col("kind") == "snp") | (F.col("kind").isin("insertion", "deletion") & F.col("change").between(1, max_indel)))
    key = F.col("pos") + F.least(F.length("ref"), F.length("alt")) - 1
    sites = sites.withColumn("key", key).withColumn("bin", F.floor(key / width).cast("long"))
    added = F.col("kind") == "insertion"
    sites = sites.withColumn("first", F.when(added, F.col("key")).otherwise(F.col("pos")))
    sites = sites.withColumn("last", F.when(added, F.col("key") + 1).otherwise(F.col("pos") + F.length("ref") - 1))
    return sites.withColumn("tail", F.when(added, F.expr("substring(alt, length(ref) + 1)")))


def observations(reads: DataFrame, targets: DataFrame, min_qual: int = 5, max_indel: int = 50, ref_alt_only: bool = False, width: int = BIN) -> DataFrame:
    """What each read says about each site: the reads' other columns with chrom, pos, ref, alt, code (0 ref, 1 alt, 2 other) and qual.

    reads: chrom, pos (from 1), cigar, seq, qual (null: 30), mapq (null: no bound), any others; targets: chrom, pos, ref, alt. A SNP is the
    aligned base. An insertion after a site's last reference base is alternative if it is the very sequence, else other; a deletion is
    alternative if it has the length, else other. Without an event there, a read that matches at all bases of the reference allele (for
    insertions: at its last base and the next one) says reference. Qualities are the lowest of the bases used, held by the mapping quality;
    an event of too low a quality says nothing, not reference. `ref_alt_only` leaves out code 2.

    Pieces of reads and sites meet by an equality join on bins. A piece is shuffled once for each bin that it touches, with the bases
    which that bin can ask for, so long reads do not multiply. Sites are hashed in memory, one partition of them at a time, so pieces are
    never sorted; adaptive execution may split bins of deep coverage, as nothing is grouped.
    """
    keep = [c for c in reads.columns if c not in ("chrom", "pos", "cigar", "seq", "qual", "mapq", "ref", "alt", "code")]
    longest = targets.agg(F.max(F.greatest(F.length("ref"), F.length("alt")))).first()[0] or 1
    rows = walked(reads, max_indel)
    inserted = F.transform(F.filter("pieces", lambda p: p["kind"] == "insertion"), lambda p: p["at"])
    rows = rows.select(
        F.struct(*keep, F.lit(0).alias("_")).alias("own"), "chrom", F.col("pos").cast("long").alias("start"), "end", F.col("mapq").cast("int").alias("mapq"),
        inserted.alias("inserted"), F.explode("pieces").alias("piece"),
    )
    rows = rows.select("own", "chrom", "start", "end", "mapq", "inserted", *[F.col("piece").getField(c).alias(f"p_{c}") for c in ("kind", "at", "bases", "quals", "n", "q")])
    match = F.col("p_kind") == "match"
    stop = F.when(match, F.col("p_at") + F.length("p_bases") - 1).otherwise(F.col("p_at"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("p_at") / width).cast("long"), F.floor(stop / width).cast("long"))))
    begin = F.greatest(F.col("p_at"), F.col("bin") * width - longest)
    skip, size = (begin - F.col("p_at") + 1).cast("int"), ((F.col("bin") + 1) * width + longest - begin + 1).cast("int")

    def cut(text):
        return F.when(match, F.substring(text, skip, size)).otherwise(F.col(text))

    rows = rows.select(
        "own", "chrom", "bin", "start", "end", "mapq", "p_kind", "p_n", "p_q", F.when(match, begin).otherwise(F.col("p_at")).alias("p_at"),
        # only the anchors near this bin, so that a row stays small
        F.filter("inserted", lambda a: F.floor(a / width) == F.col("bin")).alias("inserted"), cut("p_bases").alias("p_bases"), cut("p_quals").alias("p_quals"),
    )
    site = target_bins(targets, max_indel, width).select("chrom", "bin", "pos", "ref", "alt", "kind", "change", "key", "first", "last", "tail")
    met = rows.join(site.hint("shuffle_hash"), ["chrom", "bin"])
    covers = match & (F.col("first") >= F.col("p_at")) & (F.col("last") < F.col("p_at") + F.length("p_bases"))
    as_reference = F.col("pos").between(F.col("start"), F.col("end")) & ~((F.col("kind") == "insertion") & F.array_contains("inserted", F.col("key")))
    event = (F.col("p_kind") == F.col("kind")) & (F.col("p_at") == F.col("key")) & (F.col("pos") >= F.col("p_at") - max(max_indel, 1) - 2)
    met = met.where((covers & as_reference) | event)
    at = (F.col("first") - F.col("p_at") + 1).cast("int")
    base = F.substring("p_bases", at, F.lit(1))
    code = (
        F.when(F.col("kind") == "snp", F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1).otherwise(2))
        .when(match, 0)
        .when(F.when(F.col("kind") == "insertion", F.col("p_bases") == F.col("tail")).otherwise(F.col("p_n") == F.col("change")), 1).otherwise(2)
    )
    quality = F.when(match, _lowest(F.substring("p_quals", at, (F.col("last") - F.col("first") + 1).cast("int")))).otherwise(F.col("p_q"))
    out = met.select("own", "chrom", "pos", "ref", "alt", code.cast("int").alias("code"), F.least(quality, F.col("mapq")).cast("int").alias("qual")).where(F.col("qual") >= min_qual)
    if ref_alt_only:
        out = out.where("code < 2")
    return out.select(*[F.col("own").getField(c).alias(c) for c in keep], "chrom", "pos", "ref", "alt", "code", "qual")
