"""Founders learned from reads: where they start, EM rounds with patience and restoring, several starts scanned together.

Starts (and any other variants of a panel) are a column `run` of the panel: one job scans them all, and a start whose founders have
settled is left out of later rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators import hmm
from lociweave.operators.evidence import site_alt_fraction
from lociweave.operators.posterior import clipped
from lociweave.sources.scratch import forget, never_broadcast, written

#: What a drawn allele starts at, and the range of founder probabilities.
LOW, HIGH, LEAST, MOST = 0.02, 0.98, 1e-4, 1 - 1e-4
#: Founders of a site with no more spread than this have collapsed; jitter of all starts but the first is at least that.
COLLAPSED, LEAST_JITTER = 1e-7, 0.02


def uniform(*keys: Column | int | str) -> Column:
    """A number in (0, 1) that depends on the keys alone: the first eight hexadecimal digits of an md5 digest, plus a half."""
    text = F.concat_ws("/", *[F.lit(str(k)) if isinstance(k, (int, str)) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def initial_founders(panel: DataFrame, fractions: DataFrame, seed: int = 0, jitter: float = 0.0) -> DataFrame:
    """The panel (pos, founder, alt_prob, immutable) as EM starts from it.

    At sites whose mutable founders have collapsed (no spread, or fewer than two of them) these are drawn: HIGH with the site's
    alternative fraction as chance, else LOW; a single mutable founder takes the fraction itself. Then mutable founders get normal
    noise of `jitter`, and all are held in [LEAST, MOST]. fractions: pos, alt_fraction; a site without one has 0.5.
    """
    site = Window.partitionBy("pos", "immutable")
    rows = panel.join(never_broadcast(fractions.select("pos", "alt_fraction")), "pos", "left")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(site)).withColumn("spread", F.stddev_pop("alt_prob").over(site))
    chance = clipped(F.coalesce("alt_fraction", F.lit(0.5)), 1e-3, 1 - 1e-3)
    drawn = F.when(F.col("n") < 2, chance).when(uniform(seed, "allele", F.col("pos"), F.col("founder")) < chance, HIGH).otherwise(LOW)
    value = F.when((F.col("n") < 2) | (F.col("spread") <= COLLAPSED), drawn).otherwise(F.col("alt_prob"))
    if jitter > 0:
        one, two = (uniform(seed, name, F.col("pos"), F.col("founder")) for name in ("radius", "angle"))
        value = value + jitter * F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)
    value = F.when(F.col("immutable") == 1, F.col("alt_prob")).otherwise(value)
    return rows.select("pos", "founder", clipped(value, LEAST, MOST).alias("alt_prob"), "immutable")


def read_log_likelihoods(posteriors: DataFrame, evidence: DataFrame, error: float = 0.01, floor: float = 1e-6) -> DataFrame:
    """(sample_id, read_log_likelihood, and run if posteriors has one): read counts given the expected alternative share.

    posteriors: sample_id, pos, gp; evidence: sample_id, pos, ref_count, alt_count, other_count.
    """
    ploidy = F.greatest(F.size("gp") - 1, F.lit(1))
    dosage = F.aggregate(F.transform("gp", lambda x, i: x * i), F.lit(0.0), lambda x, y: x + y)
    alt = clipped(dosage / ploidy, floor, 1 - floor)
    rows = never_broadcast(posteriors).join(evidence.select("sample_id", "pos", "ref_count", "alt_count", "other_count"), ["sample_id", "pos"]).withColumn("alt", alt)
    p_ref = clipped((1 - F.col("alt")) * (1 - error) + F.col("alt") * (error / 3), floor, 1.0)
    p_alt = clipped(F.col("alt") * (1 - error) + (1 - F.col("alt")) * (error / 3), floor, 1.0)
    each = F.col("ref_count") * F.log(p_ref) + F.col("alt_count") * F.log(p_alt) + F.col("other_count") * F.log(F.lit(max(error / 3, floor)))
    keys = [c for c in ("run", "sample_id") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.sum(each).alias("read_log_likelihood"))


def learn(
    evidence: DataFrame,
    positions: DataFrame,
    samples: DataFrame,
    panel: DataFrame,
    rounds: int = 3,
    ploidy: int = 2,
    tolerance: float = 1e-4,
    least_rounds: int = 1,
    patience: int = 1,
    restore: bool = True,
    harden: bool = False,
    damping: float = 0.5,
    fragments: DataFrame | None = None,
    mode: str = "replace",
    grid: hmm.Grid | None = None,
) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """EM over the mutable founders of every run: (panel, history of (run, round from 1, largest change)).

    panel: run, pos, founder, alt_prob, immutable. A run ends after `patience` rounds in a row (none before `least_rounds`) that change no founder by
    more than the tolerance; then, with `restore`, its founders are those of the round that changed them least. A run that does not
    end has the founders of the last round. Every round's panel is written, so lineage does not grow and lost executors cost one round.
    Reads are laid out once, in `grid`, for all rounds.
    """
    grid = grid or hmm.laid_out(evidence, positions, samples, panel, ploidy)
    now = {r[0]: panel for r in panel.select("run").distinct().collect()}  # a handful of runs; where each one's founders are
    best: dict[int, tuple[float, DataFrame]] = {}
    calm = dict.fromkeys(now, 0)
    history: list[tuple[int, int, float]] = []
    active = sorted(now)
    for k in range(1, rounds + 1):
        given = _of(now, active)
        statistics = hmm.scanned_founder_statistics(evidence, positions, samples, given, ploidy, fragments=fragments, mode=mode, grid=grid._replace(runs=list(active)))
        if harden:
            aim = hmm.hardened(hmm.updated_founders(given, statistics, 0.0), given)
            both = aim.join(never_broadcast(given.select("run", "pos", "founder", F.col("alt_prob").alias("before"))), ["run", "pos", "founder"])
            moved = clipped(damping * F.col("before") + (1 - damping) * F.col("alt_prob"), LEAST, MOST)
            new = both.select("run", "pos", "founder", F.when(F.col("immutable") == 1, F.col("before")).otherwise(moved).alias("alt_prob"), "immutable")
        else:
            new = hmm.updated_founders(given, statistics, damping)
        new = written(new)
        both = new.join(never_broadcast(given.select("run", "pos", "founder", F.col("alt_prob").alias("before"))), ["run", "pos", "founder"])
        change = both.groupBy("run").agg(F.max(F.when(F.col("immutable") == 0, F.abs(F.col("alt_prob") - F.col("before"))).otherwise(0.0)).alias("change"))
        old = list({id(df): df for df in [*now.values(), *(df for _, df in best.values())]}.values())
        for run, delta in sorted((r["run"], r["change"]) for r in change.collect()):  # one row for each run
            history.append((run, k, delta))
            now[run] = new
            if run not in best or delta < best[run][0]:
                best[run] = delta, new
            calm[run] = calm[run] + 1 if delta <= tolerance and k >= least_rounds else 0
        for run in [r for r in active if calm[r] >= patience]:
            active.remove(run)
            if restore:
                now[run] = best[run][1]
        used = {id(df) for df in [*now.values(), *(df for _, df in best.values())]}
        for df in old:
            if id(df) not in used and df is not panel:
                forget(df)
        if not active:
            break
    return _of(now, sorted(now)), history


def _of(now: dict[int, DataFrame], runs: list[int]) -> DataFrame:
    """The founders of some runs, each from where they are."""
    out = None
    for df in {id(now[r]): now[r] for r in runs}.values():
        part = df.where(F.col("run").isin([r for r in runs if now[r] is df])).select("run", "pos", "founder", "alt_prob", "immutable")
        out = part if out is None else out.unionByName(part)
    return out


def learn_founders(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, **how) -> tuple[DataFrame, list[float]]:
    """EM over mutable founders of one panel: (panel, largest change of each round). See `learn` for what may be said further."""
    out, history = learn(evidence, positions, samples, panel.withColumn("run", F.lit(0)), **how)
    return out.drop("run"), [delta for _, _, delta in history]


def multistart(
    evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, starts: int = 3, seed: int = 0, jitter: float = 0.0, ploidy: int = 2, **how
) -> tuple[DataFrame, DataFrame]:
    """(founders of the best start, scores): run, read_log_likelihood, rounds, founder_delta, selected of every start.

    Start k draws with seed + k, all but the first with a jitter of LEAST_JITTER at least. The best has the largest read log-likelihood after
    its last round, the smallest number on ties. A panel without mutable founders has one start, which changes nothing.
    """
    if panel.where("immutable = 0").isEmpty():
        starts = 1
    evidence = written(evidence)
    fractions = site_alt_fraction(evidence)
    first = None
    for k in range(starts):
        one = initial_founders(panel, fractions, seed + k, jitter if k == 0 else max(jitter, LEAST_JITTER)).withColumn("run", F.lit(k))
        first = one if first is None else first.unionByName(one)
    first = written(first)
    grid = hmm.laid_out(evidence, positions, samples, first, ploidy, counts=True)
    learned, history = learn(evidence, positions, samples, first, ploidy=ploidy, grid=grid, **how)
    rest = {name: how[name] for name in ("fragments", "mode") if name in how}
    score = hmm.scanned_read_log_likelihoods(evidence, positions, samples, learned, ploidy, grid=grid, **rest).groupBy("run").agg(F.sum("read_log_likelihood").alias("read_log_likelihood")).collect()  # one row for each start
    done = {run: (k, delta) for run, k, delta in history}
    totals = {r["run"]: r["read_log_likelihood"] for r in score}
    chosen = max(range(starts), key=lambda k: (totals.get(k, -math.inf), -k))
    rows = [(k, totals.get(k), *done.get(k, (0, None)), k == chosen) for k in range(starts)]
    scores = evidence.sparkSession.createDataFrame(rows, "run int, read_log_likelihood double, rounds int, founder_delta double, selected boolean")
    return learned.where(F.col("run") == chosen).drop("run"), scores
