"""Cross-validation of imputation: reads of held-out sites are masked fold by fold, all folds scanned in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators import founders, hmm
from lociweave.operators.posterior import argmax, clipped
from lociweave.sources.scratch import never_broadcast, written


def pseudo_truth(rows: DataFrame) -> DataFrame:
    """(sample_id, pos, genotype_truth, dosage_truth) of a table with sample_id, pos and one of genotype, genotype_truth, dosage_truth, dosage.

    The first of these columns that is there gives the genotype (dosages are held in [0, 2] and rounded half to even); dosage_truth is
    that column or the genotype. Of repeated cells the smallest genotype and its smallest dosage stay; cells without a genotype go.
    """
    name = next((c for c in ("genotype", "genotype_truth", "dosage_truth", "dosage") if c in rows.columns), None)
    if name is None or not {"sample_id", "pos"} <= set(rows.columns):
        raise ValueError("pseudo-truth needs sample_id, pos and one of genotype, genotype_truth, dosage_truth, dosage")
    # bounds alone would make a genotype of a null
    held = F.when(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")), clipped(F.col(name).cast("double"), 0.0, 2.0))
    genotype = F.rint(held) if name.startswith("dosage") else F.col(name)
    dosage = F.col("dosage_truth") if "dosage_truth" in rows.columns else genotype
    cells = rows.select("sample_id", F.col("pos").cast("long").alias("pos"), F.struct(genotype.cast("int").alias("g"), dosage.cast("double").alias("d")).alias("t")).where("t.g is not null")
    best = cells.groupBy("sample_id", "pos").agg(F.min("t").alias("t"))
    return best.select("sample_id", "pos", F.col("t.g").alias("genotype_truth"), F.col("t.d").alias("dosage_truth"))


def held_out_predictions(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, folds: DataFrame, n_folds: int, ploidy: int = 2) -> DataFrame:
    """(fold, sample_id, chrom, pos, gp, dosage): every site as imputed without the reads at all sites of its own fold.

    folds: pos, fold from 0. A fold's masked reads are one run of the scan, so evidence is repeated n_folds - 1 times and nothing else; a
    run's sites of other folds stay in the tasks.
    """
    own = never_broadcast(folds.select("pos", F.col("fold").cast("int").alias("fold")))
    runs = F.array(*[F.lit(k) for k in range(n_folds)])
    masked = evidence.join(own, "pos").withColumn("run", F.explode(F.filter(runs, lambda r: r != F.col("fold")))).drop("fold")
    # every run occurs among the panel's runs, whatever reads are left
    every = panel.withColumn("run", F.explode(runs))
    out = hmm.posteriors(masked, positions.join(own.withColumnRenamed("fold", "only_run"), "pos", "left"), samples, every, ploidy, wanted=("gp", "dosage"))
    return out.select(F.col("run").alias("fold"), "sample_id", "chrom", "pos", "gp", "dosage")


def fold_scores(predictions: DataFrame, evidence: DataFrame, truth: DataFrame) -> DataFrame:
    """Per fold: cells with truth, accuracy, mean squared error of dosages, and the log-likelihood of the held-out reads per sample and site with reads."""
    predictions = never_broadcast(predictions)
    rows = predictions.join(truth, ["sample_id", "pos"])
    hit = (argmax(F.col("gp")) == F.col("genotype_truth")).cast("double")
    right = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_truth"), F.avg(hit).alias("accuracy"), F.avg(F.pow(F.col("dosage") - F.col("dosage_truth"), 2)).alias("dosage_mse"))
    reads = founders.read_log_likelihoods(predictions.withColumnRenamed("fold", "run"), evidence).groupBy(F.col("run").alias("fold")).agg(F.sum("read_log_likelihood").alias("read_log_likelihood"))
    return reads.join(right, "fold", "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0).cast("long")))


def harness(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, folds: DataFrame, n_folds: int, truth: DataFrame, scales: tuple[float, ...] = (1.0,)) -> DataFrame:
    """`fold_scores` for every scale of generations: generation_scale first. Scales are a handful, one job each."""
    out = None
    for scale in scales:
        some = samples.withColumn("generation", F.col("generation") * scale)
        # both scores read it
        predictions = written(held_out_predictions(evidence, positions, some, panel, folds, n_folds))
        part = fold_scores(predictions, evidence, truth)
        part = part.select(F.lit(float(scale)).alias("generation_scale"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out
