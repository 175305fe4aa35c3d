"""Fitted models: callability and isotonic calibration; cross-validation, and array genotypes beside reads."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def callability(rows: DataFrame, features: list[str], label: str = "correct") -> DataFrame:
    """rows plus prob: a balanced logistic model of whether a call is correct, over imputed and scaled features."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    weighted = rows.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))).withColumn("_y", F.col(label).cast("double"))
    for f in features:
        weighted = weighted.withColumn(f, F.col(f).cast("double"))
    filled = [f"_{f}" for f in features]
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-3),
    ]
    out = Pipeline(stages=stages).fit(weighted).transform(weighted)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("prob"))


def isotonic(rows: DataFrame, score: str, label: str) -> DataFrame:
    """rows plus calibrated: the label's non-decreasing regression on the score."""
    r = rows.withColumn("_s", F.col(score).cast("double")).withColumn("_y", F.col(label).cast("double"))
    model = IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol="calibrated").fit(r)
    return model.transform(r).drop("_s", "_y")


def folds(positions: DataFrame, n: int, key: Column) -> DataFrame:
    """Positions with fold: ranks by `key` in each chromosome, dealt round robin."""
    order = Window.partitionBy("chrom").orderBy(key, "pos")
    return positions.withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def cv_summary(results: DataFrame, *combo: str) -> DataFrame:
    """Means of the metrics of each combination, best first, missing ones last."""
    metrics = [c for c in results.columns if c not in (*combo, "seed", "fold")]
    out = results.groupBy(*combo).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], F.count(F.lit(1)).alias("n_runs"))
    return out.orderBy(*[F.desc_nulls_last(f"mean_{m}") for m in metrics[:2]], *combo)


def injected(evidence: DataFrame, arrays: DataFrame, weight: int = 20) -> DataFrame:
    """Evidence with array genotypes as extra reads: 0 adds weight to ref, 2 to alt, 1 half to each (the odd one to alt); 16 bits."""
    g = arrays.select("sample_id", "pos", "genotype")
    rows = evidence.join(g, ["sample_id", "pos"], "full").na.fill(0, ["ref_count", "alt_count"])
    ref = F.when(F.col("genotype") == 0, weight).when(F.col("genotype") == 1, weight // 2).otherwise(0)
    alt = F.when(F.col("genotype") == 2, weight).when(F.col("genotype") == 1, weight - weight // 2).otherwise(0)
    return rows.select("sample_id", "pos", F.least(F.lit(65535), F.col("ref_count") + ref).alias("ref_count"), F.least(F.lit(65535), F.col("alt_count") + alt).alias("alt_count"))


def aligned(arrays: DataFrame, samples: DataFrame) -> DataFrame:
    """All samples of either table, unseen ones with the median generation."""
    middle = samples.agg(F.median("generation").alias("middle"))
    ids = arrays.select("sample_id").distinct().withColumn("has_array", F.lit(True))
    rows = samples.select("sample_id", "generation").join(ids, "sample_id", "full").join(F.broadcast(middle))
    return rows.select("sample_id", F.coalesce("generation", "middle").alias("generation"), F.coalesce("has_array", F.lit(False)).alias("has_array"))
