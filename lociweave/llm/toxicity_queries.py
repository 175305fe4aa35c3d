"""Query of toxicity: learned from four fifths of the labels, applied to all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.langid_queries import in_fold
from lociweave.llm.toxicity import fit_sample, learned, scored
from lociweave.sources.tables import table

FOLDS, HELD_OUT = 5, 0


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text; labels of the held-out fold teach nothing."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held)
    out = scored(docs, learned(fit_sample(labels, docs)))
    return out.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL = {}
