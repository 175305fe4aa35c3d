"""Query of language identification: learned from three quarters of the documents, applied to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.langid import identified, learned
from lociweave.sources.tables import table

FOLDS, HELD_OUT = 4, 2


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text; documents of the held-out fold teach nothing."""
    docs = table(spark, folder, "documents")
    held = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    model = learned(docs.where(~held).select("text", "lang"))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL = {}
