"""Corpus preparation as a chain of stages, each one operator over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the shared folder
and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import bpe, debruijn, langid, minhash, mixing
from lociweave.sources.scratch import forget, written
from lociweave.sources.tables import table

#: A text whose best language explains less than this share of its n-grams is in none of the learned languages.
LEAST_LANG_SHARE = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, their lang replaced by the predicted one.

    Rejected are texts that are null or have no letter (`und`) and texts that no language learned from docs explains.
    Texts with letters but too short to be judged stay and keep their lang.
    Without any labelled document nothing can be judged, and only null and letter-free texts go.
    """
    docs = _ordered(docs)
    model = langid.learned(docs)
    out = langid.identified(docs, model)
    if not model.langs:
        return _ordered(out.where(langid.has_letter(F.col("text"))))
    unjudged = F.col("lang_share").isNull()
    out = out.where((F.col("lang_pred") != langid.UNKNOWN) & (unjudged | (F.col("lang_share") >= LEAST_LANG_SHARE)))
    return _ordered(out.withColumn("lang", F.when(unjudged, F.col("lang")).otherwise(F.col("lang_pred"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; rows that repeat an id stay together."""
    keep = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    return _ordered(docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")))


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; those of which nothing is left go."""
    out = debruijn.rewritten(docs).where("n_words = 0 or n_removed < n_words")
    return _ordered(out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities draw."""
    keep = mixing.mixed(docs).where("kept").select("doc_id").distinct()
    # one draw for each id: a null id has one too
    return _ordered(docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens of every document, and whether the ids decode to the text's bytes."""
    out = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", same.alias("round_trip"))


def _ordered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_spans),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Language models and BPE are not expressible in SQL. The tests hold every stage against its operator, and the operators against SQL,
#: the tokenizer's library or enumeration.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            forget(before)  # the result of a stage is of no use once the next one is written
    return docs
