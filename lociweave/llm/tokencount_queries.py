"""Query of token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.tokencount import counted
from lociweave.sources.tables import table

LIMIT = 2048


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text by the 49k word vocabulary, and whether they exceed the limit."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = counted(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL = {}
