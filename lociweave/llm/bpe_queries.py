"""Query of byte-level BPE: counts and digests of ids and of what they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.bpe import encoded
from lociweave.sources.tables import table


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes and decodes every whole text by the 50k byte-level vocabulary."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packed=True)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL = {}
