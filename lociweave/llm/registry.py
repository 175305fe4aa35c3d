"""All queries of the corpus operators by name, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from lociweave.llm import (
    bpe_queries,
    chat_queries,
    contamination_queries,
    debruijn_queries,
    filteraudit_queries,
    hardnegatives_queries,
    langid_queries,
    minhash_queries,
    mixing_queries,
    pivots_queries,
    tokencount_queries,
    topk_queries,
    toxicity_queries,
)

_MODULES = (topk_queries, langid_queries, pivots_queries, minhash_queries, debruijn_queries, chat_queries, bpe_queries, mixing_queries, tokencount_queries, toxicity_queries, contamination_queries, hardnegatives_queries, filteraudit_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
