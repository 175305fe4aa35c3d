"""All queries of the genotype engine by name, with their DuckDB twins."""

from __future__ import annotations

from lociweave.plans import (
    boosting_queries,
    crossvalidation_queries,
    decision_queries,
    evidence_queries,
    file_queries,
    filter_queries,
    hmm_queries,
    indel_queries,
    mixed_queries,
    model_queries,
    posterior_queries,
    rate_queries,
    relation_queries,
    site_queries,
    transmission_queries,
)

_MODULES = (evidence_queries, filter_queries, site_queries, posterior_queries, hmm_queries, relation_queries, transmission_queries, model_queries, mixed_queries, decision_queries, boosting_queries, indel_queries, rate_queries, file_queries, crossvalidation_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
