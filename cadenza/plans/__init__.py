"""Registered queries of the recording-quality operators and the SQL that must agree with them."""

from . import audit_queries, contract_queries, inference_queries, interval_queries, measure_queries, robust_queries, statistics_queries, summary_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (interval_queries, statistics_queries, audit_queries, measure_queries, inference_queries, contract_queries, summary_queries, robust_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
