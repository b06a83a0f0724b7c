"""All queries of the library, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomtext.plans import evaluation_queries, feature_queries, markup_queries, pair_queries, report_queries, table_queries, tier_queries

MODULES = (feature_queries, evaluation_queries, pair_queries, markup_queries, report_queries, tier_queries, table_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.oracle_sql().items()}
