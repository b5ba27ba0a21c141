"""All queries over the driver's tables; importing a module registers its queries."""

from __future__ import annotations

from . import registry
from . import evaluation_queries, experiment_queries, metric_queries, operations_queries, platform_queries, product_queries, reliability_queries, text_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
