"""Registered queries over the given tables."""

from dipsift.plans import registry
from dipsift.plans import q_clean, q_eval, q_record, q_search, q_sets, q_sources, q_views  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
