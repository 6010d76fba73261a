"""Imports every query module so that the registry is complete."""

from sparkmail.plans import q_analytics, q_flows, q_io, q_merge, q_ml, q_parse, q_serving, q_store, q_stream, q_text  # noqa: F401
from sparkmail.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
