"""Whole plans over the given tables: pipelines and the registered queries."""

from textlens.plans import (
    evaluation_queries,
    lexical_queries,
    modelling_queries,
    preparation_queries,
    profile_queries,
    rebalance_queries,
    scalar_queries,
)
from textlens.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "evaluation_queries",
    "lexical_queries",
    "modelling_queries",
    "preparation_queries",
    "profile_queries",
    "rebalance_queries",
    "scalar_queries",
]
