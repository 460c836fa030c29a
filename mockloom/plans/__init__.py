"""Composed flows and the registered queries."""

from __future__ import annotations

import importlib

MODULES = [
    "fidelity_queries",
    "generation_queries",
    "catalog_queries",
    "source_queries",
    "job_queries",
    "privacy_queries",
    "model_queries",
]


def load_queries():
    """Import every query module and return (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"mockloom.plans.{name}")
    from mockloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
