"""All registered queries of the engine."""

from __future__ import annotations

from . import classifying, evaluation, exchange, fitting, labelling, lookups, normalising, sampling, strain

MODULES = (labelling, lookups, sampling, normalising, evaluation, classifying, fitting, strain, exchange)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
