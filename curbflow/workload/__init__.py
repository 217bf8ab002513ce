"""Registered queries over the driver tables, with their SQL oracles."""

from __future__ import annotations

from importlib import import_module

from curbflow.workload.registry import ORACLES, QUERIES, Query

MODULES = (
    "trip_queries",
    "mart_queries",
    "semantic_queries",
    "model_queries",
    "stated_queries",
    "bronze_queries",
    "lake_queries",
    "reader_queries",
    "resume_queries",
)


def _load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
