"""Registration of queries and the SQL they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import with_inputs

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_MODULES = [
    "publishing", "contracts", "lookups", "principals", "access", "workflows",
    "components", "status", "scalars", "rows", "plans", "provisioning",
]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may use the derived inputs of ``checks.inputs`` by name."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = with_inputs(oracle)
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"checks.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
