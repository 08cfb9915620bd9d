"""Every registered query of the core engine, with its SQL oracle where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    """Importing the modules registers their queries."""
    from lodeworks.plans import articles, artifacts, audit, captures, documents, fetching, more_payloads, papers, payloads, requests, retrieval, rules, sinks, sources, streams, vision_output  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["f2_federated_top_k"](spark, sf_dir)
