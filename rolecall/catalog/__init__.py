"""Every registered query with its oracle text, keyed by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolecall.plans.views import Tables, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register `fn(tables) -> DataFrame` under an operator id."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"{key} registered twice")
        _QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            _ORACLES[key] = with_views(oracle)
        return fn

    return register


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"rolecall.catalog.{name}")


MODULES = ["search", "stats", "windows", "ingest", "sync", "match", "feeds", "exports", "quality", "activity", "streams", "resume"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
