"""Analyses that users add: a name, a function of (session, folder of the tables, arguments), a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plugin = Callable[..., DataFrame]
_PLUGINS: dict[str, Plugin] = {}


def plugin(name: str) -> Callable[[Plugin], Plugin]:
    """Register a function under `name`; a later one of the same name takes its place."""

    def add(f: Plugin) -> Plugin:
        _PLUGINS[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_PLUGINS)


def run(name: str, spark: SparkSession, root: str, **arguments) -> DataFrame:
    if name not in _PLUGINS:
        raise KeyError(f"no plugin {name}; there are {names()}")
    return _PLUGINS[name](spark, root, **arguments)
