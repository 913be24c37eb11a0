"""Queries over streams: the dialect has no stream operators of its own.

A streaming DataFrame registered as a view can be filtered, projected and joined to tables like any other; what
needs all rows (ORDER BY, LIMIT, OFFSET) Spark refuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.engine import Engine


def stream(engine: Engine, name: str, source: DataFrame, sql: str) -> DataFrame:
    """The streaming result of a SELECT over ``source`` under ``name``; start it with ``writeStream``."""
    if not source.isStreaming:
        raise ValueError("the source is no stream")
    engine.register(name, source)
    return engine.sql(sql)
