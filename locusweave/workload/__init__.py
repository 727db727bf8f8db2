"""Registered queries: each reads the given tables whole; most carry equivalent SQL for checking."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its checking SQL, if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load() -> None:
    from locusweave.workload import (  # noqa: F401
        coverage,
        evaluation,
        family,
        isoforms,
        loci,
        modes,
        reads,
        transcripts,
        validation,
    )
