"""Queries of the engine over the parquet tables of a directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, chunking, citations, corpus, extras, manifests, retrieval, scoring, search  # noqa: F401  (they register their queries)
from .common import SQL, Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
