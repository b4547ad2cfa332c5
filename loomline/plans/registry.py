"""Every operator of the engine as a named query over the test tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, curation, details, evaluation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return curation.QUERIES | evaluation.QUERIES | details.QUERIES | checks.QUERIES


def oracle_sql() -> dict[str, str]:
    return curation.SQL | evaluation.SQL | details.SQL | checks.SQL
