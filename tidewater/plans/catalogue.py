"""Every registered query of the analytics operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), dates and the rest as they are."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, build: Callable[[Views], DataFrame], sql: str | None = None, digits: int | None = 6) -> None:
    """A query of the given name; its doubles are rounded as its SQL does."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(Views(spark, sf_dir))
        return df if digits is None else rounded(df, digits)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)


def _load() -> None:
    from . import q_core, q_data, q_factors, q_ledger, q_rolling, q_series, q_text  # noqa: F401  each registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
