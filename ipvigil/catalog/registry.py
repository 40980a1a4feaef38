"""Registered queries by name, with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `check` it has no SQL equivalent and is tested on fixtures only."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def positioned(df: DataFrame) -> DataFrame:
    """A page of rows with their places in it, so that the SQL sees the order as well."""
    return df.coalesce(1).withColumn("position", F.monotonically_increasing_id())


def listed(df: DataFrame, *columns: str, separator: str = ",") -> DataFrame:
    """Array columns as text, so results compare across engines."""
    return df.withColumns({c: F.array_join(c, separator) for c in columns})
