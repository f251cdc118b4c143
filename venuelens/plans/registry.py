"""Where queries are registered together with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (and no negative zero), so that results of two engines can be compared."""
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = "", longs: str = ""):
    """Register a query. ``doubles``, ``ints`` and ``longs`` name result columns of the SQL to round or cast."""
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            fixed = [f'round(CAST("{c}" AS DOUBLE), 6) + 0e0 AS "{c}"' for c in doubles.split()]
            fixed += [f'CAST("{c}" AS INTEGER) AS "{c}"' for c in ints.split()]
            fixed += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs.split()]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({sql}) AS result" if fixed else sql
        return fn
    return register
