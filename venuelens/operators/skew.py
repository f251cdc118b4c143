"""Joins whose many-side may have a few very frequent keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

SALTS = 64
# Below this many rows a skewed join is harmless and is left to adaptive execution.
MIN_ROWS = 1_000_000
ROWS_PER_TASK = 5_000_000
MAX_SALTS = 65_536


def frequent_keys(counts: DataFrame, keys: list[str], n: str, parts: int = SALTS, min_rows: int | None = None) -> list[Row]:
    """Keys that hold more than 1/parts of all rows: fewer than ``parts`` of them, by arithmetic."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < max(MIN_ROWS if min_rows is None else min_rows, 1):
        return []
    return counts.filter(F.col(n) * parts > total).select(*keys, F.col(n).alias("_rows_of_key")).collect()


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner",
                counts: tuple[DataFrame, str] | None = None, salts: int = SALTS,
                min_rows: int | None = None) -> DataFrame:
    """Equi-join in which the rows of frequent keys are spread over ``salts`` tasks.

    ``one`` has at most one row per key. Its rows for frequent keys are repeated once per salt, so
    the result is that of the plain join. Salts grow with the largest key, so that a task gets about
    ``ROWS_PER_TASK`` rows of it; equal rows without other columns are dealt by their place. Without frequent keys it is the plain join, and Spark
    broadcasts the smaller side if its measured size allows. ``counts`` gives the rows per key of
    ``many`` and the name of the count where they are known already.
    """
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count("*").alias("_n")), "_n"
    hot = frequent_keys(counts[0], keys, counts[1], salts, min_rows)
    if not hot:
        return many.join(one, keys, how)
    flag = is_one_of(keys, hot)
    salts = min(MAX_SALTS, max(salts, -(-max(r["_rows_of_key"] for r in hot) // ROWS_PER_TASK)))
    payload = [c for c in many.columns if c not in keys]
    # any salt gives the same result, so a task that runs again may deal its rows anew
    dealt = F.xxhash64(*payload, F.monotonically_increasing_id()) if payload else F.monotonically_increasing_id()
    spread = F.pmod(dealt, F.lit(salts)).cast("int")
    m = many.withColumn("_salt", F.when(flag, spread).otherwise(0))
    o = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(flag, salts - 1).otherwise(0))))
    return m.join(o, [*keys, "_salt"], how).drop("_salt")


def is_one_of(keys: list[str], rows: list[Row]) -> Column:
    """Whether the key columns equal one of a few collected keys; NULL equals NULL."""
    tests = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]) for r in rows]
    return reduce(lambda a, b: a | b, tests)
