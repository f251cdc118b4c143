"""Repeatable samples by hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.operators.ordering import running_total
from venuelens.operators.skew import spread_join
from venuelens.session import cut_lineage


# Up to this many rows a sample is taken as an ordered limit, which passes them through the driver.
TOP_ROWS = 10_000


def draw_order(key: str, seed: int = 42) -> Column:
    """A uniform pseudo-random text that depends only on the key and the seed; a NULL key counts as one more key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42, top_rows: int = TOP_ROWS) -> DataFrame:
    """n rows; the same rows on every run, for any n. A large sample is cut by rank, away from the driver."""
    drawn = df.withColumn("_d", draw_order(key, seed))
    if n <= top_rows:
        return drawn.orderBy("_d").limit(n).drop("_d")
    return _draw_rank(drawn, [], "_r").filter(F.col("_r") <= n).drop("_r", "_d")


def _draw_rank(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Position in draw order per key. The leading hash digits make buckets of equal size."""
    bucket = F.conv(F.substring("_d", 1, 3), 16, 10).cast("int")
    return running_total(df, keys, [F.col("_d")], F.lit(1), out, bucket)


def stratum_quotas(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """Share of ``total`` per stratum in proportion to its rows, at least 1."""
    counts = rows.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    everything = rows.agg(F.count("*")).scalar()
    return counts.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("n") / everything)).cast("int"))


def stratified_venues(rows: DataFrame, key: str, stratum: str, total: int, seed: int = 42) -> DataFrame:
    """Venue ids drawn per stratum by quota, then topped up from the rest to ``total``.

    ``rows`` are reviews with the stratum of their venue.
    """
    venues = cut_lineage(rows.groupBy(key).agg(F.max(stratum).alias(stratum)).withColumn("_d", draw_order(key, seed)))
    quotas = stratum_quotas(rows, stratum, total).select(stratum, "quota")
    ranked = _draw_rank(venues.filter(F.col(stratum).isNotNull()), [stratum], "_r")
    chosen = spread_join(ranked, quotas, [stratum]).filter(F.col("_r") <= F.col("quota")).select(key)
    chosen = cut_lineage(chosen)
    missing = F.lit(total) - chosen.agg(F.count("*")).scalar()
    rest = _draw_rank(venues.join(chosen, key, "left_anti"), [], "_r").filter(F.col("_r") <= missing).select(key)
    return chosen.unionByName(rest)
