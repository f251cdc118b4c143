"""Ids that earlier batches have handled, kept beside a sink so that a batch reads only the parts its own ids fall in.

Ids are cut into ranges of ``width`` (other types by a 64-bit hash, then compared as they are). A range never holds more than
``width`` ids, so what a batch reads is bounded by its own number of ids, however large the sink has become.
Within a range every batch has its own file, and a repeated batch replaces its own and does not see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from venuelens.sources.tables import path_exists

WIDTH = 1_000_000
#: Ranges of hashed ids: as many as about a billion ids fill.
HASHED_RANGES = 1_000


def range_of(df: DataFrame, key: str, width: int = WIDTH) -> Column:
    if isinstance(df.schema[key].dataType, IntegralType):
        return F.call_function("div", F.col(key), F.lit(width))
    return F.pmod(F.xxhash64(key), F.lit(HASHED_RANGES))


def without_known(df: DataFrame, index: str, key: str, batch: int, width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` whose id no other batch has; only the ranges of its ids are read."""
    spark = df.sparkSession
    touched = sorted(r[0] for r in df.select(range_of(df, key, width)).distinct().collect() if r[0] is not None)
    here = f"{index}/range={{{','.join(map(str, touched))}}}"
    if not touched or not path_exists(spark, here):
        return df
    # the batch number is part of the path, so the batch's own file is not opened
    known = spark.read.option("basePath", index).parquet(here).filter(F.col("batch") != batch).select(key)
    return df.join(known, key, "left_anti")


def remember(df: DataFrame, index: str, key: str, batch: int, width: int = WIDTH) -> None:
    """Store the ids of a batch in their ranges, in place of what an earlier attempt of the batch stored there."""
    (df.select(key, range_of(df, key, width).alias("range"), F.lit(batch).alias("batch")).repartition("range").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("range", "batch").parquet(index))
