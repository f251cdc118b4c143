"""Scans of pipeline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens.functions.scalars import nan_to_null
from venuelens.session import cut_lineage


#: A table of at least so many file splits (128 MB each by default) is never moved to be spread.
SMALL_SPLITS = 16


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float column; comparisons then follow SQL NULL logic."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
                       for f in df.schema.fields])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """Parquet scan; only ``columns`` are read when given.

    ``where`` holds comparisons (no test for NULL). It is applied to the stored columns, where it
    reaches the file scan, and again after the normalisation, which turns NaN into NULL.
    """
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    df = normalise(df.select(*columns) if columns else df)
    return df if where is None else df.filter(where)


def spread_input(df: DataFrame, parts: int, key: str) -> DataFrame:
    """Deal rows out over ``parts`` tasks by ``key``, for work that is heavy per row, such as reading long texts.

    The caller decides by the size of the table: below ``SMALL_SPLITS`` file splits that is cheap and worth it.
    """
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < min(parts, SMALL_SPLITS) else df


def stored_and_spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored, and stored once more in rows dealt over the cores where it lies in few parts: for rows that are read many times."""
    stored = cut_lineage(df)
    dealt = spread_input(stored, df.sparkSession.sparkContext.defaultParallelism, key)
    return stored if dealt is stored else cut_lineage(dealt)


def list_paths(spark: SparkSession, glob: str) -> list[str]:
    """Paths behind a glob, in order, through the cluster's own file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(list_paths(spark, path))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one with the given schema when it is absent."""
    return read_table(spark, path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_shards(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """All shards behind a glob with the name of their folder; unreadable files are skipped, see ``files.check_shards``."""
    shard = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    return normalise(spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(glob)
                     .select("*", shard.alias("shard")))


def shard_counts(shards: DataFrame) -> DataFrame:
    return shards.groupBy("shard").agg(F.count("*").alias("n"))


def read_json_artifact(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """One JSON document per file, or with ``lines`` one per line."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def with_derived(df: DataFrame) -> DataFrame:
    """Add the price number and the label array only where the table lacks them."""
    from venuelens.functions.scalars import price_level, split_labels
    if "price_level_num" not in df.columns and "priceLevel" in df.columns:
        df = df.withColumn("price_level_num", price_level("priceLevel"))
    if "cuisine_list" not in df.columns and "cuisines" in df.columns:
        df = df.withColumn("cuisine_list", split_labels("cuisines"))
    return df
