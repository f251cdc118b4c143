"""Files as rows: listings, whole texts with the reason why one cannot be read, and shards checked on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest file that is read as one value.
MAX_BYTES = 256 * 1024 * 1024
CHECKED = "path string, shard string, length long, n_rows long, error string"


def list_files(spark: SparkSession, glob: str, pattern: str | None = None) -> DataFrame:
    """Path, length and time of every file behind a glob of files or folders; no content is read, and nothing there gives no rows."""
    return _files(spark, glob, pattern).select("path", "length", F.col("modificationTime").alias("modified"))


def _files(spark: SparkSession, glob: str, pattern: str | None, skip_unreadable: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(skip_unreadable).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        return reader.load(glob)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def _contents(files: DataFrame, max_bytes: int, value: Column) -> DataFrame:
    """Rows of all files, with ``value`` of their content. Longer files are not opened: the limit on the length reaches the scan."""
    read = files.filter(F.col("length") <= max_bytes).select("path", "length", value.alias("value"), F.lit(None).cast("string").alias("error"))
    left = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast(read.schema["value"].dataType).alias("value"),
        F.format_string("longer than %d bytes: %d", F.lit(max_bytes), "length").alias("error"))
    return read.unionByName(left)


def read_texts(spark: SparkSession, glob: str, pattern: str = "*.json", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per file: path, file_name, length, its whole text as ``value``, or why there is none in ``error``."""
    content = F.col("content").cast("string")
    rows = _contents(_files(spark, glob, pattern), max_bytes, content)
    broken = F.col("value").isNotNull() & ~F.is_valid_utf8("value")
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "length",
                       F.when(~broken, F.col("value")).alias("value"), F.when(broken, "not UTF-8").otherwise(F.col("error")).alias("error"))


def check_shards(spark: SparkSession, glob: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per file of the shard folders behind a glob: its rows, or the error of the first part of it that cannot be read.

    Files are read whole on the executors, as a footer can be sound where a page is not; one longer than ``max_bytes`` is
    reported as such, and one that the file system does not give out as ``cannot be read``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for at in range(batch.num_rows):
                data, error = batch.column(2)[at].as_buffer(), batch.column(3)[at].as_py()
                count = None
                if data is not None:
                    try:
                        count = sum(b.num_rows for b in pq.ParquetFile(pa.BufferReader(data)).iter_batches())
                    except Exception as e:  # noqa: BLE001 - whatever a damaged file raises is its row
                        error = f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
                rows.append(count)
                errors.append(error)
            paths = batch.column(0)
            shards = [p.rstrip("/").split("/")[-2] for p in paths.to_pylist()]
            yield pa.RecordBatch.from_arrays([paths.cast(pa.string()), pa.array(shards, pa.string()), batch.column(1), pa.array(rows, pa.int64()),
                                              pa.array(errors, pa.string())], names=["path", "shard", "length", "n_rows", "error"])

    read = _contents(_files(spark, glob, None, skip_unreadable=True), max_bytes, F.col("content")).mapInArrow(run, CHECKED)
    every = list_files(spark, glob).select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("shard"), "length")
    return every.join(read.drop("shard", "length").withColumn("seen", F.lit(True)), "path", "left").select(
        "path", "shard", "length", "n_rows", F.when(F.col("seen").isNull(), "cannot be read").otherwise(F.col("error")).alias("error"))


def unreadable_shards(checked: DataFrame) -> DataFrame:
    """The files of ``check_shards`` that a scan leaves out, wholly or in part."""
    return checked.filter(F.col("error").isNotNull()).select("path", "shard", "length", "error")
