"""What the operators of this package share: narrow inputs, Arrow row mapping, materialised steps and positions in a group."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from venuelens.session import scratch_path


ROWS_AT_ONCE = 512
#: Spark's setting that frees the shuffle files of an action at its end, not when the driver's garbage is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: other columns of the caller can clash with nothing.

    Backquotes keep names with dots or spaces whole.
    """
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str,
             setup: Callable[[], object] | None = None) -> DataFrame:
    """``fn(rows)`` per Arrow batch: an iterator of tuples in, tuples of ``schema`` out.

    ``setup`` runs once per task and its result becomes the second argument. Results are handed back in
    batches of bounded size, whatever the number of rows that one input row makes.
    """
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()

        def rows():
            for batch in batches:
                # not all texts of a batch at once as Python objects
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns])

        held: list[tuple] = []
        for row in fn(rows(), *state):
            held.append(row)
            if len(held) >= 4096:
                yield packed(held, target)
                held = []
        if held:
            yield packed(held, target)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], like: DataFrame) -> DataFrame:
    """``fn`` over Arrow batches; the result has the columns of ``like``, of any names. Inside they are c0, c1, ..."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = like.toDF(*[f"c{i}" for i in range(len(like.columns))]).schema
    return inner.mapInArrow(fn, schema).toDF(*like.columns)


def packed(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


#: Writer's options for rows of megabytes: Parquet looks at what it holds after every hundred rows only, so its pages and groups, and
#: what reads them, would hold all rows of a task, in memory that grows with the input. They change no row.
WIDE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.page.row.count.limit": 1,
             "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 8 << 20}
#: Spark's settings of the number of partitions that rows are shuffled to, and of the rows sent to Python at once.
PARTITIONS, ROWS_SENT = "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"


def at_least(spark, partitions: int) -> dict[str, str]:
    """The setting that shuffles to so many partitions, or as many as are set."""
    return {PARTITIONS: str(max(partitions, int(spark.conf.get(PARTITIONS))))}


def written(df: DataFrame, name: str, options: dict[str, int] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: cuts the lineage and survives lost executors.

    What was shuffled for it is of no use any more and is freed at once. ``options`` are those of the writer, ``settings`` those of the
    session meanwhile.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    settings = {FREE_SHUFFLES: "true", **(settings or {})}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.options(**(options or {})).parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Free the disk of tables that ``written`` gave, once all that is made of them is stored too."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of(text: str) -> int:
    return zlib.crc32(text.encode())


def chunks_for(rows: int, least: int = 256) -> int:
    """A power of two near the root of ``rows``: that many pieces of that many rows cover a group of any size."""
    return max(least, 1 << math.ceil(math.log2(max(rows, 1)) / 2))


def running(df: DataFrame, group: list[str], chunk: str, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``weight`` in each group, in order of ``chunk`` and then ``order``.

    ``chunk`` must be monotonic in the order. A task holds one chunk of one group, so a group of a third of all
    rows is spread; the sums of the chunks (few rows) are added up per group. NULL groups are groups.
    """
    part = [*group, chunk]
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    sums = (df.groupBy(*part).agg(F.sum(weight).alias("_sum"))
            .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], "_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return (df.withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(sums, on)
            .withColumn(out, (F.col(out) + F.col("_before")).cast("long"))
            .drop("_before", *[f"_k{i}" for i in range(len(part))]))


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


class Memo:
    """A bounded cache of two generations: what is used survives when the older generation is dropped."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
