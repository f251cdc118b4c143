"""Ranks and running totals over totally ordered data, without a one-task window."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens.operators.skew import spread_join
from venuelens.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 10_000


def value_bounds(df: DataFrame, value: str, rows_per_bucket: int | None = None) -> list[float]:
    """Cut points that leave about ``rows_per_bucket`` rows between them; at most ``MAX_BUCKETS`` doubles.

    They only balance the work: any cut points give the same result.
    """
    rows = df.count()
    buckets = min(-(-rows // (rows_per_bucket or ROWS_PER_BUCKET)), MAX_BUCKETS)
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 5 * buckets)).first()
    return sorted(set(row[0] or []))


def bucket_of(df: DataFrame, value: str, bounds: list[float], out: str) -> DataFrame:
    """Ordered bucket number of the value; equal values share a bucket."""
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_cut", outputCol=out, handleInvalid="keep")
    placed = cut.transform(df.withColumn("_cut", F.col(value).cast("double"))).drop("_cut")
    # NULL sorts first, so its rows have the bucket before all others; NaN is kept in the last one
    return placed.withColumn(out, F.when(F.col(value).isNull(), -1).otherwise(F.col(out).cast("int")))


def running_total(df: DataFrame, keys: list[str], order: list[Column], weight: str | Column, out: str,
                  bucket: Column | str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` per key in the given order.

    ``bucket`` is a column that is monotonic in the order, or with ``bounds`` the numeric column to
    cut at them. The sum runs inside each (key, bucket) and the totals of the earlier buckets are
    added, so no task needs a whole key. Empty ``bounds`` mean a table small enough for one window.
    A NULL key is a key, and rows whose order value is NULL come first, in either way.
    """
    return running_totals(df, keys, order, {out: weight}, bucket, bounds)


def running_totals(df: DataFrame, keys: list[str], order: list[Column], weights: dict[str, str | Column],
                   bucket: Column | str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """``running_total`` of several weights (by result column) in one pass."""
    weights = {out: F.col(w) if isinstance(w, str) else w for out, w in weights.items()}
    if bucket is None or bounds == []:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(w).over(whole) for out, w in weights.items()})
    placed = (df.withColumn("_b", F.coalesce(F.col(bucket) if isinstance(bucket, str) else bucket, F.lit(-1))) if bounds is None
              else bucket_of(df, bucket, bounds, "_b"))
    # a struct is never NULL itself, and its NULL fields are equal
    placed = placed.withColumn("_part", F.struct(*keys, "_b"))
    part = ["_part"]
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy("_part._b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy(*part).agg(*[F.sum(w).alias(f"_t{i}") for i, w in enumerate(weights.values())])
               .select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(weights))]))
    return (placed.withColumns({out: F.sum(w).over(inside) for out, w in weights.items()}).join(offsets, part)
            .withColumns({out: F.col(out) + F.col(f"_before{i}") for i, out in enumerate(weights)})
            .drop("_b", "_part", *[f"_before{i}" for i in range(len(weights))]))


def running_max(df: DataFrame, order: list[Column], value: str, out: str, bucket: Column | None = None) -> DataFrame:
    """Largest ``value`` up to and including each row in the given order; NULL values add nothing.

    ``bucket`` is monotonic in the order; without it one window takes the whole table.
    """
    if bucket is None:
        return df.withColumn(out, F.max(value).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    placed = df.withColumn("_b", bucket)
    inside = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = (placed.groupBy("_b").agg(F.max(value).alias("_m"))
               .withColumn("_before", F.max("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_m"))
    return (placed.withColumn(out, F.max(value).over(inside)).join(earlier, "_b")
            .withColumn(out, F.greatest(out, "_before")).drop("_before", "_b"))


def value_counts(df: DataFrame, cols: list[str], n: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias(n))


def ranks_of_counts(counts: DataFrame, value: str, out: str = "rank_avg", rows_per_bucket: int | None = None) -> DataFrame:
    """Average-tie rank of every distinct value, from the table of values and their count ``n``."""
    cum = running_total(counts, [], [F.col(value)], "n", "_cum", value, value_bounds(counts, value, rows_per_bucket))
    return cum.select(value, "n", (F.col("_cum") - F.col("n") + (F.col("n") + 1) / 2).alias(out))


def average_ranks(df: DataFrame, value: str, out: str = "rank_avg", rows_per_bucket: int | None = None) -> DataFrame:
    """One row per distinct value with its tie count ``n`` and its average-tie rank."""
    counts = cut_lineage(value_counts(df.filter(F.col(value).isNotNull()), [value]))
    return ranks_of_counts(counts, value, out, rows_per_bucket)


def row_ranks(df: DataFrame, value: str, out: str = "rank_avg", rows_per_bucket: int | None = None) -> DataFrame:
    """Every row with its average-tie rank; frequent values are spread over tasks."""
    data = df.filter(F.col(value).isNotNull())
    counts = cut_lineage(value_counts(data, [value]))
    ranks = ranks_of_counts(counts, value, out, rows_per_bucket)
    return spread_join(data, ranks.drop("n"), [value], counts=(counts, "n"))


def global_row_number(df: DataFrame, order: str, out: str = "row_no", rows_per_bucket: int | None = None) -> DataFrame:
    """1-based position of every row by a unique numeric column."""
    return running_total(df, [], [F.col(order)], F.lit(1), out, order, value_bounds(df, order, rows_per_bucket))


def assign_chunks(df: DataFrame, order: str, chunks: int, out: str = "chunk_id",
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Round-robin chunk of every row in id order."""
    return global_row_number(df, order, "_rn", rows_per_bucket).withColumn(
        out, F.pmod(F.col("_rn") - 1, F.lit(chunks)).cast("int")).drop("_rn")


def empirical_cdf(df: DataFrame, value: str, group: str, top_n: int = 8, rows_per_bucket: int | None = None) -> DataFrame:
    """Cumulative share per distinct value in the ``top_n`` largest groups.

    Rows with equal values are folded into one with their count, which keeps every step of the curve.
    """
    top = top_groups(df, group, top_n)
    data = df.filter(F.col(value).isNotNull()).join(F.broadcast(top), group, "left_semi")
    counts = cut_lineage(value_counts(data, [group, value]))
    cum = running_total(counts, [group], [F.col(value)], "n", "cum_n", value, value_bounds(counts, value, rows_per_bucket))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("group_n")).filter("group_n >= 2")
    return cum.join(F.broadcast(sizes), group).select(
        group, value, "n", (F.col("cum_n") / F.col("group_n")).alias("cdf"))


def top_groups(df: DataFrame, group: str, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent non-NULL values; ties by value. At most ``top_n`` rows."""
    return (value_counts(df.filter(F.col(group).isNotNull()), [group], "_n")
            .orderBy(F.desc("_n"), F.asc(group)).limit(top_n).select(group))


def restrict_to_top(df: DataFrame, group: str, top_n: int) -> DataFrame:
    return df.join(F.broadcast(top_groups(df, group, top_n)), group, "left_semi")


def top_rows(df: DataFrame, measure: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    """Top or bottom k rows with a non-NULL measure, ties by id ascending."""
    first = F.desc(measure) if largest else F.asc(measure)
    return df.filter(F.col(measure).isNotNull()).orderBy(first, F.asc(tie)).limit(k)


def extremes_per_group(df: DataFrame, group: str, measure: str, tie: str, k: int = 5) -> DataFrame:
    """The k lowest and the k highest rows of every group, in two limited windows.

    Each window keeps at most k rows per group and task before its shuffle.
    """
    low = W.partitionBy(group).orderBy(F.asc_nulls_last(measure), F.asc(tie))
    high = W.partitionBy(group).orderBy(F.desc_nulls_first(measure), F.desc(tie))
    data = df.filter(F.col(group).isNotNull())
    bottom = data.withColumn("position", F.row_number().over(low)).filter(F.col("position") <= k)
    top = data.withColumn("position", F.row_number().over(high)).filter(F.col("position") <= k)
    return bottom.withColumn("side", F.lit("negative")).unionByName(top.withColumn("side", F.lit("positive")))
