"""Exact interpolated quantiles per group that never gather a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens.operators.skew import spread_join
from venuelens.session import cut_lineage

ACCURACY = 10000
# A group of at most this many rows fits one task and takes the built-in exact percentile.
DIRECT_ROWS = 2_000_000
# The brackets of at most this many groups are broadcast; more are joined through a shuffle.
BROADCAST_GROUPS = 100_000


def grouped_stats(df: DataFrame, keys: list[str], aggs: list[Column], quantiles: dict[str, tuple[str, float]],
                  accuracy: int = ACCURACY, direct_rows: int | None = None) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` plus exact quantiles ``{name: (numeric column, q)}``.

    The rows per group are counted first. If every group is small, one aggregate does it all. Otherwise
    see ``_bracketed``. A NULL key is a group; without keys the whole table is one group.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= (DIRECT_ROWS if direct_rows is None else direct_rows):
        # One buffer per column serves all its quantiles.
        shares = {c: sorted({q for col, q in quantiles.values() if col == c}) for c, _ in quantiles.values()}
        exact = [F.percentile(F.col(c).cast("double"), qs).alias(f"_p_{c}") for c, qs in shares.items()]
        picked = [F.col(f"_p_{c}")[shares[c].index(q)].alias(name) for name, (c, q) in quantiles.items()]
        out = df.groupBy(*keys).agg(*aggs, *exact)
        return out.select(*[c for c in out.columns if not c.startswith("_p_")], *picked)
    # a struct is never NULL itself, and its NULL fields are equal
    key = F.struct(*keys) if keys else F.lit(1)
    out = _bracketed(df.withColumn("_key", key), ["_key"], aggs, quantiles, accuracy)
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in out.columns if c != "_key"])


def _bracketed(df: DataFrame, keys: list[str], aggs: list[Column], quantiles: dict[str, tuple[str, float]],
               accuracy: int) -> DataFrame:
    """Exact quantiles of groups that are too large for one task.

    Pass 1 computes the plain aggregates and, by mergeable sketches, two values that bracket each
    wanted rank; its one row per group is materialised. Pass 2 counts what lies below each bracket,
    and keeps only the distinct values inside, about 6/accuracy of a group, from which the linear
    interpolation is taken exactly. Groups of at most 2·accuracy rows are bracketed as a whole. If a rank
    lies outside its bracket, all is done again with brackets ten times as wide, at last with whole
    groups. The brackets of few groups are broadcast, so that the rows stay where they are.
    """
    margin = 3.0 / max(accuracy, 1)
    accuracy = max(accuracy, 1)
    columns = sorted({c for c, _ in quantiles.values()})
    brackets = [F.count("*").alias("_rows")]
    edges: dict[tuple[str, float], int] = {}
    for j, c in enumerate(columns):
        shares = sorted({s for col, q in quantiles.values() if col == c
                         for s in (max(q - margin, 0.0), min(q + margin, 1.0))})
        edges.update({(c, s): k for k, s in enumerate(shares)})
        x = F.col(c).cast("double")
        brackets += [F.count(x).alias(f"_n{j}"), F.min(x).alias(f"_min{j}"), F.max(x).alias(f"_max{j}"),
                     F.percentile_approx(x, shares, accuracy).alias(f"_e{j}")]
    helper_columns = ["_rows", *[f"_{p}{j}" for j in range(len(columns)) for p in ("n", "min", "max", "e")]]
    first = cut_lineage(df.groupBy(*keys).agg(*aggs, *brackets))

    slim = df.select(*keys, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    limits = first.select(*keys, *helper_columns[1:])
    if first.count() <= BROADCAST_GROUPS:
        joined = slim.join(F.broadcast(limits), keys)
    else:
        joined = spread_join(slim, limits, keys, counts=(first, "_rows"))
    inside, cells, below = [], [], []
    for i, (c, q) in enumerate(quantiles.values()):
        j = columns.index(c)
        x = F.col(f"_x{j}")
        small = F.col(f"_n{j}") <= 2 * accuracy
        lo, hi = F.col(f"_min{j}"), F.col(f"_max{j}")
        if q - margin > 0:
            lo = F.when(small, lo).otherwise(F.col(f"_e{j}")[edges[c, q - margin]])
        if q + margin < 1:
            hi = F.when(small, hi).otherwise(F.col(f"_e{j}")[edges[c, q + margin]])
        inside.append((x >= lo) & (x <= hi))
        below.append(F.count_if(x < lo).alias(f"_below{i}"))
        cells.append(F.when(inside[-1], F.struct(F.lit(i).alias("_q"), x.alias("_v"))))
    ranks = joined.groupBy(*keys).agg(*below).join(first.select(*keys, *helper_columns[1:]), keys)
    wanted = F.array(*[F.struct(F.lit(i).alias("_q"), F.col(f"_below{i}").alias("_below"),
                                (F.lit(q) * (F.col(f"_n{columns.index(c)}") - 1)).alias("_pos"))
                       for i, (c, q) in enumerate(quantiles.values())])
    ranks = ranks.select(*keys, F.explode(wanted).alias("_w")).select(*keys, "_w.*")
    counted = (joined.filter(reduce(lambda a, b: a | b, inside))
               .select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_c"))
               .select(*keys, "_c.*").groupBy(*keys, "_q", "_v").agg(F.count("*").alias("_k")))
    order = W.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_in", F.sum("_k").over(order)).join(ranks, [*keys, "_q"])
    cum = F.col("_below") + F.col("_in")
    picked = placed.groupBy(*keys, "_q").agg(
        F.max("_pos").alias("_pos"), F.max("_below").alias("_below"),
        F.min(F.when(cum >= F.floor("_pos") + 1, F.col("_v"))).alias("_a"),
        F.min(F.when(cum >= F.ceil("_pos") + 1, F.col("_v"))).alias("_b"))
    sound = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_below") <= F.floor("_pos"))
    picked = cut_lineage(picked.withColumn("_sound", sound))
    if not picked.filter(~F.col("_sound")).isEmpty():
        return _bracketed(df, keys, aggs, quantiles, accuracy // 10)
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    wide = picked.withColumn("_val", value).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_val"))).alias(n) for i, n in enumerate(quantiles)])
    return first.drop(*helper_columns).join(wide, keys, "left")
