"""Joins between pipeline tables, deduplication and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens.operators.skew import spread_join


def enrich_venues(venues: DataFrame, *tables: DataFrame, key: str = "locationId",
                  zero_filled: tuple[str, ...] = ("nb_items_total", "nb_categories", "shannon_entropy",
                                                  "type_token_ratio")) -> DataFrame:
    """Left-join one-row-per-venue tables and fill the menu columns of venues without menu."""
    joined = reduce(lambda a, b: a.join(b, key, "left"), tables, venues)
    return joined.fillna(0, subset=[c for c in zero_filled if c in joined.columns])


def with_review_details(scored: DataFrame, details: DataFrame, columns: list[str],
                        require: str | None = "publishedDate", key: str = "review_id") -> DataFrame:
    """Look up date, text or title of each review; drop those without ``require``."""
    extra = details.select(key, *columns)
    out = scored.join(extra, key, "left")
    return out.filter(F.col(require).isNotNull()) if require else out


def with_group_value(rows: DataFrame, groups: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Attach one-row-per-group values to many rows, whose groups may be very uneven."""
    return spread_join(rows, groups, [key], how)


def keep_one(df: DataFrame, key: str, *priority: Column) -> DataFrame:
    """First row per key in priority order.

    Spark limits each map task to one row per key before the shuffle, so copies do not pile up.
    """
    w = W.partitionBy(key).orderBy(*priority)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def union_shards(*shards: DataFrame) -> DataFrame:
    """All rows with their shard position, columns matched by name."""
    tagged = [s.withColumn("shard_no", F.lit(i)) for i, s in enumerate(shards)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_shards(*shards: DataFrame, key: str = "review_id", order: Column | None = None) -> DataFrame:
    """Union of shards with the copy of the earliest shard kept."""
    extra = [order] if order is not None else []
    return keep_one(union_shards(*shards), key, F.asc("shard_no"), *extra).drop("shard_no")


def upsert(existing: DataFrame, new: DataFrame, key: str = "review_id") -> DataFrame:
    """Union in which the new row of a key replaces the old one."""
    return keep_one(union_shards(existing, new), key, F.desc("shard_no")).drop("shard_no")


def known_ids(*shards: DataFrame, key: str = "review_id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [s.select(key) for s in shards]).distinct()


def with_price_quality(df: DataFrame, rating: str = "rating", price: str = "price_level_num",
                       out: str = "qp_score") -> DataFrame:
    """Min-max rating divided by the price share of the maximum, over rows with a price."""
    priced = df.filter(F.col(price) > 0)
    g = priced.agg(F.struct(F.min(rating).alias("lo"), F.max(rating).alias("hi"), F.max(price).alias("p"))
                   .alias("g")).scalar()
    score = (F.col(rating) - g["lo"]) / (g["hi"] - g["lo"] + F.lit(0.01)) / (F.col(price) / g["p"])
    return priced.withColumn(out, score)


def with_zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores with the sample deviation, as ``z_<column>``; NULL when it is 0."""
    g = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns],
                        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).alias("g")).scalar()
    return df.select("*", *[((F.col(c) - g[f"m_{c}"]) / F.nullif(g[f"s_{c}"], F.lit(0.0))).alias(f"z_{c}")
                            for c in columns])
