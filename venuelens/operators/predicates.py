"""Filters over venues, menu items and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.operators.skew import spread_join


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def venue_filter(districts: list[int] = (), price_levels: list[str] = (), cuisines: list[str] = (),
                 rating: tuple[float, float] = (0.0, 5.0), michelin_only: bool = False, min_reviews: int = 0,
                 max_neighbours: int = 10**9, categories: list[str] = ()) -> Column:
    """Conjunction of the chosen constraints; an empty selection does not constrain.

    The three range tests always run, so rows with a NULL rating, review count or neighbour count drop.
    """
    conditions = [F.col("rating").between(*rating), F.col("reviewCount") >= min_reviews,
                  F.col("nb_restos_500m") <= max_neighbours]
    if districts:
        conditions.append(F.col("arrondissement").isin(list(districts)))
    if price_levels:
        conditions.append(F.col("priceLevel").isin(list(price_levels)))
    if cuisines:
        conditions.append(has_any_label("cuisine_list", cuisines))
    if michelin_only:
        conditions.append(F.col("hasMichelin"))
    if categories:
        conditions.append(has_all_categories(categories))
    return all_of(conditions)


def has_any_label(labels: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.col(labels), F.array(*[F.lit(w) for w in wanted]))


def has_all_categories(categories: list[str]) -> Column:
    return all_of([F.col(f"`{L.CATEGORY_ALIASES.get(c, c)}`") > 0 for c in categories])


def supported_languages(df: DataFrame, column: str = "language") -> DataFrame:
    return df.filter(F.col(column).isin(L.SUPPORTED_LANGUAGES)) if column in df.columns else df


def with_route(df: DataFrame, column: str = "language") -> DataFrame:
    """Mark every row for the primary or the fallback scorer in one pass."""
    if column not in df.columns:
        return df.withColumn("route", F.lit("primary"))
    return df.withColumn("route", F.when(F.col(column).isin(L.SUPPORTED_LANGUAGES), "primary").otherwise("fallback"))


def long_enough(df: DataFrame, column: str = "text", more_than: int = 5) -> DataFrame:
    return df.filter(F.length(column) > more_than)


def min_support(df: DataFrame, n: str, at_least: int) -> DataFrame:
    return df.filter(F.col(n) >= at_least)


def keep_matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Semi-join on a key that may be frequent in ``df``; ``ids`` may repeat."""
    return spread_join(df, ids.select(key).distinct(), [key], "left_semi")


def drop_matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Anti-join by a unique key of ``df``, such as reviews that are already scored."""
    return df.join(ids.select(key), key, "left_anti")


def available_filters(venues: DataFrame, items: DataFrame, top: int = 30) -> DataFrame:
    """One row of choices for the filter widgets.

    Labels are split without trimming here. Districts (in number order) and price levels are code lists.
    """
    from venuelens.functions.scalars import split_labels
    from venuelens.operators.quantiles import grouped_stats
    labels = (venues.select(F.explode(split_labels("cuisines", trim=False)).alias("label"))
              .filter(F.col("label") != "").groupBy("label").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), F.asc("label")).limit(top))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "label")))
    top_labels = labels.agg(F.array_join(F.transform(ordered, lambda s: s["label"]), "|").alias("t")).scalar()
    prices = grouped_stats(items, [], [], {"price_min": ("item_price", 0.01), "price_max": ("item_price", 0.99)})
    ranges = venues.agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(F.col("arrondissement").cast("int"))),
                                 lambda d: d.cast("string")), "|").alias("arrondissements"),
        F.array_join(F.sort_array(F.collect_set("priceLevel")), "|").alias("price_levels"),
        F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        F.max("reviewCount").alias("review_count_max"), F.max("nb_restos_500m").alias("concurrence_max"))
    edge = prices.select(F.struct("price_min", "price_max").alias("p")).scalar()
    return ranges.select("*", F.lit("|".join(L.FILTER_CATEGORIES)).alias("menu_categories"), top_labels.alias("top_cuisines"), edge["price_min"].alias("price_min"),
                         edge["price_max"].alias("price_max"))
