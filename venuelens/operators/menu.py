"""Menu analytics: classification, diversity and seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators.quantiles import grouped_stats
from venuelens.operators.skew import spread_join


def price_calibration(prices: DataFrame, key: str = "locationId", price: str = "price") -> DataFrame:
    """Per venue, the number of its prices and their 33 % and 67 % quantiles."""
    known = prices.filter(F.col(price).isNotNull() & F.col(key).isNotNull())
    return grouped_stats(known, [key], [F.count(price).alias("n_prices")],
                         {"price_q33": (price, 0.33), "price_q67": (price, 0.67)})


def classify_items(items: DataFrame, prices: DataFrame, key: str = "locationId") -> DataFrame:
    """Add ``category`` to items with title, description and price."""
    calibrated = spread_join(items, price_calibration(prices, key), [key], "left")
    return calibrated.withColumn("category", S.item_category(
        "item_title", "item_description", S.menu_category("menu_title"), "item_price",
        F.coalesce("n_prices", F.lit(0)), "price_q33", "price_q67")).drop("n_prices", "price_q33", "price_q67")


def menu_items(parsed: DataFrame) -> DataFrame:
    """Item table from parsed menus: first price per item, all prices of a venue for calibration."""
    prices = (parsed.select("locationId", F.explode("price_texts").alias("t"))
              .select("locationId", S.clean_price("t").alias("price")))
    items = parsed.withColumn("item_price", S.clean_price(F.get("price_texts", F.lit(0)))).drop("price_texts")
    return classify_items(items, prices)


def category_counts(items: DataFrame, key: str = "locationId", category: str = "category") -> DataFrame:
    """Items per category, in total, and the number of courses present."""
    counts = [F.count_if(F.col(category) == c).alias(c) for c in L.CATEGORIES]
    courses = sum((F.col(c) > 0).cast("int") for c in L.COURSE_CATEGORIES)
    return (items.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(category).alias("nb_items_total"), *counts)
            .withColumn("nb_categories", courses))


def with_entropy(counts: DataFrame, columns: list[str] = L.COURSE_CATEGORIES, out: str = "shannon_entropy") -> DataFrame:
    """Natural-log entropy of the class shares; 0 when there is nothing."""
    total = sum(F.col(c) for c in columns)
    terms = [F.when(F.col(c) > 0, -(F.col(c) / total) * F.ln(F.col(c) / total)).otherwise(0.0) for c in columns]
    return counts.withColumn(out, sum(terms))


def type_token_ratio(rows: DataFrame, text: str, key: str = "locationId", out: str = "type_token_ratio") -> DataFrame:
    """Distinct share of word tokens per group, 0 without tokens.

    Words are counted per (group, word) first, so neither step gathers a group.
    """
    data = rows.filter(F.col(key).isNotNull())
    words = (data.select(key, F.explode_outer(S.tokens(text)).alias("w")).groupBy(key, "w")
             .agg(F.count("w").alias("n")))
    return words.groupBy(key).agg(
        F.coalesce(F.count("w") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias(out))


def menu_diversity(items: DataFrame, key: str = "locationId") -> DataFrame:
    out = with_entropy(category_counts(items, key)).join(type_token_ratio(items, "item_title", key), key)
    return out.select(key, "nb_items_total", "nb_categories", *L.CATEGORIES, "shannon_entropy", "type_token_ratio")


def season_hits(rows: DataFrame, text: str = "text", key: str = "locationId") -> DataFrame:
    """``(venue, season, term, n)``: in how many rows each seasonal term occurs.

    Terms are looked up per row; the one term of two words is not matched across two items.
    """
    return (rows.filter(F.col(key).isNotNull()).select(key, F.lower(F.col(text)).alias("_t"))
            .select(key, F.explode(S.terms_in(F.col("_t"), L.SEASON_TERMS)).alias("h"))
            .groupBy(key, F.col("h.season").alias("season"), F.col("h.term").alias("term"))
            .agg(F.count("*").alias("n")))


def seasonality(rows: DataFrame, text: str = "text", key: str = "locationId") -> DataFrame:
    """Distinct seasonal terms per venue and season, their ratio to the item count, and the best ratio."""
    seasons = list(L.SEASON_TERMS)
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    per = season_hits(rows, text, key).groupBy(key).agg(
        *[F.count_if(F.col("season") == s).cast("int").alias(f"seasonal_{s}") for s in seasons])
    out = sizes.join(per, key, "left").fillna(0, [f"seasonal_{s}" for s in seasons])
    for s in seasons:
        out = out.withColumn(f"seasonal_{s}_ratio", F.col(f"seasonal_{s}") / F.col("_n"))
    return out.select(key, *[c for s in seasons for c in (f"seasonal_{s}", f"seasonal_{s}_ratio")],
                      sum(F.col(f"seasonal_{s}") for s in seasons).alias("seasonal_items_total"),
                      F.greatest(*[f"seasonal_{s}_ratio" for s in seasons]).alias("seasonality_score"))
