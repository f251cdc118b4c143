"""Report tables with definitions of our own: rankings, outliers, prices, clusters and narrative."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators import ordering as O
from venuelens.operators import stats
from venuelens.operators.quantiles import grouped_stats
from venuelens.operators.skew import spread_join
from venuelens.session import cut_lineage
from venuelens.sources.tables import stored_and_spread


def rankings(df: DataFrame, group: str, metric: str, key: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Rank, row number (ties by id) and percent rank of every row in its group, highest first.

    Built on bucketed running totals, so a group of any size is spread over tasks.
    """
    data = df.filter(F.col(group).isNotNull() & F.col(metric).isNotNull()).select(
        key, group, metric, (-F.col(metric)).alias("_m"))
    counts = cut_lineage(O.value_counts(data, [group, "_m"]))
    cum = O.running_total(counts, [group], [F.col("_m")], "n", "_cum", "_m", O.value_bounds(counts, "_m", rows_per_bucket))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("_size"))
    ranks = spread_join(cum, sizes, [group]).select(group, "_m", "_size", (F.col("_cum") - F.col("n") + 1).alias("rank"))
    placed = O.running_total(data, [group, "_m"], [F.col(key)], F.lit(1), "_pos", key, O.value_bounds(data, key, rows_per_bucket))
    out = spread_join(placed, ranks, [group, "_m"], counts=(counts, "n"))
    return out.select(key, group, metric, "rank", (F.col("rank") + F.col("_pos") - 1).alias("row_no"),
                      F.when(F.col("_size") > 1, (F.col("rank") - 1) / (F.col("_size") - 1)).otherwise(0.0).alias("percent_rank"))


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and deviation by each single key and overall, in one grouping-sets aggregate."""
    out = df.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_gid"), F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"))
    width = len(keys)
    level = F.lit("all")
    member = F.lit("all")
    for i, k in enumerate(keys):
        chosen = F.col("_gid").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0
        level = F.when(chosen, F.lit(k)).otherwise(level)
        member = F.when(chosen, F.col(k).cast("string")).otherwise(member)
    return out.select(level.alias("level"), member.alias("member"), "n", "mean", "std").filter(
        F.col("member").isNotNull())


def price_analysis(items: DataFrame, keys: list[str], price: str = "item_price") -> DataFrame:
    data = items.filter(F.col(price).isNotNull())
    for k in keys:
        data = data.filter(F.col(k).isNotNull())
    return grouped_stats(data, keys, [F.count(price).alias("n"), F.avg(price).alias("mean")],
                         {"q25": (price, 0.25), "median": (price, 0.5), "q75": (price, 0.75)})


def outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows outside the 1.5·IQR fences or more than three deviations from the mean."""
    g = grouped_stats(df, [], [F.avg(value).alias("m"), F.stddev_samp(value).alias("s")],
                      {"q1": (value, 0.25), "q3": (value, 0.75)}).select(F.struct("*").alias("g")).scalar()
    iqr = g["q3"] - g["q1"]
    x = F.col(value)
    out = df.filter(x.isNotNull()).select(
        key, value, ((x < g["q1"] - 1.5 * iqr) | (x > g["q3"] + 1.5 * iqr)).alias("tukey"),
        (F.abs((x - g["m"]) / F.nullif(g["s"], F.lit(0.0))) > 3).alias("z3"))
    return out.filter(F.col("tukey") | F.col("z3"))


def label_analysis(venues: DataFrame, labels: str = "cuisine_list", value: str = "rating") -> DataFrame:
    return (venues.select(F.explode(labels).alias("label"), value, "reviewCount").groupBy("label")
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.sum("reviewCount").alias("n_reviews")))


def label_prices(venues: DataFrame, items: DataFrame, key: str = "locationId", labels: str = "cuisine_list",
                 price: str = "item_price") -> DataFrame:
    """Item prices per venue label; items are reduced to sums per venue before the labels fan out."""
    per = (items.filter(F.col(price).isNotNull() & F.col(key).isNotNull()).groupBy(key)
           .agg(F.count(price).alias("_n"), F.sum(price).alias("_s"), F.min(price).alias("_lo"), F.max(price).alias("_hi")))
    return (venues.select(key, F.explode(labels).alias("label")).join(per, key).groupBy("label")
            .agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"),
                 F.min("_lo").alias("min"), F.max("_hi").alias("max")))


def flag_analysis(venues: DataFrame, flag: str = "hasMichelin") -> DataFrame:
    return (venues.filter(F.col(flag).isNotNull()).groupBy(flag)
            .agg(F.count("*").alias("n"), F.avg("rating").alias("rating_mean"), F.stddev_samp("rating").alias("rating_std"),
                 F.avg("price_level_num").alias("price_mean"), F.avg("nb_items_total").alias("items_mean"))
            .withColumn("label", S.flag_label(flag)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of every pair plus Spearman, one row per pair."""
    return stats.spearman_matrix(df, columns)


def multiple_regression(df: DataFrame, predictors: list[str], target: str) -> DataFrame:
    """Least-squares coefficients with intercept, one row per term."""
    data = df.na.drop(subset=[*predictors, target]).select(
        *[F.col(c).cast("double").alias(c) for c in [*predictors, target]])
    vectors = VectorAssembler(inputCols=predictors, outputCol="features").transform(data)
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal").fit(vectors)
    terms = [("intercept", float(model.intercept)), *zip(predictors, map(float, model.coefficients))]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def spatial_clusters(venues: DataFrame, k: int = 8, steps: int = 10, key: str = "locationId") -> tuple[DataFrame, DataFrame]:
    """K-means on coordinates by a fixed number of Lloyd steps: venue labels and cluster centres.

    The first centres are the k venues with the smallest ids. A venue belongs to the nearest centre, the first of
    equally near ones; a centre without venues stays. Only the k centres pass through the driver.
    """
    data = stored_and_spread(venues.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
                             .select(key, "latitude", "longitude"), key)
    centres = [(r["latitude"], r["longitude"]) for r in data.orderBy(key).limit(k).collect()]
    if not centres:
        return (data.select(key, F.lit(None).cast("int").alias("cluster")),
                data.select(F.lit(None).cast("int").alias("cluster"), "latitude", "longitude"))

    def labelled() -> DataFrame:
        near = [F.struct((F.pow(F.col("latitude") - a, F.lit(2)) + F.pow(F.col("longitude") - b, F.lit(2))).alias("d"),
                         F.lit(i).alias("i")) for i, (a, b) in enumerate(centres)]
        return data.withColumn("cluster", F.array_min(F.array(*near))["i"])

    for _ in range(steps):
        means = labelled().groupBy("cluster").agg(F.avg("latitude").alias("a"), F.avg("longitude").alias("b")).collect()
        for r in means:
            centres[r["cluster"]] = (r["a"], r["b"])
    rows = [(i, a, b) for i, (a, b) in enumerate(centres)]
    return (labelled().select(key, "cluster"),
            venues.sparkSession.createDataFrame(rows, "cluster int, latitude double, longitude double"))


def lexicon_sentiment(reviews: DataFrame, key: str = "locationId", text: str = "text") -> DataFrame:
    """Positive and negative word counts per venue over whole texts."""
    return (reviews.filter(F.col(key).isNotNull())
            .select(key, S.count_words(text, L.POSITIVE_TERMS).alias("p"), S.count_words(text, L.NEGATIVE_TERMS).alias("m"))
            .groupBy(key).agg(F.sum("p").alias("n_positive"), F.sum("m").alias("n_negative"),
                              F.avg(F.col("p") - F.col("m")).alias("mean_balance")))


# How many bullets of each kind a narrative shows.
NARRATIVE_LIMITS = {"contrast": 4, "anticorrelation": 2, "recommendation": 2}


def limit_bullets(facts: DataFrame) -> DataFrame:
    """Keep the first bullets of each kind by rank; ``facts`` has kind, rank and text."""
    w = W.partitionBy("kind").orderBy("rank", "text")
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in NARRATIVE_LIMITS.items()], F.lit(1))
    most = max(NARRATIVE_LIMITS.values())
    return (facts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
            .filter(F.col("position") <= allowed).select("kind", "position", "text"))


def narrative(venues: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Summary sentence, district contrasts, negative correlations and best-value venues as bullets.

    A contrast is marked where its district differs from all others, corrected for testing every district.
    """
    from venuelens.operators.joins import with_price_quality
    from venuelens.operators.rollups import headline
    one = headline(venues)
    summary = one.select(F.lit("summary").alias("kind"), F.lit(1).alias("rank"), F.format_string(
        L.SUMMARY_TEXT, "n_venues", "n_districts", "rating_mean", "rating_median").alias("text"))
    mean = venues.agg(F.avg("rating")).scalar()
    contrasts = (stats.group_contrasts(venues, "arrondissement", "rating", alpha).filter(F.col("n") >= 5)
                 .withColumn("size", F.round(F.abs(F.col("mean") - mean), 6)).orderBy(F.desc("size"), F.asc("group")).limit(4)
                 .select(F.lit("contrast").alias("kind"), (-F.col("size")).alias("rank"), F.concat(
                     F.format_string(L.CONTRAST_TEXT, F.col("group").cast("int"), "mean"),
                     F.when(F.col("significant"), L.SIGNIFICANT_TEXT).otherwise("")).alias("text")))
    corr = stats.pearson_matrix(venues, ["rating", "reviewCount", "nb_items_total", "nb_restos_500m"])
    anti = corr.filter(F.col("pearson") < 0).select(
        F.lit("anticorrelation").alias("kind"), F.round("pearson", 6).alias("rank"),
        F.format_string(L.ANTICORRELATION_TEXT, "y", "x").alias("text"))
    scored = with_price_quality(venues.filter(F.col("rating").isNotNull())).withColumn("s", F.round("qp_score", 6))
    best = scored.orderBy(F.desc("s"), F.asc("locationId")).limit(3).withColumn(
        "k", F.struct((-F.col("s")).alias("s"), F.col("locationId").alias("i")))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda v: v["name"]), ", ")
    advice = best.agg(F.concat(F.lit(L.BEST_VALUE_TEXT), names).alias("text")).select(
        F.lit("recommendation").alias("kind"), F.lit(1.0).alias("rank"), "text")
    facts = summary.withColumn("rank", F.lit(0.0))
    for part in (contrasts, anti, advice):
        facts = facts.unionByName(part)
    return limit_bullets(facts)
