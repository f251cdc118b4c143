"""Aggregates over reviews, venues and their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.functions import scalars as S
from venuelens.operators.joins import with_price_quality, with_zscores
from venuelens.operators.quantiles import grouped_stats


# ---- review level ----------------------------------------------------------------------

def with_sentiment(df: DataFrame) -> DataFrame:
    """Expected stars, class and confidence from the five probabilities."""
    return (df.withColumn("sent_stars_expected", S.expected_stars())
              .withColumn("sent_class", S.top_class()).withColumn("sent_confidence", S.confidence()))


def with_irony(df: DataFrame) -> DataFrame:
    """Irony flag and corrected score; a table without ratings gets no ironic rows."""
    if "rating" not in df.columns:
        return (df.withColumn("is_ironic", F.lit(False))
                  .withColumn("sent_stars_corrected", F.col("sent_stars_expected"))
                  .withColumn("sent_class_corrected", F.col("sent_class")))
    return (df.withColumn("is_ironic", S.is_ironic())
              .withColumn("sent_stars_corrected", S.corrected("is_ironic", "rating", "sent_stars_expected"))
              .withColumn("sent_class_corrected",
                          S.corrected("is_ironic", F.col("rating").cast("int"), "sent_class")))


def backfill_irony(df: DataFrame) -> DataFrame:
    """Fill the three irony columns of older rows and keep those that are set."""
    wanted = ["is_ironic", "sent_stars_corrected", "sent_class_corrected"]
    fresh = with_irony(df.drop(*wanted))
    if "is_ironic" not in df.columns:
        return fresh
    rating = F.col("rating") if "rating" in df.columns else F.lit(None).cast("double")
    flag = F.coalesce("is_ironic", S.is_ironic("sent_class", rating))
    return (df.withColumn("is_ironic", flag)
              .withColumn("sent_stars_corrected", F.coalesce(
                  "sent_stars_corrected", S.corrected("is_ironic", rating, "sent_stars_expected")))
              .withColumn("sent_class_corrected", F.coalesce(
                  "sent_class_corrected", S.corrected("is_ironic", rating.cast("int"), "sent_class"))))


def sentiment_rollup(scored: DataFrame, key: str = "locationId") -> DataFrame:
    """Sentiment per venue, raw and with ironic reviews corrected."""
    df = with_irony(scored.filter(F.col(key).isNotNull()))
    rating = F.avg("rating") if "rating" in df.columns else F.lit(None).cast("double")
    out = grouped_stats(df, [key], [
        F.count("review_id").alias("n_reviews_scored"),
        F.avg("sent_stars_expected").alias("sent_mean"),
        F.stddev_samp("sent_stars_expected").alias("sent_std"),
        S.share_pct(F.col("sent_class") <= 2, null_is_false=True).alias("pct_negative"),
        S.share_pct(F.col("sent_class") >= 4, null_is_false=True).alias("pct_positive"),
        F.avg("sent_confidence").alias("confidence_mean"),
        F.avg("sent_stars_corrected").alias("sent_mean_corrected"),
        F.stddev_samp("sent_stars_corrected").alias("sent_std_corrected"),
        S.share_pct(F.col("sent_class_corrected") <= 2).alias("pct_negative_corrected"),
        S.share_pct(F.col("sent_class_corrected") >= 4).alias("pct_positive_corrected"),
        S.share_pct(F.col("is_ironic")).alias("pct_ironic"),
        rating.alias("rating_mean_reviews"),
    ], {"sent_median": ("sent_stars_expected", 0.5), "sent_median_corrected": ("sent_stars_corrected", 0.5)})
    return (out.withColumn("discordance", F.col("sent_mean") - F.col("rating_mean_reviews"))
               .withColumn("discordance_corrected", F.col("sent_mean_corrected") - F.col("rating_mean_reviews")))


def calibration(df: DataFrame, predicted: str, actual: str, keys: list[str] = (), within: float = 0.5) -> DataFrame:
    """Mean absolute error, bias, correlation and the share within a tolerance, over complete pairs."""
    d = F.col(predicted) - F.col(actual)
    return df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        F.corr(predicted, actual).alias("pearson"), S.share_pct(F.abs(d) <= within).alias("pct_within"))


def language_calibration(df: DataFrame, top: int = 8, min_n: int = 50) -> DataFrame:
    """Calibration of the most frequent languages among rated reviews."""
    per = calibration(df.filter(F.col("language").isNotNull()), "sent_stars_expected", "rating", ["language"])
    return (per.orderBy(F.desc("n"), F.asc("language")).limit(top).filter(F.col("n") >= min_n)
            .select("language", "n", *[F.round(c, 3).alias(c) for c in ("mae", "bias", "pearson")]))


def _tone(score: str = "sent_stars_expected", cls: str = "sent_class") -> list[Column]:
    return [F.avg(score).alias("sent_mean"), F.count("review_id").alias("n"),
            S.share_pct(F.col(cls) <= 2, True).alias("pct_neg"), S.share_pct(F.col(cls) >= 4, True).alias("pct_pos")]


def monthly_trend(dated: DataFrame, date: str = "publishedDate", min_n: int = 50) -> DataFrame:
    return (dated.filter(F.col(date).isNotNull())
            .groupBy(F.date_format(F.trunc(date, "month"), "yyyy-MM-dd").alias("year_month"))
            .agg(*_tone()).filter(F.col("n") >= min_n))


def month_pattern(dated: DataFrame, date: str = "publishedDate") -> DataFrame:
    return (dated.filter(F.col(date).isNotNull()).groupBy(F.month(date).alias("month"))
            .agg(F.avg("sent_stars_expected").alias("mean"), F.count("sent_stars_expected").alias("count"))
            .withColumn("month_name", S.month_name("month")))


def yearly_volume(dated: DataFrame, date: str = "publishedDate") -> DataFrame:
    return dated.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n_avis"))


def yearly_by_venue(dated: DataFrame, key: str = "locationId", date: str = "publishedDate", min_n: int = 20) -> DataFrame:
    """Mean score per venue and year for venues with enough dated reviews."""
    per = (dated.filter(F.col(date).isNotNull()).groupBy(key, F.year(date).alias("year"))
           .agg(F.avg("sent_stars_expected").alias("sent_mean"), F.count("*").alias("n")))
    enough = per.groupBy(key).agg(F.sum("n").alias("total")).filter(F.col("total") >= min_n).select(key)
    return per.join(enough, key, "left_semi")


def class_distribution(scored: DataFrame, key: str = "locationId") -> DataFrame:
    return (scored.filter(F.col(key).isNotNull() & F.col("sent_class").isNotNull())
            .groupBy(key, "sent_class").agg(F.count("*").alias("n")))


def venue_profile(scored: DataFrame, key: str = "locationId") -> DataFrame:
    return scored.filter(F.col(key).isNotNull()).groupBy(key).agg(*_tone())


def confidence_by_class(scored: DataFrame, low: float = 0.4) -> DataFrame:
    return (scored.filter(F.col("sent_class").isNotNull()).groupBy("sent_class")
            .agg(F.avg("sent_confidence").alias("confidence"), F.count("*").alias("n"),
                 F.count_if(F.col("sent_confidence") < low).alias("n_low"))
            .withColumn("label", S.star_label("sent_class")))


def irony_summary(scored: DataFrame) -> DataFrame:
    flag = F.coalesce("is_ironic", F.lit(False))
    return scored.agg(
        F.count_if(flag).alias("n_ironic"), S.share_pct(flag).alias("pct_ironic"),
        F.avg("sent_stars_expected").alias("sent_mean"), F.avg("sent_stars_corrected").alias("sent_mean_corrected"),
        (F.avg("sent_stars_corrected") - F.avg("sent_stars_expected")).alias("delta"))


# ---- venue level -----------------------------------------------------------------------

def sentiment_band(venues: DataFrame) -> DataFrame:
    return venues.agg(
        F.count("*").alias("n_venues"), F.sum("n_reviews_scored").alias("n_reviews"),
        F.avg("sent_mean").alias("sent_mean"), F.avg("pct_positive").alias("pct_positive"),
        F.avg("pct_negative").alias("pct_negative"), F.avg(F.abs("discordance")).alias("mean_abs_discordance"))


def headline(venues: DataFrame) -> DataFrame:
    """Row count, distinct districts, rating mean and median, review sum, flag count."""
    return grouped_stats(venues, [], [
        F.count("*").alias("n_venues"), F.countDistinct("arrondissement").alias("n_districts"),
        F.avg("rating").alias("rating_mean"), F.sum("reviewCount").alias("n_reviews"),
        F.count_if("hasMichelin").alias("n_michelin")], {"rating_median": ("rating", 0.5)})


def group_aggregate(df: DataFrame, key: str, value: str, how: str = "mean") -> DataFrame:
    """Mean, median or count of a column per non-NULL key."""
    data = df.filter(F.col(key).isNotNull())
    if how == "median":
        return grouped_stats(data, [key], [], {"value": (value, 0.5)})
    fn = {"mean": F.avg, "count": F.count}[how]
    return data.groupBy(key).agg(fn(value).alias("value"))


def group_mean_count(df: DataFrame, key: str, value: str, min_n: int = 10) -> DataFrame:
    """Mean and non-NULL count per key with enough rows, highest mean first."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
            .filter(F.col("count") >= min_n).orderBy(F.desc("mean"), F.asc(key)))


def segment_rollup(venues: DataFrame, key: str | Column, name: str = "segment", min_n: int = 1) -> DataFrame:
    """Sentiment of venue segments by a column or a generated label such as ``explode(labels)``."""
    key = F.col(key) if isinstance(key, str) else key
    keep = ["sent_mean", "pct_negative", "pct_positive", "n_reviews_scored"]
    return (venues.select(key.alias(name), *keep).filter(F.col(name).isNotNull()).groupBy(name)
            .agg(F.avg("sent_mean").alias("sent_mean"), F.stddev_samp("sent_mean").alias("sent_std"),
                 F.avg("pct_negative").alias("pct_neg"), F.avg("pct_positive").alias("pct_pos"),
                 F.count("*").alias("n_restos"), F.sum("n_reviews_scored").alias("n_reviews"))
            .filter(F.col("n_restos") >= min_n))


def language_segments(scored: DataFrame, min_n: int = 200) -> DataFrame:
    return (scored.filter(F.col("language").isNotNull()).groupBy("language")
            .agg(F.avg("sent_stars_expected").alias("sent_mean"), F.avg("rating").alias("rating_mean"),
                 F.count("review_id").alias("n"), S.share_pct(F.col("sent_class") <= 2, True).alias("pct_neg"))
            .filter(F.col("n") >= min_n))


def district_map(venues: DataFrame, min_reviews: int = 5, min_venues: int = 3) -> DataFrame:
    """Sentiment and centre of each district with enough venues that have enough reviews."""
    return (venues.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                          & (F.col("n_reviews_scored") >= min_reviews) & F.col("arrondissement").isNotNull())
            .groupBy("arrondissement")
            .agg(F.avg("sent_mean").alias("sent_mean"), F.count("*").alias("n_restos"),
                 F.avg("pct_negative").alias("pct_neg"), F.avg("pct_positive").alias("pct_pos"),
                 F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
            .filter(F.col("n_restos") >= min_venues).withColumn("label", S.ordinal_label("arrondissement")))


def with_ironic_count(venues: DataFrame) -> DataFrame:
    n = F.bround(F.col("n_reviews_scored") * F.coalesce("pct_ironic", F.lit(0.0)) / 100, 0)
    return venues.withColumn("n_ironic", n.cast("int"))


# ---- labels ----------------------------------------------------------------------------

def label_counts(df: DataFrame, labels: str = "cuisine_list", top_n: int | None = None) -> DataFrame:
    out = (df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), F.asc("label")))
    return out.limit(top_n) if top_n else out


def label_entropy(df: DataFrame, labels: str = "cuisine_list") -> DataFrame:
    """Natural-log entropy of all label occurrences: ln N - sum(n ln n)/N."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    return counts.agg((F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)).alias("entropy"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100 / total)


def label_dispersion(df: DataFrame, labels: str = "cuisine_list", value: str = "rating") -> DataFrame:
    return (df.select(F.explode(labels).alias("label"), value).groupBy("label")
            .agg(F.stddev_samp(value).alias("std"), F.count(value).alias("n")))


def most_dispersed(df: DataFrame, labels: str = "cuisine_list", value: str = "rating") -> DataFrame:
    """Label with the largest deviation and the range of deviations, when two labels have one."""
    per = label_dispersion(df, labels, value).filter(F.col("std").isNotNull())
    best = F.min_by("label", F.struct((-F.col("std")).alias("s"), "label"))
    return (per.agg(best.alias("label"), F.max("std").alias("std_max"),
                    (F.max("std") - F.min("std")).alias("std_range"), F.count("*").alias("n_labels"))
            .filter(F.col("n_labels") >= 2))


def label_pairs(df: DataFrame, labels: str = "cuisine_list") -> DataFrame:
    """How many venues carry both labels of each pair; pairs come from the few labels of one row."""
    ordered = F.array_sort(F.array_distinct(labels))
    pairs = F.flatten(F.transform(ordered, lambda a, i: F.transform(
        F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0))),
        lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    return (df.select(F.explode(pairs).alias("p")).groupBy("p.label_a", "p.label_b")
            .agg(F.count("*").alias("n")))


# ---- summaries -------------------------------------------------------------------------

def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, exact quartiles, extremes and interquartile range per column."""
    x = {f"_c{i}": F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)}
    made = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    wide = grouped_stats(df.select(*x.values()), [], [f(c).alias(f"{name}{c}") for c in x for name, f in made.items()],
                         {f"{name}{c}": (c, q) for c in x for name, q in shares.items()})
    # one row holds all figures; it is turned into a row per column
    cells = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}_c{i}").alias(name) for name in (*made, *shares)])
             for i, c in enumerate(columns)]
    out = wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("count") > 0)
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def venue_statistics(venues: DataFrame) -> DataFrame:
    """Counts, rating statistics and correlations over venues with a menu."""
    menu = F.col("nb_items_total") > 0
    on_menu = lambda c: F.when(menu, F.col(c))
    zero = lambda c: F.when(menu, F.coalesce(c, F.lit(0)).cast("double"))
    r = on_menu("rating")
    return grouped_stats(venues, [], [
        F.count("*").alias("n_venues"), F.count("rating").alias("n_rated"), F.count_if(menu).alias("n_menu"),
        F.avg("rating").alias("rating_mean"), F.stddev_samp("rating").alias("rating_std"),
        F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        F.avg(on_menu("nb_items_total")).alias("items_mean"), F.stddev_samp(on_menu("nb_items_total")).alias("items_std"),
        F.avg(on_menu("nb_categories")).alias("categories_mean"), F.avg(on_menu("shannon_entropy")).alias("entropy_mean"),
        F.corr(r, on_menu("nb_items_total").cast("double")).alias("corr_items"),
        F.corr(r, on_menu("shannon_entropy")).alias("corr_entropy"),
        F.corr(r, zero("nb_restos_500m")).alias("corr_competition"),
        F.corr(r, zero("seasonality_score")).alias("corr_seasonality")], {"rating_median": ("rating", 0.5)})


def kpis(venues: DataFrame, all_venues: DataFrame) -> DataFrame:
    """One row of headline figures of a selection against the whole table."""
    tie = F.col("locationId")
    best = with_price_quality(venues.filter(F.col("rating").isNotNull())).agg(
        F.min_by("name", F.struct((-F.col("qp_score")).alias("s"), tie.alias("i"))).alias("v")).scalar()
    z = F.col("z_rating") + F.col("z_reviewCount")
    popular = with_zscores(venues, ["rating", "reviewCount"]).filter(z.isNotNull()).agg(
        F.min_by("name", F.struct((-z).alias("s"), tie.alias("i"))).alias("v")).scalar()
    overall = all_venues.agg(F.avg("rating")).scalar()
    polar = most_dispersed(venues).select(F.struct("label", "std_range").alias("v")).scalar()
    entropy = label_entropy(venues).scalar()
    return venues.agg(F.avg("rating").alias("avg_rating")).select(
        S.short_name(best, 30).alias("best_qp"), "avg_rating",
        F.round(F.col("avg_rating") - overall, 2).alias("avg_rating_delta"),
        polar["label"].alias("polarizing_cuisine"), polar["std_range"].alias("polarizing_range"),
        entropy.alias("diversity"), S.short_name(popular, 35).alias("most_popular"))


def ingest_profile(reviews: DataFrame) -> DataFrame:
    """Rows, venues, languages and the date span of an ingest."""
    return reviews.agg(
        F.count("*").alias("n_reviews"), F.countDistinct("locationId").alias("n_venues"),
        F.countDistinct("language").alias("n_languages"), F.count("rating").alias("n_rated"),
        F.date_format(F.min("publishedDate"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("publishedDate"), "yyyy-MM-dd").alias("last_date"),
        (F.count("rating") * 100 / F.count("*")).alias("pct_rated"))


def ingest_counts(reviews: DataFrame, venues: DataFrame, errors: DataFrame) -> DataFrame:
    """Exact counts of an ingest as (kind, name, n): reviews by language, venues by district, venues with and without a district, skipped
    files by reason."""
    resolved = F.when(F.col("arrondissement").isNotNull(), "resolved").otherwise("unresolved")

    def counted(df: DataFrame, kind: str, name: Column) -> DataFrame:
        return df.groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    return (counted(reviews, "language", F.coalesce("language", F.lit("unknown")))
            .unionByName(counted(venues.filter(F.col("arrondissement").isNotNull()), "district", F.col("arrondissement").cast("int")))
            .unionByName(counted(venues, "resolution", resolved)).unionByName(counted(errors, "skipped", F.col("error"))))


#: Size of the distinct sketches (2 to this power of registers) and the relative error that four deviations of it stay below.
DISTINCT_BITS = 14
DISTINCT_ERROR = 4 * 1.04 / 2 ** (DISTINCT_BITS / 2)


def distinct_sketches(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """One mergeable sketch of the different values of each column, by ``keys`` (a shard, say): a few kilobytes, whatever the rows."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT_BITS)).alias(c) for c in columns])


def distinct_estimates(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """(name, estimate) of the different values of each column over all stored sketches together."""
    row = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("estimate")) for c in columns])).alias("e")).select("e.*")
