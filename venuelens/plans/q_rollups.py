"""Queries over aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens.operators import menu as M
from venuelens.operators import rollups as R
from venuelens.plans import bindings as B
from venuelens.plans.q_joins import DIVERSITY_SQL, ITEM_TEXTS, REVIEW_TEXTS, season_hits_sql
from venuelens.plans.q_sources import venue_documents
from venuelens.plans.registry import query
from venuelens.session import scratch_path
from venuelens.sources import documents as D

V, RV, SC, IT, MG = B.VENUES_SQL, B.REVIEWS_SQL, B.SCORED_SQL, B.ITEMS_SQL, B.MERGED_SQL


@query("d1_sentiment_rollup", f"""WITH {SC} {B.rollup_sql('source')}""", doubles=B.ROLLUP_COLUMNS)
def _(spark, sf):
    return R.sentiment_rollup(B.scored(spark, sf), "source")


@query("d1_hot_venue_rollup", f"""WITH {SC} {B.rollup_sql('"locationId"')}""", doubles=B.ROLLUP_COLUMNS)
def _(spark, sf):
    return R.sentiment_rollup(B.scored(spark, sf))


@query("d3_category_counts", f"""WITH {IT}, {DIVERSITY_SQL} SELECT "locationId", nb_items_total, "entrée", plat, dessert, boisson, formule, autre, nb_categories FROM diversity""")
def _(spark, sf):
    return M.category_counts(B.items(spark, sf))


@query("d4_course_entropy", f"""WITH {V} SELECT "locationId", CASE WHEN "entrée" > 0 THEN -("entrée"/t)*ln("entrée"/t) ELSE 0 END
  + CASE WHEN plat > 0 THEN -(plat/t)*ln(plat/t) ELSE 0 END + CASE WHEN dessert > 0 THEN -(dessert/t)*ln(dessert/t) ELSE 0 END AS h
  FROM (SELECT *, CAST("entrée" + plat + dessert AS DOUBLE) AS t FROM venues)""", doubles="h")
def _(spark, sf):
    return M.with_entropy(B.venues(spark, sf), out="h").select("locationId", "h")


@query("d5_type_token_ratio", r"""WITH words AS (SELECT source, w FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS w FROM documents) WHERE length(w) > 2)
  SELECT source, count(DISTINCT w) / CAST(count(*) AS DOUBLE) AS ttr FROM words GROUP BY 1""", doubles="ttr")
def _(spark, sf):
    return M.type_token_ratio(B.documents(spark, sf), "text", "source", "ttr")


@query("d5_menu_diversity", f"""WITH {IT}, {DIVERSITY_SQL} SELECT * FROM diversity""", doubles="shannon_entropy type_token_ratio")
def _(spark, sf):
    return M.menu_diversity(B.items(spark, sf))


def seasonality_sql(texts: str) -> str:
    seasons = ["printemps", "été", "automne", "hiver"]
    n = {s: f"count(*) FILTER (season = '{s}')" for s in seasons}
    return f"""{season_hits_sql(texts)}, sizes AS (SELECT "locationId", count(*) AS k FROM texts GROUP BY 1),
  per AS (SELECT s."locationId", k, {', '.join(f'CAST({n[s]} AS INTEGER) AS "seasonal_{s}"' for s in seasons)} FROM sizes s LEFT JOIN hits h USING ("locationId") GROUP BY 1, 2)
  SELECT "locationId", {', '.join(f'"seasonal_{s}", "seasonal_{s}" / CAST(k AS DOUBLE) AS "seasonal_{s}_ratio"' for s in seasons)},
  CAST({' + '.join(f'"seasonal_{s}"' for s in seasons)} AS INTEGER) AS seasonal_items_total,
  greatest({', '.join(f'"seasonal_{s}"' for s in seasons)}) / CAST(k AS DOUBLE) AS seasonality_score FROM per"""


RATIOS = "seasonal_printemps_ratio seasonal_été_ratio seasonal_automne_ratio seasonal_hiver_ratio seasonality_score"


@query("d6_seasonality", f"""WITH {B.PARSED_ITEMS_SQL}, {seasonality_sql(ITEM_TEXTS)}""", doubles=RATIOS)
def _(spark, sf):
    from venuelens.functions.scalars import item_text
    i = B.parsed_items(spark, sf).select("locationId", item_text("item_title", "item_description").alias("text"))
    return M.seasonality(i)


@query("d6_review_seasonality", f"""WITH {RV}, {seasonality_sql(REVIEW_TEXTS)}""", doubles=RATIOS)
def _(spark, sf):
    return M.seasonality(B.reviews(spark, sf, spread=True))


@query("d7_label_entropy", f"""WITH {V}, c AS (SELECT label, count(*) AS n FROM labels_of GROUP BY 1), p AS (SELECT n / CAST((SELECT sum(n) FROM c) AS DOUBLE) AS p FROM c)
  SELECT -sum(p * ln(p)) AS entropy FROM p""", doubles="entropy")
def _(spark, sf):
    return R.label_entropy(B.venues(spark, sf))


@query("d8_label_counts", f"""WITH {V} SELECT label, count(*) AS n FROM labels_of GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, sf):
    return R.label_counts(B.venues(spark, sf), top_n=5)


@query("d9_value_shares", """SELECT o_orderstatus AS value, count(*) AS n, count(*) * 100e0 / (SELECT count(*) FROM orders) AS pct FROM orders GROUP BY 1""", doubles="pct")
def _(spark, sf):
    return R.value_shares(B.table(spark, sf, "orders", ["o_orderstatus"]), "o_orderstatus")


@query("d10_group_aggregate", f"""WITH {V} SELECT arrondissement, avg(rating) AS mean, median(rating) AS median, count(rating) AS count FROM venues
  WHERE arrondissement IS NOT NULL GROUP BY 1""", doubles="mean median")
def _(spark, sf):
    v = B.venues(spark, sf)
    parts = [R.group_aggregate(v, "arrondissement", "rating", how).withColumnRenamed("value", how) for how in ("mean", "median", "count")]
    return parts[0].join(parts[1], "arrondissement").join(parts[2], "arrondissement")


@query("d11_group_mean_count", f"""WITH {V} SELECT arrondissement, avg(rating) AS mean, count(rating) AS count FROM venues WHERE arrondissement IS NOT NULL
  GROUP BY 1 HAVING count(rating) >= 5""", doubles="mean")
def _(spark, sf):
    return R.group_mean_count(B.venues(spark, sf), "arrondissement", "rating", 5)


LI = ["l_quantity", "l_extendedprice", "l_discount"]


@query("d12_describe", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM lineitem"""
                                          for c in LI), doubles="mean std min max q25 q50 q75 iqr")
def _(spark, sf):
    return R.describe(B.table(spark, sf, "lineitem", LI), LI)


@query("d13_venue_statistics", f"""WITH {V}, m AS (SELECT * FROM venues WHERE nb_items_total > 0) SELECT count(*) AS n_venues, count(rating) AS n_rated,
  count(*) FILTER (nb_items_total > 0) AS n_menu, avg(rating) AS rating_mean, stddev_samp(rating) AS rating_std, min(rating) AS rating_min, max(rating) AS rating_max,
  (SELECT avg(nb_items_total) FROM m) AS items_mean, (SELECT stddev_samp(nb_items_total) FROM m) AS items_std, (SELECT avg(nb_categories) FROM m) AS categories_mean,
  (SELECT avg(shannon_entropy) FROM m) AS entropy_mean, (SELECT corr(rating, nb_items_total) FROM m) AS corr_items, (SELECT corr(rating, shannon_entropy) FROM m) AS corr_entropy,
  (SELECT corr(rating, coalesce(nb_restos_500m, 0)) FROM m) AS corr_competition, (SELECT corr(rating, coalesce(seasonality_score, 0)) FROM m) AS corr_seasonality,
  median(rating) AS rating_median FROM venues""", doubles="rating_mean rating_std rating_min rating_max items_mean items_std categories_mean entropy_mean corr_items corr_entropy corr_competition corr_seasonality rating_median")
def _(spark, sf):
    return R.venue_statistics(B.venues(spark, sf))


@query("d14_kpis", f"""WITH {V}, sel AS (SELECT * FROM venues WHERE "reviewCount" >= 20 AND rating IS NOT NULL),
  qs AS (SELECT *, ((rating - (SELECT min(rating) FROM sel WHERE price_level_num > 0)) / ((SELECT max(rating) - min(rating) FROM sel WHERE price_level_num > 0) + 0.01e0))
   / (price_level_num / (SELECT CAST(max(price_level_num) AS DOUBLE) FROM sel WHERE price_level_num > 0)) AS s FROM sel WHERE price_level_num > 0),
  lab AS (SELECT l.label, stddev_samp(rating) AS sd, count(*) AS n FROM sel JOIN labels_of l USING ("locationId") GROUP BY 1),
  sh AS (SELECT n / CAST((SELECT sum(n) FROM lab) AS DOUBLE) AS p FROM lab),
  zs AS (SELECT name, "locationId", (rating - (SELECT avg(rating) FROM sel)) / (SELECT stddev_samp(rating) FROM sel)
    + ("reviewCount" - (SELECT avg("reviewCount") FROM sel)) / (SELECT stddev_samp("reviewCount") FROM sel) AS z FROM sel)
  SELECT (SELECT substr(name, 1, 30) FROM qs ORDER BY s DESC, "locationId" LIMIT 1) AS best_qp, (SELECT avg(rating) FROM sel) AS avg_rating,
  round((SELECT avg(rating) FROM sel) - (SELECT avg(rating) FROM venues), 2) AS avg_rating_delta,
  (SELECT label FROM lab WHERE sd IS NOT NULL ORDER BY sd DESC, label LIMIT 1) AS polarizing_cuisine, (SELECT max(sd) - min(sd) FROM lab) AS polarizing_range,
  (SELECT -sum(p * ln(p)) FROM sh) AS diversity, (SELECT substr(name, 1, 35) FROM zs ORDER BY z DESC, "locationId" LIMIT 1) AS most_popular""",
       doubles="avg_rating avg_rating_delta polarizing_range diversity")
def _(spark, sf):
    v = B.venues(spark, sf)
    return R.kpis(v.filter('reviewCount >= 20 AND rating IS NOT NULL'), v)


@query("d15_label_dispersion", f"""WITH {V} SELECT label, stddev_samp(rating) AS std, count(rating) AS n FROM venues JOIN labels_of USING ("locationId") GROUP BY 1""", doubles="std")
def _(spark, sf):
    return R.label_dispersion(B.venues(spark, sf))


CAL = """count(*) AS n, avg(abs(p - r)) AS mae, avg(p - r) AS bias, corr(p, r) AS pearson, avg(CASE WHEN abs(p - r) <= {w} THEN 1e0 ELSE 0e0 END)*100 AS pct_within"""


@query("d16_venue_calibration", f"""WITH {MG}, x AS (SELECT sent_mean AS p, rating AS r FROM merged WHERE sent_mean IS NOT NULL AND rating IS NOT NULL) SELECT {CAL.format(w='0.5')} FROM x""",
       doubles="mae bias pearson pct_within")
def _(spark, sf):
    return R.calibration(B.venue_sentiment(spark, sf), "sent_mean", "rating")


@query("d16_review_calibration", f"""WITH {SC}, x AS (SELECT sent_stars_expected AS p, rating AS r FROM scored WHERE rating IS NOT NULL) SELECT {CAL.format(w='1')} FROM x""",
       doubles="mae bias pearson pct_within")
def _(spark, sf):
    return R.calibration(B.scored(spark, sf), "sent_stars_expected", "rating", within=1.0)


@query("d17_language_calibration", f"""WITH {SC}, x AS (SELECT language, sent_stars_expected AS p, rating AS r FROM scored WHERE rating IS NOT NULL AND language IS NOT NULL),
  t AS (SELECT language, count(*) AS n, round(avg(abs(p - r)), 3) AS mae, round(avg(p - r), 3) AS bias, round(corr(p, r), 3) AS pearson FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
  SELECT * FROM t WHERE n >= 20""", doubles="mae bias pearson")
def _(spark, sf):
    return R.language_calibration(B.scored(spark, sf), min_n=20)


TONE = """avg(sent_stars_expected) AS sent_mean, count(review_id) AS n, avg(CASE WHEN sent_class <= 2 THEN 1e0 ELSE 0e0 END)*100 AS pct_neg,
  avg(CASE WHEN sent_class >= 4 THEN 1e0 ELSE 0e0 END)*100 AS pct_pos"""


@query("d18_monthly_trend", f"""WITH {SC} SELECT strftime(date_trunc('month', "publishedDate"), '%Y-%m-%d') AS year_month, {TONE} FROM scored
  WHERE "publishedDate" IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""", doubles="sent_mean pct_neg pct_pos")
def _(spark, sf):
    return R.monthly_trend(B.scored(spark, sf), min_n=3)


@query("d18_order_months", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS year_month, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1""", doubles="mean")
def _(spark, sf):
    o = B.table(spark, sf, "orders", ["o_orderdate", "o_totalprice"])
    return o.groupBy(F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("year_month")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


@query("d19_month_pattern", f"""WITH {SC} SELECT CAST(month("publishedDate") AS INTEGER) AS month, avg(sent_stars_expected) AS mean, count(sent_stars_expected) AS count,
  ['Jan','Fév','Mar','Avr','Mai','Juin','Juil','Août','Sep','Oct','Nov','Déc'][month("publishedDate")] AS month_name FROM scored WHERE "publishedDate" IS NOT NULL GROUP BY month("publishedDate")""", doubles="mean")
def _(spark, sf):
    return R.month_pattern(B.scored(spark, sf))


@query("d19_yearly_volume", f"""WITH {SC} SELECT CAST(year("publishedDate") AS INTEGER) AS year, count(*) AS n_avis FROM scored WHERE "publishedDate" IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return R.yearly_volume(B.scored(spark, sf))


@query("d19_yearly_by_venue", f"""WITH {SC}, d AS (SELECT * FROM scored WHERE "publishedDate" IS NOT NULL)
  SELECT "locationId", CAST(year("publishedDate") AS INTEGER) AS year, avg(sent_stars_expected) AS sent_mean, count(*) AS n FROM d
  WHERE "locationId" IN (SELECT "locationId" FROM d GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2""", doubles="sent_mean")
def _(spark, sf):
    return R.yearly_by_venue(B.scored(spark, sf), min_n=5)


@query("d20_district_map", f"""WITH {MG} SELECT arrondissement, avg(sent_mean) AS sent_mean, count(*) AS n_restos, avg(pct_negative) AS pct_neg, avg(pct_positive) AS pct_pos,
  avg(latitude) AS lat, avg(longitude) AS lon, CAST(arrondissement AS VARCHAR) || 'ᵉ' AS label FROM merged
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND n_reviews_scored >= 2 AND arrondissement IS NOT NULL GROUP BY arrondissement HAVING count(*) >= 2""",
       doubles="sent_mean pct_neg pct_pos lat lon")
def _(spark, sf):
    return R.district_map(B.venue_sentiment(spark, sf), 2, 2)


SEGMENT = """avg(sent_mean) AS sent_mean, stddev_samp(sent_mean) AS sent_std, avg(pct_negative) AS pct_neg, avg(pct_positive) AS pct_pos, count(*) AS n_restos,
  CAST(sum(n_reviews_scored) AS BIGINT) AS n_reviews"""
SEGMENT_D = "sent_mean sent_std pct_neg pct_pos"


@query("d21_flag_segments", f"""WITH {MG} SELECT "hasMichelin" AS segment, {SEGMENT} FROM merged GROUP BY 1""", doubles=SEGMENT_D)
def _(spark, sf):
    return R.segment_rollup(B.venue_sentiment(spark, sf), "hasMichelin")


@query("d21_price_segments", f"""WITH {MG} SELECT "priceLevel" AS segment, {SEGMENT} FROM merged WHERE "priceLevel" IS NOT NULL GROUP BY 1""", doubles=SEGMENT_D)
def _(spark, sf):
    return R.segment_rollup(B.venue_sentiment(spark, sf), "priceLevel")


@query("d21_label_segments", f"""WITH {MG} SELECT label AS segment, {SEGMENT} FROM merged JOIN labels_of USING ("locationId") GROUP BY 1 HAVING count(*) >= 5""", doubles=SEGMENT_D)
def _(spark, sf):
    return R.segment_rollup(B.venue_sentiment(spark, sf), F.explode("cuisine_list"), min_n=5)


@query("d21_language_segments", f"""WITH {SC} SELECT language, avg(sent_stars_expected) AS sent_mean, avg(rating) AS rating_mean, count(review_id) AS n,
  avg(CASE WHEN sent_class <= 2 THEN 1e0 ELSE 0e0 END)*100 AS pct_neg FROM scored WHERE language IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""", doubles="sent_mean rating_mean pct_neg")
def _(spark, sf):
    return R.language_segments(B.scored(spark, sf), 20)


@query("d22_confidence_by_class", f"""WITH {SC} SELECT sent_class, avg(sent_confidence) AS confidence, count(*) AS n, count(*) FILTER (sent_confidence < 0.4) AS n_low,
  CAST(sent_class AS VARCHAR) || '★' AS label FROM scored GROUP BY 1""", doubles="confidence")
def _(spark, sf):
    return R.confidence_by_class(B.scored(spark, sf))


@query("d23_irony_summary", f"""WITH {SC} SELECT count(*) FILTER (is_ironic) AS n_ironic, avg(CAST(is_ironic AS DOUBLE))*100 AS pct_ironic, avg(sent_stars_expected) AS sent_mean,
  avg(sent_stars_corrected) AS sent_mean_corrected, avg(sent_stars_corrected) - avg(sent_stars_expected) AS delta FROM scored""", doubles="pct_ironic sent_mean sent_mean_corrected delta")
def _(spark, sf):
    return R.irony_summary(B.scored(spark, sf))


@query("d24_sentiment_band", f"""WITH {MG} SELECT count(*) AS n_venues, CAST(sum(n_reviews_scored) AS BIGINT) AS n_reviews, avg(sent_mean) AS sent_mean, avg(pct_positive) AS pct_positive,
  avg(pct_negative) AS pct_negative, avg(abs(discordance)) AS mean_abs_discordance FROM merged""", doubles="sent_mean pct_positive pct_negative mean_abs_discordance")
def _(spark, sf):
    return R.sentiment_band(B.venue_sentiment(spark, sf))


@query("d25_headline", f"""WITH {V} SELECT count(*) AS n_venues, count(DISTINCT arrondissement) AS n_districts, avg(rating) AS rating_mean, CAST(sum("reviewCount") AS BIGINT) AS n_reviews,
  count(*) FILTER ("hasMichelin") AS n_michelin, median(rating) AS rating_median FROM venues""", doubles="rating_mean rating_median")
def _(spark, sf):
    return R.headline(B.venues(spark, sf))


@query("d26_ingest_profile", f"""WITH {RV} SELECT count(*) AS n_reviews, count(DISTINCT "locationId") AS n_venues, count(DISTINCT language) AS n_languages, count(rating) AS n_rated,
  strftime(min("publishedDate"), '%Y-%m-%d') AS first_date, strftime(max("publishedDate"), '%Y-%m-%d') AS last_date, count(rating) * 100e0 / count(*) AS pct_rated FROM reviews""", doubles="pct_rated")
def _(spark, sf):
    return R.ingest_profile(B.reviews(spark, sf))


@query("d26_ingest_counts", f"""WITH {V}, {RV} SELECT 'language' AS kind, coalesce(language, 'unknown') AS name, count(*) AS n FROM reviews GROUP BY 2
  UNION ALL SELECT 'district', CAST(arrondissement AS VARCHAR), count(*) FROM venues WHERE arrondissement IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'resolution', CASE WHEN arrondissement IS NOT NULL THEN 'resolved' ELSE 'unresolved' END, count(*) FROM venues GROUP BY 2
  UNION ALL SELECT 'skipped', 'not JSON', count(*) FROM venues WHERE "locationId" % 47 = 46""")
def _(spark, sf):
    return R.ingest_counts(B.reviews(spark, sf), B.venues(spark, sf), D.document_errors(venue_documents(spark, sf)))


DISTINCT = {"review_id": "review_id", "locationId": '"locationId"', "language": "language", "text": "text"}


@query("d26_distinct_sketches", f"WITH {RV} " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(DISTINCT {c}) AS n, true AS in_bound FROM reviews" for name, c in DISTINCT.items()))
def _(spark, sf):
    # sketches are stored per shard and only then united
    reviews = B.reviews(spark, sf)
    path = scratch_path(spark, "sketches")
    R.distinct_sketches(reviews.withColumn("shard", F.col("review_id") % 7), list(DISTINCT), ["shard"]).write.parquet(path)
    united = R.distinct_estimates(spark.read.parquet(path), list(DISTINCT))
    exact = reviews.agg(*[F.countDistinct(c).alias(c) for c in DISTINCT]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in DISTINCT])).alias("e")).select("e.*")
    return exact.join(united, "name").select("name", "n", (F.abs(F.col("estimate") - F.col("n")) <= 1 + R.DISTINCT_ERROR * F.col("n")).alias("in_bound"))


@query("d27_venue_profile", f"""WITH {SC} SELECT "locationId", {TONE} FROM scored GROUP BY 1""", doubles="sent_mean pct_neg pct_pos")
def _(spark, sf):
    return R.venue_profile(B.scored(spark, sf))


@query("d27_class_distribution", f"""WITH {SC} SELECT "locationId", sent_class, count(*) AS n FROM scored GROUP BY 1, 2""")
def _(spark, sf):
    return R.class_distribution(B.scored(spark, sf))
