"""Analysis tables derived from the given star-schema tables, and the same derivations as SQL.

Every derived value is arithmetic on ids. A third of the reviews belongs to one venue on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators.rollups import with_irony, with_sentiment
from venuelens.sources.tables import read_table, spread_input

MENU_TITLES = ["Boissons", "Nos desserts", "Les entrées", "Plat principal", "Menu Dégustation", "Garniture", "",
               "Carte", "Divers", "Soir", "Midi", "Cocktails & bieres"]
DISHES = ["Tarte aux pommes", "Salade verte", "Entrecote au poivre", "Coca", "Soupe de potiron", "Risotto aux asperges",
          "Assortiment", "Gâteau maison", "Truffe noire", "Riz", "Huîtres", "Nem", "Tomate farcie", "Pain", "Figue rôtie"]
SECOND_LABELS = ["Italien", "Bistro", "Asiatique", "Grill", "Vegan", "Marin", "Bistro"]


def table(spark: SparkSession, sf: str, name: str, columns: list[str] | None = None,
          where: Column | None = None) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", columns, where)


def _pick(values: list[str], index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- reviews ---------------------------------------------------------------------------

def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for text work: spread over the cores if they are stored in few splits."""
    return spread_input(table(spark, sf, "documents"), spark.sparkContext.defaultParallelism, "doc_id")


def reviews(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    d = F.col("doc_id")
    source = documents(spark, sf) if spread else table(spark, sf, "documents")
    return source.select(
        d.alias("review_id"), F.when(d % 3 == 0, 7).otherwise(d % 50).cast("long").alias("locationId"),
        F.when(d % 29 == 0, None).when(d % 13 == 0, "ja").otherwise(F.col("lang")).alias("language"), "text",
        F.when(d % 11 == 0, None).otherwise(1 + d % 5).cast("double").alias("rating"),
        F.when(d % 31 == 0, None).otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (d * 7 % 1400).cast("int")))
         .alias("publishedDate"),
        F.concat(F.lit("Avis "), d.cast("string")).alias("title"), "source")


REVIEWS_SQL = """reviews AS (SELECT doc_id AS review_id,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id % 50 END AS BIGINT) AS "locationId",
  CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'ja' ELSE lang END AS language, text,
  CAST(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 + doc_id % 5 END AS DOUBLE) AS rating,
  CASE WHEN doc_id % 31 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(doc_id * 7 % 1400 AS INTEGER) END AS "publishedDate",
  'Avis ' || CAST(doc_id AS VARCHAR) AS title, source FROM documents)"""


def probabilities(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """Reviews with five probabilities p_k = w_k / sum(w), w_k = 1 + id·(k+2) mod 7."""
    w = [1 + F.col("review_id") * (k + 2) % 7 for k in range(1, 6)]
    total = sum(w[1:], w[0])
    return reviews(spark, sf, spread).select("*", *[(w[k] / total).alias(f"p_{k + 1}star") for k in range(5)])


def scored(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    return with_irony(with_sentiment(probabilities(spark, sf, spread)))


_W = [f"(1 + review_id * {k + 2} % 7)" for k in range(1, 6)]
SCORED_SQL = REVIEWS_SQL + f""", probs AS (SELECT *, {', '.join(
    f"CAST({w} AS DOUBLE) / ({' + '.join(_W)}) AS p_{i + 1}star" for i, w in enumerate(_W))} FROM reviews),
predicted AS (SELECT *, p_1star + p_2star*2 + p_3star*3 + p_4star*4 + p_5star*5 AS sent_stars_expected,
  CAST(list_position([p_1star,p_2star,p_3star,p_4star,p_5star], greatest(p_1star,p_2star,p_3star,p_4star,p_5star)) AS INTEGER) AS sent_class,
  greatest(p_1star,p_2star,p_3star,p_4star,p_5star) AS sent_confidence FROM probs),
flagged AS (SELECT *, coalesce(sent_class >= 4 AND rating <= 2, false) AS is_ironic FROM predicted),
scored AS (SELECT *, CASE WHEN is_ironic THEN rating ELSE sent_stars_expected END AS sent_stars_corrected,
  CAST(CASE WHEN is_ironic THEN rating ELSE sent_class END AS INTEGER) AS sent_class_corrected FROM flagged)"""

ROLLUP_COLUMNS = ("sent_mean sent_std sent_median pct_negative pct_positive confidence_mean sent_mean_corrected "
                  "sent_std_corrected sent_median_corrected pct_negative_corrected pct_positive_corrected pct_ironic "
                  "rating_mean_reviews discordance discordance_corrected")


def rollup_sql(key: str, source: str = "scored") -> str:
    return f"""SELECT {key}, count(review_id) AS n_reviews_scored, avg(sent_stars_expected) AS sent_mean,
  stddev_samp(sent_stars_expected) AS sent_std, median(sent_stars_expected) AS sent_median,
  avg(CASE WHEN sent_class <= 2 THEN 1e0 ELSE 0e0 END)*100 AS pct_negative,
  avg(CASE WHEN sent_class >= 4 THEN 1e0 ELSE 0e0 END)*100 AS pct_positive,
  avg(sent_confidence) AS confidence_mean, avg(sent_stars_corrected) AS sent_mean_corrected,
  stddev_samp(sent_stars_corrected) AS sent_std_corrected, median(sent_stars_corrected) AS sent_median_corrected,
  avg(CAST(sent_class_corrected <= 2 AS DOUBLE))*100 AS pct_negative_corrected,
  avg(CAST(sent_class_corrected >= 4 AS DOUBLE))*100 AS pct_positive_corrected,
  avg(CAST(is_ironic AS DOUBLE))*100 AS pct_ironic, avg(rating) AS rating_mean_reviews,
  avg(sent_stars_expected) - avg(rating) AS discordance, avg(sent_stars_corrected) - avg(rating) AS discordance_corrected
  FROM {source} GROUP BY {key}"""


# ---- venues ----------------------------------------------------------------------------

def venues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    base = table(spark, sf, "customer").select(
        k.alias("locationId"), F.col("c_name").alias("name"),
        F.when(k % 13 == 0, None).otherwise(1 + (k * 7 % 41) / 10).cast("double").alias("rating"),
        (k * 31 % 500).cast("int").alias("reviewCount"),
        F.when(k % 23 == 0, None).otherwise(48.80 + (k * 37 % 1000) / 10000).cast("double").alias("latitude"),
        F.when(k % 23 == 0, None).otherwise(2.25 + (k * 91 % 1500) / 10000).cast("double").alias("longitude"),
        F.when(k % 43 == 0, None).otherwise(F.concat(F.col("c_mktsegment"), F.lit("|"), _pick(SECOND_LABELS, k * 3)))
         .alias("cuisines"),
        F.when(k % 17 == 0, None).otherwise(F.concat(F.col("c_nationkey").cast("string"),
               F.when(F.col("c_nationkey") == 1, "er").otherwise("e"), F.lit(" Arr. - Quartier"))).alias("neighborhoods"),
        F.when(k % 5 == 0, "€").when(k % 5 == 1, "€€-€€€").when(k % 5 == 2, "€€€€").when(k % 5 == 3, "€€")
         .alias("priceLevel"),
        (k % 19 == 0).alias("hasMichelin"),
        (k * 3 % 40).alias("nb_items_total"), (k % 4).cast("int").alias("nb_categories"),
        (k % 7).alias(L.STARTER), (k % 5).alias(L.MAIN), (k % 3).alias(L.DESSERT), (k % 11).alias(L.DRINK),
        (k % 2).alias(L.SET_MENU), (k % 6).alias(L.OTHER),
        ((k * 17 % 100) / 91).alias("shannon_entropy"),
        F.when(k % 29 == 0, None).otherwise(k * 11 % 60).cast("double").alias("nb_restos_500m"),
        F.when(k % 37 == 0, None).otherwise((k * 13 % 50) / 49).cast("double").alias("seasonality_score"),
        F.when(k % 41 == 0, None).otherwise(k % 10 / 9).cast("double").alias("seasonal_printemps_ratio"),
        (k % 11 / 9).alias("seasonal_été_ratio"), (k % 12 / 9).alias("seasonal_automne_ratio"),
        (k % 13 / 9).alias("seasonal_hiver_ratio"))
    return base.select("*", S.district_number("neighborhoods").alias("arrondissement"),
                       S.price_level("priceLevel").alias("price_level_num"),
                       S.split_labels("cuisines").alias("cuisine_list"))


VENUES_SQL = f"""venues AS (SELECT c_custkey AS "locationId", c_name AS name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 1 + (c_custkey * 7 % 41) / 10e0 END AS rating,
  CAST(c_custkey * 31 % 500 AS INTEGER) AS "reviewCount",
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 48.80e0 + (c_custkey * 37 % 1000) / 10000e0 END AS latitude,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 2.25e0 + (c_custkey * 91 % 1500) / 10000e0 END AS longitude,
  CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE c_mktsegment || '|' || {_sql_list(SECOND_LABELS)}[c_custkey * 3 % 7 + 1] END AS cuisines,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey = 1 THEN 'er' ELSE 'e' END || ' Arr. - Quartier' END AS neighborhoods,
  CASE c_custkey % 5 WHEN 0 THEN '€' WHEN 1 THEN '€€-€€€' WHEN 2 THEN '€€€€' WHEN 3 THEN '€€' END AS "priceLevel",
  c_custkey % 19 = 0 AS "hasMichelin", c_custkey * 3 % 40 AS nb_items_total, CAST(c_custkey % 4 AS INTEGER) AS nb_categories,
  c_custkey % 7 AS "entrée", c_custkey % 5 AS plat, c_custkey % 3 AS dessert, c_custkey % 11 AS boisson,
  c_custkey % 2 AS formule, c_custkey % 6 AS autre, (c_custkey * 17 % 100) / 91e0 AS shannon_entropy,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(c_custkey * 11 % 60 AS DOUBLE) END AS nb_restos_500m,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE (c_custkey * 13 % 50) / 49e0 END AS seasonality_score,
  CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_custkey % 10 / 9e0 END AS seasonal_printemps_ratio,
  c_custkey % 11 / 9e0 AS "seasonal_été_ratio", c_custkey % 12 / 9e0 AS seasonal_automne_ratio,
  c_custkey % 13 / 9e0 AS seasonal_hiver_ratio,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS INTEGER) END AS arrondissement,
  CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 2 END AS INTEGER) AS price_level_num FROM customer),
labels_of AS (SELECT "locationId", trim(label) AS label FROM venues, unnest(string_split(cuisines, '|')) AS u(label))"""


def venue_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Venues joined to the rollup of their reviews (the venues that have some)."""
    from venuelens.operators.rollups import sentiment_rollup
    return venues(spark, sf).join(sentiment_rollup(scored(spark, sf)), "locationId")


MERGED_SQL = VENUES_SQL + ", " + SCORED_SQL + f""", rollup_ AS ({rollup_sql('"locationId"')}),
merged AS (SELECT * FROM venues JOIN rollup_ USING ("locationId"))"""


# ---- menu items ------------------------------------------------------------------------

def _price_text(k, shift: int) -> Column:
    cents = k * (37 + shift) % 4000
    plain = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return (F.when(k % 23 == 0, None).when(k % 29 == 0, "").when(k % 31 == 0, "gratuit").when(k % 37 == 0, "1.234,50€")
             .when(k % 2 == 0, F.concat(F.lit("  "), plain, F.lit(" €"))).otherwise(F.concat(plain, F.lit("€"))))


def _price_text_sql(shift: int) -> str:
    cents = f"(p_partkey * {37 + shift} % 4000)"
    plain = f"CAST({cents} // 100 AS VARCHAR) || ',' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    return (f"CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'gratuit' "
            f"WHEN p_partkey % 37 = 0 THEN '1.234,50€' WHEN p_partkey % 2 = 0 THEN '  ' || {plain} || ' €' ELSE {plain} || '€' END")


def parsed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Menu items as they come out of the documents: with every price text."""
    k = F.col("p_partkey")
    return spread_input(table(spark, sf, "part"), spark.sparkContext.defaultParallelism, "p_partkey").select(
        F.substring("p_brand", 7, 9).cast("long").alias("locationId"), _pick(MENU_TITLES, k * 5).alias("menu_title"),
        F.when(k % 9 == 0, None).otherwise(F.col("p_type")).alias("section_title"),
        F.when(k % 53 == 0, "").otherwise(F.concat(_pick(DISHES, k * 7), F.lit(" "), F.col("p_name"))).alias("item_title"),
        F.when(k % 4 == 0, F.lit("sauce au citron")).otherwise(F.lit("")).alias("item_description"),
        F.array(_price_text(k, 0), _price_text(k, 4)).alias("price_texts"), k.alias("item_id"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    from venuelens.operators.menu import menu_items
    return menu_items(parsed_items(spark, sf))


def clean_price_sql(x: str) -> str:
    text = f"replace(trim(regexp_replace({x}, '[€  ]', '', 'g')), ',', '.')"
    return f"CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CAST({text} AS DOUBLE) END"


def class_sql(text: str, ordered: list[tuple[str, list[str]]]) -> str:
    def has(terms: list[str]) -> str:
        return " OR ".join("contains({}, '{}')".format(text, t.replace("'", "''")) for t in terms)
    return "CASE " + " ".join(f"WHEN {has(terms)} THEN '{label}'" for label, terms in ordered) + " END"


PARSED_ITEMS_SQL = f"""parsed_items AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS "locationId",
  {_sql_list(MENU_TITLES)}[p_partkey * 5 % {len(MENU_TITLES)} + 1] AS menu_title,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS section_title,
  CASE WHEN p_partkey % 53 = 0 THEN '' ELSE {_sql_list(DISHES)}[p_partkey * 7 % {len(DISHES)} + 1] || ' ' || p_name END AS item_title,
  CASE WHEN p_partkey % 4 = 0 THEN 'sauce au citron' ELSE '' END AS item_description,
  {_price_text_sql(0)} AS t1, {_price_text_sql(4)} AS t2, p_partkey AS item_id FROM part)"""

ITEMS_SQL = PARSED_ITEMS_SQL + f""", all_prices AS (
  SELECT "locationId", {clean_price_sql('t1')} AS price FROM parsed_items UNION ALL
  SELECT "locationId", {clean_price_sql('t2')} FROM parsed_items),
calibration AS (SELECT "locationId", count(price) AS n_prices, quantile_cont(price, 0.33) AS price_q33,
  quantile_cont(price, 0.67) AS price_q67 FROM all_prices WHERE price IS NOT NULL GROUP BY "locationId"),
prepared AS (SELECT p.*, {clean_price_sql('t1')} AS item_price, c.n_prices, c.price_q33, c.price_q67,
  {class_sql('lower(menu_title)', L.MENU_TITLE_TERMS)} AS menu_cat,
  trim(lower(item_title) || ' ' || lower(item_description)) AS full_text
  FROM parsed_items p LEFT JOIN calibration c USING ("locationId")),
items AS (SELECT *, CASE WHEN menu_cat IS NOT NULL AND menu_cat <> 'formule' THEN menu_cat WHEN full_text = '' THEN 'autre'
  ELSE coalesce({class_sql('full_text', L.ITEM_TERMS)},
    CASE WHEN item_price IS NOT NULL AND n_prices >= 3 THEN
      CASE WHEN item_price <= price_q33 THEN 'entrée' WHEN item_price >= price_q67 THEN 'plat' END END, 'autre') END AS category
  FROM prepared)"""
