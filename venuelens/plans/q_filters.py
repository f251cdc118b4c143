"""Queries over filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators import predicates as P
from venuelens.operators import rollups as R
from venuelens.plans import bindings as B
from venuelens.plans.registry import query

V, RV, SC, IT = B.VENUES_SQL, B.REVIEWS_SQL, B.SCORED_SQL, B.ITEMS_SQL


@query("b1_venue_filter", f"""WITH {V} SELECT "locationId", name, rating FROM venues WHERE rating BETWEEN 2 AND 5 AND "reviewCount" >= 20
  AND nb_restos_500m <= 50 AND arrondissement IN (1,2,3,5,8,13,21) AND "priceLevel" IN ('€','€€-€€€')""", doubles="rating")
def _(spark, sf):
    keep = P.venue_filter(districts=[1, 2, 3, 5, 8, 13, 21], price_levels=["€", "€€-€€€"], rating=(2.0, 5.0),
                          min_reviews=20, max_neighbours=50)
    return B.venues(spark, sf).filter(keep).select("locationId", "name", "rating")


@query("b1_default_filter", f"""WITH {V} SELECT "locationId" FROM venues WHERE rating IS NOT NULL AND nb_restos_500m IS NOT NULL""")
def _(spark, sf):
    return B.venues(spark, sf).filter(P.venue_filter()).select("locationId")


@query("b2_any_label", f"""WITH {V} SELECT DISTINCT "locationId" FROM labels_of WHERE label IN ('Bistro','MACHINERY')""")
def _(spark, sf):
    return B.venues(spark, sf).filter(P.has_any_label("cuisine_list", ["Bistro", "MACHINERY"])).select("locationId")


@query("b3_all_categories", f"""WITH {V} SELECT "locationId" FROM venues WHERE "entrée" > 0 AND plat > 0 AND boisson > 0""")
def _(spark, sf):
    return B.venues(spark, sf).filter(P.has_all_categories(["entree", "plat", "boisson"])).select("locationId")


@query("b4_supported_languages", f"""WITH {RV} SELECT review_id, language FROM reviews WHERE language IN ('fr','en','it','es','pt','de','nl')""")
def _(spark, sf):
    return P.supported_languages(B.reviews(spark, sf)).select("review_id", "language")


@query("b5_language_route", f"""WITH {RV} SELECT review_id, CASE WHEN language IN ('fr','en','it','es','pt','de','nl') THEN 'primary'
  ELSE 'fallback' END AS route FROM reviews""")
def _(spark, sf):
    return P.with_route(B.reviews(spark, sf)).select("review_id", "route")


@query("b6_min_text_length", "SELECT doc_id AS review_id FROM documents WHERE length(text) > 600")
def _(spark, sf):
    return P.long_enough(B.reviews(spark, sf), "text", 600).select("review_id")


@query("b7_complete_rows", f"""WITH {V} SELECT "locationId", rating, nb_restos_500m FROM venues
  WHERE rating IS NOT NULL AND nb_restos_500m IS NOT NULL AND arrondissement IS NOT NULL""", doubles="rating nb_restos_500m")
def _(spark, sf):
    return B.venues(spark, sf).na.drop(subset=["rating", "nb_restos_500m", "arrondissement"]).select(
        "locationId", "rating", "nb_restos_500m")


@query("b8_min_support", f"""WITH {RV} SELECT "locationId", count(*) AS n FROM reviews GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, sf):
    n = B.reviews(spark, sf).groupBy("locationId").agg(F.count("*").alias("n"))
    return P.min_support(n, "n", 3)


@query("b9_semi_join", f"""WITH {RV}, {V} SELECT review_id FROM reviews WHERE "locationId" IN
  (SELECT "locationId" FROM venues WHERE rating >= 2.5)""")
def _(spark, sf):
    chosen = B.venues(spark, sf).filter("rating >= 2.5")
    return P.keep_matching(B.reviews(spark, sf).select("review_id", "locationId"), chosen, "locationId").select("review_id")


@query("b11_display_columns", f"""WITH {V} SELECT name AS "Nom", rating AS "Note", "reviewCount" AS "Avis" FROM venues""", doubles="Note")
def _(spark, sf):
    return B.venues(spark, sf).select(F.col("name").alias("Nom"), F.col("rating").alias("Note"), F.col("reviewCount").alias("Avis"))


@query("b12_derived_columns", f"""WITH {V} SELECT "locationId", price_level_num,
  (SELECT string_agg(label, '|' ORDER BY label) FROM labels_of l WHERE l."locationId" = venues."locationId") AS labels FROM venues""")
def _(spark, sf):
    from venuelens.sources.tables import with_derived
    v = with_derived(B.venues(spark, sf).select("locationId", "priceLevel", "cuisines"))
    return v.select("locationId", "price_level_num", S.join_labels(F.array_sort("cuisine_list")).alias("labels"))


@query("b13_price_bounds", """SELECT quantile_cont(p_retailprice, 0.01) AS price_min, quantile_cont(p_retailprice, 0.99) AS price_max FROM part""",
       doubles="price_min price_max")
def _(spark, sf):
    from venuelens.operators.quantiles import grouped_stats
    return grouped_stats(B.table(spark, sf, "part"), [], [], {"price_min": ("p_retailprice", 0.01), "price_max": ("p_retailprice", 0.99)})


@query("b14_available_filters", f"""WITH {V}, {IT}, tops AS (SELECT label, count(*) AS n FROM labels_of GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
  SELECT array_to_string(list_transform(list_sort(list(DISTINCT arrondissement) FILTER (arrondissement IS NOT NULL)), lambda x: CAST(x AS VARCHAR)), '|') AS arrondissements,
  string_agg(DISTINCT "priceLevel", '|' ORDER BY "priceLevel") AS price_levels, min(rating) AS rating_min, max(rating) AS rating_max,
  max("reviewCount") AS review_count_max, max(nb_restos_500m) AS concurrence_max,
  'entree|plat|dessert|boisson' AS menu_categories, (SELECT string_agg(label, '|' ORDER BY n DESC, label) FROM tops) AS top_cuisines,
  (SELECT quantile_cont(item_price, 0.01) FROM items) AS price_min, (SELECT quantile_cont(item_price, 0.99) FROM items) AS price_max
  FROM venues""", doubles="rating_min rating_max concurrence_max price_min price_max")
def _(spark, sf):
    return P.available_filters(B.venues(spark, sf), B.items(spark, sf))


@query("b15_flagged_detail", f"""WITH {SC} SELECT review_id, "locationId", title, strftime("publishedDate", '%Y-%m-%d') AS published,
  length(text) AS n_chars FROM scored WHERE is_ironic""")
def _(spark, sf):
    from venuelens.operators.joins import with_review_details
    flagged = B.scored(spark, sf).filter("is_ironic").select("review_id", "locationId")
    out = with_review_details(flagged, B.reviews(spark, sf), ["title", "publishedDate", "text"], require=None)
    return out.select("review_id", "locationId", "title", F.date_format("publishedDate", "yyyy-MM-dd").alias("published"),
                      F.length("text").cast("long").alias("n_chars"))


@query("b16_chart_filters", f"""WITH {V} SELECT count(*) FILTER ("reviewCount" > 0) AS with_reviews,
  count(*) FILTER (nb_items_total > 0 AND rating IS NOT NULL) AS rated_menu,
  count(*) FILTER (nb_restos_500m IS NOT NULL AND rating IS NOT NULL) AS rated_placed, count(*) FILTER (price_level_num > 0) AS priced FROM venues""")
def _(spark, sf):
    c = F.col
    return B.venues(spark, sf).agg(
        F.count_if(c("reviewCount") > 0).alias("with_reviews"),
        F.count_if((c("nb_items_total") > 0) & c("rating").isNotNull()).alias("rated_menu"),
        F.count_if(c("nb_restos_500m").isNotNull() & c("rating").isNotNull()).alias("rated_placed"),
        F.count_if(c("price_level_num") > 0).alias("priced"))


# ---- scalar functions ------------------------------------------------------------------

@query("c1_price_text", f"""WITH {B.PARSED_ITEMS_SQL} SELECT item_id, {B.clean_price_sql('t1')} AS price FROM parsed_items""", doubles="price")
def _(spark, sf):
    return B.parsed_items(spark, sf).select("item_id", S.clean_price(F.get("price_texts", F.lit(0))).alias("price"))


@query("c2_price_level", f"""WITH {V} SELECT "locationId", price_level_num AS level FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.price_level("priceLevel").alias("level"))


@query("c3_split_labels", f"""WITH {V} SELECT "locationId", label FROM labels_of""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", F.explode(S.split_labels("cuisines")).alias("label"))


@query("c4_join_labels", f"""WITH {V} SELECT "locationId", cuisines AS joined FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.join_labels("cuisine_list").alias("joined"))


@query("c5_district_number", f"""WITH {V} SELECT "locationId", arrondissement FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.district_number("neighborhoods").alias("arrondissement"))


@query("c6_menu_category", f"""WITH {B.PARSED_ITEMS_SQL} SELECT item_id, {B.class_sql('lower(menu_title)', L.MENU_TITLE_TERMS)} AS category
  FROM parsed_items""")
def _(spark, sf):
    return B.parsed_items(spark, sf).select("item_id", S.menu_category("menu_title").alias("category"))


@query("c6_text_category", f"""SELECT doc_id, {B.class_sql('lower(text)', L.MENU_TITLE_TERMS)} AS category FROM documents""")
def _(spark, sf):
    return B.documents(spark, sf).select("doc_id", S.menu_category("text").alias("category"))


@query("c7_item_category", f"""WITH {IT} SELECT item_id, category FROM items""")
def _(spark, sf):
    return B.items(spark, sf).select("item_id", "category")


@query("c8_price_calibration", f"""WITH {IT} SELECT "locationId", n_prices, price_q33, price_q67 FROM calibration""", doubles="price_q33 price_q67")
def _(spark, sf):
    from venuelens.operators.menu import price_calibration
    p = B.parsed_items(spark, sf).select("locationId", F.explode("price_texts").alias("t"))
    return price_calibration(p.select("locationId", S.clean_price("t").alias("price")))


@query("c9_tokens", r"""SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id,
  unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY 1""")
def _(spark, sf):
    return B.documents(spark, sf).select("doc_id", S.tokens("text").alias("t")).filter(
        F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                                F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("c10_item_text", f"""WITH {B.PARSED_ITEMS_SQL} SELECT item_id, lower(item_title) || ' ' || lower(item_description) AS t FROM parsed_items""")
def _(spark, sf):
    return B.parsed_items(spark, sf).select("item_id", S.item_text("item_title", "item_description").alias("t"))


@query("c11_nested_field", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    e = B.table(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("c12_exists_nested", f"""WITH {V} SELECT "locationId", "hasMichelin", nb_items_total > 0 AS "hasMenu" FROM venues WHERE "locationId" % 47 <> 46""")
def _(spark, sf):
    from venuelens.plans.q_sources import venue_documents
    from venuelens.sources.documents import parse_venues
    return parse_venues(venue_documents(spark, sf)).select("locationId", "hasMichelin", "hasMenu")


@query("c13_first_element", f"""WITH {V} SELECT "locationId", split_part(cuisines, '|', 1) AS first_label FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", F.get("cuisine_list", F.lit(0)).alias("first_label"))


@query("c14_sentiment_metrics", f"""WITH {SC} SELECT review_id, sent_stars_expected, sent_class, sent_confidence FROM scored""",
       doubles="sent_stars_expected sent_confidence")
def _(spark, sf):
    return R.with_sentiment(B.probabilities(spark, sf)).select("review_id", "sent_stars_expected", "sent_class", "sent_confidence")


@query("c15_irony", f"""WITH {SC} SELECT review_id, is_ironic, sent_stars_corrected, sent_class_corrected FROM scored""",
       doubles="sent_stars_corrected")
def _(spark, sf):
    return B.scored(spark, sf).select("review_id", "is_ironic", "sent_stars_corrected", "sent_class_corrected")


@query("c16_irony_backfill", f"""WITH {SC} SELECT review_id, is_ironic, sent_stars_corrected, sent_class_corrected FROM scored""",
       doubles="sent_stars_corrected")
def _(spark, sf):
    old = F.col("review_id") % 2 == 0
    s = B.scored(spark, sf)
    for c in ("is_ironic", "sent_stars_corrected", "sent_class_corrected"):
        s = s.withColumn(c, F.when(~old, F.col(c)))
    return R.backfill_irony(s).select("review_id", "is_ironic", "sent_stars_corrected", "sent_class_corrected")


@query("c17_date_parts", f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m,
  CAST(year(o_orderdate) AS INTEGER) AS y, {B._sql_list(L.MONTH_NAMES)}[month(o_orderdate)] AS month_name FROM orders""")
def _(spark, sf):
    o = B.table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = F.try_to_timestamp(text)
    return o.select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("d"),
                    F.date_format(F.trunc(d, "month"), "yyyy-MM-dd").alias("m"), F.year(d).alias("y"),
                    S.month_name(F.month(d)).alias("month_name"))


@query("c18_quality_bins", f"""WITH {V} SELECT "locationId", CASE WHEN rating <= 0 THEN NULL WHEN rating <= 3.5 THEN 'Faible (<3.5)'
  WHEN rating <= 4 THEN 'Moyen (3.5-4)' WHEN rating <= 4.5 THEN 'Bon (4-4.5)' WHEN rating <= 5 THEN 'Excellent (>4.5)' END AS quality FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.right_closed_bin("rating").alias("quality"))


QP_SQL = """qp AS (SELECT *, ((rating - (SELECT min(rating) FROM venues WHERE price_level_num > 0)) /
  ((SELECT max(rating) - min(rating) FROM venues WHERE price_level_num > 0) + 0.01e0)) /
  (price_level_num / (SELECT CAST(max(price_level_num) AS DOUBLE) FROM venues WHERE price_level_num > 0)) AS qp_score FROM venues WHERE price_level_num > 0)"""


@query("c19_price_quality", f"""WITH {V}, {QP_SQL} SELECT "locationId", qp_score FROM qp""", doubles="qp_score")
def _(spark, sf):
    from venuelens.operators.joins import with_price_quality
    return with_price_quality(B.venues(spark, sf)).select("locationId", "qp_score")


@query("c20_zscores", """SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer) AS z_c_acctbal
  FROM customer""", doubles="z_c_acctbal")
def _(spark, sf):
    from venuelens.operators.joins import with_zscores
    return with_zscores(B.table(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", "z_c_acctbal")


@query("c21_labels", f"""WITH {V} SELECT "locationId", coalesce('Arr ' || CAST(arrondissement AS VARCHAR), 'Inconnu') AS district, substr(name, 1, 10) AS short FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.district_label("arrondissement").alias("district"), S.short_name("name", 10).alias("short"))


@query("c22_verdicts", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p < 0.001 THEN 'Hautement significatif' WHEN p < 0.01 THEN 'Tres significatif'
  WHEN p < 0.05 THEN 'Significatif' ELSE 'Non significatif' END AS verdict, CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.01 THEN 'p = ' || printf('%.4f', p)
  ELSE 'p = ' || printf('%.3f', p) END AS p_text FROM (SELECT *, (l_partkey % 200) / 1000e0 + 0.0005e0 / (1 + l_linenumber) + 0.00001e0 AS p FROM lineitem)""")
def _(spark, sf):
    p = F.col("l_partkey") % 200 / 1000 + F.lit(0.0005) / (1 + F.col("l_linenumber")) + F.lit(0.00001)
    return B.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", S.p_verdict(p).alias("verdict"), S.p_text(p).alias("p_text"))


@query("c23_half_even", f"""WITH {B.MERGED_SQL} SELECT "locationId", CAST(round_even(n_reviews_scored * pct_ironic / 100, 0) AS INTEGER) AS n_ironic FROM merged""")
def _(spark, sf):
    return R.with_ironic_count(B.venue_sentiment(spark, sf)).select("locationId", "n_ironic")


@query("c24_value_labels", f"""WITH {V} SELECT "locationId", CASE WHEN "hasMichelin" THEN 'Michelin' ELSE 'Non-Michelin' END AS flag,
  CAST(price_level_num AS VARCHAR) || '★' AS stars, CAST(arrondissement AS VARCHAR) || 'ᵉ' AS ordinal FROM venues""")
def _(spark, sf):
    return B.venues(spark, sf).select("locationId", S.flag_label("hasMichelin").alias("flag"), S.star_label("price_level_num").alias("stars"),
                                      S.ordinal_label("arrondissement").alias("ordinal"))
