"""Queries over joins, ordering, set operations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens.operators import joins as J
from venuelens.operators import menu as M
from venuelens.operators import ordering as O
from venuelens.operators import predicates as P
from venuelens.operators import sampling as X
from venuelens.operators import spatial
from venuelens.plans import bindings as B
from venuelens.plans.q_filters import QP_SQL
from venuelens.plans.registry import query

V, RV, SC, IT, MG = B.VENUES_SQL, B.REVIEWS_SQL, B.SCORED_SQL, B.ITEMS_SQL, B.MERGED_SQL
DIVERSITY_SQL = r"""counts AS (SELECT "locationId", count(category) AS nb_items_total,
  count(*) FILTER (category = 'entrée') AS "entrée", count(*) FILTER (category = 'plat') AS plat, count(*) FILTER (category = 'dessert') AS dessert,
  count(*) FILTER (category = 'boisson') AS boisson, count(*) FILTER (category = 'formule') AS formule, count(*) FILTER (category = 'autre') AS autre
  FROM items GROUP BY 1),
words AS (SELECT "locationId", w FROM (SELECT "locationId", unnest(regexp_extract_all(lower(item_title), '[\p{L}\p{N}\p{M}_]+')) AS w FROM items) WHERE length(w) > 2),
ttr AS (SELECT "locationId", count(DISTINCT w) / CAST(count(*) AS DOUBLE) AS r FROM words GROUP BY 1),
shares AS (SELECT *, CAST("entrée" + plat + dessert AS DOUBLE) AS t FROM counts),
diversity AS (SELECT "locationId", nb_items_total, CAST(("entrée" > 0)::INT + (plat > 0)::INT + (dessert > 0)::INT AS INTEGER) AS nb_categories,
  "entrée", plat, dessert, boisson, formule, autre,
  CASE WHEN "entrée" > 0 THEN -("entrée"/t)*ln("entrée"/t) ELSE 0 END + CASE WHEN plat > 0 THEN -(plat/t)*ln(plat/t) ELSE 0 END
  + CASE WHEN dessert > 0 THEN -(dessert/t)*ln(dessert/t) ELSE 0 END AS shannon_entropy, coalesce(r, 0) AS type_token_ratio
  FROM shares LEFT JOIN ttr USING ("locationId"))"""


def competition_sql(outer: str = "LEFT") -> str:
    def pairs(km: float) -> str:
        import math
        t = 2.0 * math.sin(km / 6371.0)
        return f"count(*) FILTER ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= {t * t!r}) - 1"
    return f"""placed AS (SELECT "locationId", cos(radians(latitude))*cos(radians(longitude)) AS x,
  cos(radians(latitude))*sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
  counted AS (SELECT a."locationId", CAST({pairs(0.5)} AS DOUBLE) AS nb_restos_500m, CAST({pairs(1.0)} AS DOUBLE) AS nb_restos_1km
  FROM placed a, placed b GROUP BY 1),
  competition AS (SELECT v."locationId", c.nb_restos_500m, c.nb_restos_1km FROM venues v LEFT JOIN counted c USING ("locationId"))"""


@query("j1_enriched_venues", f"""WITH {V}, {IT}, {DIVERSITY_SQL} SELECT v."locationId", v.name, coalesce(d.nb_items_total, 0) AS nb_items_total,
  coalesce(d.nb_categories, 0) AS nb_categories, coalesce(d.shannon_entropy, 0) AS shannon_entropy, coalesce(d.type_token_ratio, 0) AS type_token_ratio,
  d.dessert FROM venues v LEFT JOIN diversity d USING ("locationId")""", doubles="shannon_entropy type_token_ratio")
def _(spark, sf):
    v = B.venues(spark, sf).select("locationId", "name")
    return J.enrich_venues(v, M.menu_diversity(B.items(spark, sf))).select(
        "locationId", "name", "nb_items_total", "nb_categories", "shannon_entropy", "type_token_ratio", "dessert")


@query("b10_fill_missing", f"""WITH {V}, {IT}, {DIVERSITY_SQL} SELECT "locationId", coalesce(d.nb_items_total, 0) AS nb_items_total
  FROM venues v LEFT JOIN diversity d USING ("locationId")""")
def _(spark, sf):
    d = M.category_counts(B.items(spark, sf)).select("locationId", "nb_items_total")
    return J.enrich_venues(B.venues(spark, sf).select("locationId"), d)


@query("j2_venue_sentiment", f"""WITH {MG} SELECT "locationId", name, rating, sent_mean, n_reviews_scored FROM merged""", doubles="rating sent_mean")
def _(spark, sf):
    return B.venue_sentiment(spark, sf).select("locationId", "name", "rating", "sent_mean", "n_reviews_scored")


@query("j3_review_dates", f"""WITH {SC} SELECT review_id, sent_stars_expected, strftime("publishedDate", '%Y-%m-%d') AS published
  FROM scored WHERE "publishedDate" IS NOT NULL""", doubles="sent_stars_expected")
def _(spark, sf):
    s = B.scored(spark, sf).select("review_id", "sent_stars_expected")
    return J.with_review_details(s, B.reviews(spark, sf), ["publishedDate"]).select(
        "review_id", "sent_stars_expected", F.date_format("publishedDate", "yyyy-MM-dd").alias("published"))


@query("j4_uneven_lookup", f"""WITH {RV}, {V} SELECT r.review_id, v.name FROM reviews r LEFT JOIN venues v USING ("locationId")""")
def _(spark, sf):
    r = B.reviews(spark, sf).select("review_id", "locationId")
    return J.with_group_value(r, B.venues(spark, sf).select("locationId", "name"), "locationId").select("review_id", "name")


@query("j5_anti_join", "SELECT doc_id AS review_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    done = B.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    return P.drop_matching(B.reviews(spark, sf).select("review_id"), done, "review_id")


@query("j6_radius_neighbours", f"""WITH {V}, {competition_sql()} SELECT * FROM competition""", doubles="nb_restos_500m nb_restos_1km")
def _(spark, sf):
    return spatial.competition(B.venues(spark, sf))


@query("j6_true_radius", f"""WITH {V}, {competition_sql()} SELECT * FROM competition""", doubles="nb_restos_500m nb_restos_1km")
def _(spark, sf):
    # Half the radii with the doubled threshold are the true ones.
    return spatial.competition(B.venues(spark, sf), radii={"nb_restos_500m": 1.0, "nb_restos_1km": 2.0}, compat_double_radius=False)


@query("j7_global_scalars", """SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS share FROM orders""", doubles="share")
def _(spark, sf):
    o = B.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return o.select("o_orderkey", (F.col("o_totalprice") / o.agg(F.max("o_totalprice")).scalar()).alias("share"))


@query("j8_group_mean", f"""WITH {SC} SELECT "locationId", avg(rating) AS rating_mean, avg(sent_stars_expected) AS sent_mean FROM scored GROUP BY 1""",
       doubles="rating_mean sent_mean")
def _(spark, sf):
    return B.scored(spark, sf).groupBy("locationId").agg(F.avg("rating").alias("rating_mean"), F.avg("sent_stars_expected").alias("sent_mean"))


def season_hits_sql(source: str) -> str:
    from venuelens.lexicons import SEASON_TERMS
    terms = ", ".join(f"('{s}', '{t}')" for s, ts in SEASON_TERMS.items() for t in ts)
    return f"""lexicon(season, term) AS (VALUES {terms}), texts AS ({source}),
  hits AS (SELECT "locationId", season, term, count(*) AS n FROM texts, lexicon WHERE contains(t, term) GROUP BY 1, 2, 3)"""


REVIEW_TEXTS = 'SELECT "locationId", lower(text) AS t FROM reviews'
ITEM_TEXTS = """SELECT "locationId", lower(item_title) || ' ' || lower(item_description) AS t FROM parsed_items"""


@query("j9_lexicon_hits", f"""WITH {RV}, {season_hits_sql(REVIEW_TEXTS)} SELECT "locationId", season, term, n FROM hits""")
def _(spark, sf):
    return M.season_hits(B.reviews(spark, sf, spread=True))


# ---- ordering --------------------------------------------------------------------------

@query("w1_average_ranks", """SELECT l_quantity, n, c - n + (n + 1) / 2e0 AS rank_avg FROM (SELECT l_quantity, count(*) AS n,
  CAST(sum(count(*)) OVER (ORDER BY l_quantity) AS BIGINT) AS c FROM lineitem GROUP BY 1)""", doubles="l_quantity rank_avg")
def _(spark, sf):
    return O.average_ranks(B.table(spark, sf, "lineitem", ["l_quantity"]), "l_quantity")


@query("w1_row_ranks", """SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS rank_avg
  FROM lineitem""", doubles="rank_avg")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return O.row_ranks(li, "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "rank_avg")


@query("w2_empirical_cdf", """WITH tops AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
  c AS (SELECT o_orderpriority, o_totalprice, count(*) AS n FROM orders SEMI JOIN tops USING (o_orderpriority) GROUP BY 1, 2)
  SELECT o_orderpriority, o_totalprice, n, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) / CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS cdf
  FROM c""", doubles="o_totalprice cdf")
def _(spark, sf):
    return O.empirical_cdf(B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]), "o_totalprice", "o_orderpriority", 3)


@query("w3_chunks", """SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS chunk_id FROM documents""")
def _(spark, sf):
    return O.assign_chunks(B.table(spark, sf, "documents", ["doc_id"]), "doc_id", 7)


@query("w4_top_rows", """SELECT c_custkey, c_acctbal, 'top' AS side FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15)
  UNION ALL SELECT c_custkey, c_acctbal, 'bottom' FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15)""", doubles="c_acctbal")
def _(spark, sf):
    c = B.table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    top = O.top_rows(c, "c_acctbal", 15, "c_custkey").withColumn("side", F.lit("top"))
    return top.unionByName(O.top_rows(c, "c_acctbal", 15, "c_custkey", largest=False).withColumn("side", F.lit("bottom")))


@query("w4_best_value", f"""WITH {V}, {QP_SQL} SELECT name, rating, "priceLevel", arrondissement, qp_score FROM qp WHERE qp_score IS NOT NULL
  ORDER BY qp_score DESC, "locationId" LIMIT 20""", doubles="rating qp_score")
def _(spark, sf):
    return O.top_rows(J.with_price_quality(B.venues(spark, sf)), "qp_score", 20, "locationId").select(
        "name", "rating", "priceLevel", "arrondissement", "qp_score")


@query("w4_most_ironic", f"""WITH {MG} SELECT name, pct_ironic, n_reviews_scored FROM merged WHERE n_reviews_scored >= 2
  ORDER BY round(pct_ironic, 6) DESC, "locationId" LIMIT 15""", doubles="pct_ironic")
def _(spark, sf):
    m = P.min_support(B.venue_sentiment(spark, sf), "n_reviews_scored", 2).withColumn("pct_ironic", F.round("pct_ironic", 6))
    return O.top_rows(m, "pct_ironic", 15, "locationId").select("name", "pct_ironic", "n_reviews_scored")


@query("w4_most_polarising", f"""WITH {MG} SELECT name, sent_std FROM merged WHERE n_reviews_scored >= 2 AND sent_std IS NOT NULL
  ORDER BY round(sent_std, 6) DESC, "locationId" LIMIT 15""", doubles="sent_std")
def _(spark, sf):
    m = P.min_support(B.venue_sentiment(spark, sf), "n_reviews_scored", 2).withColumn("sent_std", F.round("sent_std", 6))
    return O.top_rows(m, "sent_std", 15, "locationId").select("name", "sent_std")


@query("w5_extremes_per_venue", f"""WITH {SC}, r AS (SELECT "locationId", review_id, sent_stars_expected,
  row_number() OVER (PARTITION BY "locationId" ORDER BY round(sent_stars_expected, 6), review_id) AS lo,
  row_number() OVER (PARTITION BY "locationId" ORDER BY round(sent_stars_expected, 6) DESC, review_id DESC) AS hi FROM scored)
  SELECT "locationId", review_id, sent_stars_expected, lo AS "position", 'negative' AS side FROM r WHERE lo <= 5 UNION ALL
  SELECT "locationId", review_id, sent_stars_expected, hi, 'positive' FROM r WHERE hi <= 5""", doubles="sent_stars_expected", ints="position")
def _(spark, sf):
    s = B.scored(spark, sf).select("locationId", "review_id", F.round("sent_stars_expected", 6).alias("sent_stars_expected"))
    return O.extremes_per_group(s, "locationId", "sent_stars_expected", "review_id", 5)


@query("w6_full_sort", f"""WITH {V} SELECT name, rating FROM venues""", doubles="rating")
def _(spark, sf):
    return B.venues(spark, sf).select("name", "rating").orderBy("name")


@query("w7_top_groups", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey IN
  (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)""")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return O.restrict_to_top(li, "l_suppkey", 8).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- sets and samples ------------------------------------------------------------------

@query("d2_keep_first", f"""SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return J.keep_one(B.table(spark, sf, "lineitem", ["l_orderkey", "l_partkey"]), "l_orderkey", F.asc("l_partkey"))


@query("s1_union_shards", """SELECT CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS shard_no, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
  FROM documents GROUP BY 1""")
def _(spark, sf):
    d = B.table(spark, sf, "documents", ["doc_id", "n_chars"])
    u = J.union_shards(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").select("n_chars", "doc_id"))
    return u.groupBy("shard_no").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s2_upsert", f"""WITH {RV} SELECT review_id, CASE WHEN review_id % 3 = 0 THEN 9e0 ELSE rating END AS rating FROM reviews""", doubles="rating")
def _(spark, sf):
    r = B.reviews(spark, sf).select("review_id", "rating")
    return J.upsert(r, r.filter("review_id % 3 = 0").withColumn("rating", F.lit(9.0)))


@query("s3_known_ids", "SELECT doc_id AS review_id FROM documents WHERE doc_id % 5 < 3")
def _(spark, sf):
    r = B.reviews(spark, sf).select("review_id")
    return J.known_ids(r.filter("review_id % 5 < 2"), r.filter("review_id % 5 in (1, 2)"))


@query("s4_uniform_sample", "SELECT doc_id AS review_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 60")
def _(spark, sf):
    return X.uniform_sample(B.reviews(spark, sf).select("review_id"), "review_id", 60)


STRATA_SQL = """joined AS (SELECT r."locationId", v.arrondissement FROM reviews r LEFT JOIN venues v USING ("locationId")),
quotas AS (SELECT arrondissement, count(*) AS n, CAST(greatest(1, floor(20 * count(*) / CAST((SELECT count(*) FROM joined) AS DOUBLE))) AS INTEGER) AS quota
  FROM joined WHERE arrondissement IS NOT NULL GROUP BY 1)"""


def _with_strata(spark, sf):
    v = B.venues(spark, sf).select("locationId", "arrondissement")
    return J.with_group_value(B.reviews(spark, sf).select("review_id", "locationId"), v, "locationId")


@query("s5_stratum_quotas", f"""WITH {RV}, {V}, {STRATA_SQL} SELECT arrondissement, n, quota FROM quotas""")
def _(spark, sf):
    return X.stratum_quotas(_with_strata(spark, sf), "arrondissement", 20)


@query("s5_stratified_sample", f"""WITH {RV}, {V}, {STRATA_SQL}, ids AS (SELECT DISTINCT "locationId", arrondissement, md5('42:' || CAST("locationId" AS VARCHAR)) AS d FROM joined),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY arrondissement ORDER BY d) AS r FROM ids WHERE arrondissement IS NOT NULL),
  chosen AS (SELECT "locationId" FROM ranked JOIN quotas USING (arrondissement) WHERE r <= quota),
  others AS (SELECT "locationId", row_number() OVER (ORDER BY d) AS r FROM ids WHERE "locationId" NOT IN (SELECT "locationId" FROM chosen))
  SELECT "locationId" FROM chosen UNION ALL SELECT "locationId" FROM others WHERE r <= 20 - (SELECT count(*) FROM chosen)""")
def _(spark, sf):
    return X.stratified_venues(_with_strata(spark, sf), "locationId", "arrondissement", 20)
