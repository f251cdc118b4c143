"""Queries over chart data and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.operators import chartdata as C
from venuelens.operators import clusters
from venuelens.operators import reports as P
from venuelens.operators import rollups as R
from venuelens.operators import smoothing, spatial, stats
from venuelens.plans import bindings as B
from venuelens.plans.q_filters import QP_SQL
from venuelens.plans.q_joins import REVIEW_TEXTS, season_hits_sql
from venuelens.plans.q_stats import rho_sql, t_tail_sql
from venuelens.plans.registry import query

V, RV, SC, IT, MG = B.VENUES_SQL, B.REVIEWS_SQL, B.SCORED_SQL, B.ITEMS_SQL, B.MERGED_SQL


def bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(least(floor(({x} - {lo}) * {bins} / ({hi} - {lo})), {bins - 1}) AS INTEGER)"


@query("r1_histogram", f"""WITH g AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT {bin_sql('o_totalprice', 'lo', 'hi', 30)} AS bin, count(*) AS n FROM orders, g GROUP BY 1)
  SELECT bin, n, lo + (hi - lo) / 30 * bin AS lower, lo + (hi - lo) / 30 * (bin + 1) AS upper FROM b, g""", doubles="lower upper")
def _(spark, sf):
    return C.histogram(B.table(spark, sf, "orders", ["o_totalprice"]), "o_totalprice", 30)


@query("r1_grouped_histogram", f"""WITH g AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
  SELECT l_returnflag, {bin_sql('l_extendedprice', 'lo', 'hi', 40)} AS bin, count(*) AS n FROM lineitem, g GROUP BY 1, 2""")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"])
    return C.histogram(li, "l_extendedprice", 40, "l_returnflag").drop("lower", "upper")


@query("r2_box_summary", """WITH q AS (SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS fence_low, q3 + 1.5 * (q3 - q1) AS fence_high FROM q)
  SELECT f.*, min(o_totalprice) FILTER (o_totalprice >= fence_low) AS whisker_low, max(o_totalprice) FILTER (o_totalprice <= fence_high) AS whisker_high,
  count(*) FILTER (o_totalprice < fence_low OR o_totalprice > fence_high) AS n_outliers FROM f JOIN orders USING (o_orderpriority) GROUP BY ALL""",
       doubles="min max q1 median q3 fence_low fence_high whisker_low whisker_high")
def _(spark, sf):
    return C.box_summary(B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]), "o_orderpriority", "o_totalprice")


@query("r3_group_density", f"""WITH {V}, g AS (SELECT min(rating) AS lo, max(rating) AS hi FROM venues WHERE "priceLevel" IS NOT NULL)
  SELECT "priceLevel", {bin_sql('rating', 'lo', 'hi', 20)} AS bin, count(*) AS n FROM venues, g WHERE rating IS NOT NULL AND "priceLevel" IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return C.histogram(B.venues(spark, sf), "rating", 20, "priceLevel").drop("lower", "upper")


@query("r3_kernel_density", f"""WITH {V}, d AS (SELECT "priceLevel" AS "group", rating AS x FROM venues WHERE rating IS NOT NULL AND "priceLevel" IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
  b AS (SELECT "group", count(*) AS n, 1.059e0 * CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349e0) ELSE stddev_samp(x) END
    * power(count(*), -0.2e0) AS bandwidth FROM d GROUP BY 1), g AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) / 40 * i AS x_at FROM e, generate_series(0, 40) AS s(i))
  SELECT "group", i, x_at, n, bandwidth, sum(exp(-0.5e0 * power((x_at - x) / bandwidth, 2))) / (n * bandwidth * sqrt(2 * pi())) AS density FROM d JOIN b USING ("group"), g GROUP BY 1, 2, 3, 4, 5""",
       doubles="x_at bandwidth density")
def _(spark, sf):
    # ratings lie on the 41 grid points, where the linear split is exact
    return smoothing.kernel_density(B.venues(spark, sf), "rating", "priceLevel", 41)


@query("r4_density_grid", f"""WITH g AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
  SELECT {bin_sql('l_quantity', 'x0', 'x1', 30)} AS bin_x, {bin_sql('l_extendedprice', 'y0', 'y1', 30)} AS bin_y, count(*) AS n FROM lineitem, g GROUP BY 1, 2""")
def _(spark, sf):
    return C.density_grid(B.table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


BIN = "CASE WHEN rating <= 0 THEN NULL WHEN rating <= 3.5 THEN 'Faible (<3.5)' WHEN rating <= 4 THEN 'Moyen (3.5-4)' WHEN rating <= 4.5 THEN 'Bon (4-4.5)' WHEN rating <= 5 THEN 'Excellent (>4.5)' END"


@query("r5_flow_edges", f"""WITH {V}, x AS (SELECT label, "priceLevel" AS price, rating FROM venues JOIN labels_of USING ("locationId") WHERE rating IS NOT NULL AND "priceLevel" IS NOT NULL),
  tops AS (SELECT label FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), k AS (SELECT *, {BIN} AS q FROM x WHERE label IN (SELECT label FROM tops))
  SELECT label AS source, price AS target, count(*) AS n, CAST(1 AS INTEGER) AS stage FROM k GROUP BY 1, 2 UNION ALL
  SELECT p.price, b.q, (SELECT count(*) FROM k WHERE k.price = p.price AND k.q = b.q), CAST(2 AS INTEGER) FROM (SELECT DISTINCT price FROM k) p,
  (VALUES ('Faible (<3.5)'), ('Moyen (3.5-4)'), ('Bon (4-4.5)'), ('Excellent (>4.5)')) b(q)""")
def _(spark, sf):
    return C.flow_edges(B.venues(spark, sf))


@query("r6_facet_rows", f"""WITH {V} SELECT "locationId", arrondissement, rating FROM venues WHERE arrondissement IN
  (SELECT arrondissement FROM venues WHERE arrondissement IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 9)""", doubles="rating")
def _(spark, sf):
    from venuelens.operators.ordering import restrict_to_top
    return restrict_to_top(B.venues(spark, sf), "arrondissement", 9).select("locationId", "arrondissement", "rating")


@query("r7_grouped_bars", """SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2""", doubles="mean", ints="", longs="total")
def _(spark, sf):
    out = C.grouped_bars(B.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return out.withColumn("total", F.round("total", 0).cast("long"))


@query("r8_map_points", f"""WITH {V} SELECT latitude, longitude, name, rating, nb_restos_500m FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
       doubles="latitude longitude rating nb_restos_500m")
def _(spark, sf):
    return C.map_points(B.venues(spark, sf), ["name", "rating", "nb_restos_500m"])


@query("r9_spatial_density", f"""WITH {V} SELECT CAST(floor(latitude / 0.01) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.01) AS BIGINT) AS cell_lon, count(*) AS n, CAST(sum("reviewCount") AS BIGINT) AS weight
  FROM venues WHERE latitude IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return spatial.grid_density(B.venues(spark, sf), "latitude", "longitude", "reviewCount")


@query("r9_kernel_heat", f"""WITH {V}, d AS (SELECT latitude / 0.005e0 AS p, longitude / 0.005e0 AS q, CAST("reviewCount" AS DOUBLE) AS z FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
  b AS (SELECT stddev_samp(p) * power(count(*), -1e0 / 6) AS hp, stddev_samp(q) * power(count(*), -1e0 / 6) AS hq FROM d),
  c AS (SELECT CAST(floor(p) AS BIGINT) + u AS i, CAST(floor(q) AS BIGINT) + v AS j, z * abs(1 - u - (p - floor(p))) * abs(1 - v - (q - floor(q))) AS w FROM d, (VALUES (0), (1)) x(u), (VALUES (0), (1)) y(v)),
  t AS (SELECT i + m AS cell_lat, j + k AS cell_lon, w * exp(-0.5e0 * (power(m / hp, 2) + power(k / hq, 2))) / (hp * hq * 0.005e0 * 0.005e0 * 2 * pi()) AS w
    FROM c, b, generate_series(-40, 40) x(m), generate_series(-40, 40) y(k) WHERE abs(m) <= 4 * hp AND abs(k) <= 4 * hq)
  SELECT cell_lat, cell_lon, round(sum(w), 2) AS heat FROM t WHERE w <> 0 GROUP BY 1, 2""")
def _(spark, sf):
    heat = smoothing.kernel_heat(B.venues(spark, sf), "latitude", "longitude", "reviewCount")
    return heat.withColumn("heat", F.round("heat", 2))


@query("r10_category_totals", f"""WITH {V}, v AS (SELECT * FROM venues WHERE nb_items_total > 0 AND rating IS NOT NULL) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS category, CAST(sum("{c}") AS BIGINT) AS total FROM v""" for c in L.CATEGORIES))
def _(spark, sf):
    return C.category_totals(B.venues(spark, sf))


@query("r11_season_means", f"""WITH {V}, v AS (SELECT * FROM venues WHERE seasonal_printemps_ratio IS NOT NULL) """ + " UNION ALL ".join(
    f"""SELECT '{s}' AS season, avg("seasonal_{s}_ratio") AS mean_ratio FROM v""" for s in L.SEASON_TERMS), doubles="mean_ratio")
def _(spark, sf):
    return C.season_means(B.venues(spark, sf))


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS)


@query("r12_word_frequencies", rf"""WITH {SC}, w AS (SELECT "locationId", CASE WHEN sent_class <= 2 THEN 'negative' WHEN sent_class >= 4 THEN 'positive' END AS polarity,
  unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS word FROM scored), c AS (SELECT "locationId", polarity, word, count(*) AS n FROM w
  WHERE polarity IS NOT NULL AND length(word) >= 2 AND word NOT IN ({STOP}) GROUP BY 1, 2, 3),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "locationId", polarity ORDER BY n DESC, word) AS INTEGER) AS "position" FROM c)
  SELECT * FROM r WHERE "position" <= 50""")
def _(spark, sf):
    return C.word_frequencies(B.scored(spark, sf, spread=True))


# ---- reports ---------------------------------------------------------------------------

@query("p2_rankings", f"""WITH {V} SELECT "locationId", arrondissement, rating, rank() OVER (PARTITION BY arrondissement ORDER BY rating DESC) AS rank,
  row_number() OVER (PARTITION BY arrondissement ORDER BY rating DESC, "locationId") AS row_no, percent_rank() OVER (PARTITION BY arrondissement ORDER BY rating DESC) AS percent_rank
  FROM venues WHERE arrondissement IS NOT NULL AND rating IS NOT NULL""", doubles="rating percent_rank")
def _(spark, sf):
    return P.rankings(B.venues(spark, sf), "arrondissement", "rating", "locationId")


@query("p3_group_stats", """SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS level,
  CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus ELSE 'all' END AS member, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""", doubles="mean std")
def _(spark, sf):
    return P.group_stats(B.table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("p4_price_analysis", f"""WITH {IT} SELECT category, count(item_price) AS n, avg(item_price) AS mean, quantile_cont(item_price, 0.25) AS q25, median(item_price) AS median,
  quantile_cont(item_price, 0.75) AS q75 FROM items WHERE item_price IS NOT NULL GROUP BY 1""", doubles="mean q25 median q75")
def _(spark, sf):
    return P.price_analysis(B.items(spark, sf), ["category"])


@query("p5_distributions", f"""WITH {' , '.join(f"g{i} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)" for i, c in enumerate(['l_quantity', 'l_discount']))} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {bin_sql(c, 'lo', 'hi', 13)} AS bin, count(*) AS n FROM lineitem, g{i} GROUP BY 2" for i, c in enumerate(['l_quantity', 'l_discount'])))
def _(spark, sf):
    return C.distributions(B.table(spark, sf, "lineitem", ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"], 13)


def clusters_sql(k: int, steps: int) -> str:
    """Lloyd steps written out; ``a`` tables are labels, ``c`` tables centres."""
    parts = [f"""pts AS (SELECT "locationId", latitude, longitude FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
  c0 AS (SELECT CAST(row_number() OVER (ORDER BY "locationId") - 1 AS INTEGER) AS i, latitude, longitude FROM (SELECT * FROM pts ORDER BY "locationId" LIMIT {k}))"""]
    for n in range(steps + 1):
        parts.append(f"""a{n} AS (SELECT p."locationId", p.latitude, p.longitude,
  min(struct_pack(d := power(p.latitude - c.latitude, 2) + power(p.longitude - c.longitude, 2), i := c.i)).i AS cluster FROM pts p, c{n} c GROUP BY 1, 2, 3),
  c{n + 1} AS (SELECT c.i, coalesce(m.a, c.latitude) AS latitude, coalesce(m.b, c.longitude) AS longitude FROM c{n} c
  LEFT JOIN (SELECT cluster, avg(latitude) AS a, avg(longitude) AS b FROM a{n} GROUP BY 1) m ON m.cluster = c.i)""")
    return ", ".join(parts)


@query("p6_spatial_clusters", f"""WITH {V}, {clusters_sql(5, 6)} SELECT "locationId", cluster FROM a6""")
def _(spark, sf):
    return P.spatial_clusters(B.venues(spark, sf), 5, 6)[0]


@query("p6_cluster_centres", f"""WITH {V}, {clusters_sql(5, 6)} SELECT i AS cluster, latitude * 1000 AS lat_thousandths,
  longitude * 1000 AS lon_thousandths FROM c6""", doubles="lat_thousandths lon_thousandths")
def _(spark, sf):
    # thousandths of a degree: more digits than the rounding of results would leave
    centres = P.spatial_clusters(B.venues(spark, sf), 5, 6)[1]
    return centres.select("cluster", (F.col("latitude") * 1000).alias("lat_thousandths"), (F.col("longitude") * 1000).alias("lon_thousandths"))


@query("p6_seeded_clusters", f"""WITH {V} SELECT count(*) AS n_venues, CAST(8 AS BIGINT) AS n_clusters, true AS all_nearest, true AS centres_are_means, true AS beats_first_ids
  FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def _(spark, sf):
    # a fixed point of Lloyd's step, no dearer than the clusters that start from the first ids
    venues = B.venues(spark, sf)
    places = ["latitude", "longitude"]
    labels, centres = clusters.kmeans(venues, "locationId", places, 8)
    first = P.spatial_clusters(venues, 8, 20)[1].select(F.collect_list(F.struct(*places)).alias("c"))
    rows = labels.join(venues.select("locationId", *places), "locationId")

    def gap(of):
        return sum((F.col(p) - of[p]) ** 2 for p in places)

    every = centres.select(F.collect_list(F.struct("cluster", *places)).alias("c"))
    judged = rows.join(F.broadcast(every)).join(F.broadcast(first.withColumnRenamed("c", "f"))).select(
        "cluster", *places, "distance2", F.array_min(F.transform("c", gap)).alias("least"), F.array_min(F.transform("f", gap)).alias("other"))
    means = judged.groupBy("cluster").agg(*[F.avg(p).alias(f"m_{p}") for p in places]).join(centres, "cluster").agg(
        F.count("*").alias("n_clusters"), F.max(sum(F.abs(F.col(f"m_{p}") - F.col(p)) for p in places)).alias("off"))
    return judged.agg(F.count("*").alias("n_venues"), (F.max(F.col("distance2") - F.col("least")) < 1e-12).alias("all_nearest"),
                      (F.sum("least") <= F.sum("other")).alias("beats_first_ids")).join(means).select(
        "n_venues", "n_clusters", "all_nearest", (F.col("off") < 1e-6).alias("centres_are_means"), "beats_first_ids")


@query("p7_outliers", """WITH x AS (SELECT l_orderkey, l_extendedprice * l_quantity AS amount FROM lineitem),
  q AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM x),
  f AS (SELECT l_orderkey, amount, amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) AS tukey, abs((amount - m) / s) > 3 AS z3 FROM x, q)
  SELECT * FROM f WHERE tukey OR z3""", doubles="amount")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_quantity"])
    return P.outliers(li.withColumn("amount", F.col("l_extendedprice") * F.col("l_quantity")), "l_orderkey", "amount")


@query("p8_label_analysis", f"""WITH {V} SELECT label, count(*) AS n, avg(rating) AS mean, stddev_samp(rating) AS std, CAST(sum("reviewCount") AS BIGINT) AS n_reviews
  FROM venues JOIN labels_of USING ("locationId") GROUP BY 1""", doubles="mean std")
def _(spark, sf):
    return P.label_analysis(B.venues(spark, sf))


@query("p8_label_prices", f"""WITH {V}, {IT} SELECT label, count(item_price) AS n, avg(item_price) AS mean, min(item_price) AS min, max(item_price) AS max FROM labels_of JOIN items USING ("locationId")
  WHERE item_price IS NOT NULL GROUP BY 1""", doubles="mean min max")
def _(spark, sf):
    return P.label_prices(B.venues(spark, sf), B.items(spark, sf))


@query("p9_label_pairs", f"""WITH {V} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM labels_of a JOIN labels_of b ON a."locationId" = b."locationId" AND a.label < b.label GROUP BY 1, 2""")
def _(spark, sf):
    return R.label_pairs(B.venues(spark, sf))


@query("p10_flag_analysis", f"""WITH {V} SELECT "hasMichelin", count(*) AS n, avg(rating) AS rating_mean, stddev_samp(rating) AS rating_std, avg(price_level_num) AS price_mean,
  avg(nb_items_total) AS items_mean, CASE WHEN "hasMichelin" THEN 'Michelin' ELSE 'Non-Michelin' END AS label FROM venues GROUP BY 1, 7""", doubles="rating_mean rating_std price_mean items_mean")
def _(spark, sf):
    return P.flag_analysis(B.venues(spark, sf))


@query("p10_flag_coordinates", f"""WITH {V} SELECT latitude, longitude, name FROM venues WHERE "hasMichelin" AND latitude IS NOT NULL""", doubles="latitude longitude")
def _(spark, sf):
    return C.map_points(B.venues(spark, sf).filter("hasMichelin"), ["name"])


@query("p11_season_detail", f"""WITH {RV}, {season_hits_sql(REVIEW_TEXTS)} SELECT season, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_venues FROM hits GROUP BY 1, 2""")
def _(spark, sf):
    from venuelens.operators.menu import season_hits
    return season_hits(B.reviews(spark, sf, spread=True)).groupBy("season", "term").agg(F.sum("n").alias("n"), F.count("*").alias("n_venues"))


def _corr_sql() -> str:
    pairs = [("rating", '"reviewCount"'), ("rating", "shannon_entropy"), ('"reviewCount"', "shannon_entropy")]
    parts, outs = [], []
    for i, (a, b) in enumerate(pairs):
        src = f"SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM venues WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        body = rho_sql(src)
        for name in ("d", "rk", "rho"):
            body = body.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name})", f"FROM {name}{i})")
        parts.append(body)
        outs.append(f"""SELECT '{a.strip('"')}' AS x, '{b.strip('"')}' AS y, (SELECT corr(x, y) FROM d{i}) AS pearson, (SELECT count(*) FROM d{i}) AS n, (SELECT rho FROM rho{i}) AS spearman""")
    return f"WITH {V}, {', '.join(parts)} " + " UNION ALL ".join(outs)


@query("p12_correlations", _corr_sql(), doubles="pearson spearman")
def _(spark, sf):
    return P.correlations(B.venues(spark, sf), ["rating", "reviewCount", "shannon_entropy"])


@query("p13_multiple_regression", """WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12,
  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem), b AS (SELECT *, (v2*c1 - c12*c2) / (v1*v2 - c12*c12) AS b1, (v1*c2 - c12*c1) / (v1*v2 - c12*c12) AS b2 FROM m)
  SELECT 'intercept' AS term, my - b1*m1 - b2*m2 AS coefficient FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b""", doubles="coefficient")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_extendedprice"])
    return P.multiple_regression(li, ["l_quantity", "l_discount"], "l_extendedprice")


@query("p13_regression_inference", f"""WITH d AS (SELECT l_quantity AS x1, l_discount AS x2, l_tax + l_quantity / 10000 AS y FROM lineitem),
  m AS (SELECT CAST(count(*) AS BIGINT) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s1, var_pop(x2) * count(*) AS s2, covar_pop(x1, x2) * count(*) AS s12,
    covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2 FROM d),
  b AS (SELECT *, s1 * s2 - s12 * s12 AS det, (s2 * c1 - s12 * c2) / (s1 * s2 - s12 * s12) AS b1, (s1 * c2 - s12 * c1) / (s1 * s2 - s12 * s12) AS b2 FROM m),
  r AS (SELECT sum(power(y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)), 2)) AS rss, sum(power(y - my, 2)) AS tss FROM d, b),
  f AS (SELECT *, n - 3 AS dof, rss / (n - 3) AS v, 1 - rss / tss AS r2 FROM b, r),
  t AS (SELECT '(intercept)' AS term, my - b1 * m1 - b2 * m2 AS coefficient, sqrt(v * (1e0 / n + (m1 * m1 * s2 - 2 * m1 * m2 * s12 + m2 * m2 * s1) / det)) AS std_error FROM f
    UNION ALL SELECT 'l_quantity', b1, sqrt(v * s2 / det) FROM f UNION ALL SELECT 'l_discount', b2, sqrt(v * s1 / det) FROM f
    UNION ALL SELECT 'copy', NULL, NULL FROM f)
  SELECT term, coefficient, std_error, coefficient / std_error AS statistic, coefficient IS NULL AS aliased, n, dof, r2, 1 - (1 - r2) * (n - 1) / dof AS adjusted_r2, sqrt(v) AS sigma,
    (tss - rss) / 2 / v AS f_statistic FROM t, f""", doubles="coefficient std_error statistic r2 adjusted_r2 sigma f_statistic", longs="dof")
def _(spark, sf):
    # the third predictor is a multiple of the first
    li = B.table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax"])
    rows = li.select("l_quantity", "l_discount", (3 * F.col("l_quantity")).alias("copy"), (F.col("l_tax") + F.col("l_quantity") / 10000).alias("y"))
    return stats.regression(rows, ["l_quantity", "l_discount", "copy"], "y").drop("p_value", "f_p_value")


@query("p13_regression_p", f"""WITH {V}, d AS (SELECT rating AS y, "reviewCount" AS x FROM venues WHERE rating IS NOT NULL), m AS (SELECT count(*) - 2e0 AS dof, corr(x, y) AS r FROM d),
  t AS (SELECT dof, r * sqrt(dof / (1 - r * r)) AS t FROM m) SELECT t.t AS statistic, {t_tail_sql('t.t', 't.dof')} AS p_value FROM t""", doubles="statistic p_value")
def _(spark, sf):
    return stats.regression(B.venues(spark, sf), ["reviewCount"], "rating").filter("term = 'reviewCount'").select("statistic", "p_value")


def _terms(ts: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in ts) + ")"


@query("p14_lexicon_sentiment", rf"""WITH {RV}, w AS (SELECT "locationId", review_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS word FROM reviews),
  c AS (SELECT "locationId", review_id, count(*) FILTER (word IN {_terms(L.POSITIVE_TERMS)}) AS p, count(*) FILTER (word IN {_terms(L.NEGATIVE_TERMS)}) AS m FROM w GROUP BY 1, 2)
  SELECT r."locationId", CAST(sum(coalesce(p, 0)) AS BIGINT) AS n_positive, CAST(sum(coalesce(m, 0)) AS BIGINT) AS n_negative, avg(coalesce(p, 0) - coalesce(m, 0)) AS mean_balance
  FROM reviews r LEFT JOIN c USING (review_id) GROUP BY 1""", doubles="mean_balance")
def _(spark, sf):
    return P.lexicon_sentiment(B.reviews(spark, sf, spread=True))


PAIRS = [("rating", "reviewCount"), ("rating", "nb_items_total"), ("rating", "nb_restos_500m"), ("reviewCount", "nb_items_total"),
         ("reviewCount", "nb_restos_500m"), ("nb_items_total", "nb_restos_500m")]


def contrasts_sql(alpha: float) -> str:
    """Each district against the rows of all others, from the rows themselves; the tail is integrated (Simpson)."""
    return f"""rated AS (SELECT arrondissement AS a, rating AS x FROM venues WHERE arrondissement IS NOT NULL AND rating IS NOT NULL),
  sides AS (SELECT d.a, count(*) FILTER (r.a = d.a) AS n, avg(x) FILTER (r.a = d.a) AS mean, count(*) FILTER (r.a <> d.a) AS rest_n, avg(x) FILTER (r.a <> d.a) AS rest_mean,
    var_samp(x) FILTER (r.a = d.a) / count(*) FILTER (r.a = d.a) AS va, var_samp(x) FILTER (r.a <> d.a) / count(*) FILTER (r.a <> d.a) AS vb FROM (SELECT DISTINCT a FROM rated) d, rated r GROUP BY 1),
  tested AS (SELECT *, (mean - rest_mean) / sqrt(va + vb) AS statistic, power(va + vb, 2) / (va * va / (n - 1) + vb * vb / (rest_n - 1)) AS dof FROM sides),
  tails AS (SELECT a, any_value(2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * (pi() / 2 - t) / 12000) * sum(w * power(greatest(cos(t + (pi() / 2 - t) * i / 4000e0), 0), dof - 1)) AS p_value
    FROM (SELECT a, dof, atan(abs(statistic) / sqrt(dof)) AS t FROM tested), (SELECT i, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM generate_series(0, 4000) AS s(i)) GROUP BY a),
  steps AS (SELECT a, p_value, max({alpha}e0 * k / m) OVER (PARTITION BY p_value) AS bound FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM tails)),
  contrasts AS (SELECT tested.*, steps.p_value, coalesce(steps.p_value <= (SELECT max(p_value) FROM steps WHERE p_value <= bound), false) AS significant FROM tested JOIN steps USING (a))"""


@query("n1_significant_contrasts", f"""WITH {V}, {contrasts_sql(0.2)} SELECT a AS "group", n, mean, rest_n, rest_mean, statistic, dof, p_value, significant FROM contrasts""",
       doubles="mean rest_mean statistic dof p_value")
def _(spark, sf):
    # a generous level, so that either answer occurs
    return stats.group_contrasts(B.venues(spark, sf), "arrondissement", "rating", 0.2)


@query("n1_narrative", f"""WITH {V}, {QP_SQL}, {contrasts_sql(0.05)}, arr AS (SELECT a, mean AS m, significant, round(abs(mean - (SELECT avg(rating) FROM venues)), 6) AS gap
  FROM contrasts WHERE n >= 5 ORDER BY 4 DESC, 1 LIMIT 4),
  cc AS ({' UNION ALL '.join(f"""SELECT '{a}' AS x, '{b}' AS y, corr("{a}", "{b}") AS c FROM venues""" for a, b in PAIRS)}),
  best AS (SELECT name, round(qp_score, 6) AS s, "locationId" AS i FROM qp WHERE rating IS NOT NULL ORDER BY 2 DESC, 3 LIMIT 3),
  facts AS (SELECT 'summary' AS kind, 0e0 AS rank, printf('%d restaurants analyses dans %d arrondissements — note moyenne %.2f/5, mediane %.2f/5',
    count(*), count(DISTINCT arrondissement), avg(rating), median(rating)) AS text FROM venues
  UNION ALL SELECT 'contrast', -gap, printf('Arr %d : note moyenne %.2f', a, m) || CASE WHEN significant THEN ' (significatif)' ELSE '' END FROM arr
  UNION ALL SELECT 'anticorrelation', round(c, 6), y || ' diminue quand ' || x || ' augmente' FROM cc WHERE c < 0
  UNION ALL SELECT 'recommendation', 1, '**Meilleur rapport qualite/prix** : ' || string_agg(name, ', ' ORDER BY s DESC, i) FROM best),
  placed AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY rank, text) AS INTEGER) AS "position", text FROM facts)
  SELECT * FROM placed WHERE "position" <= CASE kind WHEN 'contrast' THEN 4 WHEN 'anticorrelation' THEN 2 WHEN 'recommendation' THEN 2 ELSE 1 END""")
def _(spark, sf):
    return P.narrative(B.venues(spark, sf))
