"""Queries over statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens.operators import smoothing
from venuelens.operators import stats as K
from venuelens.plans import bindings as B
from venuelens.plans.registry import query

V, MG = B.VENUES_SQL, B.MERGED_SQL
CELLS = """cells AS (SELECT o_orderpriority AS "row", o_orderstatus AS "col", count(*) AS n FROM orders GROUP BY 1, 2)"""
GRID = """r AS (SELECT "row", sum(n) AS r FROM cells GROUP BY 1), c AS (SELECT "col", sum(n) AS c FROM cells GROUP BY 1),
  grid AS (SELECT r."row", c."col", coalesce(n, 0) AS n, CAST(r AS DOUBLE) * c / (SELECT sum(n) FROM cells) AS e FROM r CROSS JOIN c LEFT JOIN cells USING ("row", "col"))"""


def chi2_sql(cells: str, yates: bool = False) -> str:
    term = "(abs(n - e) - least(abs(n - e), 0.5e0))" if yates else "(n - e)"
    return f"""WITH {cells}, {GRID}, s AS (SELECT sum({term} * {term} / e) AS x, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT "row") AS nr, count(DISTINCT "col") AS nc FROM grid)
  SELECT x AS statistic, CAST((nr-1)*(nc-1) AS INTEGER) AS dof, n AS n_samples, sqrt(x / (n * (least(nr, nc) - 1))) AS effect_size FROM s"""


def _orders(spark, sf):
    return B.table(spark, sf, "orders", ["o_orderpriority", "o_orderstatus"])


@query("k1_chi2", chi2_sql(CELLS), doubles="statistic effect_size")
def _(spark, sf):
    return K.chi2_independence(K.contingency(_orders(spark, sf), "o_orderpriority", "o_orderstatus"), with_p=False).drop("error")


CELLS2 = """cells AS (SELECT l_returnflag = 'R' AS "row", l_linestatus AS "col", count(*) AS n FROM lineitem GROUP BY 1, 2)"""


@query("k1_chi2_corrected", chi2_sql(CELLS2, yates=True), doubles="statistic effect_size")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus"]).withColumn("r", F.col("l_returnflag") == "R")
    return K.chi2_independence(K.contingency(li, "r", "l_linestatus"), with_p=False).drop("error")


@query("k1_chi2_p", f"""WITH k AS ({chi2_sql(CELLS)}), h AS (SELECT *, statistic / 2 AS h FROM k)
  SELECT statistic, dof, exp(-h) * (1 + h + h*h/2 + h*h*h/6) AS p_value, CASE WHEN effect_size < 0.1 THEN 'tres faible' WHEN effect_size < 0.2 THEN 'faible'
  WHEN effect_size < 0.4 THEN 'moderee' WHEN effect_size < 0.6 THEN 'forte' ELSE 'tres forte' END AS effect_label FROM h""", doubles="statistic p_value")
def _(spark, sf):
    # Five priorities and three statuses: 8 degrees of freedom have a closed form.
    return K.chi2_independence(K.contingency(_orders(spark, sf), "o_orderpriority", "o_orderstatus")).select(
        "statistic", "dof", "p_value", "effect_label")


@query("k2_residuals", f"""WITH {CELLS}, {GRID} SELECT "row", "col", CAST(n AS BIGINT) AS n, e, (n - e) / sqrt(e) AS residual FROM grid""", doubles="e residual")
def _(spark, sf):
    return K.residuals(K.contingency(_orders(spark, sf), "o_orderpriority", "o_orderstatus"))


def anova_sql(table: str, group: str, value: str) -> str:
    return f"""g AS (SELECT {group} AS grp, count({value}) AS n, avg({value}) AS m, var_pop({value}) AS v FROM {table} WHERE {value} IS NOT NULL AND {group} IS NOT NULL
  GROUP BY 1 HAVING count({value}) >= 2), t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * power(m - (SELECT sum(n * m) / sum(n) FROM g), 2)) AS ssb, sum(n * v) AS ssw FROM g),
  f AS (SELECT (ssb / (k - 1)) / (ssw / (n - k)) AS statistic, ssb / (ssb + ssw) AS effect_size, k AS n_groups, n AS n_total, k - 1 AS dof_between, n - k AS dof_within FROM t)"""


@query("k3_anova", f"""WITH {V}, {anova_sql('venues', 'arrondissement', 'rating')} SELECT * FROM f""", doubles="statistic effect_size")
def _(spark, sf):
    return K.anova(B.venues(spark, sf), "arrondissement", "rating", with_p=False).drop("error")


@query("k3_anova_p", f"""WITH {anova_sql('lineitem', 'l_returnflag', 'l_quantity')} SELECT statistic, n_total, power(dof_within / (dof_within + 2 * statistic), dof_within / 2e0) AS p_value FROM f""",
       doubles="statistic p_value")
def _(spark, sf):
    # Three flags: with two degrees of freedom between groups the tail has a closed form.
    return K.anova(B.table(spark, sf, "lineitem", ["l_returnflag", "l_quantity"]), "l_returnflag", "l_quantity").select("statistic", "n_total", "p_value")


@query("k3_group_moments", """SELECT l_returnflag AS "group", count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1""", doubles="mean std")
def _(spark, sf):
    return K.group_moments(B.table(spark, sf, "lineitem", ["l_returnflag", "l_quantity"]), "l_returnflag", "l_quantity")


KW = """d AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem), rk AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM d),
  s AS (SELECT g, sum(r) AS r, count(*) AS n FROM rk GROUP BY 1), ties AS (SELECT sum(t*t*t - t) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY v)),
  b AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q FROM s),
  h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT t FROM ties) / (n*n*n - n)) AS statistic, k, n FROM b)"""


@query("k4_kruskal_wallis", f"""WITH {KW} SELECT statistic, greatest(0, least(1, (statistic - k + 1) / (n - k))) AS effect_size, k AS n_groups, CAST(n AS BIGINT) AS n_total, k - 1 AS dof FROM h""",
       doubles="statistic effect_size")
def _(spark, sf):
    return K.kruskal_wallis(B.table(spark, sf, "lineitem", ["l_returnflag", "l_quantity"]), "l_returnflag", "l_quantity", with_p=False).drop("error")


@query("k4_kruskal_wallis_p", f"""WITH {KW} SELECT statistic, exp(-statistic / 2) AS p_value, CASE WHEN exp(-statistic / 2) < 0.001 THEN 'Hautement significatif'
  WHEN exp(-statistic / 2) < 0.01 THEN 'Tres significatif' WHEN exp(-statistic / 2) < 0.05 THEN 'Significatif' ELSE 'Non significatif' END AS interpretation FROM h""", doubles="statistic p_value")
def _(spark, sf):
    return K.kruskal_wallis(B.table(spark, sf, "lineitem", ["l_returnflag", "l_quantity"]), "l_returnflag", "l_quantity").select("statistic", "p_value", "interpretation")


@query("k4_group_quartiles", """SELECT o_orderpriority AS "group", count(*) AS n, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr
  FROM orders GROUP BY 1""", doubles="median iqr")
def _(spark, sf):
    return K.group_quartiles(B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]), "o_orderpriority", "o_totalprice")


def rho_sql(source: str) -> str:
    return f"""d AS ({source}), rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM d), rho AS (SELECT corr(rx, ry) AS rho, count(*) AS n FROM rk)"""


def t_tail_sql(t: str, dof: str) -> str:
    """Two-sided t tail: numeric integral of cos^(dof-1) over the tail angle (Simpson)."""
    return f"""(SELECT 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * sum(w * power(greatest(cos(a + (pi()/2 - a) * i / 4000e0), 0), {dof} - 1)) * (pi()/2 - a) / 12000
  FROM (SELECT i, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, atan(abs({t}) / sqrt({dof})) AS a FROM generate_series(0, 4000) AS s(i)) GROUP BY a)"""


RATED = """SELECT CAST(nb_items_total AS DOUBLE) AS x, rating AS y FROM venues WHERE rating IS NOT NULL AND nb_items_total IS NOT NULL"""


@query("k5_spearman", f"""WITH {rho_sql('SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem')} SELECT rho AS statistic, n AS n_samples, abs(rho) AS effect_size,
  CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS direction FROM rho""", doubles="statistic effect_size")
def _(spark, sf):
    return K.spearman(B.table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice", with_p=False).drop("error")


@query("k5_spearman_p", f"""WITH {V}, {rho_sql(RATED)}, t AS (SELECT rho, n - 2e0 AS dof, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rho)
  SELECT rho AS statistic, {t_tail_sql('t.t', 't.dof')} AS p_value FROM t""", doubles="statistic p_value")
def _(spark, sf):
    return K.spearman(B.venues(spark, sf), "nb_items_total", "rating").select("statistic", "p_value")


WELCH = """m AS (SELECT count(x) FILTER (f) AS na, count(x) FILTER (NOT f) AS nb, avg(x) FILTER (f) AS ma, avg(x) FILTER (NOT f) AS mb, var_samp(x) FILTER (f) AS va,
  var_samp(x) FILTER (NOT f) AS vb, stddev_pop(x) FILTER (f) AS sa, stddev_pop(x) FILTER (NOT f) AS sb FROM d),
  w AS (SELECT (ma - mb) / sqrt(va/na + vb/nb) AS statistic, power(va/na + vb/nb, 2) / (power(va/na, 2)/(na-1) + power(vb/nb, 2)/(nb-1)) AS dof,
  abs((ma - mb) / sqrt(((na-1)*va + (nb-1)*vb) / (na+nb-2))) AS effect_size, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, sa AS std_a, sb AS std_b FROM m)"""


@query("k6_welch", f"""WITH {V}, d AS (SELECT rating AS x, "hasMichelin" AS f FROM venues), {WELCH} SELECT * FROM w""", doubles="statistic dof effect_size mean_a mean_b std_a std_b")
def _(spark, sf):
    return K.welch(B.venues(spark, sf), F.col("hasMichelin"), "rating", with_p=False).drop("error", "name_a", "name_b")


@query("k6_welch_p", f"""WITH {V}, d AS (SELECT rating AS x, price_level_num > 2 AS f FROM venues WHERE price_level_num IS NOT NULL), {WELCH} SELECT statistic, {t_tail_sql('q.statistic', 'q.dof')} AS p_value FROM w AS q""",
       doubles="statistic p_value")
def _(spark, sf):
    return K.welch(B.venues(spark, sf), F.col("price_level_num") > 2, "rating").select("statistic", "p_value")


@query("k7_contingency", f"""WITH {V}, tops AS (SELECT label FROM venues JOIN labels_of USING ("locationId") WHERE arrondissement IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
  SELECT label AS "row", arrondissement AS "col", count(*) AS n FROM venues JOIN labels_of USING ("locationId") WHERE arrondissement IS NOT NULL AND label IN (SELECT label FROM tops) GROUP BY 1, 2""")
def _(spark, sf):
    return K.label_contingency(B.venues(spark, sf), "cuisine_list", "arrondissement", 8)


@query("k7_wide_contingency", """SELECT o_orderpriority AS "row", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
  FROM orders GROUP BY 1""")
def _(spark, sf):
    return K.wide_contingency(K.contingency(_orders(spark, sf), "o_orderpriority", "o_orderstatus"), ["F", "O", "P"])


@query("k8_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS pearson, count(*) AS n FROM lineitem" for a, b in
                                                (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))), doubles="pearson")
def _(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return K.pearson_matrix(B.table(spark, sf, "lineitem", cols), cols)


@query("k9_ols", f"""WITH {V} SELECT "priceLevel", count(*) AS n, regr_slope("reviewCount", rating) AS slope, regr_intercept("reviewCount", rating) AS intercept,
  regr_r2("reviewCount", rating) AS r2 FROM venues WHERE rating IS NOT NULL AND "priceLevel" IS NOT NULL GROUP BY 1""", doubles="slope intercept r2")
def _(spark, sf):
    return K.ols(B.venues(spark, sf), "rating", "reviewCount", ["priceLevel"])


@query("k9_ols_overall", """SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2
  FROM lineitem""", doubles="slope intercept r2")
def _(spark, sf):
    return K.ols(B.table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


@query("k10_local_trend", """WITH g AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), p AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 19 AS x_at, (hi - lo) * 0.3e0 AS h FROM g, generate_series(0, 19) AS s(i)),
  d AS (SELECT i, x_at, l_quantity - x_at AS d, l_extendedprice AS y, power(1 - power(abs(l_quantity - x_at) / h, 3), 3) AS w FROM lineitem JOIN p ON abs(l_quantity - x_at) < h),
  m AS (SELECT i, x_at, count(*) AS n, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*y) AS t0, sum(w*d*y) AS t1 FROM d GROUP BY 1, 2)
  SELECT i, x_at, n, (s2*t0 - s1*t1) / (s0*s2 - s1*s1) AS fit FROM m""", doubles="x_at fit")
def _(spark, sf):
    return K.local_trend(B.table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


def lowess_sql(rows: str, share: str, points: int, rounds: int) -> str:
    """The same fits from the rows: nearest distances by sorting, every round written out."""
    last = points - 1
    parts = [f"""d AS ({rows}), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM d), g AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / {last} AS a FROM e, generate_series(0, {last}) AS s(i)),
  near AS (SELECT i, a, abs(x - a) AS r, row_number() OVER (PARTITION BY i ORDER BY abs(x - a)) AS k FROM d, g),
  w AS (SELECT i, a, r AS h FROM near WHERE k = (SELECT CAST(floor({share} * n + 1e-10) AS BIGINT) FROM e)), r0 AS (SELECT x, y, 1e0 AS robust FROM d)"""]
    for k in range(rounds + 1):
        parts.append(f"""s{k} AS (SELECT i, a, h, x - a AS d, y, robust * power(1 - power(abs(x - a) / h, 3), 3) AS w FROM r{k}, w WHERE abs(x - a) < h),
  m{k} AS (SELECT i, a, h, count(*) AS n, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*y) AS t0, sum(w*d*y) AS t1 FROM s{k} GROUP BY 1, 2, 3),
  f{k} AS (SELECT i, a AS x_at, h AS width, n, (s2*t0 - s1*t1) / (s0*s2 - s1*s1) AS fit FROM m{k})""")
        if k < rounds:
            parts.append(f"""o{k} AS (SELECT x, y, abs(y - (p.fit + (q.fit - p.fit) * ((x - lo) * {last} / (hi - lo) - p.i))) AS o FROM d, e JOIN f{k} p ON true JOIN f{k} q ON q.i = p.i + 1
    WHERE p.i = least(CAST(floor((x - lo) * {last} / (hi - lo)) AS INTEGER), {last - 1})),
  r{k + 1} AS (SELECT x, y, CASE WHEN o < 6 * c THEN power(1 - power(o / (6 * c), 2), 2) ELSE 0 END AS robust FROM o{k}, (SELECT median(o) AS c FROM o{k}))""")
    return f"WITH {', '.join(parts)} SELECT * FROM f{rounds}"


OUTLYING = "SELECT l_extendedprice / 1000 AS x, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 20 ELSE l_quantity END AS y FROM lineitem"


@query("k10_lowess", lowess_sql(OUTLYING, "0.25e0", 9, 2), doubles="x_at width fit")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"])
    rows = li.select((F.col("l_extendedprice") / 1000).alias("x"),
                     F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity") * 20).otherwise(F.col("l_quantity")).alias("y"))
    return smoothing.lowess(rows, "x", "y", 0.25, 9, 2)
