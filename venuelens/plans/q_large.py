"""Queries that take the ways meant for very large tables, by thresholds set low, over data with NULL keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens.operators import ordering as O
from venuelens.operators import sampling as X
from venuelens.operators.quantiles import grouped_stats
from venuelens.operators.skew import spread_join
from venuelens.plans import bindings as B
from venuelens.plans.registry import query


@query("w1_average_ranks_cut", """SELECT l_quantity, n, c - n + (n + 1) / 2e0 AS rank_avg FROM (SELECT l_quantity, count(*) AS n,
  CAST(sum(count(*)) OVER (ORDER BY l_quantity) AS BIGINT) AS c FROM lineitem GROUP BY 1)""", doubles="l_quantity rank_avg")
def _(spark, sf):
    return O.average_ranks(B.table(spark, sf, "lineitem", ["l_quantity"]), "l_quantity", rows_per_bucket=7)


@query("w1_row_ranks_cut", """SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS rank_avg
  FROM lineitem""", doubles="rank_avg")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return O.row_ranks(li, "l_quantity", rows_per_bucket=7).select("l_orderkey", "l_linenumber", "l_partkey", "rank_avg")


@query("w2_empirical_cdf_cut", """WITH tops AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
  c AS (SELECT o_orderpriority, o_totalprice, count(*) AS n FROM orders SEMI JOIN tops USING (o_orderpriority) GROUP BY 1, 2)
  SELECT o_orderpriority, o_totalprice, n, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) / CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS cdf
  FROM c""", doubles="o_totalprice cdf")
def _(spark, sf):
    return O.empirical_cdf(B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]), "o_totalprice", "o_orderpriority", 3,
                           rows_per_bucket=200)


ONE_NULL = "nullif(doc_id, 10)"


@query("w3_chunks_cut", f"""SELECT {ONE_NULL} AS doc_id, CAST((row_number() OVER (ORDER BY {ONE_NULL} NULLS FIRST) - 1) % 7 AS INTEGER) AS chunk_id FROM documents""")
def _(spark, sf):
    ids = B.table(spark, sf, "documents", ["doc_id"]).select(F.expr(ONE_NULL).alias("doc_id"))
    return O.assign_chunks(ids, "doc_id", 7, rows_per_bucket=30)


@query("s4_uniform_sample_cut", f"SELECT {ONE_NULL} AS doc_id FROM documents ORDER BY md5('42:' || coalesce(CAST({ONE_NULL} AS VARCHAR), 'NULL')) LIMIT 150")
def _(spark, sf):
    ids = B.table(spark, sf, "documents", ["doc_id"]).select(F.expr(ONE_NULL).alias("doc_id"))
    return X.uniform_sample(ids, "doc_id", 150, top_rows=0)


@query("k4_group_quartiles_cut", """SELECT nullif(o_orderpriority, '1-URGENT') AS "group", count(*) AS n, median(o_totalprice) AS median,
  quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1""", doubles="median iqr")
def _(spark, sf):
    orders = B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"])
    named = orders.withColumn("group", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    out = grouped_stats(named, ["group"], [F.count("*").alias("n")], {"median": ("o_totalprice", 0.5), "_a": ("o_totalprice", 0.25), "_b": ("o_totalprice", 0.75)},
                        accuracy=50, direct_rows=0)
    return out.select("group", "n", "median", (F.col("_b") - F.col("_a")).alias("iqr"))


@query("j4_uneven_lookup_cut", f"""WITH {B.REVIEWS_SQL}, {B.VENUES_SQL} SELECT r."locationId", v.name, count(*) AS n FROM reviews r LEFT JOIN venues v USING ("locationId") GROUP BY 1, 2""")
def _(spark, sf):
    # rows that are nothing but their key, a third of them one key
    keys = B.reviews(spark, sf).select("locationId")
    joined = spread_join(keys, B.venues(spark, sf).select("locationId", "name"), ["locationId"], "left", salts=8, min_rows=1)
    return joined.groupBy("locationId", "name").agg(F.count("*").alias("n"))
