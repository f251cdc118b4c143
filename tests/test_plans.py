"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from venuelens.operators import joins as J
from venuelens.operators import ordering as O
from venuelens.plans import bindings as B
from venuelens.plans.catalog import ORACLES, QUERIES
from venuelens.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(read_table(spark, f"{SF}/orders.parquet", ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 250000))
    assert "GreaterThan(o_totalprice,250000.0)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_rollup_reads_only_its_columns(spark):
    p = plan(QUERIES["d27_venue_profile"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_copies_are_limited_before_the_shuffle(spark):
    df = B.reviews(spark, SF)
    p = plan(J.keep_one(df, "review_id", F.asc("rating")))
    assert p.index("Final") < p.index("Exchange") < p.index("Partial")
    assert "WindowGroupLimit" in plan(O.extremes_per_group(df, "locationId", "rating", "review_id"))


# Queries that do eager work of their own when they are built are covered by the oracle test.
LIGHT = ["b1_venue_filter", "c7_item_category", "d27_venue_profile", "j1_enriched_venues", "k1_chi2", "k2_residuals", "k5_spearman",
         "r5_flow_edges", "p9_label_pairs", "w2_empirical_cdf", "c19_price_quality", "d9_value_shares", "j6_radius_neighbours"]


@pytest.mark.parametrize("name", LIGHT)
def test_no_cross_products(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_every_query_is_registered_with_sql_or_listed():
    without = {n for n in QUERIES if n not in ORACLES}
    assert without <= {"p6_spatial_clusters", "p6_cluster_centres"}
