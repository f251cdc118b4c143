"""Semantics that are easy to get wrong."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from venuelens.functions import scalars as S
from venuelens.operators import joins as J
from venuelens.operators import menu as M
from venuelens.operators import predicates as P
from venuelens.operators import rollups as R
from venuelens.operators import spatial
from venuelens.operators.chartdata import flow_edges
from venuelens.operators.stats import chi2_independence, spearman, welch
from venuelens.sources import documents as D
from venuelens.sources import sinks, tables


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_only_first_array_element_and_broken_files(spark, tmp_path):
    raw = tmp_path / "raw"
    write(raw, "a.json", json.dumps([{"locationId": 1, "name": "A"}, {"locationId": 2}]))
    write(raw, "b.json", "[{broken")
    write(raw, "c.json", "[]")
    docs = D.read_documents(spark, str(raw))
    rows = D.parse_venues(docs).collect()
    assert [r["locationId"] for r in rows] == [1] and rows[0]["reviewCount"] == 0 and rows[0]["hasMenu"] is False
    assert {r["file_name"] for r in D.rejected_documents(docs).collect()} == {"b.json", "c.json"}


def test_michelin_needs_first_inner_award(spark, tmp_path):
    raw = tmp_path / "raw"
    for i, inner in enumerate([["MICHELIN"], ["OTHER", "MICHELIN"], []]):
        write(raw, f"{i}.json", json.dumps([{"locationId": i, "restaurantAwards": [{"awards": [{"award_title": t} for t in inner]}]}]))
    got = {r["locationId"]: r["hasMichelin"] for r in D.parse_venues(D.read_documents(spark, str(raw))).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_nan_is_null_and_null_keys_drop(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, float("nan")), (2, 5.0), (None, 4.0)], "k int, v double").write.parquet(path)
    t = tables.read_table(spark, path)
    assert t.filter("v >= 4").count() == 2
    assert tables.read_table(spark, path, where=F.col("v") >= 4).count() == 2
    assert {r["k"] for r in R.group_aggregate(t, "k", "v").collect()} == {1, 2}


def test_missing_language_is_unknown_and_short_text_drops(spark, tmp_path):
    raw = tmp_path / "raw"
    rev = [{"id": 1, "text": "  " + "x" * 20 + "\n", "rating": 0, "publishedDate": "nope"},
           {"id": 2, "text": " " * 30 + "short", "rating": 4}, {"id": 3, "text": "y" * 25, "rating": 4, "language": "fr", "publishedDate": "2024-02-01"}]
    write(raw, "a.json", json.dumps({"data": {"locations": [{"locationId": 9, "name": "N", "reviewListPage": {"reviews": rev}}, {"locationId": 10}]}}))
    write(raw, "b.json", json.dumps({"data": {"locations": []}}))
    rows = {r["review_id"]: r for r in D.parse_reviews(D.read_documents(spark, str(raw))).collect()}
    assert set(rows) == {1, 3}
    assert rows[1]["language"] == "unknown" and rows[1]["rating"] is None and rows[1]["publishedDate"] is None
    assert rows[1]["text"] == "x" * 20 and rows[3]["publishedDate"].month == 2


def test_category_alias(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "i int, `entrée` int")
    assert [r["i"] for r in df.filter(P.has_all_categories(["entree"])).collect()] == [1]


def test_radius_is_doubled_by_default(spark):
    # 0.8 km apart: neighbours under the established threshold of 0.5 km, not under the true one.
    step = math.degrees(0.8 / spatial.EARTH_RADIUS_KM)
    df = spark.createDataFrame([(1, 48.0, 2.0), (2, 48.0 + step, 2.0), (3, 48.0, 2.0), (4, None, 2.0)],
                               "locationId long, latitude double, longitude double")
    got = {r[0]: r[1] for r in spatial.competition(df, radii={"n": 0.5}).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: None}
    got = {r[0]: r[1] for r in spatial.competition(df, radii={"n": 0.5}, compat_double_radius=False).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: None}


def test_substring_noise(spark):
    df = spark.createDataFrame([(1, "Fleur d'agrumes", "couvert"), (2, None, None)], "locationId long, t string, d string")
    rows = df.select("locationId", S.item_text("t", "d").alias("text"))
    out = {r["locationId"]: r for r in M.seasonality(rows).collect()}
    assert out[1]["seasonal_été"] == 1 and out[1]["seasonal_hiver"] == 1 and out[2]["seasonality_score"] == 0


def test_price_range_counts_all_signs(spark):
    df = spark.createDataFrame([("€€-€€€",), (None,), ("€",)], "p string").select(S.price_level("p").alias("n"))
    assert [r["n"] for r in df.collect()] == [5, None, 1]


def test_labels(spark):
    df = spark.createDataFrame([(" A | |B",), (None,)], "c string").select(S.split_labels("c").alias("l"), S.join_labels(S.split_labels("c")).alias("j"))
    assert [(r["l"], r["j"]) for r in df.collect()] == [(["A", "B"], "A|B"), ([], None)]


def test_district_pattern(spark):
    texts = ["7e Arr. - Palais Bourbon|Ecole", "1er Arr.", "12ème Arr", "3eme Arr", "7e arr.", "Arr", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.district_number("t").alias("n"))
    assert [r["n"] for r in df.orderBy("i").collect()] == [7, 1, 12, 3, None, None, None]


def test_right_closed_bins(spark):
    xs = [0.0, 0.1, 3.5, 3.6, 4.0, 4.5, 5.0, 5.1, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", S.right_closed_bin("x").alias("b"))
    got = [r["b"][:5] if r["b"] else None for r in df.orderBy("i").collect()]
    assert got == [None, "Faibl", "Faibl", "Moyen", "Moyen", "Bon (", "Excel", None, None]


def test_unicode_tokens(spark):
    df = spark.createDataFrame([("Crème brûlée, l'été à 2 pas_là",)], "t string").select(S.tokens("t").alias("w"))
    assert df.first()["w"] == ["crème", "brûlée", "été", "pas_là"]


def test_two_by_two_is_corrected(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 5), ("b", "x", 4), ("b", "y", 9)], "row string, col string, n long")
    r = chi2_independence(cells).first()
    # 28·(|10·9−5·4|−14)² / (15·13·14·14), one degree of freedom.
    assert np.isclose(r["statistic"], 28 * (70 - 14) ** 2 / (15 * 13 * 14 * 14)) and r["dof"] == 1
    diagonal = spark.createDataFrame([("a", "x", 6), ("b", "y", 8)], "row string, col string, n long")
    assert np.isclose(chi2_independence(diagonal).first()["statistic"], 14 * (48 - 7) ** 2 / (6 * 8 * 6 * 8))
    three = spark.createDataFrame([("a", "x", 6), ("b", "y", 8), ("c", "x", 2)], "row string, col string, n long")
    assert np.isclose(chi2_independence(three).first()["statistic"], 16.0)


def test_too_few_observations(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None)], "x double, y double")
    r = spearman(df, "x", "y").first()
    assert r["error"] and r["statistic"] is None
    assert welch(df, F.col("x") > 1, "x").first()["error"]


def test_merge_keeps_first_and_upsert_keeps_last(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "review_id long, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "review_id long, v string")
    assert {tuple(r) for r in J.merge_shards(a, b).collect()} == {(1, "a"), (2, "a"), (3, "b")}
    assert {tuple(r) for r in J.upsert(a, b).collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_flow_edges_need_ten_rows(spark):
    df = spark.createDataFrame([(["A"], "€", 4.2)] * 9, "cuisine_list array<string>, priceLevel string, rating double")
    assert flow_edges(df).count() == 0
    edges = flow_edges(df.union(df.limit(1)))
    assert edges.count() == 5 and edges.agg(F.sum("n")).first()[0] == 20


def test_backfill_keeps_set_flags(spark):
    df = spark.createDataFrame([(1, 1.0, 5, 4.6, True, 1.0, 1), (2, 1.0, 5, 4.6, None, None, None), (3, 4.0, 5, 4.6, None, None, None)],
                               "review_id long, rating double, sent_class int, sent_stars_expected double, is_ironic boolean, sent_stars_corrected double, sent_class_corrected int")
    rows = {r["review_id"]: r for r in R.backfill_irony(df).collect()}
    assert [rows[i]["is_ironic"] for i in (1, 2, 3)] == [True, True, False]
    assert [rows[i]["sent_class_corrected"] for i in (1, 2, 3)] == [1, 1, 5]


def test_optional_table_and_corrupt_shard(spark, tmp_path):
    schema = spark.createDataFrame([(1,)], "review_id long").schema
    assert tables.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    spark.createDataFrame([(1,), (2,)], schema).write.parquet(str(tmp_path / "s_part0"))
    (tmp_path / "s_part1").mkdir()
    (tmp_path / "s_part1" / "broken.parquet").write_bytes(b"not a parquet file at all")
    assert tables.read_shards(spark, str(tmp_path / "s_part*"), schema).count() == 2


def test_sink_can_keep_what_exists(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(9), path, skip_if_exists=True)
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
