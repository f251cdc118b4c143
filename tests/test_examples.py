"""Worked examples of single functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators import menu as M
from venuelens.operators import predicates as P
from venuelens.operators import rollups as R
from venuelens.operators.scoring import score_reviews


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_price_text(spark):
    texts = ["5,00€", "12,50€", "120,00€", "0,00€", "9,99€", "0,50€", "  7,00€  ", None, "", "1.234,50€", "5d", "nan", "12,5 €"]
    assert column(spark, texts, S.clean_price) == [5.0, 12.5, 120.0, 0.0, 9.99, 0.5, 7.0, None, None, None, None, None, 12.5]


@pytest.mark.parametrize("category,titles", [
    ("boisson", ["Boissons", "Cocktails & bieres", "Aperitifs", "Digestifs", "Boissons chaudes", "BOISSONS", "gâteau the"]),
    ("dessert", ["Desserts", "Dessert", "Nos desserts", "Les desserts", "DESSERTS"]),
    ("entrée", ["Entrees", "Entree", "Les entrees", "ENTRÉES"]),
    ("plat", ["Plats", "Plat", "Plat principal"]),
    ("formule", ["Menu Degustation", "Formule midi", "Menu Dejeuner"]),
    (None, ["Garniture", "", None])])
def test_menu_title(spark, category, titles):
    assert column(spark, titles, S.menu_category) == [category] * len(titles)


def classify(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, t string, d string, m string, p double, n int, lo double, hi double")
    out = df.select("i", S.item_category("t", "d", "m", "p", "n", "lo", "hi").alias("c")).orderBy("i")
    return [r["c"] for r in out.collect()]


@pytest.mark.parametrize("category,titles", [
    ("boisson", ["Cafe", "Coca-Cola", "Mojito", "Bouteille d'eau", "Gâteau"]),
    ("dessert", ["Tarte aux pommes", "Creme brulee", "Tiramisu maison", "Millefeuille"]),
    ("entrée", ["Salade Niçoise", "Foie gras", "Tartare de saumon", "Huitres speciales"]),
    ("plat", ["Entrecote 300g", "Burger maison", "Magret de canard", "Pave de saumon roti"])])
def test_item_by_terms(spark, category, titles):
    assert classify(spark, [(t, "", None, None, 0, None, None) for t in titles]) == [category] * len(titles)


def test_item_inheritance_and_price(spark):
    assert classify(spark, [
        ("xyz", "", "dessert", None, 0, None, None), ("Coca", "", "formule", None, 0, None, None),
        ("", "", None, 5.0, 9, 6.0, 7.0), (None, None, "plat", None, 0, None, None),
        ("xyz", "", None, 6.0, 3, 6.0, 9.0), ("xyz", "", None, 9.0, 3, 6.0, 9.0),
        ("xyz", "", None, 7.0, 3, 6.0, 9.0), ("xyz", "", None, 1.0, 2, 6.0, 9.0), ("xyz", "", None, None, 5, 6.0, 9.0),
    ]) == ["dessert", "boisson", "autre", "plat", "entrée", "plat", "autre", "autre", "autre"]


def test_price_quantiles(spark):
    prices = spark.createDataFrame([(1, p) for p in (1.0, 2.0, 4.0, 9.0)] + [(2, None)], "locationId long, price double")
    rows = {r["locationId"]: r for r in M.price_calibration(prices).collect()}
    assert rows[1]["n_prices"] == 4 and np.allclose([rows[1]["price_q33"], rows[1]["price_q67"]], [1.99, 4.05])
    assert 2 not in rows


def test_season_lists():
    assert len(L.SEASON_TERMS) == 4
    for terms in L.SEASON_TERMS.values():
        assert len(terms) > 5 and len(set(terms)) == len(terms)


def test_language_routing(spark):
    df = spark.createDataFrame([(1, "fr"), (2, "ru"), (3, "en"), (4, "ja"), (5, None)], "review_id long, language string")
    routes = {r["review_id"]: r["route"] for r in P.with_route(df).collect()}
    assert routes == {1: "primary", 2: "fallback", 3: "primary", 4: "fallback", 5: "fallback"}
    assert {r["route"] for r in P.with_route(df.drop("language")).collect()} == {"primary"}
    assert P.supported_languages(df).count() == 2
    assert P.supported_languages(df.drop("language")).count() == 5


def test_sentiment_metrics(spark):
    df = spark.createDataFrame([(.1, .1, .1, .2, .5), (.8, .1, .1, .0, .0), (.3, .3, .2, .1, .1)],
                               ", ".join(f"{c} double" for c in S.PROB_COLUMNS))
    rows = [tuple(r) for r in R.with_sentiment(df).select("sent_stars_expected", "sent_class", "sent_confidence").collect()]
    assert np.allclose(rows, [(3.9, 5, .5), (1.3, 1, .8), (2.4, 1, .3)])


def test_scoring_and_irony(spark):
    def model():
        table = {"a": [0, .05, .05, .1, .8], "b": [.8, .1, .1, 0, 0]}
        return lambda texts: np.array([table[t] for t in texts])

    df = spark.createDataFrame([(1, 101, "a", 1.0, "fr"), (2, 101, "b", 4.0, "en"), (3, 102, "a", None, "fr")],
                               "review_id long, locationId long, text string, rating double, language string")
    rows = {r["review_id"]: r for r in score_reviews(df, model).collect()}
    assert rows[1]["is_ironic"] and rows[1]["sent_stars_corrected"] == 1.0 and rows[1]["sent_class_corrected"] == 1
    assert not rows[2]["is_ironic"] and np.isclose(rows[2]["sent_stars_corrected"], 1.3) and rows[2]["sent_class_corrected"] == 1
    assert not rows[3]["is_ironic"] and rows[3]["sent_class_corrected"] == 5


def test_failed_batches_are_left_out(spark):
    def model():
        def score(texts):
            if "bad" in texts:
                raise ValueError("model failed")
            return np.tile([0, 0, 1.0, 0, 0], (len(texts), 1))
        return score

    df = spark.createDataFrame([(i, 1, "bad" if i == 3 else "ok", "fr") for i in range(6)],
                               "review_id long, locationId long, text string, language string").coalesce(1)
    out = {r["review_id"] for r in score_reviews(df, model, batch_size=1).collect()}
    assert out == {0, 1, 2, 4, 5}


ROWS = [(1, 101, 1.0, 4.5, 5, 0.90), (2, 101, 5.0, 4.8, 5, 0.95), (3, 101, None, 4.2, 4, 0.80), (4, 102, 2.0, 3.8, 4, 0.75),
        (5, 102, 4.0, 1.5, 1, 0.85)]
SCHEMA = "review_id long, locationId long, rating double, sent_stars_expected double, sent_class int, sent_confidence double"


def test_rollup_golden(spark):
    out = {r["locationId"]: r for r in R.sentiment_rollup(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    a, b = out[101], out[102]
    assert np.allclose([a["sent_mean"], a["sent_mean_corrected"], a["pct_ironic"]], [4.5, 10 / 3, 100 / 3])
    assert np.allclose([b["sent_mean"], b["sent_mean_corrected"], b["pct_ironic"]], [2.65, 1.75, 50])
    assert a["n_reviews_scored"] == 3 and np.isclose(a["rating_mean_reviews"], 3.0) and np.isclose(a["discordance"], 1.5)


def test_rollup_of_nothing_and_without_ratings(spark):
    empty = R.sentiment_rollup(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and len(empty.columns) == 17
    out = R.sentiment_rollup(spark.createDataFrame(ROWS, SCHEMA).drop("rating"))
    assert {r["pct_ironic"] for r in out.collect()} == {0.0} and out.filter("discordance IS NOT NULL").count() == 0


def test_single_row_deviation_is_null(spark):
    assert R.sentiment_rollup(spark.createDataFrame(ROWS[:1], SCHEMA)).first()["sent_std"] is None


def test_null_class_counts_as_not_negative_but_corrected_skips_it(spark):
    rows = [(1, 1, None, 1.0, 1, .5), (2, 1, None, None, None, .5)]
    r = R.sentiment_rollup(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["pct_negative"] == 50 and r["pct_negative_corrected"] == 100


def test_verdicts(spark):
    assert column(spark, [0.0001, 0.005, 0.03, 0.2, None], S.p_verdict, "double") == [
        "Hautement significatif", "Tres significatif", "Significatif", "Non significatif", None]
    assert column(spark, [0.0001, 0.00512, 0.0341, 0.2], S.p_text, "double") == [
        "p < 0.001", "p = 0.0051", "p = 0.034", "p = 0.200"]
