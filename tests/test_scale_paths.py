"""The ways taken only by large or uneven data, forced on small data and compared with brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from venuelens.operators import ordering as O
from venuelens.operators import quantiles as Q
from venuelens.operators import reports, sampling, skew, spatial, stats
from venuelens.operators import joins as J


@pytest.fixture(scope="module")
def uneven(spark):
    """3,000 rows; one group holds a third, one value a third."""
    rng = np.random.default_rng(1)
    g = np.where(np.arange(3000) % 3 == 0, 7, rng.integers(0, 20, 3000))
    v = np.where(np.arange(3000) % 3 == 1, 2.5, rng.normal(size=3000).round(3))
    w = rng.normal(size=3000).round(2)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": g, "v": v, "w": w})
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_bracketed_quantiles(uneven, accuracy):
    df, pdf = uneven
    wanted = {"q0": ("v", 0.0), "q33": ("v", 0.33), "med": ("w", 0.5), "q99": ("w", 0.99), "q1": ("v", 1.0)}
    out = Q.grouped_stats(df, ["g"], [F.count("v").alias("n")], wanted, accuracy, direct_rows=0).toPandas().set_index("g").sort_index()
    for name, (c, q) in wanted.items():
        assert np.allclose(out[name], pdf.groupby("g")[c].quantile(q)), name
    assert (out["n"] == pdf.groupby("g").size()).all()
    one = Q.grouped_stats(df, [], [], wanted, accuracy, direct_rows=0).first()
    direct = Q.grouped_stats(df, [], [], wanted).first()
    for name, (c, q) in wanted.items():
        assert np.isclose(one[name], pdf[c].quantile(q)) and np.isclose(direct[name], pdf[c].quantile(q))


def test_quantiles_of_groups_without_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "g int, v double")
    out = {r["g"]: r["m"] for r in Q.grouped_stats(df, ["g"], [], {"m": ("v", 0.5)}, direct_rows=0).collect()}
    assert out == {1: 2.0, 2: None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, uneven, how):
    df, _ = uneven
    many = df.withColumn("g", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("g")))
    one = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 7, 9, 30, None)], "g int, name string")
    assert skew.frequent_keys(many.groupBy("g").agg(F.count("*").alias("n")), ["g"], "n", 64, 0)
    a = skew.spread_join(many, one, ["g"], how, min_rows=0)
    b = many.join(one, "g", how)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_spread_join_on_two_keys(uneven):
    df, pdf = uneven
    one = df.groupBy("g", "v").agg(F.count("*").alias("k"))
    out = skew.spread_join(df, one, ["g", "v"], min_rows=0, salts=8).toPandas().sort_values("id")
    assert (out["k"].to_numpy() == pdf.groupby(["g", "v"])["id"].transform("size").to_numpy()).all()


@pytest.mark.parametrize("rows_per_bucket", [None, 40])
def test_ranks(uneven, rows_per_bucket):
    df, pdf = uneven
    out = O.row_ranks(df, "v", rows_per_bucket=rows_per_bucket).toPandas().sort_values("id")
    assert np.allclose(out["rank_avg"], pdf["v"].rank())
    n = O.global_row_number(df, "id", rows_per_bucket=rows_per_bucket).toPandas().sort_values("id")
    assert (n["row_no"].to_numpy() == np.arange(1, 3001)).all()
    r = reports.rankings(df, "g", "v", "id", rows_per_bucket).toPandas().sort_values("id")
    expected = pdf.groupby("g")["v"].rank(method="min", ascending=False)
    assert (r["rank"].to_numpy() == expected.to_numpy()).all()
    ordered = pdf.sort_values(["v", "id"], ascending=[False, True])
    numbers = (ordered.groupby("g").cumcount() + 1).to_numpy()[np.argsort(ordered["id"].to_numpy())]
    assert (r["row_no"].to_numpy() == numbers).all()


def test_cdf_in_buckets(uneven):
    df, pdf = uneven
    out = O.empirical_cdf(df, "v", "g", 3, rows_per_bucket=50).toPandas()
    top = pdf["g"].value_counts().head(3).index
    assert set(out["g"]) == set(top)
    for g, rows in out.groupby("g"):
        x = np.sort(pdf.loc[pdf["g"] == g, "v"])
        assert np.allclose(rows["cdf"], np.searchsorted(x, rows["v"], side="right") / len(x)) and rows["n"].sum() == len(x)


@pytest.mark.parametrize("rows_per_bucket", [None, 60])
def test_rank_tests(uneven, rows_per_bucket):
    df, pdf = uneven
    rho = stats.spearman(df, "v", "w", rows_per_bucket=rows_per_bucket).first()
    assert np.isclose(rho["statistic"], np.corrcoef(pdf["v"].rank(), pdf["w"].rank())[0, 1])
    r, n = pdf["v"].rank(), len(pdf)
    s = (r.groupby(pdf["g"]).sum() ** 2 / pdf.groupby("g").size()).sum()
    t = pdf["v"].value_counts().to_numpy().astype(float)
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (t ** 3 - t).sum() / (n ** 3 - n))
    assert np.isclose(stats.kruskal_wallis(df, "g", "v", rows_per_bucket=rows_per_bucket).first()["statistic"], h)


def neighbours(lat, lon, limit):
    la, lo = np.radians(lat), np.radians(lon)
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(2)
    return (d2 <= limit * limit).sum(1) - 1


def places(kind):
    rng = np.random.default_rng(3)
    if kind == "dense":  # a third at one address, a third within metres, a third spread out
        lat = np.concatenate([np.full(130, 48.85), 48.85 + rng.normal(size=130) * 1e-4, 48.8 + rng.random(130) * 0.1])
        lon = np.concatenate([np.full(130, 2.35), 2.35 + rng.normal(size=130) * 1e-4, 2.3 + rng.random(130) * 0.1])
    elif kind == "pole":
        lat, lon = 90 - rng.random(300) * 0.05, rng.random(300) * 360 - 180
    else:  # both sides of the date line
        lat, lon = rng.random(300) * 0.05, (180 + rng.normal(size=300) * 0.02 + 180) % 360 - 180
    return lat, lon


@pytest.mark.parametrize("kind", ["dense", "pole", "date line"])
@pytest.mark.parametrize("pair_limit", [1, 200])
def test_neighbour_counts_with_splitting(spark, monkeypatch, kind, pair_limit):
    monkeypatch.setattr(spatial, "PAIR_LIMIT", pair_limit)
    monkeypatch.setattr(spatial, "MAX_DEPTH", 3)
    monkeypatch.setattr(skew, "MIN_ROWS", 10)
    lat, lon = places(kind)
    df = spark.createDataFrame(pd.DataFrame({"locationId": np.arange(len(lat)), "latitude": lat, "longitude": lon}))
    out = spatial.competition(df, radii={"n": 0.5}).toPandas().sort_values("locationId")
    assert (out["n"].to_numpy() == neighbours(lat, lon, spatial.chord(0.5))).all()


def test_sample_is_repeatable(uneven, monkeypatch):
    df, _ = uneven
    a = {r["id"] for r in sampling.uniform_sample(df, "id", 50).collect()}
    b = {r["id"] for r in sampling.uniform_sample(df.repartition(3), "id", 50).collect()}
    assert len(a) == 50 and a == b
    assert a != {r["id"] for r in sampling.uniform_sample(df, "id", 50, seed=7).collect()}
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    assert a == {r["id"] for r in sampling.uniform_sample(df, "id", 50).collect()}


def test_stratified_sample_quotas(spark, uneven):
    df, _ = uneven
    rows = df.select((F.col("id") % 400).alias("k")).withColumn("s", F.when(F.col("k") % 10 == 0, None).otherwise(F.col("k") % 4))
    chosen = sampling.stratified_venues(rows, "k", "s", 60)
    out = chosen.join(rows.distinct(), "k").groupBy("s").count().collect()
    assert chosen.count() == 60 == chosen.distinct().count()
    quotas = {r["s"]: r["quota"] for r in sampling.stratum_quotas(rows, "s", 60).collect()}
    assert all(r["count"] >= quotas[r["s"]] for r in out if r["s"] is not None)
    everything = sampling.stratified_venues(rows, "k", "s", 5000)
    assert everything.count() == 400


def test_rollup_of_merged_shards_equals_whole(spark, uneven):
    df, _ = uneven
    whole = df.select(F.col("id").alias("review_id"), "g", "v")
    merged = J.merge_shards(whole.filter("review_id % 2 = 0"), whole.filter("review_id % 3 = 0"), whole)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_local_trend_follows_a_line(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(200)], "x double, y double")
    assert all(math.isclose(r["fit"], 3 * r["x_at"] + 1) for r in stats.local_trend(df, "x", "y").collect())
