"""Clusters with drawn seeds, ingest counts and distinct sketches."""

import hashlib
import random

from pyspark.sql import functions as F

from venuelens.operators import clusters, reports, rollups, spatial
from venuelens.sources import tables


def drawn(key, turn):
    return int(hashlib.md5(f"{key}:{turn}".encode()).hexdigest()[:12], 16) / (1 << 48)


def seeds_by_hand(rows, k, rounds, oversampling):
    chosen = [min((drawn(i, 0), i, p) for i, p in rows)[2]]
    gap = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    for turn in range(1, rounds + 1):
        d = [min(gap(p, c) for c in chosen) for _, p in rows]
        if not sum(d):
            break
        chosen += sorted({p for (i, p), x in zip(rows, d) if drawn(i, turn) < oversampling * k * x / sum(d)})
    near = [min(range(len(chosen)), key=lambda c: (gap(p, chosen[c]), c)) for _, p in rows]
    weights = [near.count(i) for i in range(len(chosen))]
    out = [chosen[max(range(len(chosen)), key=lambda i: (weights[i], -i))]]
    while len(out) < k:
        cost = [w * min(gap(p, c) for c in out) for p, w in zip(chosen, weights)]
        if not max(cost):
            break
        out.append(chosen[cost.index(max(cost))])
    return out


def blobs(n=200):
    rng = random.Random(3)
    return [(i, (float(10 * (i % 4)) + rng.random(), float(7 * (i % 3)) + rng.random())) for i in range(n)]


def test_seeds_are_drawn_as_stated_and_do_not_depend_on_partitions(spark):
    rows = blobs()
    df = spark.createDataFrame([(i, *p) for i, p in rows], "id long, x double, y double")
    want = seeds_by_hand(rows, 12, 3, 2.0)
    for parts in (1, 7):
        got = clusters.seeds(df.repartition(parts), "id", ["x", "y"], 12, 3)
        assert [tuple(round(v, 9) for v in g) for g in got] == [tuple(round(v, 9) for v in w) for w in want]


def test_clusters_settle_on_the_blobs(spark):
    rows = blobs()
    df = spark.createDataFrame([(i, *p) for i, p in rows] + [(999, None, 1.0)], "id long, x double, y double")
    labels, centres = clusters.kmeans(df, "id", ["x", "y"], 12)
    got = {r.id: r.cluster for r in labels.collect()}
    assert len(got) == 200 and len({got[i] for i in range(12)}) == 12
    assert all(got[i] == got[i % 12] for i in range(200))
    by = {r.cluster: r for r in centres.collect()}
    assert sum(r.n for r in by.values()) == 200 and all(r.inertia < r.n for r in by.values())
    assert abs(sum(r.inertia for r in by.values()) - labels.agg(F.sum("distance2")).first()[0]) < 1e-6


def test_few_places_and_no_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "id long, x double, y double")
    labels, centres = clusters.kmeans(same, "id", ["x", "y"], 3)
    assert [tuple(r) for r in centres.collect()] == [(0, 1.0, 2.0, 5, 0.0)] and labels.count() == 5
    labels, centres = clusters.kmeans(same.limit(0), "id", ["x", "y"], 3)
    assert labels.collect() == [] and centres.collect() == []


def test_one_descent_serves_all_radii(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, 48.85 + rng.choice([0, 0, rng.gauss(0, 0.004)]), 2.3 + rng.gauss(0, 0.004)) for i in range(150)] + [(500, None, 2.0), (501, -89.99, 10.0), (502, -89.99, -170.0)]
    df = spark.createDataFrame(rows, "locationId long, latitude double, longitude double")
    radii = {"a": 0.05, "b": 0.4, "c": 3.0}
    apart = {name: {r.locationId: r[name] for r in spatial.competition(df, radii={name: km}).collect()} for name, km in radii.items()}
    for limit in (65_536, 9):
        monkeypatch.setattr(spatial, "PAIR_LIMIT", limit)
        for r in spatial.competition(df, radii=radii).collect():
            assert [r[n] for n in radii] == [apart[n][r.locationId] for n in radii]


def test_sketches_unite_to_the_sketch_of_all_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("a"), (F.col("id") % 3).alias("b"), F.lit(None).cast("string").alias("c"))
    parts = rollups.distinct_sketches(df.withColumn("shard", F.col("a") % 4), ["a", "b", "c"], ["shard"])
    got = {r.name: r.estimate for r in rollups.distinct_estimates(parts, ["a", "b", "c"]).collect()}
    assert abs(got["a"] - 5000) <= rollups.DISTINCT_ERROR * 5000 and got["b"] == 3 and not got["c"]


def test_rows_of_one_part_are_dealt_over_the_cores(spark):
    one = spark.range(400).selectExpr("id AS locationId", "id % 20 / 10 AS latitude", "id % 7 / 10 AS longitude").coalesce(1)
    assert tables.stored_and_spread(one, "locationId").rdd.getNumPartitions() > 1
    spread = one.repartition(20)
    assert tables.stored_and_spread(spread, "locationId").rdd.getNumPartitions() == 20
    for labels in (clusters.kmeans(one, "locationId", ["latitude", "longitude"], 3)[0], reports.spatial_clusters(one, 3, 2)[0]):
        assert labels.rdd.getNumPartitions() > 1 and labels.count() == 400
