"""K-means with seeds spread by hashed draws: the same rows give the same clusters, whatever their partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.sources.tables import stored_and_spread

OVERSAMPLING = 2.0
ROUNDS = 5


def draw(key: str, turn: int) -> Column:
    """A number from 0 to 1 for every key and turn: the first 48 bits of a digest of both."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(turn))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def nearest(points: list[tuple[float, ...]], columns: list[str]) -> Column:
    """(squared distance, number) of the nearest of a few points, the first of equally near ones."""
    each = [F.struct(sum((F.col(c) - x) ** 2 for c, x in zip(columns, p)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)]
    return F.array_min(F.array(*each))


def seeds(data: DataFrame, key: str, columns: list[str], k: int, rounds: int = ROUNDS, oversampling: float = OVERSAMPLING) -> list[tuple[float, ...]]:
    """At most k starting points, far from each other, in ``rounds`` + 2 passes over the rows.

    The first candidate is the row of the smallest draw. In each round a row becomes one with a probability of
    ``oversampling`` * k * its share of the cost, by its own draw; so a round adds about ``oversampling`` * k
    candidates, however many rows there are. The candidates, weighed by the rows nearest to them, are thinned out
    to k: the heaviest first, then always the one that costs most. Only candidates pass through the driver.
    """
    head = data.orderBy(draw(key, 0), key).select(*columns).first()
    if head is None:
        return []
    chosen = [tuple(head)]
    for turn in range(1, rounds + 1):
        near = data.withColumn("_d", nearest(chosen, columns)["d"])
        cost = near.agg(F.sum("_d")).first()[0]
        if not cost:
            break
        more = near.filter(draw(key, turn) < oversampling * k * F.col("_d") / cost).select(*columns).distinct().collect()
        chosen += sorted(tuple(r) for r in more)
    weights = {r["i"]: r["n"] for r in data.groupBy(nearest(chosen, columns)["i"].alias("i")).agg(F.count("*").alias("n")).collect()}
    return thinned(chosen, [weights.get(i, 0) for i in range(len(chosen))], k)


def thinned(points: list[tuple[float, ...]], weights: list[int], k: int) -> list[tuple[float, ...]]:
    best = max(range(len(points)), key=lambda i: (weights[i], -i))
    out = [points[best]]
    gap = [math.inf] * len(points)
    while len(out) < k:
        gap = [min(g, sum((a - b) ** 2 for a, b in zip(p, out[-1]))) for g, p in zip(gap, points)]
        at = max(range(len(points)), key=lambda i: (weights[i] * gap[i], -i))
        if not weights[at] * gap[at]:
            break
        out.append(points[at])
    return out


def kmeans(df: DataFrame, key: str, columns: list[str], k: int = 8, max_steps: int = 100, tolerance: float = 1e-9,
           rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(key, cluster, distance2) of every row with all coordinates, and (cluster, the coordinates, n, inertia) of the centres.

    Lloyd steps from spread seeds until no centre moves by more than ``tolerance`` (a distance) or ``max_steps`` are done; a centre
    without rows stays. Fewer than k different points give fewer clusters; no rows give none. A step is one aggregate; only
    the k centres pass through the driver.
    """
    data = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        data = data.filter(F.col(c).isNotNull())
    data = stored_and_spread(data, key)
    centres = seeds(data, key, columns, k, rounds)
    schema = f"cluster int, {', '.join(f'`{c}` double' for c in columns)}, n long, inertia double"
    if not centres:
        return (data.select(key, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance2")),
                df.sparkSession.createDataFrame([], schema))
    rows = []
    for _ in range(max_steps):
        means = data.withColumn("_c", nearest(centres, columns)).groupBy(F.col("_c.i").alias("i")).agg(
            F.count("*").alias("n"), F.sum("_c.d").alias("inertia"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(columns)]).collect()
        found = {r["i"]: r for r in means}
        # what the aggregate measured belongs to the centres as they were
        rows = [(i, *c, found[i]["n"] if i in found else 0, float(found[i]["inertia"]) if i in found else 0.0) for i, c in enumerate(centres)]
        moved = [tuple(found[i][f"m{j}"] for j in range(len(columns))) if i in found else c for i, c in enumerate(centres)]
        shift = max(math.dist(a, b) for a, b in zip(centres, moved))
        if shift <= tolerance:
            break
        centres = moved
    else:
        rows = [(i, *c, *r[-2:]) for i, (c, r) in enumerate(zip(centres, rows))]
    labelled = data.withColumn("_c", nearest(centres, columns)).select(key, F.col("_c.i").alias("cluster"), F.col("_c.d").alias("distance2"))
    return labelled, df.sparkSession.createDataFrame(rows, schema)
