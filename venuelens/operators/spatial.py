"""Neighbour counts within a great-circle radius.

Points live on the unit sphere and two points are neighbours when their chord is short enough, so
poles and the date line need no special care. Space is cut into cubes; a pair of cubes is settled as
a whole when all (or none) of its point pairs can be neighbours. Only pairs of cubes across the rim
are compared point by point, and where such a pair holds many points it is first split into cubes a
quarter as wide. Dense areas therefore never produce all their point pairs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.operators.skew import frequent_keys, is_one_of, spread_join
from venuelens.session import cut_lineage

EARTH_RADIUS_KM = 6371.0
SPLIT = 4
MAX_DEPTH = 8
PAIR_LIMIT = 65_536
SLACK = 1e-9


def chord(radius_km: float, compat_double_radius: bool = True) -> float:
    """Chord threshold on the unit sphere.

    The established columns use 2·sin(d/R), the chord of an arc of 2·d, so "500 m" counts within
    1 km. ``compat_double_radius=False`` gives the true chord.
    """
    return 2.0 * math.sin(radius_km / EARTH_RADIUS_KM * (1.0 if compat_double_radius else 0.5))


def _locations(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct coordinates with their multiplicity and unit-sphere position."""
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(F.count("*").alias("w"))
            .withColumn("x", F.cos(F.radians("_lat")) * F.cos(F.radians("_lon")))
            .withColumn("y", F.cos(F.radians("_lat")) * F.sin(F.radians("_lon")))
            .withColumn("z", F.sin(F.radians("_lat"))))


def _cell(side: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(prefix + a) / side).alias("c" + a) for a in "xyz"]


CELL = ["cx", "cy", "cz"]


def _cells(points: DataFrame, side: float) -> DataFrame:
    return (points.select(*_cell(side), "w").groupBy(*CELL)
            .agg(F.count("*").alias("m"), F.sum("w").alias("w")))


def _classified(pairs: DataFrame, side: float, limits: list[float]) -> DataFrame:
    """Settle cube pairs for every radius r still open (``o{r}``): ``i{r}`` where all their points are neighbours.

    What stays open for some radius is near (compare points) or dense (split first); a pair without anything goes.
    """
    gaps = [F.abs(F.col(f"b{c}") - F.col(f"a{c}")) for c in CELL]
    near2 = sum((F.greatest(g - 1, F.lit(0)) * side) ** 2 for g in gaps)
    far2 = sum(((g + 1) * side) ** 2 for g in gaps)
    inner = {f"i{r}": F.col(f"o{r}") & (far2 <= limit ** 2 * (1 - SLACK)) for r, limit in enumerate(limits)}
    left = {f"o{r}": F.col(f"o{r}") & (far2 > limit ** 2 * (1 - SLACK)) & (near2 <= limit ** 2 * (1 + SLACK)) for r, limit in enumerate(limits)}
    settled = pairs.select(*[c for c in pairs.columns if c not in left], *[x.alias(n) for n, x in {**inner, **left}.items()])
    open_, whole = (reduce(lambda x, y: x | y, [F.col(f"{k}{r}") for r in range(len(limits))]) for k in "oi")
    kind = F.when(open_, F.when(F.col("am") * F.col("bm") <= PAIR_LIMIT, "near").otherwise("dense")).otherwise("settled")
    return settled.filter(open_ | whole).withColumn("kind", kind).withColumn("inner", whole)


def _renamed(cells: DataFrame, p: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(p + c) for c in cells.columns])


def _root_pairs(cells: DataFrame) -> DataFrame:
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = _renamed(cells, "a")
    for c in CELL:
        a = a.withColumn("d" + c, F.explode(step)).withColumn("b" + c, F.col("a" + c) + F.col("d" + c)).drop("d" + c)
    return a.join(_renamed(cells, "b"), ["b" + c for c in CELL])


def _split_pairs(dense: DataFrame, finer: DataFrame, flags: list[str]) -> DataFrame:
    """Children of both cubes of every dense pair, with the radii that are open for it."""
    def parent(p: str) -> DataFrame:
        child = _renamed(finer, "n" + p)
        return child.select("*", *[F.floor(F.col(f"n{p}{c}") / SPLIT).alias(p + c) for c in CELL])

    wide = (dense.select(*["a" + c for c in CELL], *["b" + c for c in CELL], *flags)
            .join(parent("a"), ["a" + c for c in CELL]).join(parent("b"), ["b" + c for c in CELL]))
    keep = [*CELL, "m", "w"]
    return wide.select(*[F.col(f"n{p}{c}").alias(p + c) for p in "ab" for c in keep], *flags)


def _compare(points: DataFrame, cells: DataFrame, pairs: DataFrame, side: float, limits: list[float], last: bool) -> DataFrame:
    """Per location and radius, the weight of the neighbours found in the cubes listed as near."""
    placed = points.select(*_cell(side), "_lat", "_lon", "x", "y", "z", "w")
    # Before the last depth a cube with more than PAIR_LIMIT locations is never near. Leave out the points
    # of those that hold a large share of all, so that they do not crowd one task.
    shares = [] if last else frequent_keys(cells, [*CELL, "m"], "m")
    crowded = [r for r in shares if r["m"] > PAIR_LIMIT]
    if crowded:
        placed = placed.filter(~is_one_of(CELL, crowded))
    a, b = _renamed(placed, "a"), _renamed(placed, "b")
    near = pairs.select(*["a" + c for c in CELL], *["b" + c for c in CELL], *[f"o{r}" for r in range(len(limits))])
    gap2 = sum((F.col("b" + t) - F.col("a" + t)) ** 2 for t in "xyz")
    return (near.join(a, ["a" + c for c in CELL]).join(b, ["b" + c for c in CELL]).filter(gap2 <= max(limits) ** 2)
            .groupBy(F.col("a_lat").alias("_lat"), F.col("a_lon").alias("_lon"))
            .agg(*[F.sum(F.when(F.col(f"o{r}") & (gap2 <= limit * limit), F.col("bw")).otherwise(0)).alias(f"k{r}") for r, limit in enumerate(limits)]))


def _inner(points: DataFrame, cells: DataFrame, pairs: DataFrame, side: float, radii: int) -> DataFrame:
    """Per location and radius, the weight of the cubes that are neighbours as a whole."""
    sums = [F.sum(F.when(F.col(f"i{r}"), F.col("bw")).otherwise(0)).alias(f"k{r}") for r in range(radii)]
    per_cell = pairs.groupBy(*["a" + c for c in CELL]).agg(*sums)
    per_cell = per_cell.select(*[F.col("a" + c).alias(c) for c in CELL], *[f"k{r}" for r in range(radii)])
    placed = points.select("_lat", "_lon", *_cell(side))
    return spread_join(placed, per_cell, CELL, counts=(cells, "m")).drop(*CELL)


def neighbour_weights(points: DataFrame, limits: list[float]) -> DataFrame:
    """``(_lat, _lon, k0, k1, ...)``: number of points within each chord of each location, itself included.

    One descent serves all radii: cubes are as wide as the largest, and a pair of cubes is kept as long as some radius is
    neither wholly inside nor wholly outside.
    """
    side, flags = max(limits), [f"o{r}" for r in range(len(limits))]
    cells = _cells(points, side)
    pairs = _root_pairs(cells).select("*", *[F.lit(True).alias(f) for f in flags])
    found = []
    for depth in range(MAX_DEPTH + 1):
        # One pass writes the classified cube pairs; the branches below read that copy.
        kinds = cut_lineage(_classified(pairs, side, limits))
        present = kinds.agg(F.collect_set("kind").alias("kinds"), F.max("inner").alias("inner")).first()
        last = depth == MAX_DEPTH
        compare = ["near", "dense"] if last else ["near"]
        if present["inner"]:
            found.append(_inner(points, cells, kinds.filter("inner"), side, len(limits)))
        if set(present["kinds"]) & set(compare):
            found.append(_compare(points, cells, kinds.filter(F.col("kind").isin(compare)), side, limits, last))
        if last or "dense" not in present["kinds"]:
            break
        side = side / SPLIT
        cells = _cells(points, side)
        pairs = _split_pairs(kinds.filter(F.col("kind") == "dense"), cells, flags)
    none = points.select("_lat", "_lon", *[F.lit(0).cast("long").alias(f"k{r}") for r in range(len(limits))]).limit(0)
    total = reduce(DataFrame.unionByName, found) if found else none
    return total.groupBy("_lat", "_lon").agg(*[F.sum(f"k{r}").alias(f"k{r}") for r in range(len(limits))])


def competition(df: DataFrame, key: str = "locationId", lat: str = "latitude", lon: str = "longitude",
                radii: dict[str, float] | None = None, compat_double_radius: bool = True) -> DataFrame:
    """Per venue, the number of other venues within each radius (km); NULL without coordinates.

    Venues at the same place count each other and the radius is inclusive.
    """
    radii = radii or {"nb_restos_500m": 0.5, "nb_restos_1km": 1.0}
    points = cut_lineage(_locations(df, lat, lon))
    weights = neighbour_weights(points, [chord(km, compat_double_radius) for km in radii.values()])
    counts = weights.select("_lat", "_lon", *[(F.col(f"k{r}") - 1).cast("double").alias(name) for r, name in enumerate(radii)])
    venues = df.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    return spread_join(venues, counts, ["_lat", "_lon"], "left", counts=(points, "w")).select(key, *radii)


def grid_density(df: DataFrame, lat: str, lon: str, weight: str, degrees: float = 0.01) -> DataFrame:
    """Weighted point density on a regular degree grid."""
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .groupBy(F.floor(F.col(lat) / degrees).alias("cell_lat"), F.floor(F.col(lon) / degrees).alias("cell_lon"))
            .agg(F.count("*").alias("n"), F.sum(weight).alias("weight")))
