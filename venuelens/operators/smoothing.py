"""Smooth curves and densities from one-pass sums: robust local lines and Gaussian kernels on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.operators import ordering as O
from venuelens.operators.quantiles import grouped_stats
from venuelens.session import cut_lineage


def nearest_distances(x: DataFrame, at: list[float], share: float, rows_per_bucket: int | None = None) -> list[float]:
    """For every point of ``at`` the distance within which it has ``share`` of all values of the only column of ``x``.

    The k nearest values of a point are k neighbours in sorted order, from some value to the one k - 1 ranks above it. Ranks
    are bucketed running totals and each value meets its upper end by rank, so no window spans all rows; the points then
    take their least distance over all such pairs in one aggregate.
    """
    counts = cut_lineage(O.value_counts(x.toDF("v"), ["v"]))
    total = counts.agg(F.sum("n")).first()[0] or 0
    k = max(1, min(total, int(share * total + 1e-10)))
    bounds = O.value_bounds(counts, "v", rows_per_bucket)
    ranked = O.running_total(counts, [], [F.col("v")], "n", "_cum", "v", bounds).withColumn("first", F.col("_cum") - F.col("n") + 1)
    events = (ranked.select(F.col("first").alias("rank"), F.lit(0).alias("kind"), "v", F.lit(None).cast("double").alias("low"))
              .unionByName(ranked.filter(F.col("first") + (k - 1) <= total).select(
                  (F.col("first") + (k - 1)).alias("rank"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"), F.col("v").alias("low"))))
    bucket = F.floor(F.col("rank") / (rows_per_bucket or O.ROWS_PER_BUCKET)) if bounds else None
    pairs = O.running_max(events, [F.col("rank"), F.col("kind")], "v", "high", bucket).filter(F.col("kind") == 1)
    reach = [F.min(F.greatest(F.lit(a) - F.col("low"), F.col("high") - F.lit(a))).alias(f"h{i}") for i, a in enumerate(at)]
    return [float(h) for h in pairs.agg(*reach).first()]


def lowess(df: DataFrame, x: str, y: str, share: float = 2 / 3, points: int = 25, rounds: int = 3,
           rows_per_bucket: int | None = None) -> DataFrame:
    """Robust local line at evenly spaced points: each point weighs its nearest ``share`` of all rows.

    Weights are tricube in the distance. After each of ``rounds`` further fits rows far from the curve (bisquare in six
    median residuals, the curve taken as straight between points) lose weight. A row takes part in the sums of the points
    it can reach, which are combined before the shuffle; only the points pass through the driver. Rows without x or y are left out; a
    constant x gives one point; no rows give none.
    """
    data = cut_lineage(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    lo, hi = data.agg(F.min("x"), F.max("x")).first()
    schema = "i int, x_at double, width double, n long, fit double"
    if lo is None:
        return data.sparkSession.createDataFrame([], schema)
    at = [lo + (hi - lo) * i / (points - 1) for i in range(points)] if hi > lo else [lo]
    width = nearest_distances(data.select("x"), at, share, rows_per_bucket)
    weight, fitted = F.lit(1.0), []
    for done in range(rounds + 1):
        fitted = _local_lines(data.withColumn("robust", weight), at, width)
        if done == rounds:
            break
        off = F.abs(F.col("y") - _between(F.col("x"), at, [f for _, f in fitted]))
        middle = grouped_stats(data.select(off.alias("r")), [], [F.count("r").alias("n")], {"m": ("r", 0.5)}).first()["m"]
        far = off / F.lit(6 * middle) if middle else F.when(off > 0, 1.0).otherwise(0.0)
        weight = F.when(far < 1, (1 - far * far) ** 2).otherwise(0.0)
    rows = [(i, a, h, n, f) for i, (a, h, (n, f)) in enumerate(zip(at, width, fitted))]
    return data.sparkSession.createDataFrame(rows, schema)


def _local_lines(data: DataFrame, at: list[float], width: list[float]) -> list[tuple[int, float | None]]:
    """(rows in reach, value of the weighted line) at every point."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(h).alias("h")) for i, (a, h) in enumerate(zip(at, width))])
    near = data.select("y", "robust", F.col("x"), F.explode(grid).alias("g")).select(
        "y", "robust", F.col("g.i").alias("i"), F.col("g.h").alias("h"), (F.col("x") - F.col("g.a")).alias("d"))
    u = F.abs("d") / F.nullif(F.col("h"), F.lit(0.0))
    w = F.col("robust") * F.when(F.col("h") > 0, (1 - u * u * u) ** 3).otherwise(1.0)
    sums = (near.filter((F.abs("d") < F.col("h")) | (F.col("d") == 0)).withColumn("w", w).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("d")).alias("s1"),
        F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"), F.sum(F.col("w") * F.col("y")).alias("t0"),
        F.sum(F.col("w") * F.col("d") * F.col("y")).alias("t1")).collect())
    out: list[tuple[int, float | None]] = [(0, None)] * len(at)
    for r in sums:
        det = r["s0"] * r["s2"] - r["s1"] * r["s1"]
        line = (r["s2"] * r["t0"] - r["s1"] * r["t1"]) / det if det > 1e-12 * (r["s0"] * r["s2"]) else None
        out[r["i"]] = (r["n"], line if line is not None else r["t0"] / r["s0"] if r["s0"] > 0 else None)
    return out


def _between(x: Column, at: list[float], values: list[float | None]) -> Column:
    """The curve at ``x``, straight between its points."""
    y = F.array(*[F.lit(v).cast("double") for v in values])
    if len(at) == 1:
        return F.get(y, F.lit(0))
    step = at[1] - at[0]
    i = F.greatest(F.least(F.floor((x - at[0]) / step), F.lit(len(at) - 2)), F.lit(0)).cast("int")
    return F.get(y, i) + (F.get(y, i + 1) - F.get(y, i)) * ((x - at[0]) / step - i)


def rule_of_thumb(sd: Column, q1: Column, q3: Column, n: Column) -> Column:
    """The usual bandwidth of a Gaussian kernel, from deviation and quartiles; NULL where the values do not vary."""
    spread = F.when(q3 > q1, F.least(sd, (q3 - q1) / 1.349)).otherwise(sd)
    return 1.059 * F.when(spread > 0, spread) * F.pow(n.cast("double"), F.lit(-0.2))


def kernel_density(df: DataFrame, value: str, group: str, points: int = 100, reach: float = 8.0) -> DataFrame:
    """Gaussian density of each group on a common grid between the extremes of the column (the outline of a violin).

    Values are split linearly between their two grid points, so that every group is reduced to at most ``points`` sums
    before the shuffle; the kernel is applied to those sums, up to ``reach`` bandwidths away. Rows without group or value are left
    out; a group whose values do not vary has no density. Result: group, i, x_at, n, bandwidth, density.
    """
    data = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        F.col(group).alias("group"), F.col(value).cast("double").alias("x"))
    shape = cut_lineage(grouped_stats(data, ["group"], [F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")],
                                      {"q1": ("x", 0.25), "q3": ("x", 0.75)})
                        .withColumn("bandwidth", rule_of_thumb(F.col("sd"), F.col("q1"), F.col("q3"), F.col("n"))))
    ends = shape.agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("v")).scalar()
    step = F.nullif((ends["hi"] - ends["lo"]) / (points - 1), F.lit(0.0))
    place = (F.col("x") - ends["lo"]) / step
    sums = _split(data.select("group", place.alias("p")).filter(F.col("p").isNotNull()), ["group"], {"p": "i"}, F.lit(1.0), points - 1)
    curves = shape.filter(F.col("bandwidth").isNotNull()).select("group", "n", "bandwidth", step.alias("step"), ends["lo"].alias("lo"))
    far = reach * F.col("bandwidth") / F.col("step")
    seen = sums.join(curves, "group").select(
        "group", "w", "step", "bandwidth", "i", F.explode(F.sequence(
            F.greatest(F.ceil(F.col("i") - far), F.lit(0)).cast("int"), F.least(F.floor(F.col("i") + far), F.lit(points - 1)).cast("int"))).alias("j"))
    u = (F.col("j") - F.col("i")) * F.col("step") / F.col("bandwidth")
    mass = seen.groupBy("group", F.col("j").alias("i")).agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("mass"))
    grid = curves.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.join(mass, ["group", "i"], "left").select(
        "group", "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x_at"), "n", "bandwidth",
        (F.coalesce("mass", F.lit(0.0)) / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))


def _split(data: DataFrame, keys: list[str], axes: dict[str, str], weight: Column, last: int | None = None) -> DataFrame:
    """Weights summed on grid points: a position (in steps) is shared between its two neighbours along every axis."""
    shares = [(weight, [])]
    for place in axes:
        low = F.floor(place) if last is None else F.least(F.floor(place), F.lit(last - 1))
        part = F.col(place) - low
        shares = [(w * s, [*at, cell]) for w, at in shares for cell, s in ((low, 1 - part), (low + 1, part))]
    corners = F.array(*[F.struct(*[c.cast("long").alias(n) for c, n in zip(at, axes.values())], w.alias("w")) for w, at in shares])
    return (data.select(*keys, F.explode(corners).alias("c")).filter(F.col("c.w") != 0)
            .groupBy(*keys, *[F.col(f"c.{n}").alias(n) for n in axes.values()]).agg(F.sum("c.w").alias("w")))


def kernel_heat(df: DataFrame, lat: str, lon: str, weight: str | None = None, cell: float = 0.005, reach: float = 4.0) -> DataFrame:
    """Gaussian heat of weighted points on a square grid of ``cell`` degrees.

    The bandwidth of an axis is its deviation times n^(-1/6), from one aggregate. Points are shared between the four grid points around
    them and summed; the kernel is then applied along one axis and along the other, each cut at ``reach``
    bandwidths, so a grid point meets only its row and its column. Rows without coordinates are left out, a missing weight
    counts nothing; points that do not vary along an axis have no heat. Result: cell_lat, cell_lon (grid point = number times ``cell``), heat (per square degree).
    """
    data = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        (F.col(lat) / cell).alias("p"), (F.col(lon) / cell).alias("q"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("z"))
    scale = F.pow(F.count("*").cast("double"), F.lit(-1 / 6))
    size = data.agg(F.struct((F.stddev_samp("p") * scale).alias("i"), (F.stddev_samp("q") * scale).alias("j")).alias("v")).scalar()
    heat = _split(data, [], {"p": "i", "q": "j"}, F.col("z"))
    for axis, other in (("i", "j"), ("j", "i")):
        h = F.nullif(size[axis], F.lit(0.0))
        far = F.floor(reach * h).cast("int")
        spread = heat.withColumn("h", h).select("w", "h", other, axis, F.explode(F.sequence(-far, far)).alias("d"))
        u = F.col("d") / F.col("h")
        heat = spread.groupBy((F.col(axis) + F.col("d")).alias(axis), other).agg(
            F.sum(F.col("w") * F.exp(-0.5 * u * u) / (F.col("h") * cell * math.sqrt(2 * math.pi))).alias("w"))
    return heat.select(F.col("i").alias("cell_lat"), F.col("j").alias("cell_lon"), F.col("w").alias("heat"))
