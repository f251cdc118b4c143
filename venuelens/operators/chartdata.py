"""The aggregates behind charts: bins, boxes, grids, flows and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import scalars as S
from venuelens.operators import ordering as O
from venuelens.operators.quantiles import grouped_stats
from venuelens.operators.skew import spread_join


def _equal_width(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of equal width; the maximum falls in the last bin, a constant column in bin 0."""
    width = F.nullif(hi - lo, F.lit(0.0))
    return F.coalesce(F.least(F.floor((x - lo) * bins / width), F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Counts in equal-width bins between the extremes of the column, optionally per group."""
    data = df.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    if group:
        data = data.filter(F.col(group).isNotNull())
    g = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("g")).scalar()
    keys = [group] if group else []
    counted = (data.withColumn("bin", _equal_width(F.col("_x"), g["lo"], g["hi"], bins))
               .groupBy(*keys, "bin").agg(F.count("*").alias("n")))
    step = (g["hi"] - g["lo"]) / bins
    return counted.select(*keys, "bin", "n", (g["lo"] + step * F.col("bin")).alias("lower"),
                          (g["lo"] + step * (F.col("bin") + 1)).alias("upper"))


def distributions(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Histograms of several columns in long form, each over its own range, in one counting pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    g = df.agg(F.struct(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns
                          for n, f in (("lo", F.min), ("hi", F.max))]).alias("g")).scalar()
    lo = F.coalesce(*[F.when(F.col("variable") == c, g[f"lo_{c}"]) for c in columns])
    hi = F.coalesce(*[F.when(F.col("variable") == c, g[f"hi_{c}"]) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("x").isNotNull())
    return (long.withColumn("bin", _equal_width(F.col("x"), lo, hi, bins))
            .groupBy("variable", "bin").agg(F.count("*").alias("n")))


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5·IQR fences, whisker ends and the number of suspected outliers per group."""
    data = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    q = grouped_stats(data, [group], [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max")],
                      {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)})
    fences = (q.withColumn("fence_low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
               .withColumn("fence_high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    x = F.col(value)
    rows = spread_join(data.select(group, value), fences.select(group, "fence_low", "fence_high"), [group])
    ends = rows.groupBy(group).agg(
        F.min(F.when(x >= F.col("fence_low"), x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("fence_high"), x)).alias("whisker_high"),
        F.count_if((x < F.col("fence_low")) | (x > F.col("fence_high"))).alias("n_outliers"))
    return fences.join(ends, group)


def density_grid(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Counts on a grid of gridsize x gridsize cells over the range of both axes."""
    data = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = data.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                          F.max("y").alias("y1")).alias("g")).scalar()
    return data.groupBy(_equal_width(F.col("x"), g["x0"], g["x1"], gridsize).alias("bin_x"),
                        _equal_width(F.col("y"), g["y0"], g["y1"], gridsize).alias("bin_y")) \
               .agg(F.count("*").alias("n"))


def flow_edges(df: DataFrame, labels: str = "cuisine_list", price: str = "priceLevel", rating: str = "rating",
               top_n: int = 8, min_rows: int = 10, zero_edges: bool = True) -> DataFrame:
    """Edge counts label → price and price → quality of the most frequent labels.

    With ``zero_edges`` every (price, quality) pair is listed. Fewer than ``min_rows`` rows give none.
    """
    rows = df.select(F.explode(labels).alias("label"), F.col(price).alias("price"), F.col(rating).alias("r")).na.drop()
    enough = rows.limit(min_rows).agg(F.count("*") >= min_rows).scalar()
    kept = O.restrict_to_top(rows, "label", top_n).filter(enough)
    first = kept.groupBy(F.col("label").alias("source"), F.col("price").alias("target")).agg(F.count("*").alias("n"))
    binned = kept.withColumn("q", S.right_closed_bin("r"))
    second = binned.filter(F.col("q").isNotNull()).groupBy("price", "q").agg(F.count("*").alias("n"))
    if zero_edges:
        classes = F.array(*[F.lit(label) for _, label in L.QUALITY_BINS])
        grid = kept.select("price").distinct().select("price", F.explode(classes).alias("q"))
        second = grid.join(second, ["price", "q"], "left").fillna(0, ["n"])
    second = second.select(F.col("price").alias("source"), F.col("q").alias("target"), "n")
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))


def grouped_bars(df: DataFrame, x: str, group: str, value: str) -> DataFrame:
    return (df.filter(F.col(x).isNotNull() & F.col(group).isNotNull())
            .groupBy(x, group).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("n")))


def map_points(df: DataFrame, columns: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lat, lon, *columns)


def category_totals(df: DataFrame, categories: list[str] = L.CATEGORIES) -> DataFrame:
    """Sum of every category column over rated venues with a menu, in long form."""
    sums = df.filter((F.col("nb_items_total") > 0) & F.col("rating").isNotNull()).agg(
        *[F.sum(F.col(f"`{c}`")).alias(c) for c in categories])
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("total")) for c in categories])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def season_means(df: DataFrame, seasons: list[str] = list(L.SEASON_TERMS)) -> DataFrame:
    """Mean ratio per season over rows where every ratio is known."""
    columns = [f"seasonal_{s}_ratio" for s in seasons]
    means = df.na.drop(subset=columns).agg(*[F.avg(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(s).alias("season"), F.col(c).alias("mean_ratio")) for s, c in zip(seasons, columns)])
    return means.select(F.explode(cells).alias("c")).select("c.*")


def word_frequencies(scored: DataFrame, key: str = "locationId", text: str = "text", top: int = 50,
                     min_chars: int = 2) -> DataFrame:
    """Most frequent words of the negative and of the positive reviews of every venue.

    All reviews and whole texts are read. Words are counted per task before the shuffle and the
    ranking keeps at most ``top`` rows per venue and task before its own.
    """
    polarity = F.when(F.col("sent_class") <= 2, "negative").when(F.col("sent_class") >= 4, "positive")
    counts = (scored.filter(F.col(key).isNotNull()).select(key, polarity.alias("polarity"), text)
              .filter(F.col("polarity").isNotNull())
              .select(key, "polarity", F.explode(S.tokens(text, min_chars)).alias("word"))
              .filter(~F.col("word").isin(L.STOP_WORDS))
              .groupBy(key, "polarity", "word").agg(F.count("*").alias("n")))
    order = W.partitionBy(key, "polarity").orderBy(F.desc("n"), F.asc("word"))
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
