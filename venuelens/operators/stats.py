"""Statistical tests as aggregates; every test gives one row with a fixed schema.

Data is reduced on the executors to counts, moments or rank sums. Only the tail probability of the
single result row is computed outside the JVM.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.functions import pvalues as P
from venuelens.functions import scalars as S
from venuelens.operators import ordering as O
from venuelens.operators.quantiles import grouped_stats
from venuelens.operators.skew import spread_join
from venuelens.session import cut_lineage


def verdict(result: DataFrame, test: str, test_name: str, effect_name: str, p: Column | None = None) -> DataFrame:
    """Labels around ``statistic``, ``effect_size`` and the p-value of a result row."""
    out = result.withColumn("p_value", p) if p is not None else result
    return (out.withColumn("test_name", F.lit(test_name)).withColumn("effect_name", F.lit(effect_name))
            .withColumn("effect_label", S.effect_label(test, F.col("effect_size")))
            .withColumn("p_formatted", S.p_text(F.col("p_value")))
            .withColumn("interpretation", S.p_verdict(F.col("p_value"))))


def summary_text(result: DataFrame, n: str) -> DataFrame:
    """The display sentence of a test row; an error text where the test could not be run."""
    values = [F.col("test_name"), F.col("p_formatted"), F.col("interpretation"), F.col("effect_name"),
              F.format_string("%.4f", "effect_size"), F.col("effect_label"), F.col(n).cast("string")]
    text = F.concat(*[x for part, value in zip(L.SUMMARY_PARTS, values) for x in (F.lit(part), value)])
    missing = F.concat(F.lit(L.SUMMARY_MISSING), F.col("error"), F.lit("*"))
    return result.select(F.when(F.col("error").isNotNull(), missing).otherwise(text).alias("summary"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of every occurring pair of non-NULL values, in long form."""
    return (df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.count("*").alias("n")))


def label_contingency(df: DataFrame, labels: str, col: str, top_n: int = 8) -> DataFrame:
    """Contingency of exploded labels, restricted to the most frequent ones, with a column."""
    rows = df.filter(F.col(col).isNotNull()).select(F.explode(labels).alias("_label"), col)
    return contingency(O.restrict_to_top(rows, "_label", top_n), "_label", col)


def wide_contingency(cells: DataFrame, columns: list) -> DataFrame:
    return cells.groupBy("row").pivot("col", columns).sum("n").fillna(0)


def expected_counts(cells: DataFrame) -> DataFrame:
    """The full row x column grid with observed count ``n`` and expected count ``e``.

    The dense matrix is the result here. Rows meet columns by equal part number, so neither margin is
    gathered in one place.
    """
    parts = 16
    rows = cells.groupBy("row").agg(F.sum("n").alias("r")).withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cols = cells.groupBy("col").agg(F.sum("n").alias("c")).withColumn(
        "_p", F.pmod(F.xxhash64("col"), F.lit(parts)).cast("int"))
    total = cells.agg(F.sum("n")).scalar()
    return (rows.join(cols, "_p").join(cells, ["row", "col"], "left").fillna(0, ["n"])
            .select("row", "col", "n", (F.col("r") * F.col("c") / total).alias("e")))


def residuals(cells: DataFrame) -> DataFrame:
    return expected_counts(cells).withColumn("residual", (F.col("n") - F.col("e")) / F.sqrt("e"))


def chi2_independence(cells: DataFrame, with_p: bool = True) -> DataFrame:
    """Chi-square of a contingency in long form, with the continuity correction for one degree of freedom.

    Only occurring cells are visited: an empty cell adds its expected count, and those sum to what the
    occurring cells leave of the total. With two rows and two columns all four gaps are equal, so the
    corrected statistic follows from one gap and the margins.
    """
    cells = cut_lineage(cells)
    rows = cells.groupBy("row").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("col").agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n")).scalar()
    by_row = rows.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("r")).alias("inv")).alias("v")).scalar()
    by_col = cols.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("c")).alias("inv")).alias("v")).scalar()
    placed = cells.join(rows, "row").join(cols, "col").withColumn("e", F.col("r") * F.col("c") / total)
    gap = F.abs(F.col("n") - F.col("e"))
    sums = placed.agg(F.sum(gap * gap / F.col("e")).alias("seen"), F.sum("e").alias("e"), F.sum("n").alias("n_samples"),
                      F.max(gap).alias("gap"))
    base = sums.select(
        (F.col("seen") + F.col("n_samples") - F.col("e")).alias("plain"),
        ((F.col("gap") - F.least("gap", F.lit(0.5))) ** 2 * F.col("n_samples") * by_row["inv"] * by_col["inv"]).alias("yates"),
        by_row["k"].alias("nr"), by_col["k"].alias("nc"), "n_samples")
    out = base.select(
        F.when((F.col("nr") - 1) * (F.col("nc") - 1) == 1, F.col("yates")).otherwise(F.col("plain")).alias("statistic"),
        ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("int").alias("dof"), "n_samples",
        (F.least("nr", "nc") - 1).alias("k"))
    out = out.select("statistic", "dof", "n_samples", F.when(F.col("k") > 0, F.sqrt(
        F.col("statistic") / (F.col("n_samples") * F.col("k")))).otherwise(0.0).alias("effect_size"),
        F.when(F.col("dof") < 1, F.lit("Moins de 2 lignes ou colonnes")).alias("error"))
    return verdict(out, "chi2", *L.TEST_TEXTS["chi2"], P.chi2_p("statistic", "dof")) if with_p else out


def _valid_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean and variances of groups with at least two values."""
    return (df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("group"))
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
            .filter(F.col("n") >= 2))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation per valid group."""
    return _valid_groups(df, group, value).select("group", "n", "mean", F.sqrt("var").alias("std"))


def anova(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """One-way analysis of variance from per-group moments."""
    g = _valid_groups(df, group, value)
    grand = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    base = g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_total"),
                 F.sum(F.col("n") * (F.col("mean") - grand) ** 2).alias("ssb"),
                 F.sum(F.col("n") * F.col("var")).alias("ssw"))
    d1, d2 = F.col("n_groups") - 1, F.col("n_total") - F.col("n_groups")
    sst = F.col("ssb") + F.col("ssw")
    out = base.select(
        ((F.col("ssb") / F.nullif(d1, F.lit(0))) / F.nullif(F.col("ssw") / d2, F.lit(0.0))).alias("statistic"),
        F.when(sst > 0, F.col("ssb") / F.nullif(sst, F.lit(0.0))).otherwise(0.0).alias("effect_size"),
        "n_groups", "n_total", d1.alias("dof_between"), d2.alias("dof_within"),
        F.when(F.col("n_groups") < 2, F.lit("Moins de 2 groupes valides")).alias("error"))
    return verdict(out, "variance", *L.TEST_TEXTS["anova"],
                   P.f_p("statistic", "dof_between", "dof_within")) if with_p else out


def kruskal_wallis(df: DataFrame, group: str, value: str, with_p: bool = True,
                   rows_per_bucket: int | None = None) -> DataFrame:
    """Rank test of equal location with tie correction.

    Values are counted per (value, group); the average rank of a value comes from a bucketed running
    total, so neither a frequent value nor a large group lands in one task.
    """
    pairs = cut_lineage(O.value_counts(df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
                                       .select(group, F.col(value).cast("double").alias("_v")), [group, "_v"], "m"))
    keep = pairs.groupBy(group).agg(F.sum("m").alias("_n")).filter(F.col("_n") >= 2).select(group)
    pairs = spread_join(pairs, keep, [group], "left_semi")
    counts = cut_lineage(pairs.groupBy("_v").agg(F.sum("m").alias("n")))
    ranks = O.ranks_of_counts(counts, "_v", "rank", rows_per_bucket)
    placed = spread_join(pairs, ranks.select("_v", "rank"), ["_v"])
    sums = placed.groupBy(group).agg(F.sum(F.col("rank") * F.col("m")).alias("r"), F.sum("m").alias("n"))
    t = F.col("n").cast("double")
    ties = counts.agg(F.sum(t * t * t - t)).scalar()
    base = sums.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_total"),
                    F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n, k = F.col("n_total").cast("double"), F.col("n_groups")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - ties / (n * n * n - n), F.lit(0.0))
    out = base.select(h.alias("statistic"), "n_groups", "n_total").select(
        "statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(
            n > k, (F.col("statistic") - k + 1) / (n - k)).otherwise(0.0))).alias("effect_size"),
        "n_groups", "n_total", (k - 1).alias("dof"),
        F.when(k < 2, F.lit("Moins de 2 groupes valides")).alias("error"))
    return verdict(out, "variance", *L.TEST_TEXTS["kruskal"], P.chi2_p("statistic", "dof")) if with_p else out


def group_quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median and interquartile range of groups with at least two values."""
    data = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    q = grouped_stats(data, [group], [F.count(value).alias("n")],
                      {"median": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)})
    return q.filter(F.col("n") >= 2).select(F.col(group).alias("group"), "n", "median",
                                            (F.col("q75") - F.col("q25")).alias("iqr"))


def spearman(df: DataFrame, x: str, y: str, with_p: bool = True, min_n: int = 3,
             rows_per_bucket: int | None = None) -> DataFrame:
    """Rank correlation with average ties over complete pairs."""
    pairs = cut_lineage(O.value_counts(
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), ["_x", "_y"], "m"))
    placed = pairs
    for v, r in (("_x", "rx"), ("_y", "ry")):
        # rows and distinct partners per value, counted once for the sketch, the running total and the join
        counts = cut_lineage(pairs.groupBy(v).agg(F.sum("m").alias("n"), F.count("*").alias("k")))
        ranks = O.ranks_of_counts(counts.select(v, "n"), v, r, rows_per_bucket).select(v, r)
        placed = spread_join(placed, ranks, [v], counts=(counts, "k"))
    middle = (pairs.agg(F.sum("m")).scalar() + 1) / 2
    dx, dy, m = F.col("rx") - middle, F.col("ry") - middle, F.col("m")
    base = placed.agg(F.sum(m).alias("n_samples"), F.sum(m * dx * dy).alias("xy"),
                      F.sum(m * dx * dx).alias("xx"), F.sum(m * dy * dy).alias("yy"))
    n = F.coalesce("n_samples", F.lit(0))
    rho = F.when(n >= min_n, F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)))
    out = base.select(rho.alias("statistic"), n.alias("n_samples")).select(
        "statistic", "n_samples", F.abs("statistic").alias("effect_size"),
        F.when(F.col("statistic") > 0, F.lit("positive")).when(F.col("statistic").isNotNull(), F.lit("negative")).alias("direction"),
        F.when(F.col("n_samples") < min_n, F.lit(f"Moins de {min_n} observations valides")).alias("error"))
    if not with_p:
        return out
    dof = F.col("n_samples") - 2
    t = F.col("statistic") * F.sqrt(dof / F.nullif(1 - F.col("statistic") ** 2, F.lit(0.0)))
    p = F.when(F.abs("statistic") >= 1, F.lit(0.0)).otherwise(F.col("_p"))
    return verdict(out.withColumn("_p", P.t_p(t, dof)), "spearman", *L.TEST_TEXTS["spearman"], p).drop("_p")


def welch(df: DataFrame, flag: Column, value: str, with_p: bool = True, min_n: int = 2,
          name_a: str = "Groupe A", name_b: str = "Groupe B") -> DataFrame:
    """Unequal-variance t-test between the rows where ``flag`` holds and those where it does not."""
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    m = df.agg(*[f(x).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b))
                 for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("std", F.stddev_pop))])
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    se2 = va / na + vb / nb
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0)))
    enough = (na >= min_n) & (nb >= min_n)
    out = m.select(
        F.when(enough, diff / F.nullif(F.sqrt(se2), F.lit(0.0))).alias("statistic"),
        F.when(enough, se2 ** 2 / F.nullif((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1), F.lit(0.0))).alias("dof"),
        F.when(enough, F.when(pooled > 0, F.abs(diff / F.nullif(pooled, F.lit(0.0)))).otherwise(0.0)).alias("effect_size"),
        "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", F.lit(name_a).alias("name_a"), F.lit(name_b).alias("name_b"),
        F.when(~enough, F.lit(f"Moins de {min_n} observations")).alias("error"))
    return verdict(out, "welch", *L.TEST_TEXTS["welch"], P.t_p("statistic", "dof")) if with_p else out


def complement_welch(df: DataFrame, group: str, value: str, min_n: int = 2) -> DataFrame:
    """Unequal-variance t-test of every group against all rows of the other groups, in one pass over the data.

    Each group is reduced to count, mean and squared deviations; those of its complement are the totals without it. Rows
    without group or value belong to no side. Result: group, n, mean, rest_n, rest_mean, statistic, dof; the last two are
    NULL where either side has fewer than ``min_n`` values or neither varies.
    """
    g = cut_lineage(df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("group"))
                    .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("q")))
    grand = g.agg(F.struct(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
                  .alias("v")).scalar()
    spread = g.agg(F.sum(F.col("q") + F.col("n") * (F.col("mean") - grand["mean"]) ** 2)).scalar()
    n, rest = F.col("n"), F.col("rest_n")
    sides = g.withColumn("rest_n", grand["n"] - n).withColumn(
        "rest_mean", (grand["mean"] * grand["n"] - n * F.col("mean")) / F.nullif(rest, F.lit(0)))
    between = n * rest / grand["n"] * (F.col("mean") - F.col("rest_mean")) ** 2
    enough = (n >= min_n) & (rest >= min_n)
    # a rest without spread can come out a little below zero
    var_a = F.col("q") / F.nullif(n - 1, F.lit(0))
    var_b = F.greatest(spread - F.col("q") - between, F.lit(0.0)) / F.nullif(rest - 1, F.lit(0))
    a, b = var_a / n, var_b / F.nullif(rest, F.lit(0))
    t = (F.col("mean") - F.col("rest_mean")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    dof = (a + b) ** 2 / F.nullif(a ** 2 / F.nullif(n - 1, F.lit(0)) + b ** 2 / F.nullif(rest - 1, F.lit(0)), F.lit(0.0))
    return sides.select("group", "n", "mean", "rest_n", "rest_mean", F.when(enough, t).alias("statistic"), F.when(enough, dof).alias("dof"))


def step_up(df: DataFrame, p: str, alpha: float = 0.05, out: str = "significant", rows_per_bucket: int | None = None) -> DataFrame:
    """Rows whose p-value is significant when all of them are tested together (false discoveries at most ``alpha``).

    The largest p with p <= alpha * rank / tests is the limit; equal p-values share their highest rank. Ranks are
    bucketed running totals, so any number of tests is spread over tasks. A NULL p-value is no test and not significant.
    """
    counts = cut_lineage(O.value_counts(df.filter(F.col(p).isNotNull()).select(F.col(p).alias("_p")), ["_p"]))
    cum = O.running_total(counts, [], [F.col("_p")], "n", "_rank", "_p", O.value_bounds(counts, "_p", rows_per_bucket))
    tests = counts.agg(F.sum("n")).scalar()
    limit = cum.filter(F.col("_p") <= alpha * F.col("_rank") / tests).agg(F.max("_p")).scalar()
    return df.withColumn(out, F.coalesce(F.col(p) <= limit, F.lit(False)))


def group_contrasts(df: DataFrame, group: str, value: str, alpha: float = 0.05, min_n: int = 2) -> DataFrame:
    """Every group against the rest with its p-value and whether it stands the correction over all groups."""
    tested = cut_lineage(complement_welch(df, group, value, min_n).withColumn("p_value", P.t_p("statistic", "dof")))
    return step_up(tested, "p_value", alpha)


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns over rows where both are set, in one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
                 *[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("pearson"),
                               F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def spearman_matrix(df: DataFrame, columns: list[str], min_n: int = 3, rows_per_bucket: int | None = None) -> DataFrame:
    """Pearson and rank correlation of every pair of columns over the rows where both are set.

    A column's ranks differ from partner to partner, as other rows are missing. So its values are counted once for
    every partner (rows of the value where the partner is set), and one ordered pass turns these counts into the ranks among
    each partner's rows. All columns share that pass; each is then joined once, and all pairs are sums of one aggregate.
    """
    data = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]))
    own = range(len(columns))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"), *[F.col(f"v{j}").isNotNull().cast("long").alias(f"n{j}") for j in own])
                      for i in own])
    counts = cut_lineage(data.select(F.explode(cells).alias("z")).select("z.*").filter(F.col("v").isNotNull())
                         .groupBy("c", "v").agg(F.count("*").alias("n"), *[F.sum(f"n{j}").alias(f"n{j}") for j in own]))
    ranked = O.running_totals(counts, ["c"], [F.col("v")], {f"t{j}": f"n{j}" for j in own}, "v", O.value_bounds(counts, "v", rows_per_bucket))
    ranks = cut_lineage(ranked.select("c", "v", "n", *[(F.col(f"t{j}") - F.col(f"n{j}") + (F.col(f"n{j}") + 1) / 2).alias(f"r{j}") for j in own]))
    placed = data
    for i in own:
        mine = ranks.filter(F.col("c") == i)
        placed = spread_join(placed, mine.select(F.col("v").alias(f"v{i}"), *[F.col(f"r{j}").alias(f"r{i}_{j}") for j in own if j != i]),
                             [f"v{i}"], "left", counts=(mine.select(F.col("v").alias(f"v{i}"), "n"), "n"))
    pairs = list(combinations(own, 2))
    # a rank exists for every value, so only rows with both values may count
    both = {p: F.col(f"v{p[0]}").isNotNull() & F.col(f"v{p[1]}").isNotNull() for p in pairs}
    row = placed.agg(*[x.alias(f"{n}{i}_{j}") for i, j in pairs for n, x in (
        ("p", F.corr(f"v{i}", f"v{j}")), ("n", F.count_if(both[i, j])),
        ("s", F.corr(F.when(both[i, j], F.col(f"r{i}_{j}")), F.when(both[i, j], F.col(f"r{j}_{i}")))))])
    out = F.array(*[F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"p{i}_{j}").alias("pearson"), F.col(f"n{i}_{j}").alias("n"),
                             F.when(F.col(f"n{i}_{j}") >= min_n, F.col(f"s{i}_{j}")).alias("spearman")) for i, j in pairs])
    return row.select(F.explode(out).alias("z")).select("z.*")


REGRESSION = ("term string, coefficient double, std_error double, statistic double, p_value double, aliased boolean, n long, dof long, "
              "r2 double, adjusted_r2 double, sigma double, f_statistic double, f_p_value double")


def regression(df: DataFrame, predictors: list[str], target: str, tolerance: float = 1e-10) -> DataFrame:
    """Least squares with intercept and inference: one row per term, the figures of the model repeated on each.

    One aggregate gives the means and the covariances of all columns over the rows where all are set; only that square of numbers
    reaches the driver. Predictors enter by a pivoted Cholesky factorisation of their correlations, always the one with
    most variance left; what is left below ``tolerance`` of a predictor is a combination of those before it: it is
    ``aliased``, without figures. Without degrees of freedom left there are coefficients only; without rows all is NULL.
    """
    names = [*predictors, target]
    data = df.na.drop(subset=names).select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    size = len(names)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    row = data.agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(size)],
                   *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in cells]).first()
    n = row["n"]
    blank = [None] * 4
    if not n:
        return df.sparkSession.createDataFrame([(t, *blank, t != "(intercept)", 0, None, *[None] * 5) for t in ["(intercept)", *predictors]], REGRESSION)
    mean = np.array([row[f"m{i}"] for i in range(size)])
    cov = np.zeros((size, size))
    for i, j in cells:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    kept, root = pivoted_cholesky(cov[:-1, :-1], tolerance)
    beta = solve_root(root, cov[kept, -1])
    total = float(n * cov[-1, -1])
    rss = max(float(n * (cov[-1, -1] - beta @ cov[kept, -1])), 0.0)
    k, dof = len(kept), n - len(kept) - 1
    inverse = solve_root(root, np.eye(k)) / n
    var = rss / dof if dof > 0 else None
    values = {"(intercept)": (float(mean[-1] - beta @ mean[kept]), 1 / n + float(mean[kept] @ inverse @ mean[kept]))}
    values |= {predictors[c]: (float(b), float(inverse[i, i])) for i, (c, b) in enumerate(zip(kept, beta))}
    r2 = 1 - rss / total if total > 0 else None
    f = (total - rss) / k / var if k and var else None
    model = (n, dof, r2, 1 - (1 - r2) * (n - 1) / dof if r2 is not None and dof > 0 else None, var ** 0.5 if var is not None else None,
             f, P.f_tail(f, k, dof) if f is not None else None)
    rows = []
    for term in ["(intercept)", *predictors]:
        if term not in values:
            rows.append((term, *blank, True, *model))
            continue
        b, share = values[term]
        error = (var * share) ** 0.5 if var is not None else None
        t = b / error if error else None
        rows.append((term, b, error, t, P.t_two_sided(t, dof) if t is not None else None, False, *model))
    return df.sparkSession.createDataFrame(rows, REGRESSION)


def pivoted_cholesky(cov: np.ndarray, tolerance: float) -> tuple[list[int], np.ndarray]:
    """(columns kept, in order of choice, lower triangular root of their covariance)."""
    scale = np.sqrt(np.diag(cov))
    left = (scale > 0).astype(float)
    rows = np.zeros((len(cov), 0))
    corr = cov / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    kept: list[int] = []
    while len(kept) < len(cov):
        at = int(np.argmax(left))
        if left[at] <= tolerance:
            break
        column = (corr[:, at] - rows @ rows[at]) / np.sqrt(left[at])
        rows = np.column_stack([rows, column])
        left = left - column ** 2
        left[[*kept, at]] = 0.0
        kept.append(at)
    return kept, np.tril(rows[kept] * scale[kept][:, None])


def solve_root(root: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(root.T, np.linalg.solve(root, right)) if len(root) else right


def ols(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Least-squares line per group over complete pairs."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    data = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for k in keys:
        data = data.filter(F.col(k).isNotNull())
    return data.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(fy, fx).alias("slope"),
                                   F.regr_intercept(fy, fx).alias("intercept"), F.regr_r2(fy, fx).alias("r2"))


def local_trend(df: DataFrame, x: str, y: str, points: int = 20, width: float = 0.3) -> DataFrame:
    """Tricube-weighted local line at evenly spaced points between the extremes of x.

    The window is a fixed share of the range. A row is sent to the points it can reach only, and the weighted
    moments are combined before the shuffle.
    """
    data = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = data.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("g")).scalar()
    span = g["hi"] - g["lo"]
    at = g["lo"] + span * F.col("i") / (points - 1)
    step = F.nullif(span / (points - 1), F.lit(0.0))
    first = F.greatest(F.floor((F.col("x") - g["lo"] - span * width) / step), F.lit(0))
    last = F.least(F.ceil((F.col("x") - g["lo"] + span * width) / step), F.lit(points - 1))
    reach = data.select("x", "y", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i")).select(
        "y", "i", at.alias("x_at"), (F.col("x") - at).alias("d"), (span * width).alias("h"))
    u = F.abs("d") / F.col("h")
    w = (1 - u * u * u) ** 3
    m = reach.filter(F.abs("d") < F.col("h")).withColumn("w", w).groupBy("i", "x_at").agg(
        F.count("*").alias("n"), F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("d")).alias("s1"),
        F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"), F.sum(F.col("w") * F.col("y")).alias("t0"),
        F.sum(F.col("w") * F.col("d") * F.col("y")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return m.select("i", "x_at", "n", F.when(det > 0, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.nullif(det, F.lit(0.0)))
                    .otherwise(F.col("t0") / F.col("s0")).alias("fit"))
