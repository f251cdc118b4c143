"""Regression, contrasts, robust lines, densities and rank correlations against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuelens.operators import ordering, smoothing, stats


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_regression_matches_normal_equations_and_names_collinear_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    y = 2 + x @ [1.0, -0.5, 0.0, 3.0] + rng.normal(size=60)
    rows = [(*map(float, r), float(r[0] - 2 * r[3]), 7.0, float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0, 7.0, 1.0)]
    names = ["a", "b", "c", "d", "mix", "flat"]
    out = {r.term: r for r in stats.regression(rows_of(spark, rows, ", ".join(f"{c} double" for c in [*names, "y"])), names, "y").collect()}
    assert out["flat"].aliased and out["flat"].coefficient is None
    kept = [c for c in names if not out[c].aliased]
    assert len(kept) == 4 and sum(out[c].aliased for c in ("a", "d", "mix")) == 1
    full = np.column_stack([np.ones(60), *[[r[names.index(c)] for r in rows[:60]] for c in kept]])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    rss = float(((y - full @ beta) ** 2).sum())
    errors = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss / 55)
    for at, term in enumerate(["(intercept)", *kept]):
        assert out[term].coefficient == pytest.approx(beta[at]) and out[term].std_error == pytest.approx(errors[at])
    one = out["a"]
    r2 = 1 - rss / float(((y - y.mean()) ** 2).sum())
    assert (one.n, one.dof) == (60, 55) and one.r2 == pytest.approx(r2) and one.sigma == pytest.approx(math.sqrt(rss / 55))
    assert one.f_statistic == pytest.approx(r2 / 4 / ((1 - r2) / 55)) and one.f_p_value < 1e-10


def test_regression_without_rows_or_freedom(spark):
    nothing = stats.regression(rows_of(spark, [(None, 1.0)], "x double, y double"), ["x"], "y").collect()
    assert [(r.term, r.coefficient, r.n) for r in nothing] == [("(intercept)", None, 0), ("x", None, 0)]
    two = {r.term: r for r in stats.regression(rows_of(spark, [(1.0, 2.0), (3.0, 8.0)], "x double, y double"), ["x"], "y").collect()}
    assert two["x"].coefficient == pytest.approx(3) and two["x"].std_error is None and two["x"].dof == 0
    flat = {r.term: r for r in stats.regression(rows_of(spark, [(1.0, 2.0)] * 3, "x double, y double"), ["x"], "y").collect()}
    assert flat["x"].aliased and flat["(intercept)"].coefficient == pytest.approx(2) and flat["x"].r2 is None


def test_contrasts_against_the_rest_with_step_up(spark):
    rng = random.Random(8)
    rows = [(g, rng.gauss(3 + (g == 2) * 2, 1)) for g in range(6) for _ in range(12)] + [(None, 1.0), (3, None), (9, 4.0)]
    df = rows_of(spark, rows, "g int, x double")
    out = {r.group: r for r in stats.group_contrasts(df, "g", "x").collect()}
    known = [(g, x) for g, x in rows if g is not None and x is not None]
    for g in range(6):
        a, b = (np.array([x for h, x in known if (h == g) == side]) for side in (True, False))
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        assert out[g].statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
        assert out[g].dof == pytest.approx((va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1)))
    assert out[9].statistic is None and out[9].significant is False
    assert out[2].significant
    ps = sorted(r.p_value for r in out.values() if r.p_value is not None)
    limit = max((p for i, p in enumerate(ps, 1) if p <= 0.05 * i / len(ps)), default=-1)
    assert all(r.significant == (r.p_value is not None and r.p_value <= limit) for r in out.values())


def test_step_up_shares_ranks_and_spreads(spark):
    ps = [0.001, 0.02, 0.02, 0.02, 0.2, None]
    df = rows_of(spark, [(i, p) for i, p in enumerate(ps)], "i int, p double")
    for cut in (None, 1):
        got = {r.i: r.significant for r in stats.step_up(df, "p", 0.05, rows_per_bucket=cut).collect()}
        # 0.02 has rank 4 of 5: 0.05 * 4 / 5 = 0.04
        assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def lowess_by_hand(x, y, share, points, rounds):
    lo, hi = x.min(), x.max()
    at = lo + (hi - lo) * np.arange(points) / (points - 1)
    k = int(share * len(x) + 1e-10)
    width = np.array([np.sort(np.abs(x - a))[k - 1] for a in at])
    robust = np.ones(len(x))
    for done in range(rounds + 1):
        fit = []
        for a, h in zip(at, width):
            d = x - a
            w = robust * np.where(np.abs(d) < h, (1 - (np.abs(d) / h) ** 3) ** 3, 0)
            s0, s1, s2, t0, t1 = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * y).sum(), (w * d * y).sum()
            fit.append((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1))
        off = np.abs(y - np.interp(x, at, fit))
        robust = np.clip(1 - (off / (6 * np.median(off))) ** 2, 0, None) ** 2
    return width, fit


def test_lowess_matches_plain_fits_also_in_buckets(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 10, 400), 1)
    y = np.sin(x) + rng.normal(0, 0.1, 400) + np.where(np.arange(400) % 20 == 0, 30, 0)
    df = rows_of(spark, [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double")
    width, fit = lowess_by_hand(x, y, 0.3, 9, 3)
    for cut in (None, 40):
        got = smoothing.lowess(df, "x", "y", 0.3, 9, 3, rows_per_bucket=cut).orderBy("i").collect()
        assert [r.width for r in got] == pytest.approx(list(width)) and [r.fit for r in got] == pytest.approx(fit)
    # the outliers do not draw the curve
    assert abs(got[4].fit - math.sin(5)) < 0.3


def test_lowess_edge_cases(spark):
    assert smoothing.lowess(rows_of(spark, [(None, 1.0)], "x double, y double"), "x", "y").collect() == []
    flat = smoothing.lowess(rows_of(spark, [(2.0, 1.0), (2.0, 3.0)], "x double, y double"), "x", "y").collect()
    assert [(r.i, r.x_at, r.fit) for r in flat] == [(0, 2.0, 2.0)]


def test_running_max_in_buckets(spark):
    rng = random.Random(1)
    values = [rng.choice([None, rng.randint(0, 99)]) for _ in range(50)]
    df = rows_of(spark, list(enumerate(values)), "i int, v int")
    want, top = [], None
    for v in values:
        top = v if top is None else top if v is None else max(top, v)
        want.append(top)
    for bucket in (None, F.floor(F.col("i") / 7)):
        got = ordering.running_max(df, [F.col("i")], "v", "m", bucket).orderBy("i").collect()
        assert [r.m for r in got] == want


def test_kernel_density_close_to_raw_sums_and_groups_without_spread(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 300)
    df = rows_of(spark, [("a", float(v)) for v in x] + [("flat", 5.0)] * 3 + [(None, 1.0), ("a", None)], "g string, x double")
    got = smoothing.kernel_density(df, "x", "g", 200).orderBy("i").collect()
    assert {r.group for r in got} == {"a"} and len(got) == 200
    h = 1.059 * min(x.std(ddof=1), (np.percentile(x, 75) - np.percentile(x, 25)) / 1.349) * 300 ** -0.2
    assert got[0].bandwidth == pytest.approx(h)
    raw = [np.exp(-0.5 * ((r.x_at - x) / h) ** 2).sum() / (300 * h * math.sqrt(2 * math.pi)) for r in got]
    assert max(abs(r.density - v) for r, v in zip(got, raw)) < 0.001
    assert smoothing.kernel_density(df.filter("g = 'flat'"), "x", "g").collect() == []


def test_kernel_heat_keeps_the_weight(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(w)) for a, b, w in zip(rng.normal(48, 0.02, 200), rng.normal(2, 0.03, 200), rng.integers(1, 9, 200))]
    df = rows_of(spark, [*rows, (None, 2.0, 5.0), (48.0, 2.0, None)], "a double, b double, w double")
    heat = smoothing.kernel_heat(df, "a", "b", "w", 0.002, reach=6.0).collect()
    assert sum(r.heat for r in heat) * 0.002 ** 2 == pytest.approx(sum(r[2] for r in rows), rel=1e-3)
    assert smoothing.kernel_heat(df.limit(0), "a", "b").collect() == []


def test_spearman_matrix_ranks_each_pair_on_its_own_rows(spark):
    rng = random.Random(6)
    rows = [tuple(rng.choice([None, float(rng.randint(0, 6))]) for _ in range(3)) for _ in range(150)] + [(None, None, None)]
    df = rows_of(spark, rows, "a double, b double, c double")

    def ranks(values):
        order = sorted(values)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in values]

    for cut in (None, 3):
        for r in stats.spearman_matrix(df, ["a", "b", "c"], rows_per_bucket=cut).collect():
            pairs = [(x["abc".index(r.x)], x["abc".index(r.y)]) for x in rows]
            pairs = [p for p in pairs if None not in p]
            want = np.corrcoef(ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs]))[0, 1]
            assert r.n == len(pairs) and r.spearman == pytest.approx(want)
            assert r.pearson == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])
