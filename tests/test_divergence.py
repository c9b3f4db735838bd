"""Divergence joins against all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.operators import divergence as V


def _side(spark, rows, key, name):
    return spark.createDataFrame(rows, f"{key} int, k int, g string").select(key, "k", D.parse_gmm(F.col("g")).alias(name))


def _text(parts, d=1):
    k = len(parts)
    means = [[m] * d for _, m, _ in parts]
    covs = [[[s * s if i == j else 0.0 for j in range(d)] for i in range(d)] for _, _, s in parts]
    return f'{{"k":{k},"d":{d},"weights":{[w for w, _, _ in parts]},"means":{means},"covariances":{covs}}}'


def _mixtures(n, seed):
    draw = random.Random(seed)
    made = []
    for _ in range(n):
        k = draw.choice([1, 1, 2])
        made.append([(1 / k, draw.uniform(-20, 20), 10 ** draw.uniform(-2, 1.5)) for _ in range(k)])
    return made


def _exact(a, b):
    return float(V._flat_jsd(*(np.array([x], float) for x in (*zip(*a, strict=True), *zip(*b, strict=True))))[0])


def _density(x, w, m, s):
    z = (x[:, None] - m) / s
    return (np.exp(-z * z / 2) / (s * math.sqrt(2 * math.pi))) @ w


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.3, 0.65])
def test_divjoin_finds_all_pairs(spark, tolerance):
    a, b = _mixtures(60, 1), _mixtures(50, 2) + _mixtures(60, 1)[:5]
    left = _side(spark, [*((i, i % 2, _text(x)) for i, x in enumerate(a)), (900, 0, None), (901, 0, "{}")], "u", "x")
    right = _side(spark, [*((i, i % 2, _text(x)) for i, x in enumerate(b)), (900, 0, None)], "v", "y").drop("k")
    pairs, seen = V.divjoin(left, right, "x", "y", tolerance)
    got = sorted((r.u, r.v) for r in pairs.select("u", "v").collect())
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)) if _exact(x, y) <= tolerance)
    assert got == want
    assert seen.get["metPairs"] == seen.get["prunedDim"] + seen.get["prunedMean"] + seen.get["prunedVariance"] + seen.get["fullJSD"] and 0 <= V.pruning_rate(seen.get, 60, 55) <= 1
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_crowded_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)
    a = [[(1.0, 0.0, 1.0)]] * 20 + _mixtures(10, 5)
    rows = [(i, 0, _text(x)) for i, x in enumerate(a)]
    pairs, _ = V.divjoin(_side(spark, rows, "u", "x").drop("k"), _side(spark, rows, "v", "y").drop("k"), "x", "y", 0.1)
    assert sorted((r.u, r.v) for r in pairs.collect()) == sorted((i, j) for i, j in itertools.product(range(30), repeat=2) if _exact(a[i], a[j]) <= 0.1)


def test_divjoin_keys_and_empty(spark):
    a = _mixtures(40, 3)
    rows = [(i, i % 3, _text(x)) for i, x in enumerate(a)]
    pairs, _ = V.divjoin(_side(spark, rows, "u", "x"), _side(spark, rows, "v", "y"), "x", "y", 0.2, keys=["k"])
    want = sorted((i, j) for i, j in itertools.product(range(40), repeat=2) if i % 3 == j % 3 and _exact(a[i], a[j]) <= 0.2)
    assert sorted((r.u, r.v) for r in pairs.collect()) == want
    none = V.divjoin(_side(spark, [], "u", "x"), _side(spark, rows, "v", "y").drop("k"), "x", "y", 0.2)[0]
    assert none.count() == 0
    assert V.divjoin(_side(spark, rows[:5], "u", "x"), _side(spark, rows[:4], "v", "y").drop("k"), "x", "y", 1.0)[0].count() == 20


def test_several_dimensions(spark):
    rows = [(0, 0, _text([(1.0, 0.0, 1.0)], 2)), (1, 0, _text([(1.0, 0.1, 1.0)], 2)), (2, 0, _text([(1.0, 9.0, 1.0)], 2)), (3, 0, _text([(1.0, 0.0, 1.0)]))]
    pairs, _ = V.divjoin(_side(spark, rows, "u", "x"), _side(spark, rows, "v", "y").drop("k"), "x", "y", 0.05)
    assert sorted((r.u, r.v) for r in pairs.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3)]
    one = np.array([1.0])
    far = V._sampled_jsd(one, np.zeros(2), np.eye(2).ravel(), one, np.full(2, 50.0), np.eye(2).ravel())
    assert math.isclose(far, math.log(2), abs_tol=1e-6)


def test_total_variation_bound():
    assert V._total_variation(0.0) < 1e-6 and V._total_variation(math.log(2)) > 0.999


def test_quadrature_resolves_scales(spark):
    """A narrow beside a wide component: against a fine sum, and the native expression against the kernel."""
    a, b = [(0.5, 1.0, 0.01), (0.5, 3.0, 20.0)], [(1.0, 2.0, 25.0)]
    at = np.unique(np.concatenate([np.linspace(-250, 250, 400_001), np.linspace(0.9, 1.1, 100_001)]))
    p, q = (_density(at, *(np.array(x, float) for x in zip(*m, strict=True))) for m in (a, b))
    want = np.trapezoid((np.where(p > 0, p * np.log(np.maximum(p, 1e-300) * 2 / (p + q + 1e-300)), 0) + np.where(q > 0, q * np.log(np.maximum(q, 1e-300) * 2 / (p + q + 1e-300)), 0)) / 2, at)
    assert math.isclose(_exact(a, b), want, abs_tol=1e-5)
    df = spark.createDataFrame([(_text(a), _text(b))], "a string, b string").select(D.jsd(D.parse_gmm(F.col("a")), D.parse_gmm(F.col("b"))).alias("j"))
    assert math.isclose(df.first().j, want, abs_tol=1e-4)


def _pairs_within(a, b, tolerance):
    return sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)) if _exact(x, y) <= tolerance)


def _normals(n, seed):
    draw = random.Random(seed)
    return [[(1.0, draw.gauss(50, 6) * scale, draw.gauss(49, 8) * scale)] for scale in (1e-6, 1.0, 1.0, 1e5) for _ in range(n)]


@pytest.mark.parametrize("tolerance", [0.0005, 0.002, 0.005])
def test_near_normals_join_without_python(spark, monkeypatch, tolerance):
    monkeypatch.setattr(V, "BLOCK", 7)
    a, b = _normals(40, 8), _normals(30, 9) + _normals(40, 8)[::3] * 2
    left, right = (_side(spark, [*((i, i % 2, _text(x)) for i, x in enumerate(v)), (900, 0, None), (901, 0, "{}")], key, name) for v, key, name in ((a, "u", "x"), (b, "v", "y")))
    want = _pairs_within(a, b, tolerance)
    pairs, seen = V.divjoin(left, right.drop("k"), "x", "y", tolerance)
    got = pairs.select("u", "v", "jsd").collect()
    assert sorted((r.u, r.v) for r in got) == want
    assert all(math.isclose(r.jsd, _exact(a[r.u], b[r.v]), abs_tol=1e-12) for r in got)
    assert seen.get["metPairs"] == seen.get["prunedMean"] + seen.get["prunedVariance"] + seen.get["fullJSD"] and seen.get["resultCount"] == len(want)
    plan = pairs._jdf.queryExecution().toString()
    assert not any(n in plan for n in ("ArrowEvalPython", "NestedLoop", "Cartesian"))
    keyed, none = V.divjoin(left, right, "x", "y", tolerance, keys=["k"], on=F.col("u") < F.col("v"), observed=False)
    assert none is None and sorted((r.u, r.v) for r in keyed.collect()) == [(i, j) for i, j in want if i % 2 == j % 2 and i < j]


def test_near_normals_beside_mixtures(spark):
    a = _normals(10, 4) + [[(0.5, m, s), (0.5, m + s / 50, s)] for [(_, m, s)] in _normals(10, 4)] + [[(1.0, 50.0, 1e-120)]] * 2
    sides = [_side(spark, [*((i, 0, _text(x)) for i, x in enumerate(a)), (800, 0, _text([(1.0, 0.0, 1.0)], 2)), (900, 0, None)], key, name).drop("k") for key, name in (("u", "x"), ("v", "y"))]
    pairs, seen = V.divjoin(*sides, "x", "y", 0.002)
    assert sorted((r.u, r.v) for r in pairs.collect()) == sorted([*_pairs_within(a, a, 0.002), (800, 800)])
    assert seen.get["metPairs"] == seen.get["prunedDim"] + seen.get["prunedMean"] + seen.get["prunedVariance"] + seen.get["fullJSD"]


def test_curve_of_normals():
    """Beyond the box no pair is within the tolerance; within it the divergence grows both ways, as the box's sides suppose."""
    assert V._curve(0.0) is None and V._curve(0.3) is None
    for tolerance in (1e-5, 0.002):
        top, high, _ = V._curve(tolerance)
        at = np.array([(p, q) for p in np.geomspace(1e-3, 1e6, 60) for q in np.geomspace(1e-3, 1e4, 60)])
        jsd = V._normal_jsd(at[:, 0] * top, np.minimum(at[:, 1] * high, 400))
        assert (jsd[(at > 1).any(1)] > tolerance).all()
        b = -math.log1p(-2 * tolerance)
        steps = np.linspace(0, 1, 30)
        grid = V._normal_jsd(*(v.ravel() for v in np.meshgrid(steps * 8 * b, steps * math.acosh(math.exp(2 * b)) ** 2, indexing="ij"))).reshape(30, 30)
        assert (np.diff(grid, axis=0) > 0).all() and (np.diff(grid, axis=1) > 0).all()


def test_rounded_as_round_does(spark):
    from quillon.plans.catalog import _rounded

    x = spark.range(40_001).select((F.col("id") / 20_000_000.0).alias("x")).unionByName(spark.range(400).select((F.col("id") / 20_000.0).alias("x")))
    assert x.where(~_rounded(F.col("x"), 4).eqNullSafe(F.round("x", 4))).count() == 0
