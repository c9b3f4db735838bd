"""Joins on divergence of distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.functions import distributions as D

REACH, SAMPLES, SEED = 8, 10_000, 20_240
#: Left rows of a grid cell that are met in one task.
BLOCK = 512
NODES = np.polynomial.legendre.leggauss(8)
#: Greatest error and degree of the polynomial that stands for the divergence of near normal distributions.
EXACT, DEGREE = 1e-13, 10


def hist_divjoin(left: DataFrame, right: DataFrame, lvar: str, rvar: str, tolerance: float, strict: bool = False) -> DataFrame:
    """Pairs whose histograms have a Jensen-Shannon divergence of at most `tolerance` (below it, if strict), with column jsd. A theta join: histograms of different edges never pair, so it is keyed by the edges."""
    keyed = left.withColumn("__e", F.col(lvar)["edges"]).join(right.withColumn("__e", F.col(rvar)["edges"]), "__e").drop("__e")
    jsd = D.weights_jsd(F.col(lvar)["weights"], F.col(rvar)["weights"])
    rated = keyed.withColumn("jsd", jsd)
    return rated.where(F.col("jsd") < tolerance if strict else F.col("jsd") <= tolerance)


def _below(x: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Mixture distribution function: rows of x against rows of w, m, s."""
    p, a1, a2, a3, a4, a5 = D.ERF
    z = (x[:, :, None] - m[:, None, :]) / s[:, None, :]
    t = 1 / (1 + p * np.abs(z) / math.sqrt(2))
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * np.exp(-z * z / 2)
    return (np.where(z >= 0, 1 - tail / 2, tail / 2) * w[:, None, :]).sum(2)


def _term(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What cells of masses p and q add to the divergence."""
    p, q = np.maximum(p, 0), np.maximum(q, 0)
    mid = np.maximum((p + q) / 2, 1e-300)
    return (p * np.log(np.maximum(p, 1e-300) / mid) + q * np.log(np.maximum(q, 1e-300) / mid)) / 2


def _verdicts(w, m, s, x, n, t, tolerance: float) -> np.ndarray:
    """1 or 2 where a sound bound rejects the pair, else 0.

    By data processing, the divergence of the masses between cuts bounds the
    full one from below: 1 (mean) for the cut at the middle of the means, 2
    (variance) for three cuts a mean deviation apart.
    """
    c, d = (w * m).sum(1), (x * n).sum(1)
    step = np.sqrt(np.maximum((w * (s * s + m * m)).sum(1) - c * c, 0)) + np.sqrt(np.maximum((x * (t * t + n * n)).sum(1) - d * d, 0))
    cuts = ((c + d) / 2)[:, None] + np.array([-0.5, 0.0, 0.5]) * step[:, None]
    p, q = _below(cuts, w, m, s), _below(cuts, x, n, t)
    mean = _term(p[:, 1], q[:, 1]) + _term(1 - p[:, 1], 1 - q[:, 1])
    ends = lambda v: np.diff(v, axis=1, prepend=0.0, append=1.0)
    return np.where(mean > tolerance + 1e-5, 1, np.where(_term(ends(p), ends(q)).sum(1) > tolerance + 1e-5, 2, 0))


def _total_variation(divergence: float) -> float:
    """The greatest total variation of two distributions of that Jensen-Shannon divergence in nats (at equality for two points with swapped weights)."""
    low, high = 0.0, 1.0
    for _ in range(60):
        v = (low + high) / 2
        least = (1 + v) / 2 * math.log1p(v) + ((1 - v) / 2 * math.log1p(-v) if v < 1 else 0.0)
        low, high = (v, high) if least <= divergence else (low, v)
    return high


def _interval(g: Column, z: float) -> tuple[Column, Column]:
    """An interval of the first dimension that leaves out at most the normal tail at -z on either side: quantiles of a mixture lie within those of its components."""
    ends = lambda sign: F.zip_with(g["means"], g["covs"], lambda m, c: m[0] + sign * z * F.sqrt(c[0][0]))
    return F.array_min(ends(-1)), F.array_max(ends(1))


def _gridded(side: DataFrame, var: str, z: float) -> DataFrame:
    """Adds __lo, __hi and __level: the least power of two that covers the interval. Rows of null or malformed values have no divergence and go."""
    lo, hi = _interval(F.col(var), z)
    wide = side.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi and not isnan(__hi) and abs(__lo) < 1e300 and abs(__hi) < 1e300")
    size = lambda x: F.ceil(F.log2(F.greatest(x, F.lit(1e-15))))
    return wide.withColumn("__level", F.greatest(size(F.col("__hi") - F.col("__lo")), size(F.greatest(F.abs("__lo"), F.abs("__hi"))) - 50).cast("int"))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _dealt(side: DataFrame, levels: list[int], owner: str) -> DataFrame:
    """One row per grid cell that the interval touches (one or two a level) at its own level and each wider level in use. Under the key of its owner a pair meets where that side's interval has its own level; under the other's key, where it is the narrower."""
    known = F.array(*[F.lit(x) for x in levels])
    here = side.withColumn("__at", F.explode(F.filter(known, lambda x: x >= F.col("__level"))))
    own = F.col("__at") == F.col("__level")
    first, last = _cell(F.col("__lo"), F.col("__at")), _cell(F.col("__hi"), F.col("__at"))
    roles = F.when(own, F.array(F.lit("left"))).otherwise(F.array(F.lit("right"))) if owner == "left" else F.when(own, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("left")))
    return here.withColumn("__role", F.explode(roles)).withColumn("__cell", F.explode(F.sequence(first, last))).drop("__level")


def _met(ours: DataFrame, there: DataFrame, names: list[str], left: DataFrame) -> DataFrame:
    """The equi-join of dealt sides with column __block. Crowded cells are met in blocks of left rows, each with all right rows of the cell, so that no cell is one task. A merge join that keeps the block's rows at hand: how often right rows are dealt is nothing Spark can foresee, so it might send them to all."""
    plain = [F.col(f"`{n}`") for n, t in left.dtypes if "map<" not in t]
    blocks = ours.groupBy(*names).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    ours = ours.join(blocks, names).withColumn("__block", F.pmod(F.xxhash64(*plain), F.col("__blocks")).cast("int")).drop("__blocks")
    there = there.join(blocks, names).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    names = [*names, "__block"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = there.repartition(parts, *names).hint("merge").join(ours.repartition(parts, *names), names)
    return met.select(*dict.fromkeys([*names, *ours.columns, *there.columns]))


def near_pairs(left: DataFrame, right: DataFrame, lvar: str, rvar: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Every pair whose divergence can be within the tolerance, each once: an equi-join over grid cells, not a product of the sides.

    A divergence of at most t bounds the total variation by v < 1; then
    intervals that leave out less than (1 - v) / 2 on either side must overlap.
    Intervals are dealt over grids of cells as wide as themselves (powers of
    two; the levels in use, at most a few hundred numbers, are read first).
    From ln 2 on every pair qualifies by definition and all pairs are returned.
    """
    if tolerance >= math.log(2):
        return left.join(right, keys, "inner") if keys else left.withColumn("__k", F.col(lvar)["d"]).join(right.withColumn("__k", F.col(rvar)["d"]), "__k").drop("__k")
    tail = (1 - _total_variation(max(tolerance, 0.0) + 1e-6)) / 2 * 0.99
    z = -NormalDist().inv_cdf(tail)
    a, b = _gridded(left, lvar, z), _gridded(right, rvar, z)
    levels = sorted(r["__level"] for r in a.select("__level").unionByName(b.select("__level")).distinct().collect())
    if not levels:
        levels = [0]
    names = [*(keys or []), "__role", "__at", "__cell"]
    ours, there = _dealt(a, levels, "left"), _dealt(b, levels, "right").withColumnsRenamed({"__lo": "__lo2", "__hi": "__hi2"})
    met = _met(ours, there, names, left)
    begin = F.greatest("__lo", "__lo2")
    once = (begin <= F.least("__hi", "__hi2")) & (_cell(begin, F.col("__at")) == F.col("__cell"))
    return met.where(once).drop("__lo", "__hi", "__lo2", "__hi2", "__at", "__role", "__cell", "__block")


def _parameters(name: str) -> list[Column]:
    g = F.col(name)
    return [g["weights"], F.flatten(g["means"]), F.when(g["d"] == 1, F.transform(g["covs"], lambda c: F.sqrt(c[0][0]))).otherwise(F.flatten(F.flatten(g["covs"])))]


def _flat_jsd(w, m, s, x, n, t) -> np.ndarray:
    """Gauss-Legendre quadrature, row by row, on panels that end at whole deviations of every component, so that narrow components beside wide ones count in full."""
    both, dev = np.concatenate([m, n], 1), np.concatenate([s, t], 1)
    ends = np.sort((both[:, :, None] + np.arange(-REACH, REACH + 1) * dev[:, :, None]).reshape(len(m), -1), 1)
    half = np.diff(ends, axis=1)[:, :, None] / 2
    at = (ends[:, :-1, None] + half + half * NODES[0]).reshape(len(m), -1)
    p, q = np.zeros_like(at), np.zeros_like(at)
    for out, *side in ((p, w, m, s), (q, x, n, t)):
        for a, b, c in zip(*(v.T for v in side), strict=True):
            z = (at - b[:, None]) / c[:, None]
            out += np.exp(-z * z / 2) * (a / (c * math.sqrt(2 * math.pi)))[:, None]
    return (_term(p, q) * (half * NODES[1]).reshape(len(m), -1)).sum(1)


def _log_density(at: np.ndarray, w, m, roots) -> np.ndarray:
    """Logarithm of a mixture's density at the rows of `at`; roots are the Cholesky factors."""
    parts = []
    for weight, centre, root in zip(w, m, roots, strict=True):
        z = np.linalg.solve(root, (at - centre).T)
        parts.append(math.log(max(weight, 1e-300)) - (z * z).sum(0) / 2 - np.log(np.diag(root)).sum() - len(centre) * math.log(2 * math.pi) / 2)
    return np.logaddexp.reduce(parts)


def _sampled_jsd(w, m, c, x, n, u) -> float | None:
    """Jensen-Shannon divergence in several dimensions over SAMPLES draws of a fixed seed from either side; null where a covariance isn't positive definite."""
    d = len(m) // len(w)
    sides = [(a / a.sum(), b.reshape(-1, d), k.reshape(-1, d, d)) for a, b, k in ((w, m, c), (x, n, u))]
    try:
        sides = [(a, b, np.linalg.cholesky(k)) for a, b, k in sides]
    except np.linalg.LinAlgError:
        return None
    total = 0.0
    for a, b, roots in sides:
        draw = np.random.default_rng(SEED)
        part = draw.choice(len(a), SAMPLES, p=a)
        at = b[part] + np.einsum("nij,nj->ni", roots[part], draw.standard_normal((SAMPLES, d)))
        p, q = (_log_density(at, *side) for side in sides)
        total += float((_log_density(at, a, b, roots) - np.logaddexp(p, q) + math.log(2)).mean()) / 2
    return min(max(total, 0.0), math.log(2))


def _rated(rows: list[tuple[np.ndarray, ...]], tolerance: float) -> list[tuple[str | None, float | None]]:
    """(what rejected the pair, divergence) of pairs of one-dimensional mixtures that have equal numbers of components."""
    parts = [np.stack(v) for v in zip(*rows, strict=True)]
    told = _verdicts(*parts, tolerance)
    jsd = np.full(len(rows), np.nan)
    step = max(1, 250_000 // (parts[0].shape[1] + parts[3].shape[1]) // (2 * REACH * 8))
    left = np.flatnonzero(told == 0)
    for at in (left[i : i + step] for i in range(0, len(left), step)):
        jsd[at] = _flat_jsd(*(v[at] for v in parts))
    return [(("mean", "variance")[v - 1], None) if v else (None, float(j)) for v, j in zip(told, jsd, strict=True)]


def rating(tolerance: float):
    """Pandas UDF of weights, flat means and deviations or flat covariances of two mixtures: the bound that rejects the pair at this tolerance, else the divergence in nats, by quadrature in one dimension, from seeded draws in more. Sides of different dimension are rejected; null parts and deviations of zero give null."""

    @F.pandas_udf(StructType([StructField("pruned", StringType()), StructField("jsd", DoubleType())]))
    def rate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            out: list[tuple[str | None, float | None]] = [(None, None)] * len(cols[0])
            alike: dict[tuple[int, int], list[tuple[int, tuple]]] = {}
            for i, row in enumerate(zip(*cols, strict=True)):
                if any(v is None for v in row):
                    continue
                w, m, s, x, n, t = parts = tuple(np.asarray(v, float) for v in row)
                if len(m) * len(x) != len(n) * len(w):
                    out[i] = ("dim", None)
                elif len(m) > len(w):
                    out[i] = (None, _sampled_jsd(*parts))
                elif (s > 0).all() and (t > 0).all():
                    alike.setdefault((len(w), len(x)), []).append((i, parts))
            for found in alike.values():
                for (i, _), told in zip(found, _rated([p for _, p in found], tolerance), strict=True):
                    out[i] = told
            yield pd.DataFrame(out, columns=["pruned", "jsd"])

    return rate


def _normal_jsd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Divergence of two normal distributions of which (m - n)^2 / (s t) = x and ln(t / s)^2 = y: these two decide it."""
    one, root = np.ones((len(x), 1)), np.sqrt(y)[:, None]
    return _flat_jsd(one, 0 * one, np.exp(-root / 2), one, np.sqrt(x)[:, None], np.exp(root / 2))


@lru_cache(maxsize=16)
def _curve(tolerance: float) -> tuple[float, float, dict[tuple[int, int], float]] | None:
    """Greatest x and y (see _normal_jsd) of pairs of normal distributions within the tolerance, and the coefficients of a polynomial of x and y, in these units, that is within EXACT of their divergence; None for tolerances it can't serve.

    A divergence of at most t bounds the squared Hellinger distance by 2 t, and
    so x / (8 cosh ln(t / s)) + ln(cosh ln(t / s)) / 2 by b = -ln(1 - 2 t); for
    b < 1/2 then x <= 8 b. In that box the divergence grows with x and with y.
    """
    if not 1e-6 <= tolerance <= 0.02:
        return None
    b = -math.log1p(-2 * tolerance)
    tops = []
    for top, at in ((8 * b, lambda v: (v, 0.0)), (math.acosh(math.exp(2 * b)) ** 2, lambda v: (0.0, v))):
        low, high = 0.0, top
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _normal_jsd(*(np.array([v]) for v in at(mid)))[0] <= tolerance else (low, mid)
        tops.append(high * (1 + 1e-6))
    exact = lambda at: _normal_jsd(at[:, 0] * tops[0], at[:, 1] * tops[1])
    knots = (1 - np.cos(np.pi * (np.arange(16) + 0.5) / 16)) / 2
    known = np.array([(p, q) for p in knots for q in knots])
    tried = np.random.default_rng(SEED).random((2000, 2))
    want, held = exact(known), exact(tried)
    for degree in range(2, DEGREE + 1):
        powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j]
        terms = lambda at: np.stack([at[:, 0] ** i * at[:, 1] ** j for i, j in powers], 1)  # noqa: B023, E731
        found = np.linalg.lstsq(terms(known), want, rcond=None)[0]
        if max(np.abs(terms(known) @ found - want).max(), np.abs(terms(tried) @ found - held).max()) <= EXACT:
            return tops[0], tops[1], {k: float(v) for k, v in zip(powers, found, strict=True)}
    return None


def _is_normal(g: Column) -> Column:
    """Whether the value is one normal distribution in one dimension, of a mean and deviation that _normal_pairs can deal over cells."""
    first = lambda a: F.get(a, F.lit(0))
    mean, var = first(first(g["means"])), first(first(first(g["covs"])))
    one = (g["d"] == 1) & (first(g["weights"]) == 1.0)
    for a in (g["weights"], g["means"], g["covs"]):
        one = one & (F.size(a) == 1)
    return F.coalesce(one & var.between(1e-200, 1e200) & (F.abs(mean) <= 1e9 * F.sqrt(var)), F.lit(False))


def _normal_pairs(left: DataFrame, right: DataFrame, lvar: str, rvar: str, curve: tuple, keys: list[str], on: Column, observed: bool) -> DataFrame:
    """Pairs of normal distributions that share a cell and that `on` holds for, each once, with __cut (the bound that rejects the pair) and jsd, all native expressions; not `observed`, only pairs no bound rejects.

    Bands of the logarithm of the deviation, and in each cells of the mean, are
    as wide as pairs within the tolerance can lie apart; right rows go to the
    three bands and three cells that left rows near them are in.
    """
    wide, tall = math.sqrt(curve[0]), math.sqrt(curve[1])

    def placed(side: DataFrame, var: str, tag: str) -> DataFrame:
        g = F.col(var)
        values = {"m": g["means"][0][0], "i": F.pow(g["covs"][0][0][0], F.lit(-0.5)) / wide, "l": F.ln(g["covs"][0][0][0]) / (2 * tall)}
        return side.withColumns({f"__{k}{tag}": F.coalesce(v, F.lit(0.0)) for k, v in values.items()})  # never null here; so Spark knows

    cell = lambda mean: F.floor(F.col(mean) / (wide * F.exp((F.col("__band") + 1.5) * tall))).cast("long")
    near = lambda n: F.explode(F.sequence(n - 1, n + 1))
    ours = placed(left, lvar, "1").withColumn("__band", F.floor("__l1").cast("long")).withColumn("__cell", cell("__m1"))
    there = placed(right, rvar, "2").withColumn("__band", near(F.floor("__l2").cast("long"))).withColumn("__cell", near(cell("__m2")))
    met = _met(ours, there, [*keys, "__band", "__cell"], left).drop("__band", "__cell", "__block").where(on)
    gap, ratio = F.col("__m1") - F.col("__m2"), F.col("__l1") - F.col("__l2")
    x, y = gap * gap * (F.col("__i1") * F.col("__i2")), ratio * ratio
    if not observed:
        met = met.where((x <= 1) & (y <= 1))
    # An expression Spark must not move: else it writes x and y out at each of their places in the polynomial, and that in every condition, and such code is too long to be compiled.
    kept = lambda v: F.when(F.spark_partition_id() >= 0, v).otherwise(F.lit(0.0))
    met = met.withColumns({"__x": kept(x), "__y": kept(y)})
    x, y = F.col("__x"), F.col("__y")
    degree, jsd = max(i for i, _ in curve[2]), F.lit(0.0)
    for i in range(degree, -1, -1):
        inner = F.lit(0.0)
        for j in range(degree - i, -1, -1):
            c = F.lit(curve[2].get((i, j), 0.0))
            inner = c if j == degree - i else inner * y + c
        jsd = inner if i == degree else jsd * x + inner
    cut = F.when(x > 1, F.lit("mean")).when(y > 1, F.lit("variance")) if observed else F.lit(None).cast("string")
    rated = met.withColumns({"__cut": cut, "jsd": kept(F.greatest(jsd, F.lit(0.0)))})
    if observed:
        rated = rated.withColumn("jsd", F.when(F.col("__cut").isNull(), F.col("jsd")))
    return rated.drop("__x", "__y", *[f"__{k}{tag}" for k in "mil" for tag in "12"])


def divjoin(left: DataFrame, right: DataFrame, lvar: str, rvar: str, tolerance: float, strict: bool = False, keys: list[str] | None = None, on: Column | None = None, observed: bool = True) -> tuple[DataFrame, Observation | None]:
    """Pairs of mixtures whose Jensen-Shannon divergence is at most `tolerance`; shared `keys` make it an equi-join on those, and only pairs count for which `on` holds, if given. Overlap of central intervals selects the pairs that meet at all, then cheap bounds decide; the observation counts the pairs that met by what decided them (pairs that never met are pruned by the mean bound).

    At small tolerances pairs of single normal distributions are joined apart,
    without Python: two numbers decide their divergence. Counting every pair
    that met costs more than the divergence there; not `observed`, none is counted.
    """

    def general(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = [side.select("*", *[c.alias(f"__{tag}{i}") for i, c in enumerate(_parameters(var))]) for side, var, tag in ((left, lvar, "p"), (right, rvar, "q"))]
        parts = [f"__{tag}{i}" for tag in "pq" for i in range(3)]
        told = near_pairs(*sides, lvar, rvar, tolerance, keys).where(on).withColumn("__v", rating(tolerance)(*parts))
        return told.withColumn("__cut", F.col("__v.pruned")).withColumn("jsd", F.col("__v.jsd")).drop("__v", *parts)

    on, curve = F.lit(True) if on is None else on, _curve(tolerance)
    if curve is None:
        found = [general(left, right)]
    else:
        (mine, odd), (theirs, odd2) = ((side.where(_is_normal(F.col(var))), side.where(~_is_normal(F.col(var)) & F.col(var).isNotNull())) for side, var in ((left, lvar), (right, rvar)))
        found = [_normal_pairs(mine, theirs, lvar, rvar, curve, keys or [], on, observed)]
        if not odd.isEmpty():
            found.append(general(odd, right))
        if not odd2.isEmpty():
            found.append(general(mine, odd2))
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    seen = None
    if observed:
        seen, cut = Observation(), F.col("__cut")
        told = told.observe(seen, F.count("*").alias("metPairs"), F.count_if(cut == "dim").alias("prunedDim"), F.count_if(cut == "mean").alias("prunedMean"), F.count_if(cut == "variance").alias("prunedVariance"), F.count_if(cut.isNull()).alias("fullJSD"), F.count_if(F.col("jsd") <= tolerance).alias("resultCount"))
        _last[:] = [seen]
    rated = told.drop("__cut")
    return rated.where(F.col("jsd") < tolerance if strict else F.col("jsd") <= tolerance), seen


_last: list[Observation] = []


def last_stats() -> dict[str, float] | None:
    """Counts of the last divergence join that was planned, once it has run: of pairs that met by what decided them, of results, and the share of met pairs that needed no full divergence. Waits for the run; None if no join was planned."""
    if not _last:
        return None
    seen = dict(_last[-1].get)
    met = seen["metPairs"]
    return seen | {"totalPairs": met, "prunedVar": seen["prunedVariance"], "computedFullJSD": seen["fullJSD"], "pruningRate": (met - seen["fullJSD"]) / met if met else 0.0}


def pruning_rate(stats: dict[str, int], left: int, right: int) -> float:
    """Share of the left * right pairs that needed no full divergence; 0 when there are none."""
    total = left * right
    return (total - stats["fullJSD"]) / total if total else 0.0


def fusejoin(left: DataFrame, right: DataFrame, lvar: str, rvar: str, tolerance: float, out: str, keys: list[str] | None = None) -> DataFrame:
    """divjoin that binds the fused distribution to `out`."""
    return divjoin(left, right, lvar, rvar, tolerance, keys=keys)[0].withColumn(out, D.fuse(F.col(lvar), F.col(rvar)))


def exact_join(left: DataFrame, right: DataFrame, lvar: str, rvar: str) -> DataFrame:
    """Pairs of equal distributions: an equi-join on the values."""
    return left.join(right, F.to_json(F.col(lvar)) == F.to_json(F.col(rvar)))
