"""Distributions as column values, all native expressions.

A mixture is struct<k,d,weights,means,covs>: k components in d dimensions. A
histogram is struct<edges,weights>: edges per dimension, weights in row-major
order. A null or malformed value gives null, as an error does in a filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GMM = "struct<k:int,d:int,weights:array<double>,means:array<array<double>>,covs:array<array<array<double>>>>"
HIST = "struct<edges:array<array<double>>,weights:array<double>>"
#: erf to 1.5e-7 (Abramowitz and Stegun 7.1.26). Fixed values.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def phi(z: Column) -> Column:
    """Standard normal distribution function; absolute error below 1e-7."""
    p, a1, a2, a3, a4, a5 = ERF
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def parse_gmm(text: Column) -> Column:
    raw = F.from_json(text, "k int, d int, weights array<double>, means array<array<double>>, covariances array<array<array<double>>>")
    ok = (F.size(raw["weights"]) == raw["k"]) & (F.size(raw["means"]) == raw["k"]) & (F.size(raw["covariances"]) == raw["k"])
    return F.when(ok, F.struct(raw["k"].alias("k"), raw["d"].alias("d"), raw["weights"].alias("weights"), raw["means"].alias("means"), raw["covariances"].alias("covs")))


def format_gmm(g: Column) -> Column:
    return F.to_json(F.struct(g["k"].alias("k"), g["d"].alias("d"), g["weights"].alias("weights"), g["means"].alias("means"), g["covs"].alias("covariances")))


def parse_hist(text: Column) -> Column:
    raw = F.from_json(text, "bins array<double>, dimensions int, edges array<array<double>>, weights array<double>")
    edges = F.coalesce(raw["edges"], F.array(raw["bins"]))
    cells = F.aggregate(edges, F.lit(1), lambda n, e: n * (F.size(e) - 1))
    return F.when(F.size(raw["weights"]) == cells, F.struct(edges.alias("edges"), raw["weights"].alias("weights")))


def _gmm(k: Column, d: Column, weights: Column, means: Column, covs: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), d.cast("int").alias("d"), weights.alias("weights"), means.alias("means"), covs.alias("covs"))


def gaussian(mean: Column, std: Column) -> Column:
    return _gmm(F.lit(1), F.lit(1), F.array(F.lit(1.0)), F.array(F.array(mean)), F.array(F.array(F.array(std * std))))


def mixture(*parts: tuple[float, Column, Column]) -> Column:
    """One-dimensional mixture of (weight, mean, std)."""
    return _gmm(F.lit(len(parts)), F.lit(1), F.array(*[F.lit(float(w)) for w, _, _ in parts]), F.array(*[F.array(m) for _, m, _ in parts]), F.array(*[F.array(F.array(s * s)) for _, _, s in parts]))


def _components(g: Column) -> Column:
    return F.arrays_zip(g["weights"].alias("w"), g["means"].alias("m"), g["covs"].alias("c"))


def _total(g: Column, of) -> Column:
    """Sum over the components of of(weight, mean, cov)."""
    parts = F.zip_with(F.zip_with(g["means"], g["covs"], lambda m, c: F.struct(m.alias("m"), c.alias("c"))), g["weights"], lambda p, w: of(w, p["m"], p["c"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def _one(g: Column, value: Column) -> Column:
    return F.when(g["d"] == 1, value)


def cdf(g: Column, x: Column) -> Column:
    return _one(g, _total(g, lambda w, m, c: w * phi((x - m[0]) / F.sqrt(c[0][0]))))


def pdf(g: Column, x: Column) -> Column:
    return _one(g, _total(g, lambda w, m, c: w * F.exp(-(x - m[0]) * (x - m[0]) / (2 * c[0][0])) / F.sqrt(c[0][0] * (2 * math.pi))))


def logpdf(g: Column, x: Column) -> Column:
    parts = F.zip_with(F.zip_with(g["means"], g["covs"], lambda m, c: F.struct(m.alias("m"), c.alias("c"))), g["weights"], lambda p, w: F.ln(w) - (x - p["m"][0]) * (x - p["m"][0]) / (2 * p["c"][0][0]) - F.ln(p["c"][0][0] * (2 * math.pi)) / 2)
    top = F.array_max(parts)
    return _one(g, top + F.ln(F.aggregate(parts, F.lit(0.0), lambda a, b: a + F.exp(b - top))))


def logcdf(g: Column, x: Column) -> Column:
    return F.ln(cdf(g, x))


def confidence(g: Column, lo: Column, hi: Column) -> Column:
    return cdf(g, hi) - cdf(g, lo)


def mean(g: Column) -> Column:
    """Array of d means."""
    return F.transform(F.sequence(F.lit(0), g["d"] - 1), lambda i: _total(g, lambda w, m, c: w * m[i]))


def std(g: Column) -> Column:
    centre = mean(g)
    return F.transform(F.sequence(F.lit(0), g["d"] - 1), lambda i: F.sqrt(_total(g, lambda w, m, c: w * (c[i][i] + m[i] * m[i])) - centre[i] * centre[i]))


def mode_count(g: Column) -> Column:
    return g["k"]


def linear(g: Column, a: Column, b: Column) -> Column:
    return _gmm(g["k"], g["d"], g["weights"], F.transform(g["means"], lambda m: F.transform(m, lambda v: v * a + b)), F.transform(g["covs"], lambda c: F.transform(c, lambda r: F.transform(r, lambda v: v * a * a))))


def scale(g: Column, a: Column) -> Column:
    return linear(g, a, F.lit(0.0))


def shift(g: Column, b: Column) -> Column:
    return linear(g, F.lit(1.0), b)


def marginal(g: Column, dim: Column) -> Column:
    return F.when((dim >= 0) & (dim < g["d"]), _gmm(g["k"], F.lit(1), g["weights"], F.transform(g["means"], lambda m: F.array(m[dim])), F.transform(g["covs"], lambda c: F.array(F.array(c[dim][dim])))))


def mix(g: Column, h: Column, w: Column) -> Column:
    return F.when(g["d"] == h["d"], _gmm(g["k"] + h["k"], g["d"], F.concat(F.transform(g["weights"], lambda x: x * w), F.transform(h["weights"], lambda x: x * (1 - w))), F.concat(g["means"], h["means"]), F.concat(g["covs"], h["covs"])))


def _pairs(g: Column, h: Column, of) -> Column:
    return F.flatten(F.transform(_components(g), lambda a: F.transform(_components(h), lambda b: of(a, b))))


def _paired(g: Column, h: Column, of) -> Column:
    """One-dimensional mixture over all pairs of components; of gives weight, mean, variance."""
    parts = _pairs(g, h, lambda a, b: F.struct(*[v.alias(n) for v, n in zip(of(a["w"], a["m"][0], a["c"][0][0], b["w"], b["m"][0], b["c"][0][0]), "wmv", strict=True)]))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"])
    return F.when((g["d"] == 1) & (h["d"] == 1), _gmm(g["k"] * h["k"], F.lit(1), F.transform(parts, lambda p: p["w"] / total), F.transform(parts, lambda p: F.array(p["m"])), F.transform(parts, lambda p: F.array(F.array(p["v"])))))


def convolve(g: Column, h: Column) -> Column:
    """Distribution of the sum of independent variables."""
    return _paired(g, h, lambda w, m, v, x, n, u: (w * x, m + n, v + u))


def multiply(g: Column, h: Column) -> Column:
    """Distribution of the product of independent variables, moments matched per pair."""
    return _paired(g, h, lambda w, m, v, x, n, u: (w * x, m * n, m * m * u + n * n * v + v * u))


def fuse(g: Column, h: Column) -> Column:
    """Normalised product of the densities."""
    return _paired(g, h, lambda w, m, v, x, n, u: (w * x * F.exp(-(m - n) * (m - n) / (2 * (v + u))) / F.sqrt(2 * math.pi * (v + u)), (m * u + n * v) / (v + u), v * u / (v + u)))


def joint(g: Column, h: Column) -> Column:
    """Independent joint distribution: block-diagonal covariances."""
    pad = lambda rows, before, after: F.transform(rows, lambda r: F.concat(F.array_repeat(F.lit(0.0), before), r, F.array_repeat(F.lit(0.0), after)))
    parts = _pairs(g, h, lambda a, b: F.struct((a["w"] * b["w"]).alias("w"), F.concat(a["m"], b["m"]).alias("m"), F.concat(pad(a["c"], F.lit(0), h["d"]), pad(b["c"], g["d"], F.lit(0))).alias("c")))
    return _gmm(g["k"] * h["k"], g["d"] + h["d"], F.transform(parts, lambda p: p["w"]), F.transform(parts, lambda p: p["m"]), F.transform(parts, lambda p: p["c"]))


def quantile(g: Column, q: Column, steps: int = 40) -> Column:
    """Bisection on the distribution function, within 12 standard deviations of the means."""
    spread = lambda sign: F.aggregate(F.zip_with(g["means"], g["covs"], lambda m, c: m[0] + sign * 12 * F.sqrt(c[0][0])), F.lit(None).cast("double"), lambda a, b: F.least(a, b) if sign < 0 else F.greatest(a, b))
    start = F.struct(spread(-1).alias("lo"), spread(1).alias("hi"))
    halve = lambda s, _: F.when(cdf(g, (s["lo"] + s["hi"]) / 2) < q, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
    return F.when((q > 0) & (q < 1), _one(g, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)))


def map_estimate(g: Column) -> Column:
    """The component mean of highest density; exact for one component."""
    rated = F.transform(g["means"], lambda m: F.struct(pdf(g, m[0]).alias("p"), (-m[0]).alias("tie"), m.alias("m")))
    return F.when(g["k"] == 1, g["means"][0]).otherwise(F.array_max(rated)["m"])


def kl_gaussian(g: Column, h: Column) -> Column:
    """Kullback-Leibler divergence of single one-dimensional Gaussians, in nats; null for mixtures."""
    m, n, v, u = g["means"][0][0], h["means"][0][0], g["covs"][0][0][0], h["covs"][0][0][0]
    return F.when((g["k"] == 1) & (h["k"] == 1) & (g["d"] == 1) & (h["d"] == 1), (F.ln(u / v) + (v + (m - n) * (m - n)) / u - 1) / 2)


def hellinger_gaussian(g: Column, h: Column) -> Column:
    m, n, v, u = g["means"][0][0], h["means"][0][0], g["covs"][0][0][0], h["covs"][0][0][0]
    return F.when((g["k"] == 1) & (h["k"] == 1), F.sqrt(1 - F.sqrt(2 * F.sqrt(v * u) / (v + u)) * F.exp(-(m - n) * (m - n) / (4 * (v + u)))))


def bhattacharyya_gaussian(g: Column, h: Column) -> Column:
    m, n, v, u = g["means"][0][0], h["means"][0][0], g["covs"][0][0][0], h["covs"][0][0][0]
    return F.when((g["k"] == 1) & (h["k"] == 1), (m - n) * (m - n) / (4 * (v + u)) + F.ln((v + u) / (2 * F.sqrt(v * u))) / 2)


def wasserstein_gaussian(g: Column, h: Column) -> Column:
    """Wasserstein-2 distance of single one-dimensional Gaussians."""
    m, n, v, u = g["means"][0][0], h["means"][0][0], g["covs"][0][0][0], h["covs"][0][0][0]
    return F.when((g["k"] == 1) & (h["k"] == 1), F.sqrt((m - n) * (m - n) + (F.sqrt(v) - F.sqrt(u)) * (F.sqrt(v) - F.sqrt(u))))


#: Nodes and weights of five-point Gauss-Legendre quadrature on (-1, 1). Fixed values.
GAUSS = ((0.0, 0.5688888888888889), (-0.5384693101056831, 0.47862867049936647), (0.5384693101056831, 0.47862867049936647), (-0.906179845938664, 0.23692688505618908), (0.906179845938664, 0.23692688505618908))


def jsd(g: Column, h: Column) -> Column:
    """Jensen-Shannon divergence in nats of one-dimensional mixtures: quadrature on panels that end at whole deviations of every component, up to eight."""
    both = mix(g, h, F.lit(0.5))
    ends = F.flatten(F.zip_with(both["means"], both["covs"], lambda m, c: F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda k: m[0] + k * F.sqrt(c[0][0]))))
    ends = F.array_sort(F.array_distinct(ends))

    def at(x: Column) -> Column:
        p, q = pdf(g, x), pdf(h, x)
        term = lambda a: F.when(a > 0, a * F.ln(2 * a / (p + q))).otherwise(0.0)
        return (term(p) + term(q)) / 2

    def panel(b: Column, i: Column) -> Column:
        half = (b - ends[i]) / 2
        node = lambda n: at(ends[i] + half + half * n["x"]) * n["w"]
        return half * F.aggregate(F.transform(nodes, node), F.lit(0.0), lambda a, c: a + c)

    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in GAUSS])
    panels = F.transform(F.slice(ends, F.lit(2), F.size(ends) - 1), panel)
    return _one(g, F.aggregate(panels, F.lit(0.0), lambda a, b: a + b))


def hist_mean(h: Column) -> Column:
    """Mean of a one-dimensional histogram."""
    e, total = h["edges"][0], F.aggregate(h["weights"], F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(h["edges"]) == 1, F.aggregate(F.transform(h["weights"], lambda w, i: w / total * (e[i] + e[i + 1]) / 2), F.lit(0.0), lambda a, b: a + b))


def hist_cdf(h: Column, x: Column) -> Column:
    """P(X <= x) of a one-dimensional histogram, linear within bins."""
    e, total = h["edges"][0], F.aggregate(h["weights"], F.lit(0.0), lambda a, b: a + b)
    share = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - e[i]) / (e[i + 1] - e[i])))
    return F.when(F.size(h["edges"]) == 1, F.aggregate(F.transform(h["weights"], lambda w, i: w / total * share(i)), F.lit(0.0), lambda a, b: a + b))


def hist_pdf(h: Column, x: Column) -> Column:
    e, total = h["edges"][0], F.aggregate(h["weights"], F.lit(0.0), lambda a, b: a + b)
    inside = lambda w, i: F.when((x >= e[i]) & ((x < e[i + 1]) | ((x == e[i + 1]) & (i == F.size(h["weights"]) - 1))), w / total / (e[i + 1] - e[i])).otherwise(0.0)
    return F.when(F.size(h["edges"]) == 1, F.aggregate(F.transform(h["weights"], inside), F.lit(0.0), lambda a, b: a + b))


def weights_jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats of two weight arrays over the same cells."""
    sp, sq = (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in (p, q))

    def cell(a: Column, b: Column) -> Column:
        a, b = a / sp, b / sq
        m = (a + b) / 2
        term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
        return (term(a) + term(b)) / 2

    return F.aggregate(F.zip_with(p, q, cell), F.lit(0.0), lambda a, b: a + b)


def hist_jsd(g: Column, h: Column) -> Column:
    return F.when(g["edges"] == h["edges"], weights_jsd(g["weights"], h["weights"]))
