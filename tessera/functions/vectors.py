"""Vector and embedding-model scores on array columns. Sums are in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    # The norm is bound once; inside the inner lambda it would be summed for each element.
    return F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(doubles(a), lambda x: x / n))[0]


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def transe(h, r, t, p: int = 1) -> Column:
    gap = F.zip_with(F.zip_with(doubles(h), doubles(r), lambda x, y: x + y), doubles(t), lambda x, y: x - y)
    return total(F.transform(gap, F.abs)) if p == 1 else F.sqrt(total(F.transform(gap, lambda x: x * x)))


def distmult(h, r, t) -> Column:
    return total(F.zip_with(F.zip_with(doubles(h), doubles(r), lambda x, y: x * y), doubles(t), lambda x, y: x * y))


def _halves(a, n: int):
    return F.slice(doubles(a), 1, n // 2), F.slice(doubles(a), n // 2 + 1, n // 2)


def _three(a, b, c) -> Column:
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: x * y), c, lambda x, y: x * y))


def complex_score(h, r, t, n: int) -> Column:
    """Real part of <h, r, conj(t)>; arrays of n hold the real parts, then the imaginary ones."""
    (hr, hi), (rr, ri), (tr, ti) = _halves(h, n), _halves(r, n), _halves(t, n)
    return _three(hr, rr, tr) + _three(hi, rr, ti) + _three(hr, ri, ti) - _three(hi, ri, tr)


def transh(h, r, t, w) -> Column:
    """L1 gap of the projections on the hyperplane of normal w."""
    unit = l2_normalize(w)
    on = lambda x: F.transform(F.array(dot(x, unit)), lambda s: F.zip_with(doubles(x), unit, lambda a, b: a - s * b))[0]
    return transe(on(h), r, on(t))


def rotate(h, r, t, n: int) -> Column:
    """Summed distance of h turned by the phases in the first half of r from t; real parts first, then imaginary ones."""
    (hr, hi), (phase, _), (tr, ti) = _halves(h, n), _halves(r, n), _halves(t, n)
    turned = lambda a, b, sign: F.zip_with(F.zip_with(a, phase, lambda x, p: x * F.cos(p)), F.zip_with(b, phase, lambda x, p: x * F.sin(p)), lambda x, y: x + sign * y)
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return total(F.transform(F.zip_with(gap(turned(hr, hi, -1.0), tr), gap(turned(hi, hr, 1.0), ti), lambda x, y: x + y), F.sqrt))


def hole(h, r, t, n: int) -> Column:
    """r with the circular correlation of h and t."""
    shifted = lambda k: F.concat(F.slice(doubles(t), k + 1, n - k), F.slice(doubles(t), F.lit(1), k))
    return total(F.transform(doubles(r), lambda x, k: x * dot(h, shifted(k))))


def analogy(h, r, t, n: int) -> Column:
    """Half of it as DistMult, half as ComplEx."""
    first, second = zip(*[_halves(x, n) for x in (h, r, t)])
    return distmult(*first) + complex_score(*second, n // 2)


def project(x, m, rows: int, cols: int) -> Column:
    """x (rows) times the matrix m, kept row by row in one array."""
    at = lambda j: total(F.transform(F.slice(doubles(x), 1, rows), lambda v, i: v * F.element_at(doubles(m), i * cols + j + 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), at)


def transr(h, r, t, m, n: int) -> Column:
    """L1 gap after both ends are moved into the relation's space of n dimensions."""
    return transe(project(h, m, n, n), F.slice(doubles(r), 1, n), project(t, m, n, n))


def transd(h, r, t, hp, rp, tp) -> Column:
    """L1 gap after each end is moved along rp by its own product with its transfer vector, and normalised."""
    moved = lambda x, p: l2_normalize(F.transform(F.array(dot(x, p)), lambda s: F.zip_with(doubles(x), doubles(rp), lambda a, b: a + s * b))[0])
    return transe(moved(h, hp), r, moved(t, tp))


def rescal(h, m, t, n: int) -> Column:
    return -total(F.zip_with(project(h, m, n, n), F.slice(doubles(t), 1, n), lambda a, b: a * b))


def simple(h, r, inverse, t) -> Column:
    """The mean of the products with a relation and with its inverse."""
    return (distmult(h, r, t) + distmult(h, inverse, t)) / 2


def trend(mean, slope: float, direction, amplitude, frequency, at: float) -> Column:
    """The mean of an embedding that drifts and swings in time: mean + at * slope * direction + amplitude * sin(2 pi frequency at)."""
    swing = F.zip_with(doubles(amplitude), doubles(frequency), lambda a, w: a * F.sin(w * (2 * math.pi * at)))
    return F.zip_with(F.zip_with(doubles(mean), doubles(direction), lambda m, x: m + x * (at * slope)), swing, lambda a, b: a + b)


def gaussian_divergence(h, r, t, h_var, r_var, t_var) -> Column:
    """Both Kullback-Leibler divergences between the normal distributions of h - t and r, with diagonal variances, over 4."""
    gap = F.zip_with(F.zip_with(doubles(h), doubles(t), lambda a, b: a - b), doubles(r), lambda a, b: (a - b) * (a - b))
    both = F.zip_with(doubles(h_var), doubles(t_var), lambda a, b: a + b)
    terms = F.zip_with(F.arrays_zip(gap.alias("g"), both.alias("e")), doubles(r_var), lambda x, v: x["e"] / v + x["g"] / v + v / x["e"] + x["g"] / x["e"] - 2)
    return total(terms) / 4


def tero(h, r, t, angle, dim: int) -> Column:
    """Temporal rotation: entities (real half, imaginary half) are turned by the time's angles; |h + r - conj(t)| in L1."""
    half = dim // 2
    cols = {"h": doubles(h), "r": doubles(r), "t": doubles(t)}
    parts = [p.alias(f"{k}{s}") for k, c in cols.items() for s, p in (("r", F.slice(c, 1, half)), ("i", F.slice(c, half + 1, half)))]

    def term(x, a):
        cos, sin = F.cos(a), F.sin(a)
        real = (x["hr"] * cos - x["hi"] * sin) + x["rr"] - (x["tr"] * cos - x["ti"] * sin)
        imaginary = (x["hr"] * sin + x["hi"] * cos) + x["ri"] + (x["tr"] * sin + x["ti"] * cos)
        return F.abs(real) + F.abs(imaginary)

    return total(F.zip_with(F.arrays_zip(*parts), F.slice(doubles(angle), 1, half), term))
