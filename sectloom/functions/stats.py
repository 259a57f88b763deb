"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Term frequency, saturating and normalised by document length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * saturation(tf, dl, avgdl, k1, b)


def xlogx(k: Column, expected: Column) -> Column:
    """k ln(k / expected), 0 for k = 0."""
    return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))


def g2(a: Column, row: Column, col: Column, n: Column) -> Column:
    """Log-likelihood ratio of a 2x2 table by its first cell and margins."""
    k11, k12, k21, k22 = a, row - a, col - a, n - row - col + a
    return 2 * (xlogx(k11, row * col / n) + xlogx(k12, row * (n - col) / n) + xlogx(k21, (n - row) * col / n) + xlogx(k22, (n - row) * (n - col) / n))


def npmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information; 0 if the pair is in everything."""
    return F.when(ab >= n, F.lit(0.0)).otherwise(F.log(ab * n / (a * b)) / -F.log(ab / n))


def ppmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Positive pointwise mutual information in bits; 0 if the pair is in everything."""
    return F.when(ab >= n, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log2(ab * n / (a * b))))


def residual_idf(df: Column, cf: Column, n: Column) -> Column:
    """Observed idf less that of a Poisson of the same mean, in bits."""
    return -F.log2(df / n) + F.log2(1 - F.exp(-cf / n))


def log_odds_z(count: Column, size: Column, total: Column, n: Column, mass: float, base: Column) -> Column:
    """z of a term's log odds in a group against the rest, with an informative prior of ``mass`` and
    share ``base``; 0 if there is no rest."""
    at, ao = F.lit(mass) * base, F.lit(mass) * (1 - base)
    oc, on = total - count, n - size
    d = F.log((count + at) / (size - count + ao)) - F.log((oc + at) / (on - oc + ao))
    v = 1 / (count + at) + 1 / (size - count + ao) + 1 / (oc + at) + 1 / (on - oc + ao)
    return F.when(on > 0, d / F.sqrt(v)).otherwise(F.lit(0.0))


def inverse_normal(p: float) -> float:
    """Quantile of the standard normal distribution."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def t_sf(t: float, dof: float) -> float:
    """Upper tail of Student's t by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    return 0.5 * beta_inc(dof / 2, 0.5, x) if t >= 0 else 1 - 0.5 * beta_inc(dof / 2, 0.5, x)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d) if 1 + num * d else 1e300
        c = 1 + num / c if c else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def mad_scale() -> float:
    """Factor that makes the median absolute deviation comparable with a standard deviation."""
    return 1.4826
