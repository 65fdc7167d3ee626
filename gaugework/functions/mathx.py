"""Special functions as column expressions: the error function, normal, t and F quantiles, log-gamma."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients (Abramowitz & Stegun 7.1.26 and 26.2.23; Lanczos, g = 7, 9 terms).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
PROBIT_C = (2.515517, 0.802853, 0.010328)
PROBIT_D = (1.432788, 0.189269, 0.001308)
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def erf(x) -> Column:
    x = col(x)
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def phi(z) -> Column:
    """The standard normal distribution function."""
    return 0.5 * (1 + erf(col(z) / math.sqrt(2)))


def probit(p) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    p = col(p)
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    top = PROBIT_C[0] + t * (PROBIT_C[1] + t * PROBIT_C[2])
    bottom = 1 + t * (PROBIT_D[0] + t * (PROBIT_D[1] + t * PROBIT_D[2]))
    z = t - top / bottom
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))


def lgamma(x) -> Column:
    """log Gamma for x >= 0.5, which is all that the beta functions here ask for."""
    x = col(x) - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + k)
    t = x + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(total)


def lbeta(a, b) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(col(a) + col(b))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def t_quantile(p, df) -> Column:
    """Student's t quantile by the Cornish-Fisher expansion around the normal's."""
    v = col(df)

    def expand(z):
        z2 = z * z
        a, b, c = z * (z2 + 1), z * (5 * z2 * z2 + 16 * z2 + 3), z * (3 * z2 * z2 * z2 + 19 * z2 * z2 + 17 * z2 - 15)
        return z + (a + (b / 24 + c / (96 * v)) / v) / (4 * v)

    return _let(probit(p), expand)


def f_quantile(p, d1, d2) -> Column:
    """The F quantile by the Wilson-Hilferty cube-root approximation."""
    a, b = 2 / (9 * col(d1)), 2 / (9 * col(d2))

    def cube(z):
        root = ((1 - b) * (1 - a) + z * F.sqrt((1 - b) ** 2 * a + (1 - a) ** 2 * b - a * b * z * z)) / ((1 - b) ** 2 - b * z * z)
        return root**3

    return _let(probit(p), cube)


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def ratio(a, b, least: float = 1e-15) -> Column:
    """a / b, null where b is about 0."""
    return F.when(F.abs(b) > least, a / b)
