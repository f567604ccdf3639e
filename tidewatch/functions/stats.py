"""Normal distribution and effect sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the seven-digit approximation of the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_STEP = 0.3275911
#: Two-sided normal quantiles by confidence.
Z_TWO_SIDED = {0.9: 1.645, 0.95: 1.96, 0.99: 2.576}


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1 / (1 + ERF_STEP * a)
    poly = ((((ERF[4] * t + ERF[3]) * t + ERF[2]) * t + ERF[1]) * t + ERF[0]) * t
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-a * a))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / 1.4142135623730951))


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def normal_quantile(p: Column) -> Column:
    """Rational approximation of the inverse (absolute error under 4.5e-4), for probabilities inside (0, 1)."""
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    size = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -size).otherwise(size)


def sql_normal_cdf(x: str) -> str:
    """The same polynomial as SQL text."""
    a = f"(abs({x}) / 1.4142135623730951::double)"
    t = f"(1 / (1 + {ERF_STEP}::double * {a}))"
    poly = f"(((({ERF[4]}::double * {t} + {ERF[3]}::double) * {t} + {ERF[2]}::double) * {t} + {ERF[1]}::double) * {t} + {ERF[0]}::double) * {t}"
    return f"(0.5 * (1 + case when {x} < 0 then -1 else 1 end * (1 - {poly} * exp(-{a} * {a}))))"
