"""Functions of mathematics that Spark lacks, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the usual rational approximation of the error function, and the quantiles of the normal distribution in use.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
NORMAL = {0.975: 1.96, 0.995: 2.576, 0.9: 1.282}


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2))) / 2


def inverse_normal(p: float) -> float:
    return NORMAL.get(round(p, 6), 1.96)
