"""Special functions that Spark SQL lacks, as Arrow-batched column functions, and closed forms of genetics."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0 (else null), by Stirling's series ten places up: no Python worker."""
    product, z = x, x + 10.0
    for i in range(1, 10):
        product = product * (x + float(i))
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * F.pow(z, F.lit(3))) + 1.0 / (1260.0 * F.pow(z, F.lit(5))) - 1.0 / (1680.0 * F.pow(z, F.lit(7)))
    return F.when(x > 0, (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


@F.pandas_udf(DoubleType())
def normal_quantile(x: pd.Series) -> pd.Series:
    return x.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma((n + 1).cast("double")) - lgamma((k + 1).cast("double")) - lgamma((n - k + 1).cast("double"))


def max_credible_af(prevalence: float, genetic: float, allelic: float, penetrance: float, biallelic: bool) -> float:
    """Highest allele frequency that a disease's prevalence allows."""
    return allelic * math.sqrt(prevalence * genetic / penetrance) if biallelic else prevalence * genetic * allelic / (2 * penetrance)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the incomplete beta function."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d, tiny = 0.0, 1e-300
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or tiny)
        c = (1 + top / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)
