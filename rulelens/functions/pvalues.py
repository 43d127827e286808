"""Tail probabilities for result tables: plain formulas on the standard library, applied to a handful of rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coefficient / c
            c = c if abs(c) > tiny else tiny
            change = d * c
            h *= change
        if abs(change - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail by the series below the mean and the continued fraction above it."""
    if x <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = y + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def kolmogorov_tail(stat: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * stat
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total)) if lam > 0.2 else 1.0


def signed_rank_exact(w: float, n: int) -> float:
    """Exact two-sided tail of the signed-rank statistic (no ties, no zeros): counts of subset sums of 1..n."""
    ways = [1]
    for r in range(1, n + 1):
        wider = ways + [0] * r
        for s, c in enumerate(ways):
            wider[s + r] += c
        ways = wider
    low = int(math.floor(min(w, n * (n + 1) / 2 - w)))
    return min(1.0, 2.0 * sum(ways[: low + 1]) / 2.0 ** n)


def _column(fn, *cols: Column) -> Column:
    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series)], dtype="float64")

    if len(cols) == 1:
        return _one(batch, *cols)
    return _two(batch, *cols) if len(cols) == 2 else _three(batch, *cols)


def _one(batch, a: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        return batch(x)

    return f(a)


def _two(batch, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return batch(x, y)

    return f(a, b)


def _three(batch, a: Column, b: Column, c: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return batch(x, y, z)

    return f(a, b, c)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t.cast("double"), df.cast("double"))


def normal_p(z: Column) -> Column:
    return _column(normal_two_sided, z.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_tail, x.cast("double"), df.cast("double"))


def ks_p(stat: Column, n1: Column, n2: Column) -> Column:
    return _column(kolmogorov_tail, stat.cast("double"), n1.cast("double"), n2.cast("double"))


def signed_rank_p(w: Column, n: Column) -> Column:
    return _column(lambda a, b: signed_rank_exact(a, int(b)), w.cast("double"), n.cast("double"))


def binomial_two_sided(low: Column, n: Column) -> Column:
    """min(1, 2 * P[Bin(n, 1/2) <= low]), summed term by term; meant for small n."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    steps = F.sequence(F.lit(0).cast("long"), low.cast("long"))
    total = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] * (n - k) / (k + 1)).alias("term"), (s["total"] + s["term"]).alias("total")), lambda s: s["total"])
    return F.least(F.lit(1.0), 2.0 * total * F.pow(F.lit(0.5), n))
