"""Reproducible randomness: draws depend on row keys and a seed, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def order_key(seed, *keys) -> Column:
    """Portable hex key ordering rows pseudo-randomly (same text in any SQL engine)."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(str(seed))))


def uniform(seed, *keys) -> Column:
    """Draw in [0, 1) from a 53-bit slice of a row-key hash."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    bits = F.xxhash64(*cols, F.lit(str(seed))).bitwiseAND(F.lit((1 << 53) - 1))
    return bits.cast("double") / F.lit(float(1 << 53))


def pick(seed, n, *keys) -> Column:
    """Integer draw in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(seed, *keys) * n).cast("long")


def gaussian(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller)."""
    u1 = F.greatest(uniform(f"{seed}:u", *keys), F.lit(1e-300))
    u2 = uniform(f"{seed}:v", *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def poisson_one(u: Column, limit: int = 12) -> Column:
    """Poisson(1) draw from a uniform column by inversion; mass beyond ``limit`` is below 1e-9."""
    cdf, term, out = 0.0, math.exp(-1.0), None
    for k in range(limit):
        cdf += term
        term /= k + 1
        out = F.when(u < cdf, k) if out is None else out.when(u < cdf, k)
    return out.otherwise(limit)
