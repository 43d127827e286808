"""Bootstrap intervals by Poisson reweighting: no index tables, no collected groups, stable under repartitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rulelens.operators.metrics import poisson_replicas


def _interval(per: DataFrame, by: Sequence[str], value: str, alpha: float) -> DataFrame:
    return per.groupBy(*by).agg(F.percentile(value, alpha / 2).alias("ci_low"), F.percentile(value, 1 - alpha / 2).alias("ci_high"), F.count(value).alias("replicas"))


def mean_interval(df: DataFrame, value: str, key: Sequence[str], by: Sequence[str] = (), replicas: int = 400, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of a mean (or of a paired difference)."""
    by = list(by)
    draws = poisson_replicas(df.select(*by, F.col(value).alias("__v"), *[F.col(k).alias(f"__k_{k}") for k in key]), [f"__k_{k}" for k in key], replicas, seed)
    per = draws.groupBy(*by, "replica").agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("m"))
    point = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    out = _interval(per, by, "m", alpha)
    return out.join(point, by) if by else out.withColumns({"mean": point.select("mean").scalar(), "n": point.select("n").scalar()})


def ratio_interval(df: DataFrame, num: str, den: str, key: Sequence[str], by: Sequence[str] = (), replicas: int = 400, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of mean(num) / mean(den); replicas with a vanishing denominator drop out."""
    by = list(by)
    draws = poisson_replicas(df.select(*by, F.col(num).alias("__a"), F.col(den).alias("__b"), *[F.col(k).alias(f"__k_{k}") for k in key]), [f"__k_{k}" for k in key], replicas, seed)
    a, b, w = F.sum(F.col("w") * F.col("__a")), F.sum(F.col("w") * F.col("__b")), F.sum("w")
    per = draws.groupBy(*by, "replica").agg(F.when(F.abs(b / w) > 1e-12, a / b).alias("r")).filter("r IS NOT NULL")
    point = df.groupBy(*by).agg((F.avg(num) / F.avg(den)).alias("point"))
    out = _interval(per, by, "r", alpha)
    return out.join(point, by) if by else out.withColumn("point", point.select("point").scalar())
