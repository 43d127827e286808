"""Rules as explanations: summaries, matching rows, extrapolation, similar rows and decision paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulelens.functions.neighbours import nearest
from rulelens.functions.ordering import top_k
from rulelens.operators.trees import literal


def rule_summaries(rules: DataFrame, k: int) -> DataFrame:
    """The k rules of largest support with an importance between 0 and 1."""
    score = (F.least(F.col("support") / 100.0, F.lit(1.0)) + F.col("confidence")) / 2
    return rules.withColumn("importance", score).orderBy(F.desc("support"), "rule").limit(k)


def simplified_conditions(conditions: DataFrame) -> DataFrame:
    """(rule, feature, upper, lower): the tightest bound per side."""
    return conditions.groupBy("rule", "feature").agg(F.min(F.when(F.col("op") == "<=", F.col("thr"))).alias("upper"), F.max(F.when(F.col("op") == ">", F.col("thr"))).alias("lower"))


def rule_column(rules: Mapping[int, Sequence[tuple]]) -> Column:
    """Array of the rules a row satisfies; rules may overlap."""
    cells = []
    for rule, lits in rules.items():
        ok = F.lit(True)
        for l in lits:
            ok = ok & literal(*l)
        cells.append(F.when(ok, F.lit(rule)))
    return F.array_compact(F.array(*cells))


def rule_matches(df: DataFrame, rules: Mapping[int, Sequence[tuple]]) -> DataFrame:
    """One row per (row, satisfied rule), from expressions on the scan instead of a join."""
    return df.withColumn("rule", F.explode(rule_column(rules)))


def rule_examples(df: DataFrame, rules: Mapping[int, Sequence[tuple]], key: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """k reproducible example rows per rule."""
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return top_k(rule_matches(df, rules).withColumn("__o", order), k, [F.col("__o"), *[F.col(c) for c in key]], ["rule"], salt=list(key)).drop("__o")


def extrapolation(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of each row outside the training range, and whether any is."""
    lim = train.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = F.array_compact(F.array(*[F.when((F.col(c) < lim[f"lo_{c}"]) | (F.col(c) > lim[f"hi_{c}"]), F.lit(c)) for c in features]))
    return df.withColumn("outside", out).withColumn("is_extrapolation", F.size("outside") > 0)


def similar_examples(queries: DataFrame, train: DataFrame, features: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """k nearest training rows of every query row, with similarity 1 / (1 + distance)."""
    q = queries.select(F.col(key).alias("query"), *features)
    near = nearest(train, q, features, k, key, "query")
    return near.withColumn("similarity", 1 / (1 + F.col("distance")))
