"""Splits that every model shares, made from row keys alone so that partitioning never changes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rulelens.functions.ordering import with_hash_rank
from rulelens.functions.shapes import join_small


def _class_sizes(df: DataFrame, label: str, name: str = "class_rows") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def holdout(df: DataFrame, key: Sequence[str], label: str, seeds: Sequence[int], test_share: float = 0.25) -> DataFrame:
    """(key, label, split_id, role): stratified hold-out per seed; plain when some class is too small to stratify."""
    sizes = [r["class_rows"] for r in _class_sizes(df, label).collect()]  # one row per class
    stratify = min(sizes) >= 2 and round(sum(sizes) * test_share) >= len(sizes)
    base = df.select(*key, label).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    groups = ["seed", label] if stratify else ["seed"]
    ranked = with_hash_rank(base, "holdout", [*key, "seed"], groups)
    if stratify:
        sized = join_small(ranked, _class_sizes(df, label), [label])
    else:
        sized = ranked.withColumn("class_rows", F.lit(sum(sizes)))
    role = F.when(F.col("hash_rank") <= F.round(F.col("class_rows") * test_share), "test").otherwise("train")
    return sized.select(*key, label, F.concat(F.lit("seed"), F.col("seed")).alias("split_id"), role.alias("role"))


def repeated_folds(df: DataFrame, key: Sequence[str], label: str, folds: int = 5, repeats: int = 2, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """(key, label, keep, repeat, fold): stratified folds, their number cut to the smallest class; ``keep`` names columns that stay."""
    smallest = _class_sizes(df, label).agg(F.min("class_rows").alias("m")).first()["m"]
    k = min(folds, smallest)
    if k < 2:
        raise ValueError("every class needs at least two rows")
    base = df.select(*key, label, *keep).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = with_hash_rank(base, seed, [*key, "repeat"], ["repeat", label])
    return ranked.select(*key, label, *keep, "repeat", F.pmod(F.col("hash_rank") - 1, F.lit(k)).alias("fold"))


def overlap(train: DataFrame, test: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number of keys on both sides; must be zero."""
    return train.select(*key).distinct().join(test.select(*key).distinct(), list(key), "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def identity(split: DataFrame, key: str) -> DataFrame:
    """Order-free digest per (split_id, role): equal digests mean equal row sets."""
    h = F.xxhash64(key)
    return split.groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("digest"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("check_sum"))


def stratified_share(df: DataFrame, key: Sequence[str], label: str, share_of: float, maximum: int = 0, seed: int = 42) -> DataFrame:
    """ceil(share * n) rows of every class (at least one), optionally limited to ``maximum`` rows in hash order."""
    ranked = join_small(with_hash_rank(df, seed, key, [label]), _class_sizes(df, label), [label])
    kept = ranked.filter(F.col("hash_rank") <= F.greatest(F.lit(1), F.ceil(F.col("class_rows") * share_of))).drop("hash_rank", "class_rows")
    if maximum:
        kept = with_hash_rank(kept, f"{seed}:all", key).filter(F.col("hash_rank") <= maximum).drop("hash_rank")
    return kept


def three_way(df: DataFrame, key: Sequence[str], label: str, validation: float = 0.2, selection: float = 0.2, seed: int = 7) -> DataFrame:
    """train / selection / validation with every class on every side where its size allows."""
    ranked = join_small(with_hash_rank(df.select(*key, label), seed, key, [label]), _class_sizes(df, label), [label])
    n = F.col("class_rows")
    v = F.greatest(F.lit(1), F.least(F.ceil(n * validation), n - 2))
    s = F.greatest(F.lit(1), F.least(F.ceil(n * selection), n - v - 1))
    role = F.when(F.col("hash_rank") <= v, "validation").when(F.col("hash_rank") <= v + s, "selection").otherwise("train")
    return ranked.select(*key, label, role.alias("role"))


def entity_overlap(train: DataFrame, test: DataFrame, entity: str) -> DataFrame:
    """Entities seen on both sides and the share of test rows they carry."""
    seen = train.select(entity).distinct().withColumn("seen", F.lit(True))
    tagged = test.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).join(seen, entity, "left")
    return tagged.agg(F.count("seen").alias("shared_entities"), (F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)) / F.sum("n")).alias("test_share"),
                      (F.count("seen") > 0).alias("leakage"))


def temporal_check(df: DataFrame, role: str, ts: str) -> DataFrame:
    """Prospective when every training time precedes every test time."""
    ends = df.agg(F.max(F.when(F.col(role) == "train", F.col(ts))).alias("train_end"), F.min(F.when(F.col(role) == "test", F.col(ts))).alias("test_start"))
    return ends.withColumn("verdict", F.when(F.col("train_end") < F.col("test_start"), "prospective").otherwise("overlap"))


def evaluation_strategy(df: DataFrame, label: str, small: int = 200, imbalance: float = 3.0) -> DataFrame:
    """Repeated CV for small tables, hold-out with bootstrap otherwise; balanced accuracy when classes are uneven."""
    c = _class_sizes(df, label).agg(F.sum("class_rows").alias("n"), F.max("class_rows").alias("hi"), F.min("class_rows").alias("lo"))
    return c.select("n", (F.col("hi") / F.col("lo")).alias("imbalance_ratio"), F.when(F.col("n") < small, "repeated_stratified_cv").otherwise("stratified_holdout_bootstrap").alias("mode"),
                    F.when(F.col("hi") / F.col("lo") >= imbalance, "balanced_accuracy").otherwise("accuracy").alias("primary_metric"),
                    F.greatest(F.lit(2), F.least(F.lit(5), F.col("lo"))).alias("folds"), (1 / F.col("n")).alias("resolution"))
