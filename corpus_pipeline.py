"""The corpus pipeline: its stages, in order, applied to the document table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulelens.llm import mixing, neardup, packing, quality, suffix
from rulelens.llm.common import documents, fresh, saved

SIMILAR = 80  # percent of shared word shingles from which documents are near-duplicates here


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score, = fresh(docs, "score")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return neardup.one_of_each(docs, SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur anywhere else."""
    return suffix.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in a global shuffle."""
    mixed, added = mixing.replicate(docs)
    return mixed.drop(*added)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good), ("near-duplicates", deduplicate), ("repeats", cut_repeats), ("mix", mix), ("pack", pack),
]

ORACLE_SQL = None  # a trained classifier and best-fit packing have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
