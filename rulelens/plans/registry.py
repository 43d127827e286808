"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


MANY_ROWS = 100_000
_ONE_TASK: dict[str, bool] = {}


def _read_by_one_task(table: DataFrame, path: str) -> bool:
    """A long table stored as a single row group: one task would do all the work above the scan.

    Tables of a real size have many splits and are left alone.
    """
    if path not in _ONE_TASK:
        _ONE_TASK[path] = table.rdd.getNumPartitions() == 1 and table.count() >= MANY_ROWS
    return _ONE_TASK[path]


class Tables:
    """Lazily opened input tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        table = self.spark.read.parquet(path)
        if _read_by_one_task(table, path):
            table = table.repartition(self.spark.sparkContext.defaultParallelism)
        self.__dict__[name] = table
        return table


def query(name: str, sql: str | None = None, floats: str = "", ints: str = ""):
    """Register a query; ``floats`` are rounded and ``ints`` widened alike on both sides."""
    real, whole = floats.split(), ints.split()

    def decorate(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(Tables(spark, folder))
            casts = {c: F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0) for c in real}
            casts |= {c: F.col(c).cast("long") for c in whole}
            return out.withColumns(casts) if casts else out

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            casts = [f'round(("{c}")::DOUBLE, {DIGITS}) + 0 AS "{c}"' for c in real] + [f'("{c}")::BIGINT AS "{c}"' for c in whole]
            replace = f" REPLACE ({', '.join(casts)})" if casts else ""
            ORACLES[name] = f"SELECT *{replace} FROM ({sql.strip()}) AS result"
        return build

    return decorate
