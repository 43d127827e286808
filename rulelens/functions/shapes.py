"""Small column-building helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def add(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds, NULL for no rows."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def hits(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(num: Column, den: Column, empty=None) -> Column:
    """num / den with ``empty`` where the denominator is zero or missing."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; columns must share a type (numeric columns become doubles)."""
    return df.unpivot(list(ids), list(columns), name, value)


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rows_of_structs(df: DataFrame, structs: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Turn one wide row of statistics into one row per struct."""
    return df.select(*keep, F.explode(F.array(*structs)).alias("__s")).select(*keep, "__s.*")


def unions(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """One row with the columns of frames that have one row or none each; columns of an empty one are NULL."""
    both = unions(frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def failed_names(checks: dict[str, Column]) -> Column:
    """Comma-separated names of the checks that do not hold (NULL counts as failed)."""
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, c in checks.items()]
    return F.concat_ws(",", *named)


def all_hold(checks: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()])


def bin_column(feature: str, edges: Sequence[float]) -> Column:
    """Number of edges below the value, NULL for NULL; a plain sum, since Java never compiles the code of a long nested CASE."""
    known = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    below = add([F.lit(0), *[(known > F.lit(float(e))).cast("int") for e in edges]])
    return F.when(F.col(feature).isNotNull(), below)


FEW_ROWS = 10_000


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table expected to be tiny (one row per class or group): broadcast when counted so, a shuffle join otherwise.

    A shuffle join on a handful of keys would send each key's rows to one task.
    """
    return df.join(F.broadcast(small) if small.count() <= FEW_ROWS else small, list(on), how)
