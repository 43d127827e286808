"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rulelens.functions.lineage import new_folder

BATCH_BYTES = 16 << 20
ROW_GROUP = 16 << 20  # a reader holds a row group of a few wide rows at a time


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written once under the folder all executors share: cuts lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def emptied(table: DataFrame) -> None:
    """Frees the room of a table written by ``saved`` that nothing reads any more: an empty one takes its place."""
    files = table.inputFiles()
    if files:
        none = table.sparkSession.createDataFrame([], table.schema)
        none.write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def by_batch(df: DataFrame, build: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches whose size is bounded in bytes, so long texts do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(build, schema)


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def unit(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from the md5 of the parts and a seed; the same in any SQL engine, on any cluster."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def unit_sql(*parts: str, seed: int = 0) -> str:
    """The DuckDB twin of ``unit``."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)}, '{seed}')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r})"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


SMALL_ROWS = 10_000


def beside(df: DataFrame, few: DataFrame, on: Column) -> DataFrame:
    """Left join with a table of one row a group; it is broadcast only if a count shows that it is small."""
    return df.join(F.broadcast(few) if few.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else few, on, "left")


def runs(df: DataFrame, key: list[str], finer: list[str], ties: list[str]) -> DataFrame:
    """``df`` in order of key and finer key, each row with what its two neighbours tell.

    ``many``: another row has the same key and finer key. ``split``: a neighbour has the same key and another finer key, so
    that every pair of finer keys of a key is present among the split rows. ``edge``: first or last row of its task, whose
    neighbour there is unknown. Rows are range-partitioned by the keys and ``ties``, which tell rows of equal keys apart, and
    streamed, so that a key however frequent is spread over tasks. The rows are read twice: ``df`` had better be a table.
    """
    shape = T.StructType([*df.schema.fields, *[T.StructField(c, T.BooleanType(), False) for c in ("many", "split", "edge")]])

    def known(batch: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        """``batch`` with its flags; ``before`` and ``after`` are the keys of the rows around it, if the task has them."""
        same = []
        for names, part in ((key, slice(0, len(key))), (finer, slice(len(key), None))):
            equal = np.ones(batch.num_rows + 1, dtype=bool)  # row i and the one before it
            for c, lo, hi in zip(names, before[part] if before else names, after[part] if after else names):
                values = batch.column(c).to_numpy(zero_copy_only=False)
                equal[1:-1] &= values[1:] == values[:-1]
                equal[0] &= before is not None and values[0] == lo
                equal[-1] &= after is not None and values[-1] == hi
            same.append(equal)
        twin, cousin = same[0] & same[1], same[0] & ~same[1]
        edge = np.zeros(batch.num_rows, dtype=bool)
        edge[-1] |= after is None
        edge[0] |= before is None
        flags = [twin[1:] | twin[:-1], cousin[1:] | cousin[:-1], edge]
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, flags)], [*batch.schema.names, "many", "split", "edge"])

    def ends(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in [*key, *finer])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield known(held, before, ends(b, 0))
                    before = ends(held, -1)
                held = b
        if held is not None:
            yield known(held, before, None)

    order = [*key, *finer, *ties]
    return by_batch(df.repartitionByRange(*order).sortWithinPartitions(*order), build, shape)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written; else they stay until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` as a written table dealt by ``key``, so that later joins on the key do not move it again."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, label)
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", folder).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved: the name is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return table


def by_group(df: DataFrame, by: list[str], order: list[str], build: Callable[[dict[str, list]], list[tuple]], schema: T.StructType) -> DataFrame:
    """Rows that ``build`` makes of each group's columns, for many groups of bounded size.

    Groups are dealt by hash and sorted, and a task goes through its groups in one stream of batches: for small groups that
    costs far less than a call and a frame each.
    """
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            out, keys = [], list(zip(*[b.column(c).to_pylist() for c in by]))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and keys[lo] != key:
                    out += build(pa.Table.from_batches(held).to_pydict())
                    held = []
                key = keys[lo]
                held.append(b.slice(lo, hi - lo))
            yield rows_of(out)
        if held:
            yield rows_of(build(pa.Table.from_batches(held).to_pydict()))

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(shape), shape)], schema=shape)

    return by_batch(df.repartition(*by).sortWithinPartitions(*by, *order), run, schema)
