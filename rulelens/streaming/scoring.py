"""Streaming forms of scoring, fidelity, drift and query budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rulelens.functions.lineage import new_folder
from rulelens.functions.ordering import with_hash_rank
from rulelens.functions.shapes import long_form
from rulelens.operators.contract import align
from rulelens.operators.trees import RuleTree


def open_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder (or glob) as a stream with the schema of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Process what is available into a Parquet sink with its own checkpoint, and read the sink back.

    A run that names the ``folder`` of an earlier one goes on where that one stopped.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, label)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_updates(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Process what is available of an aggregate by ``keys`` and return the last state of every key, open windows included.

    Each micro-batch writes the keys it changed to its own folder, which a replay rewrites; the watermark still bounds the state.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, label)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")  # a stream without rows has no batch

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    cells = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cells), "batch").alias("c")).select(*keys, "c.*")


def score_stream(stream: DataFrame, tree: RuleTree, needed: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Contract check on the columns, then the rule tree's answer per row; stateless, so it scales with the source."""
    return tree.score(align(stream, [*dict.fromkeys([*keep, *needed])]), "prediction", "node_id")


def windowed_fidelity(stream: DataFrame, ts: str, teacher: Column, surrogate: Column, truth: Column, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Agreement counts per event-time window; rows later than the watermark are dropped."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = stream.withColumns({"__t": teacher, "__s": surrogate, "__y": truth}).withWatermark(ts, late)
    agg = rows.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__t") == F.col("__s")).alias("agree"), F.count_if((F.col("__t") == F.col("__y")) & (F.col("__s") != F.col("__y"))).alias("teacher_only"),
                                            F.count_if((F.col("__t") != F.col("__y")) & (F.col("__s") == F.col("__y"))).alias("surrogate_only"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "agree", "teacher_only", "surrogate_only")


def _bin(features: Sequence[str], edges: dict[str, Sequence[float]]) -> Column:
    """Number of the feature's edges below the value; a missing value has no bin."""
    place = F.lit(None).cast("int")
    for f in features:
        place = F.when(F.col("feature") == f, F.when(F.col("value").isNotNull(), F.lit(0) + sum((F.when(F.col("value") > float(e), 1).otherwise(0) for e in edges[f]), F.lit(0)))).otherwise(place)
    return place


def windowed_bins(stream: DataFrame, ts: str, features: Sequence[str], edges: dict[str, Sequence[float]], window: str, late: str) -> DataFrame:
    """Counts per (window, feature, bin); bins come from the reference, so state stays small."""
    rows = long_form(stream.withWatermark(ts, late).select(ts, *[F.col(f).cast("double").alias(f) for f in features]), [ts], features)
    agg = rows.withColumn("bin", _bin(features, edges)).filter("bin IS NOT NULL").groupBy(F.window(ts, window).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("window_start"), "feature", "bin", "n")


def window_drift(windows: DataFrame, reference: DataFrame, features: Sequence[str], edges: dict[str, Sequence[float]]) -> DataFrame:
    """Largest gap of cumulative bin shares between each window and the reference (bins x windows rows)."""
    long = long_form(reference.select(*[F.col(f).cast("double").alias(f) for f in features]), [], features)
    ref = long.withColumn("bin", _bin(features, edges)).filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("r"))
    spans = windows.select("window_start").distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(b).alias("bin")) for f in features for b in range(len(edges[f]) + 1)]))
    grid = spans.select("window_start", cells.alias("c")).select("window_start", "c.*").join(windows, ["window_start", "feature", "bin"], "left").join(ref, ["feature", "bin"], "left").fillna(0, ["n", "r"])
    w = Window.partitionBy("window_start", "feature").orderBy("bin")
    whole = Window.partitionBy("window_start", "feature")
    gap = F.abs(F.sum("n").over(w) / F.sum("n").over(whole) - F.sum("r").over(w) / F.sum("r").over(whole))
    return grid.withColumn("gap", gap).groupBy("window_start", "feature").agg(F.max("gap").alias("drift"), F.sum("n").alias("n"))
