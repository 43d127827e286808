"""Writing results once, reading them back with an integrity check, and identifying tables by content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulelens.functions.shapes import unions


def save_result(folder: str, tables: Mapping[str, DataFrame], config: Mapping[str, str], partition_by: Sequence[str] = ()) -> None:
    """Tables as Parquet plus configuration and a manifest; an existing folder is an error, never overwritten."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        cols = [c for c in partition_by if c in df.columns]
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*cols) if cols else writer).parquet(f"{folder}/{name}")
    spark.createDataFrame(list(config.items()), "key string, value string").write.mode("errorifexists").json(f"{folder}/config")
    file_digests(spark, folder, list(tables)).write.mode("errorifexists").json(f"{folder}/manifest")


def file_digests(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """(table_name, file, bytes, digest) of the stored part files."""
    parts = []
    for n in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder}/{n}")
        parts.append(files.select(F.lit(n).alias("table_name"), F.regexp_extract("path", f"/{n}/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest")))
    return unions(parts)


def integrity(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """(table_name, file, state): ok, missing, changed or unindexed against the manifest."""
    listed = spark.read.schema("table_name string, file string, bytes long, digest string").json(f"{folder}/manifest")
    now = file_digests(spark, folder, names).select("table_name", "file", F.col("digest").alias("now"))
    both = listed.join(now, ["table_name", "file"], "full_outer")
    state = F.when(F.col("digest").isNull(), "unindexed").when(F.col("now").isNull(), "missing").when(F.col("digest") != F.col("now"), "changed").otherwise("ok")
    return both.select("table_name", "file", state.alias("state"))


def load_result(spark: SparkSession, folder: str, names: Sequence[str], verify: bool = True) -> dict[str, DataFrame]:
    if verify:
        broken = integrity(spark, folder, names).filter("state <> 'ok'").limit(5).collect()
        if broken:
            raise ValueError(f"stored result does not match its manifest: {[(r['file'], r['state']) for r in broken]}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content identity that does not depend on row order or partitioning: count and three independent digests."""
    h1, h2 = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h1).alias("xor_digest"), F.bit_xor(h2).alias("second_digest"), F.sum(F.pmod(h1, F.lit((1 << 31) - 1))).alias("sum_digest"),
                  F.lit(",".join(columns)).alias("columns"))


def flatten_candidates(results: DataFrame) -> DataFrame:
    """Nested counterfactual results (instance with an array of candidates) as one row per candidate."""
    keep = [c for c in results.columns if c != "candidates"]
    return results.select(*keep, F.posexplode("candidates").alias("place", "c")).select(*keep, "place", "c.*")


def export_candidates(results: DataFrame, folder: str) -> None:
    """Flat CSV, nested JSON and a summary, each written by the executors."""
    flat = flatten_candidates(results)
    flat.write.mode("errorifexists").option("header", True).csv(f"{folder}/flat")
    results.write.mode("errorifexists").json(f"{folder}/nested")
    flat.groupBy("method").agg(F.count(F.lit(1)).alias("candidates"), F.avg("distance").alias("distance")).write.mode("errorifexists").json(f"{folder}/summary")


def row_diagnostics(df: DataFrame, key: Sequence[str], truth: str, models: Sequence[str]) -> DataFrame:
    """One row per evaluated row with every model's prediction and whether it was right."""
    return df.select(*key, truth, *[F.col(m) for m in models], *[(F.col(m) == F.col(truth)).alias(f"{m}_correct") for m in models])


def consolidate(frames: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Group means over the union of per-dataset result files."""
    return unions(frames).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("rows"))


def master_table(base: DataFrame, others: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join further result tables on the shared keys."""
    out = base
    for other in others.values():
        out = out.join(other, list(keys), "left")
    return out


def feature_audit(df: DataFrame, derived: Sequence[str], originals: Sequence[str], information: DataFrame, selection: DataFrame) -> DataFrame:
    """One row per derived column: variance, largest |correlation| with an original, information, selection, decision."""
    structs = []
    for d in derived:
        pairs = F.array(*[F.struct(F.abs(F.corr(F.col(d).cast("double"), F.col(o).cast("double"))).alias("r"), F.lit(o).alias("o")) for o in originals])
        structs.append(F.struct(F.lit(d).alias("feature"), F.var_pop(d).alias("variance"), F.array_max(pairs).alias("top")))
    stats = df.agg(F.array(*structs).alias("s")).select(F.explode("s").alias("s")).select("s.feature", "s.variance", F.col("s.top.r").alias("max_correlation"), F.col("s.top.o").alias("closest"))
    out = stats.join(information, "feature", "left").join(selection, "feature", "left")
    return out.withColumn("decision", F.when(F.col("variance") <= 1e-12, "constant").when(F.col("max_correlation") >= 0.999, "redundant").when(F.col("frequency") >= 0.6, "keep").otherwise("unstable"))
