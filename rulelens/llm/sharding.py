"""Sampled splitters: size-weighted key samples, quantile boundaries, range partitions, subdivided where overfull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.llm.common import saved, text_bytes

LAW = "bytes"
PER_SHARD = 4  # ranges aimed at for each shard
PER_RANGE = 32  # keys sampled for each range
OVERFULL = 2.0  # times the mean range, from which a range is subdivided


def _key(row) -> tuple:
    """Order of sampled keys on the driver; a null id comes first, as in Spark."""
    return row["key"], row["doc_id"] is not None, row["doc_id"] or 0


def _literal(cut: tuple) -> Column:
    return F.struct(F.lit(cut[0]).alias("key"), F.lit(cut[2] if cut[1] else None).cast("long").alias("doc_id"))


def range_of(cuts: list[tuple], key: Column) -> Column:
    """Index of the range that holds ``key``: cuts at most ``key``, searched in two steps of a square root each."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[_literal(g[0]) for g in groups])
    rest = F.array(*[F.array(*[_literal(c) for c in g]) for g in groups])
    below = F.size(F.filter(heads, lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(rest, F.greatest(below, F.lit(1))), lambda c: c <= key))
    return F.when(below == 0, F.lit(0)).otherwise((below - 1) * step + inside)


def sample_keys(rows: DataFrame, rate: float) -> list[tuple[tuple, float]]:
    """Keys drawn with chance rate x size (at most 1), in key order, each with the size it stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    draw = F.pmod(F.xxhash64("key", "doc_id", F.lit(rate)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    got = rows.where(draw < chance).select("key", "doc_id", (F.col("size") / chance).alias("weight")).collect()
    return sorted((_key(r), r["weight"]) for r in got)


def quantile_cuts(sample: list[tuple[tuple, float]], ranges: int) -> list[tuple]:
    """Keys at the ranges' size quantiles of a sample."""
    total, run, cuts = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        if len(cuts) < ranges - 1 and run >= total * (len(cuts) + 1) / ranges:
            cuts.append(key)
        run += weight
    return sorted(set(cuts))


def shards(docs: DataFrame, n_shards: int = 40, per_shard: int = PER_SHARD, per_range: int = PER_RANGE) -> DataFrame:
    """Rows in ``n_shards`` runs of near equal bytes along the key (md5 of the text, doc_id).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Equal texts lie beside each other; a group larger than a
    shard is cut at its ids. A row goes to the shard that holds its middle byte in key order, so sizes differ from the mean by
    one document at most. The splitters decide only how the rows are dealt to tasks, never the result.

    Null text: no bytes, crc 0. Null doc_id: first among equal texts. Repeated rows each take a slot. Other columns are
    ignored. An empty table gives no rows. The driver holds about n_shards x per_shard x per_range keys, whatever the input.
    """
    spark = docs.sparkSession
    data = text_bytes()
    rows = saved(
        docs.select(F.substring(F.md5(data), 1, 16).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32")),
        "shard-keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges, key = n_shards * per_shard, F.struct("key", "doc_id")
    rate = ranges * per_range / max(total, 1)
    cuts = quantile_cuts(sample_keys(rows, rate), ranges)
    while True:
        dealt = rows.withColumn("range", range_of(cuts, key))
        held = {r["range"]: r for r in dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        over = [r for r in held.values() if r["bytes"] > OVERFULL * total / ranges and r["lo"] != r["hi"] and r["bytes"] - r["most"] > total / ranges]
        new = set(cuts)
        for r in over:  # a range holds a bounded share of the bytes, so its finer sample is bounded too
            parts = int(r["bytes"] * ranges / total) + 1
            new |= set(quantile_cuts(sample_keys(dealt.where(F.col("range") == r["range"]), per_range * parts / r["bytes"]), parts))
        if len(new) == len(cuts):
            break
        cuts = sorted(new)
    before = bytes_before = 0
    starts = []
    for i in sorted(held):
        starts.append((i, before, bytes_before))
        before, bytes_before = before + held[i]["n"], bytes_before + held[i]["bytes"]
    starts = spark.createDataFrame(starts, "range int, rows_before long, bytes_before long")  # a row for each range
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(starts), "range")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(order) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.count(F.lit(1)).over(order) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * start + size) * {n_shards} div {2 * max(total, 1)}")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


# crc32 has no SQL function in DuckDB: it is folded here from the polynomial over the bytes in hexadecimal.
SHARDS_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
     r AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, substr(md5(coalesce(text, '')), 1, 16) AS key, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32 FROM documents, t),
     w AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id) - size AS start, row_number() OVER (ORDER BY key, doc_id) AS place, sum(size) OVER () AS total FROM r),
     s AS (SELECT *, least(39, ((2 * start + size) * 40) // (2 * total)) AS shard FROM w)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
