"""Poisson replication: documents repeated to the rates that move their sources to target weights, in a global shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rulelens.llm.common import beside, fresh, unit, unit_sql

TEMPERATURE = 0.7  # a source's target weight is its share of the bytes to this power
SEED = 7


def rates(docs: DataFrame, temperature: float = TEMPERATURE, weights: DataFrame | None = None) -> DataFrame:
    """One row a source: its bytes, target share, mean repetitions, and the Poisson distribution's running sums.

    ``weights`` (source, weight) sets the targets; without it they are the tempered shares. The total stays that of the input.
    Sums run over the counts that a 53-bit draw can reach, a few dozen for a rate near one.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sums = docs.groupBy("source").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("_source"), "weight")
        sums = sums.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    total = sums.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    sums = sums.withColumn("rate", F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(total["bytes"] or 0) / F.col("bytes"))
    counts = sums.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int"))))
    run = Window.partitionBy("source").orderBy("k")  # as many rows as a draw can reach
    counts = counts.withColumn("log_k", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(run))
    term = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_k"))).otherwise((F.col("k") == 0).cast("double"))
    counts = counts.withColumn("p", term)
    counts = counts.withColumn("cdf", F.sum("p").over(run))
    cdf = F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"])
    return counts.groupBy("source").agg(F.first("bytes").alias("bytes"), F.first("n").alias("n"), F.first("rate").alias("rate"), cdf.alias("cdf"))


def replicate(docs: DataFrame, temperature: float = TEMPERATURE, weights: DataFrame | None = None, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """``docs`` with each row repeated by its Poisson count, in global random order, and the names of four added columns:
    rate, number of copies, this copy, and place in the shuffle.

    The count is the smallest k whose running sum exceeds a draw from doc_id and seed, so any retry gives the same rows, and
    repeated doc_ids repeat alike. A count of 0 leaves a document out: that is the sampling. Null source: a source of its own.
    Null doc_id: drawn as the word null. Null or empty text: one byte. Extra columns pass through whatever their names.
    The order comes from a sampled range partition of hashed keys, so no source, however large, lies in one task.
    """
    rate, copies, copy, place = fresh(docs, "rate", "copies", "copy", "place")
    of, mean, cdf = fresh(docs, "of", "mean", "cdf")
    few = rates(docs, temperature, weights).select(F.col("source").alias(of), F.col("rate").alias(mean), F.col("cdf").alias(cdf))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = beside(docs, few, docs["source"].eqNullSafe(F.col(of)))
    drawn = drawn.withColumn(copies, F.size(F.filter(cdf, lambda c: c <= unit(key, seed=seed)))).withColumn(rate, F.col(mean)).drop(of, mean, cdf)
    each = drawn.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    each = each.withColumn(place, F.substring(F.md5(F.concat_ws("|", key, F.col(copy).cast("string"), F.lit(f"place {seed}"))), 1, 16))
    return each.repartitionByRange(F.col(place)).sortWithinPartitions(place), [rate, copies, copy, place]


MIX_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes FROM documents GROUP BY source),
     w AS (SELECT *, pow(bytes::DOUBLE, {TEMPERATURE}) AS weight FROM s),
     r AS (SELECT source, weight / sum(weight) OVER () * sum(bytes) OVER () / bytes AS rate FROM w),
     k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::INTEGER + 1)) AS k FROM r),
     l AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_k FROM k),
     p AS (SELECT *, exp(k * ln(rate) - rate - log_k) AS p FROM l),
     c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
     d AS (SELECT source, max(rate) AS rate, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
     n AS (SELECT doc_id, documents.source, rate, len(list_filter(cdf, lambda x: x <= {unit_sql('doc_id', seed=SEED)})) AS copies FROM documents JOIN d ON documents.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, round(rate, 6) AS rate, copies::INTEGER AS copies, copy::INTEGER AS copy, substr(md5(concat_ws('|', doc_id::VARCHAR, copy::VARCHAR, 'place {SEED}')), 1, 16) AS place
FROM (SELECT *, unnest(range(copies)) AS copy FROM n)
"""
