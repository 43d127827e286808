"""Registered streaming queries; each drains the files of its table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators.growth import bin_edges
from rulelens.plans.bases import SCORED, SURROGATE, teacher_class
from rulelens.plans.registry import query
from rulelens.streaming import scoring as SS
from rulelens.streaming.budget import budgeted_queries


def lines(t):
    """Line items as a stream with the feature names the tree expects."""
    raw = SS.open_stream(t.spark, f"{t.folder}/lineitem.parquet*")
    return raw.select(F.col("l_orderkey").alias("okey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
                      F.col("l_returnflag").alias("y"), F.col("l_shipdate").cast("timestamp").alias("ts"))


@query("ss01_stream_scoring", f"""WITH {SCORED} SELECT s AS prediction, leaf AS node_id, count(*) AS n, count_if(s = y) AS "right" FROM scored GROUP BY 1, 2""", ints="node_id n right")
def _(t):
    out = SS.run_to_end(SS.score_stream(lines(t), SURROGATE, ["qty", "price"], ["okey", "y"]), "scored")
    return out.groupBy("prediction", "node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("right"))


@query("ss02_windowed_fidelity", f"""WITH {SCORED}, w AS (SELECT DATE '1970-01-01' + (30*floor(epoch(shipdate::TIMESTAMP)/2592000))::INT AS d, t, s, y FROM scored)
SELECT d::VARCHAR AS window_start, (d + 30)::VARCHAR AS window_end, count(*) AS n, count_if(t = s) AS agree, count_if(t = y AND s <> y) AS teacher_only, count_if(t <> y AND s = y) AS surrogate_only, count_if(t = s)/count(*) AS fidelity FROM w GROUP BY d""",
       floats="fidelity", ints="n agree teacher_only surrogate_only")
def _(t):
    stream = SURROGATE.score(lines(t), "s", "leaf")
    agg = SS.windowed_fidelity(stream, "ts", teacher_class(), F.col("s"), F.col("y"), "30 days", "1 day")
    found = SS.run_updates(agg, ["window_start", "window_end"], "fidelity")
    return found.withColumns({"fidelity": F.col("agree") / F.col("n"), "window_start": F.date_format("window_start", "yyyy-MM-dd"), "window_end": F.date_format("window_end", "yyyy-MM-dd")})


@query("ss03_windowed_drift")
def _(t):
    features = ["qty", "disc"]
    reference = t.lineitem.select(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    edges = bin_edges(reference, features, 16)
    found = SS.run_updates(SS.windowed_bins(lines(t), "ts", features, edges, "90 days", "1 day"), ["window_start", "feature", "bin"], "bins")
    return SS.window_drift(found, reference, features, edges).withColumn("drift", F.round("drift", 6))


@query("ss04_query_budget", """WITH q AS (SELECT DISTINCT user_id, event_type, floor(value) AS asked FROM events), p AS (SELECT user_id, count(*) AS n FROM q GROUP BY 1)
SELECT count(*) AS users, sum(n) AS questions, max(least(n, 20)) AS most_granted, sum(least(n, 20)) AS granted FROM p""", ints="users questions most_granted granted")
def _(t):
    stream = SS.open_stream(t.spark, f"{t.folder}/events.parquet*").select("user_id", "event_type", F.floor("value").alias("asked"))
    out = budgeted_queries(stream, "user_id", ["event_type", "asked"], 20)
    per = out.groupBy("user_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if("granted").alias("granted"))
    return per.agg(F.count(F.lit(1)).alias("users"), F.sum("questions").alias("questions"), F.max("granted").alias("most_granted"), F.sum("granted").alias("granted"))
