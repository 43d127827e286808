"""Registered explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators import explain as EX
from rulelens.plans.bases import JUDGED, OBSERVED, SCORED, SURROGATE, judged, observed, scored
from rulelens.plans.registry import query

# Overlapping rules over line items.
RULES = {1: [("price", "<=", 60000.0), ("price", "<=", 45000.0), ("qty", "<=", 28.0)], 2: [("price", ">", 20000.0), ("price", ">", 30000.0), ("qty", ">", 10.0), ("qty", "<=", 40.0)], 3: [("disc", ">", 0.05), ("tax", "<=", 0.04)]}
WHERE = {k: " AND ".join(f"{f} {op} {v}" for f, op, v in lits) for k, lits in RULES.items()}
MATCHED = SCORED + ", mt AS (" + " UNION ALL ".join(f"SELECT {k} AS rule, * FROM scored WHERE {w}" for k, w in WHERE.items()) + ")"


@query("ex01_rule_summaries", f"WITH {MATCHED} SELECT rule, count(*) AS support, avg((t='R')::INT) AS confidence, (least(count(*)/100.0, 1.0)+avg((t='R')::INT))/2 AS importance FROM mt GROUP BY 1 ORDER BY support DESC, rule LIMIT 2", floats="confidence importance", ints="rule support")
def _(t):
    stats = EX.rule_matches(scored(t), RULES).groupBy("rule").agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("t") == "R").cast("double")).alias("confidence"))
    return EX.rule_summaries(stats, 2)


@query("ex02_simplified_conditions", f"""WITH {MATCHED}, c AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{f}', '{op}', {v})" for k, ls in RULES.items() for f, op, v in ls)}) v(rule, feature, op, thr)), s AS (SELECT rule, feature, min(thr) FILTER (op='<=') AS upper, max(thr) FILTER (op='>') AS lower FROM c GROUP BY 1, 2)
SELECT s.*, (SELECT count(*) FROM mt WHERE mt.rule = s.rule) AS rows FROM s""", floats="upper lower", ints="rule rows")
def _(t):
    rows = [(k, f, op, v) for k, ls in RULES.items() for f, op, v in ls]
    table = EX.simplified_conditions(t.spark.createDataFrame(rows, "rule int, feature string, op string, thr double"))
    return table.join(EX.rule_matches(scored(t), RULES).groupBy("rule").agg(F.count(F.lit(1)).alias("rows")), "rule")


@query("ex03_rule_rows", f"WITH {MATCHED} SELECT rule, y, count(*) AS n, avg(price) AS price FROM mt GROUP BY 1, 2", floats="price", ints="rule n")
def _(t):
    return EX.rule_matches(scored(t), RULES).groupBy("rule", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))


@query("ex03_rule_examples", f"""WITH {JUDGED}, mt AS (SELECT 1 AS rule, id FROM judged WHERE total > 100000 UNION ALL SELECT 2, id FROM judged WHERE total > 200000 AND month <= 6) SELECT rule, id, row_number() OVER (PARTITION BY rule ORDER BY md5(concat_ws('|', id, '1')), id) AS rank FROM mt QUALIFY rank <= 5""", ints="rule id rank")
def _(t):
    rules = {1: [("total", ">", 100000.0)], 2: [("total", ">", 200000.0), ("month", "<=", 6.0)]}
    return EX.rule_examples(judged(t).select("id", "total", "month"), rules, ["id"], 5).select("rule", "id", "rank")


@query("ex04_extrapolation", f"""WITH {OBSERVED}, m AS (SELECT min(price) AS pl, max(price) AS ph, min(qty) AS ql, max(qty) AS qh FROM observed WHERE status='F' AND qty < 45), o AS (SELECT concat_ws(',', CASE WHEN qty < ql OR qty > qh THEN 'qty' END, CASE WHEN price < pl OR price > ph THEN 'price' END) AS outside FROM observed, m WHERE NOT (status='F' AND qty < 45))
SELECT outside, outside <> '' AS is_extrapolation, count(*) AS n FROM o GROUP BY 1, 2""", ints="n")
def _(t):
    rows, known = observed(t), "status = 'F' AND qty < 45"  # the training side; all other rows are judged
    out = EX.extrapolation(rows.filter(f"NOT ({known})"), rows.filter(known), ["qty", "price"])
    return out.groupBy(F.concat_ws(",", "outside").alias("outside"), "is_extrapolation").agg(F.count(F.lit(1)).alias("n"))


@query("ex05_similar_examples", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query, v FROM e),
d AS (SELECT query, vec_id AS neighbour, list_distance(q.v, e.v) AS distance FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d) SELECT query, neighbour, distance, rank, 1/(1+distance) AS similarity FROM r WHERE rank <= 3""", floats="distance similarity", ints="query neighbour rank")
def _(t):
    names = [f"v{i}" for i in range(len(t.embeddings.first()["embedding"]))]
    rows = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return EX.similar_examples(rows, rows, names, "vec_id", 3)


@query("ex06_decision_paths", f"""WITH {SCORED} SELECT CASE leaf WHEN 3 THEN 'not 1-of-1(price <= 60000)' WHEN 4 THEN '1-of-1(price <= 60000) & 1-of-1(qty <= 28)' ELSE '1-of-1(price <= 60000) & not 1-of-1(qty <= 28)' END AS path, s, count(*) AS n FROM scored GROUP BY 1, 2""", ints="n")
def _(t):
    return scored(t).withColumn("path", SURROGATE.explain_column()).groupBy("path", "s").agg(F.count(F.lit(1)).alias("n"))
