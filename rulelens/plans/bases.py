"""Working tables the queries share, each with the SQL text that yields the same rows.

`scored`: one row per line item with a true label, a closed-form teacher and a small rule tree imitating it.
`runs`: accuracy and fidelity per (dataset, arm, split), computed from `scored`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulelens.operators.trees import RuleTree
from rulelens.plans.registry import Tables

CLASSES = ["A", "N", "R"]
FEATURES = ["qty", "price", "disc", "tax"]

# A three-leaf rule tree: node 1 is the root, 2 its "holds" branch.
SURROGATE = RuleTree.from_rows([
    dict(node_id=1, parent_id=None, branch=None, m=1, literals=[("price", "<=", 60000.0)], prediction=None),
    dict(node_id=2, parent_id=1, branch="yes", m=1, literals=[("qty", "<=", 28.0)], prediction=None),
    dict(node_id=3, parent_id=1, branch="no", m=0, literals=[], prediction="N"),
    dict(node_id=4, parent_id=2, branch="yes", m=0, literals=[], prediction="R"),
    dict(node_id=5, parent_id=2, branch="no", m=0, literals=[], prediction="A"),
])


def teacher_logits(cols=None) -> dict:
    qty, price, disc, tax = (cols[c] if cols else F.col(c) for c in FEATURES)
    return {
        "z_a": F.lit(0.04) * qty - F.lit(10.0) * disc,
        "z_n": price / F.lit(40000.0) - F.lit(10.0) * tax,
        "z_r": F.lit(0.5) + F.lit(10.0) * disc - F.lit(0.02) * qty,
    }


def teacher_class(cols=None):
    """Best logit, first in class order on ties; takes columns so that it can be asked about any point."""
    z = teacher_logits(cols)
    return (F.when((z["z_a"] >= z["z_n"]) & (z["z_a"] >= z["z_r"]), "A")
            .when(z["z_n"] >= z["z_r"], "N").otherwise("R"))


def with_teacher(df: DataFrame) -> DataFrame:
    """Teacher class and probabilities from the four feature columns."""
    z = teacher_logits()
    total = F.exp("z_a") + F.exp("z_n") + F.exp("z_r")
    probs = {f"p_{c}": F.round(F.exp(f"z_{c}") / total, 6) for c in "anr"}
    return df.withColumns({**z, "t": teacher_class()}).withColumns(probs).drop(*z).withColumn("conf", F.greatest("p_a", "p_n", "p_r"))


def observed(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("okey"), F.col("l_partkey").alias("pkey"), F.col("l_suppkey").alias("skey"),
        F.col("l_linenumber").alias("lno"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("y"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipdate"),
    )


def scored(t: Tables) -> DataFrame:
    return SURROGATE.score(with_teacher(observed(t)), prediction="s", node="leaf")


OBSERVED = """
observed AS (SELECT l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey, l_linenumber AS lno, l_quantity AS qty,
  l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS y, l_linestatus AS status, l_shipdate AS shipdate FROM lineitem)"""

SCORED = OBSERVED + """,
logits AS (SELECT *, 0.04::DOUBLE*qty - 10.0::DOUBLE*disc AS z_a, price/40000.0::DOUBLE - 10.0::DOUBLE*tax AS z_n,
  0.5::DOUBLE + 10.0::DOUBLE*disc - 0.02::DOUBLE*qty AS z_r FROM observed),
probs AS (SELECT *, CASE WHEN z_a >= z_n AND z_a >= z_r THEN 'A' WHEN z_n >= z_r THEN 'N' ELSE 'R' END AS t,
  round(exp(z_a)/(exp(z_a)+exp(z_n)+exp(z_r)),6) AS p_a, round(exp(z_n)/(exp(z_a)+exp(z_n)+exp(z_r)),6) AS p_n,
  round(exp(z_r)/(exp(z_a)+exp(z_n)+exp(z_r)),6) AS p_r FROM logits),
scored AS (SELECT okey, pkey, skey, lno, qty, price, disc, tax, y, status, shipdate, t, p_a, p_n, p_r, greatest(p_a,p_n,p_r) AS conf,
  CASE WHEN price <= 60000 THEN CASE WHEN qty <= 28 THEN 'R' ELSE 'A' END ELSE 'N' END AS s,
  CASE WHEN price <= 60000 THEN CASE WHEN qty <= 28 THEN 4 ELSE 5 END ELSE 3 END AS leaf FROM probs)"""

# Arms compared by the benchmark operators: name -> predicted class.  "shuffled" is the negative control.
ARMS = {
    "teacher": "t",
    "full": "CASE WHEN price <= 55000 THEN CASE WHEN qty <= 30 THEN 'R' ELSE 'A' END ELSE 'N' END",
    "core": "s",
    "plain": "CASE WHEN price <= 50000 THEN 'R' ELSE 'N' END",
    "shuffled": "CASE WHEN tax <= 0.04 THEN CASE WHEN disc <= 0.05 THEN 'R' ELSE 'A' END ELSE 'N' END",
}


def predictions(t: Tables) -> DataFrame:
    """One row per line item with the predicted class of every arm as a column."""
    return scored(t).withColumns({f"arm_{a}": F.expr(e) for a, e in ARMS.items()})


def runs(t: Tables) -> DataFrame:
    """(dataset, arm, split_id, metric, value, n_test, oracle_name): dataset = ship year, split = month.

    Aggregated wide first, so the scan shuffles one partial row per (dataset, split).
    """
    rows = predictions(t).withColumns({"dataset": F.year("shipdate"), "split_id": F.month("shipdate")})
    aggs = [F.count(F.lit(1)).alias("n_test")]
    for a in ARMS:
        aggs += [F.sum(F.when(F.col(f"arm_{a}") == F.col("y"), 1).otherwise(0)).alias(f"acc_{a}"),
                 F.sum(F.when(F.col(f"arm_{a}") == F.col("t"), 1).otherwise(0)).alias(f"fid_{a}")]
    wide = rows.groupBy("dataset", "split_id").agg(*aggs)
    cells = [F.struct(F.lit(a).alias("arm"), F.lit(m).alias("metric"), (F.col(f"{p}_{a}") / F.col("n_test")).alias("value"))
             for a in ARMS for m, p in (("accuracy", "acc"), ("fidelity", "fid")) if (a, m) != ("teacher", "fidelity")]
    return wide.select("dataset", "split_id", "n_test", F.lit("closed_form").alias("oracle_name"), F.explode(F.array(*cells)).alias("c")).select(
        "dataset", "split_id", "n_test", "oracle_name", "c.*")


RUNS = SCORED + """,
wide AS (SELECT year(shipdate) AS dataset, month(shipdate) AS split_id, count(*) AS n_test, """ + ", ".join(
    f"sum(CASE WHEN ({e}) = y THEN 1 ELSE 0 END)::DOUBLE AS acc_{a}, sum(CASE WHEN ({e}) = t THEN 1 ELSE 0 END)::DOUBLE AS fid_{a}"
    for a, e in ARMS.items()) + """ FROM scored GROUP BY 1, 2),
runs AS (""" + " UNION ALL ".join(
    f"SELECT dataset, split_id, n_test, 'closed_form' AS oracle_name, '{a}' AS arm, '{m}' AS metric, {p}_{a}/n_test AS value FROM wide"
    for a in ARMS for m, p in (("accuracy", "acc"), ("fidelity", "fid")) if (a, m) != ("teacher", "fidelity")) + ")"


def cases(t: Tables) -> DataFrame:
    """One row per order with a unique id, mixed column kinds and a three-class label."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("total"),
                             F.col("o_orderdate").alias("odate"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"),
                             F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("label"))
    people = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"),
                               F.col("c_mktsegment").alias("segment"))
    return orders.join(people, "cust")


CASES = """cases AS (SELECT o_custkey AS cust, o_orderkey AS id, o_totalprice AS total, o_orderdate AS odate, month(o_orderdate) AS month, year(o_orderdate) AS year,
  o_orderpriority AS priority, o_orderstatus AS label, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)"""


def raw_text(t: Tables) -> DataFrame:
    """Orders as a messy text table: missing markers, mixed numbers, dates, yes/no flags, a constant."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.when(k % 13 == 0, " N/A ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 17 == 0, "?").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 19 == 0, "abc").otherwise(k.cast("string")).alias("mixed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"),
        F.col("o_orderkey").cast("string").alias("code"), (k % 5).cast("string").alias("grade"), F.lit("x").alias("same"),
        F.when(k % 2 == 1, "null").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 23 == 0, "NA").otherwise((k % 2).cast("string")).alias("paid"), F.when(k % 3 == 0, "Sim").otherwise("não").alias("urgente"), F.when(k % 3 == 0, "si").otherwise("no").alias("gift"))


RAW_TEXT = """raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN ' N/A ' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE o_totalprice::VARCHAR END AS price, CASE WHEN o_orderkey % 19 = 0 THEN 'abc' ELSE o_orderkey::VARCHAR END AS mixed,
  strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, o_orderkey::VARCHAR AS code,
  (o_orderkey % 5)::VARCHAR AS grade, 'x' AS same, CASE WHEN o_orderkey % 2 = 1 THEN 'null' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 23 = 0 THEN 'NA' ELSE (o_orderkey % 2)::VARCHAR END AS paid, CASE WHEN o_orderkey % 3 = 0 THEN 'Sim' ELSE 'não' END AS urgente, CASE WHEN o_orderkey % 3 = 0 THEN 'si' ELSE 'no' END AS gift FROM orders)"""
RAW_COLUMNS = ["status", "price", "mixed", "day", "flag", "code", "grade", "same", "priority", "paid", "urgente", "gift"]


CASE_FEATURES = ["total", "balance", "month", "nation"]
CASE_CLASSES = ["bronze", "gold", "silver"]


def case_scores(cols=None) -> dict:
    c = {f: (cols[f] if cols else F.col(f)) for f in CASE_FEATURES}
    return {"bronze": F.lit(0.2), "gold": c["total"] / F.lit(200000.0) + c["balance"] / F.lit(10000.0) - F.lit(1.2),
            "silver": c["month"] / F.lit(6.0) - c["total"] / F.lit(400000.0) - F.lit(0.3)}


def case_teacher(cols=None):
    """Closed-form teacher of the order table."""
    s = case_scores(cols)
    return F.when((s["gold"] >= s["silver"]) & (s["gold"] >= s["bronze"]), "gold").when(s["silver"] >= s["bronze"], "silver").otherwise("bronze")


def case_margin(target, cols=None):
    """Score of a class minus the best other score; the teacher says ``target`` where this is positive."""
    s = case_scores(cols)
    return s[target] - F.greatest(*[v for k, v in s.items() if k != target])


def judged(t: Tables) -> DataFrame:
    """Orders with the teacher's class, numeric features as doubles."""
    return cases(t).withColumns({f: F.col(f).cast("double") for f in CASE_FEATURES}).withColumn("cls", case_teacher())


JUDGED = CASES + """, j0 AS (SELECT id, cust, odate, year, priority, label, segment, total, balance, month::DOUBLE AS month, nation::DOUBLE AS nation, 0.2::DOUBLE AS s_bronze,
  total/200000.0::DOUBLE + balance/10000.0::DOUBLE - 1.2::DOUBLE AS s_gold, month/6.0::DOUBLE - total/400000.0::DOUBLE - 0.3::DOUBLE AS s_silver FROM cases),
judged AS (SELECT *, CASE WHEN s_gold >= s_silver AND s_gold >= s_bronze THEN 'gold' WHEN s_silver >= s_bronze THEN 'silver' ELSE 'bronze' END AS cls FROM j0)"""
