"""Registered tree queries: split scoring and rules on line items, growth loops, selection among grown trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions.shapes import long_form
from rulelens.operators import growth as G
from rulelens.operators import trees as TR
from rulelens.plans.bases import CLASSES, FEATURES, RUNS, SCORED, SURROGATE, runs, scored
from rulelens.plans.prep import ent, gain_sql
from rulelens.plans.registry import query

BIG = [("qty", ">", 25.0), ("disc", ">", 0.05), ("tax", "<=", 0.03)]
BIG_SQL = "((qty > 25)::INT + (disc > 0.05)::INT + (tax <= 0.03)::INT)"
SEARCHED = ["qty", "disc", "tax"]


def nodes(t):
    return SURROGATE.table(t.spark)


@query("tr01_m_of_n", f"WITH {SCORED} SELECT {BIG_SQL} >= 2 AS two_of_three, {BIG_SQL} >= 1 AS any_of_three, count(*) AS n, count_if(t='R') AS teacher_r FROM scored GROUP BY 1, 2", ints="n teacher_r")
def _(t):
    return scored(t).groupBy(TR.m_of_n(2, BIG).alias("two_of_three"), TR.m_of_n(1, BIG).alias("any_of_three")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == "R").alias("teacher_r"))


@query("tr02_path_filter", f"WITH {SCORED} SELECT leaf, count(*) AS n, avg(price) AS mean_price FROM scored WHERE price <= 60000 AND NOT qty <= 28 GROUP BY leaf", floats="mean_price", ints="leaf n")
def _(t):
    return scored(t).filter(SURROGATE.accepts(5)).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"))


DIST = SCORED + """, nd AS (SELECT leaf AS node_id, t AS label, count(*) AS n FROM scored GROUP BY 1, 2), dist AS (SELECT node_id, first(label ORDER BY n DESC, label) AS prediction, sum(n) AS rows, max(n)/sum(n) AS fidelity, sum(n)/(SELECT count(*) FROM scored) AS reach FROM nd GROUP BY 1)"""


@query("tr03_node_distribution", f"WITH {DIST} SELECT *, reach*(1-fidelity) AS priority FROM dist", floats="fidelity reach priority", ints="node_id rows")
def _(t):
    return TR.node_distribution(scored(t), "leaf", "t")


@query("tr04_purity", f"""WITH {DIST}, w AS (SELECT node_id, ((fidelity + 1.96*1.96/(2*rows)) - 1.96*sqrt((fidelity*(1-fidelity) + 1.96*1.96/(4*rows))/rows))/(1+1.96*1.96/rows) AS wilson_low FROM dist)
SELECT node_id, wilson_low, wilson_low >= 0.5 AS pure FROM w""", floats="wilson_low", ints="node_id")
def _(t):
    return TR.purity(TR.node_distribution(scored(t), "leaf", "t"), epsilon=0.5).select("node_id", "wilson_low", "pure")


def counts(t, features=("qty", "disc", "tax", "price")):
    return TR.value_class_counts(scored(t), "leaf", "t", list(features), CLASSES)


LONG4 = " UNION ALL ".join(f"SELECT leaf, '{f}' AS feature, {f} AS value, t FROM scored" for f in FEATURES)
HIST = SCORED + f", lng AS ({LONG4}), hist AS (SELECT leaf, feature, value, {', '.join(f'''count_if(t='{c}') AS n{c}''' for c in CLASSES)} FROM lng GROUP BY 1, 2, 3)"
CUTS = HIST + f""", run AS (SELECT *, {', '.join(f'sum(n{c}) OVER w AS y{c}, sum(n{c}) OVER p AS t{c}, lead(n{c}) OVER o AS x{c}' for c in CLASSES)}, lead(value) OVER o AS nv FROM hist
 WINDOW w AS (PARTITION BY leaf, feature ORDER BY value), o AS (PARTITION BY leaf, feature ORDER BY value), p AS (PARTITION BY leaf, feature)),
cuts AS (SELECT leaf, feature, (value+nv)/2 AS thr, {', '.join(f'y{c}, t{c}' for c in CLASSES)} FROM run WHERE nv IS NOT NULL AND {'+'.join(f'(n{c}+x{c} > 0)::INT' for c in CLASSES)} <> 1)"""
SPREAD = CUTS + """, pos AS (SELECT *, row_number() OVER (PARTITION BY leaf, feature ORDER BY thr)-1 AS ps, count(*) OVER (PARTITION BY leaf, feature) AS size FROM cuts),
spread AS (SELECT * FROM pos WHERE size <= 24 OR ps IN (SELECT round_even(j*(size-1)/23.0::DOUBLE, 0) FROM range(24) r(j)))"""


@query("tr05_boundaries", f"WITH {SPREAD} SELECT leaf, feature, thr, yA, yN, yR FROM spread", floats="thr", ints="leaf yA yN yR")
def _(t):
    cuts = TR.spread_evenly(TR.boundaries(counts(t), "leaf", CLASSES), "leaf")
    return cuts.select("leaf", "feature", "thr", *[F.col(f"l_n_{c}").alias(f"y{c}") for c in CLASSES])


Y3, T3 = [f"y{c}" for c in CLASSES], [f"t{c}" for c in CLASSES]
NL, NT = "(yA+yN+yR)", "(tA+tN+tR)"
GAIN = gain_sql(Y3, T3)
SCOREDCUTS = SPREAD + f""", sc AS (SELECT leaf, feature, thr, {NL} AS n_left, {NT}-{NL} AS n_right, {GAIN} AS gain, {ent(['(yA+yN+yR)', '(tA+tN+tR-yA-yN-yR)'])} AS info, {ent(T3)} AS h,
 (greatest(yA,yN,yR)+greatest(tA-yA,tN-yN,tR-yR))/{NT}::DOUBLE AS split_fidelity FROM spread WHERE {NL} >= 50 AND {NT}-{NL} >= 50)"""


def cut_gains(t):
    return TR.gains(TR.spread_evenly(TR.boundaries(counts(t), "leaf", CLASSES), "leaf"), CLASSES, 50)


@query("tr06_information_gain", f"WITH {SCOREDCUTS} SELECT leaf, feature, thr, n_left, n_right, gain FROM sc", floats="thr gain", ints="leaf n_left n_right")
def _(t):
    return cut_gains(t).select("leaf", "feature", "thr", "n_left", "n_right", "gain")


@query("tr07_literal_ranking", f"""WITH {SCOREDCUTS}, v AS (SELECT leaf, feature, var_pop(value) AS variance, list_position(['qty','price','disc','tax'], feature) AS fi FROM lng GROUP BY 1, 2), k AS (SELECT leaf, feature, fi FROM v QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY variance DESC, fi) <= 3),
r AS (SELECT sc.leaf, sc.feature, thr, op, gain, row_number() OVER (PARTITION BY sc.leaf ORDER BY round(gain, 12) DESC, fi, thr, op DESC) AS rank FROM sc JOIN k USING (leaf, feature), (VALUES ('>'),('<=')) o(op))
SELECT leaf, feature, thr, op, gain, rank FROM r WHERE rank <= 10""", floats="thr gain", ints="leaf rank")
def _(t):
    return TR.rank_literals(scored(t), cut_gains(t), "leaf", FEATURES, top_features=3, pool=10).select("leaf", "feature", "thr", "op", "gain", "rank")


def searched(t, widest=False):
    """Literal pools of the three leaves, ready for a beam search (or one literal per feature and direction)."""
    rows = scored(t).select("leaf", "t", *FEATURES)
    cfg = G.Growth(bins=16, pool=10 ** 6 if widest else 16, min_leaf=50)
    edges = G.bin_edges(rows, FEATURES, cfg.bins)
    tables = G.histograms(G.with_bins(rows, edges), F.col("leaf").cast("long"), "t", CLASSES, edges)
    pools = {i: G.literal_pool(tb, edges, cfg) for i, tb in tables.items()}
    if widest:
        pools = {i: G.one_per_direction(p) for i, p in pools.items()}
    return rows.withColumnRenamed("leaf", "node_id"), pools, cfg


@query("tr08_beam_search")
def _(t):
    rows, pools, cfg = searched(t)
    patterns = TR.mask_counts(rows, "node_id", "t", CLASSES, {i: [l for _, l in p] for i, p in pools.items()}).persist()
    found = G.beam_search(patterns, pools, CLASSES, cfg)
    return t.spark.createDataFrame([(int(i), TR.test_text(m, lits), round(score, 6)) for i, (score, m, lits) in sorted(found.items())], "node_id long, test string, gain double")


@query("tr09_partition_difference", f"""WITH {SCORED}, o AS (SELECT leaf, count_if(price > 30000 AND qty > 25) AS a, count_if(price > 30000 AND qty <= 25) AS b, count_if(price <= 30000 AND qty > 25) AS c, count_if(price <= 30000 AND qty <= 25) AS d FROM scored GROUP BY 1)
SELECT leaf, CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) > 0 THEN (a+b+c+d)*(a*d-b*c)::DOUBLE**2/((a+b)::DOUBLE*(c+d)*(a+c)*(b+d)) END AS chi2 FROM o""", floats="chi2", ints="leaf")
def _(t):
    x, y = F.col("price") > 30000, F.col("qty") > 25
    n = scored(t).groupBy("leaf").agg(*[F.count_if(c).cast("double").alias(k) for k, c in dict(a=x & y, b=x & ~y, c=~x & y, d=~x & ~y).items()])
    return n.select("leaf", TR.partition_chi2(*[F.col(k) for k in "abcd"]).alias("chi2"))


def grown(t, **settings):
    return G.grow(scored(t).select("t", *FEATURES), FEATURES, "t", CLASSES, G.Growth(**({"max_nodes": 9, "bins": 16, "pool": 12, "min_leaf": 20} | settings)))


@query("tr10_surrogate_growth")
def _(t):
    got = grown(t)
    tested = got.tree.score(scored(t).select("t", *FEATURES), "guess", "node_id")
    return tested.groupBy("node_id", "guess").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("t")).cast("double")), 6).alias("fidelity"))


@query("tr11_stop_summary")
def _(t):
    return G.stop_summary(G.log_table(t.spark, grown(t, max_depth=2).log))


EQUAL = TR.RuleTree.from_rows([
    dict(node_id=1, parent_id=None, branch=None, m=1, literals=[("price", "<=", 60000.0)], prediction=None), dict(node_id=2, parent_id=1, branch="yes", m=1, literals=[("qty", "<=", 28.0)], prediction=None),
    dict(node_id=3, parent_id=1, branch="no", m=0, literals=[], prediction="N"), dict(node_id=4, parent_id=2, branch="yes", m=0, literals=[], prediction="R"), dict(node_id=5, parent_id=2, branch="no", m=0, literals=[], prediction="R")])


@query("tr12_equal_leaf_pruning", f"WITH {SCORED} SELECT CASE WHEN price <= 60000 THEN 2 ELSE 3 END AS node_id, CASE WHEN price <= 60000 THEN 'R' ELSE 'N' END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2", ints="node_id n")
def _(t):
    kept = TR.prune_equal_leaves(EQUAL.table(t.spark))
    rows = EQUAL.pruned().score(scored(t), "prediction", "node_id").groupBy("node_id", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(kept.select("node_id", "prediction"), ["node_id", "prediction"], "left_semi")


@query("tr13_rule_table", f"""WITH {SCORED} SELECT leaf AS node_id, s AS prediction, CASE leaf WHEN 3 THEN 1 ELSE 2 END AS length, CASE leaf WHEN 3 THEN 'not 1-of-1(price <= 60000.0)' WHEN 4 THEN '1-of-1(price <= 60000.0) & 1-of-1(qty <= 28.0)' ELSE '1-of-1(price <= 60000.0) & not 1-of-1(qty <= 28.0)' END AS conditions,
 count(*) AS support, avg((t=s)::INT) AS confidence FROM scored GROUP BY 1, 2""", floats="confidence", ints="node_id length support")
def _(t):
    stats = scored(t).groupBy(F.col("leaf").alias("node_id")).agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("t") == F.col("s")).cast("double")).alias("confidence"))
    return TR.rules(nodes(t), t.spark).join(stats, "node_id")


@query("tr14_rule_scoring", f"WITH {SCORED}, d AS (SELECT leaf, avg((t='A')::INT) AS p_leaf_a FROM scored GROUP BY 1) SELECT s AS prediction, leaf, y, count(*) AS n, max(p_leaf_a) AS p_leaf_a FROM scored JOIN d USING (leaf) GROUP BY 1, 2, 3", floats="p_leaf_a", ints="leaf n")
def _(t):
    rows = scored(t)
    shares = rows.groupBy("leaf").agg(F.avg((F.col("t") == "A").cast("double")).alias("p_leaf_a"))
    return rows.join(shares, "leaf").groupBy(F.col("s").alias("prediction"), "leaf", "y").agg(F.count(F.lit(1)).alias("n"), F.max("p_leaf_a").alias("p_leaf_a"))


GAPS = HIST.replace("price AS value", "CASE WHEN price > 90000 THEN NULL ELSE price END AS value")
GRATIO = CUTS.replace(HIST, GAPS).replace("FROM hist\n WINDOW", "FROM hist WHERE value IS NOT NULL\n WINDOW") + f""", mis AS (SELECT leaf, feature, sum(nA+nN+nR) AS w_all, coalesce(sum(nA+nN+nR) FILTER (value IS NULL), 0) AS w_missing FROM hist GROUP BY 1, 2),
cg AS (SELECT c.*, w_all, w_missing, count(*) OVER (PARTITION BY leaf, feature) AS n_cuts FROM cuts c JOIN mis USING (leaf, feature)),
pg AS (SELECT *, greatest(0, {NT}/w_all*({GAIN}) - CASE WHEN n_cuts > 1 THEN log2(n_cuts)/w_all ELSE 0 END) AS gain, {ent(['(yA+yN+yR)', '(tA+tN+tR-yA-yN-yR)', 'w_missing'])} AS info FROM cg WHERE {NL} >= 2 AND {NT}-{NL} >= 2),
rg AS (SELECT *, CASE WHEN info <> 0 THEN gain/info ELSE 0 END AS gain_ratio FROM pg),
numeric_best AS (SELECT leaf, feature, thr, gain, gain_ratio, {NL}::DOUBLE/{NT} AS prior_left FROM rg QUALIFY row_number() OVER (PARTITION BY leaf, feature ORDER BY round(gain_ratio, 12) DESC, round(gain, 12) DESC, thr) = 1)"""


def gappy(t):
    return scored(t).withColumn("price", F.when(F.col("price") <= 90000, F.col("price")))


def numeric_best(t):
    return TR.numeric_gain_ratio(TR.value_class_counts(gappy(t), "leaf", "t", FEATURES, CLASSES), "leaf", CLASSES)


@query("tr15_numeric_gain_ratio", f"WITH {GRATIO} SELECT * FROM numeric_best", floats="thr gain gain_ratio prior_left", ints="leaf")
def _(t):
    return numeric_best(t).select("leaf", "feature", "thr", "gain", "gain_ratio", "prior_left")


CAT = SCORED + f""", cl AS (SELECT leaf, 'lno' AS feature, lno::VARCHAR AS v, t FROM scored UNION ALL SELECT leaf, 'status', CASE WHEN qty > 45 THEN NULL ELSE status END, t FROM scored),
cc AS (SELECT leaf, feature, v, {', '.join(f"count_if(t='{c}') AS b{c}" for c in CLASSES)}, count(*) AS n FROM cl GROUP BY 1, 2, 3),
ch AS (SELECT *, n*({ent([f'b{c}' for c in CLASSES])}) AS h FROM cc),
ca AS (SELECT leaf, feature, count(v) AS branches, min(n) FILTER (v IS NOT NULL) AS smallest, sum(n) FILTER (v IS NOT NULL) AS known, sum(n) AS total, sum(h) FILTER (v IS NOT NULL) AS child, sum(n*log2(n)) AS nlogn,
 {', '.join(f'sum(b{c}) FILTER (v IS NOT NULL) AS t{c}' for c in CLASSES)} FROM ch GROUP BY 1, 2),
cat_best AS (SELECT leaf, feature, branches, known/total*({ent(T3)}-child/known) AS gain, CASE WHEN log2(total)-nlogn/total <> 0 THEN known/total*({ent(T3)}-child/known)/(log2(total)-nlogn/total) ELSE 0 END AS gain_ratio FROM ca WHERE branches >= 2 AND smallest >= 2)"""


def categorical_best(t):
    rows = scored(t).withColumn("status", F.when(F.col("qty") <= 45, F.col("status")))
    return TR.categorical_gain_ratio(rows, "leaf", "t", ["lno", "status"], CLASSES)


@query("tr16_categorical_gain_ratio", f"WITH {CAT} SELECT * FROM cat_best", floats="gain gain_ratio", ints="leaf branches")
def _(t):
    return categorical_best(t)


@query("tr17_split_choice", f"""WITH {GRATIO}, {CAT[len(SCORED) + 2:]}, al AS (SELECT leaf, feature, gain, gain_ratio FROM numeric_best UNION ALL SELECT leaf, feature, gain, gain_ratio FROM cat_best), u AS (SELECT *, avg(gain) OVER (PARTITION BY leaf) AS mean_gain FROM al WHERE gain > 1e-12)
SELECT leaf, feature, gain, gain_ratio FROM u WHERE gain + 1e-12 >= mean_gain QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY round(gain_ratio, 12) DESC, round(gain, 12) DESC, feature) = 1""", floats="gain gain_ratio", ints="leaf")
def _(t):
    cols = ["leaf", "feature", "gain", "gain_ratio"]
    return TR.choose_split(numeric_best(t).select(*cols).unionByName(categorical_best(t).select(*cols)), "leaf").select(*cols)


@query("tr18_fractional_routing", f"""WITH {SCORED}, g AS (SELECT y, CASE WHEN price > 90000 THEN NULL ELSE price END AS price FROM scored), r AS (SELECT y, 'left' AS branch, CASE WHEN price IS NULL THEN 0.4 WHEN price <= 40000 THEN 1 ELSE 0 END AS w FROM g
UNION ALL SELECT y, 'right', CASE WHEN price IS NULL THEN 0.6 WHEN price > 40000 THEN 1 ELSE 0 END FROM g) SELECT branch, y, sum(w)::DOUBLE AS w FROM r WHERE w > 0 GROUP BY 1, 2""", floats="w")
def _(t):
    return TR.route_fractionally(gappy(t).select("y", "price").withColumn("w", F.lit(1.0)), "price", 40000.0, 0.4).groupBy("branch", "y").agg(F.sum("w").alias("w"))


def gain_ratio_tree(t, depth=3):
    rows = gappy(t).select("t", "status", *FEATURES)
    return rows, G.grow_gain_ratio(rows, FEATURES, ["status"], "t", CLASSES, max_depth=depth, bins=16)


@query("tr19_gain_ratio_growth")
def _(t):
    rows, tree = gain_ratio_tree(t)
    return tree.probabilities(rows).groupBy("t", "prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share_A"), 6).alias("mean_share_a"))


@query("tr20_pessimistic_pruning")
def _(t):
    rows, tree = gain_ratio_tree(t, 4)
    pruned, audit = G.prune_pessimistic(tree)
    out = pruned.probabilities(rows).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("t")).cast("double")), 6).alias("fidelity"))
    return out.withColumns({"nodes_before": F.lit(len(tree.nodes)), "nodes_after": F.lit(len(pruned.nodes)), "collapsed": F.lit(len(audit))})


@query("tr21_feature_importance", f"""WITH {SCOREDCUTS}, b AS (SELECT leaf, feature, max(gain) AS gain, max(n_left+n_right) AS n FROM sc GROUP BY 1, 2), m AS (SELECT feature, sum(gain*n) AS mass FROM b GROUP BY 1) SELECT feature, mass/(SELECT sum(mass) FROM m) AS importance FROM m""", floats="importance")
def _(t):
    best = cut_gains(t).groupBy("leaf", "feature").agg(F.max("gain").alias("gain"), F.max(F.col("n_left") + F.col("n_right")).alias("n"))
    return TR.importance(best)


@query("tr22_structure", f"WITH {SCORED} SELECT status, 5 AS nodes, 3 AS leaves, 2 AS depth, 5.0::DOUBLE/3 AS mean_rule_length, 2 AS features, 2 AS literals, count(*) AS rows FROM scored GROUP BY status", floats="mean_rule_length", ints="nodes leaves depth features literals rows")
def _(t):
    shape = TR.structure(nodes(t).withColumn("tree_id", F.lit("surrogate")), ["tree_id"])
    used = SURROGATE.score(scored(t), "s2", "n2").groupBy("status").agg(F.count(F.lit(1)).alias("rows")).withColumn("tree_id", F.lit("surrogate"))
    return used.join(shape, "tree_id").drop("tree_id")


@query("tr22_split_signatures", f"""WITH {SCORED}, s AS (SELECT stddev_pop(price) AS sp, stddev_pop(qty) AS sq FROM scored) SELECT 1 AS node_id, 'price' AS feature, '<=' AS op, floor(60000/(0.5*sp)) AS band FROM s UNION ALL SELECT 2, 'qty', '<=', floor(28/(0.5*sq)) FROM s""", ints="node_id band")
def _(t):
    return TR.split_signatures(nodes(t), scored(t).agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first().asDict())


SEMANTIC = SCOREDCUTS + """, sem AS (SELECT *, CASE feature WHEN 'price' THEN 1.3 WHEN 'qty' THEN 1.1 ELSE 1.0 END::DOUBLE AS weight, CASE feature WHEN 'price' THEN 0.8 WHEN 'qty' THEN 0.4 ELSE 0.1 END::DOUBLE AS semantic_depth,
 CASE feature WHEN 'disc' THEN 0.9 ELSE 0.2 END::DOUBLE AS error_coverage, n_left+n_right AS n, row_number() OVER (PARTITION BY leaf ORDER BY feature, thr) AS test_id FROM sc),
sem2 AS (SELECT *, weight-1 AS lift, 0.05*semantic_depth+0.1*error_coverage AS extra, CASE WHEN gain <= 1e-12 THEN 0 ELSE gain*weight+0.05*semantic_depth+0.1*error_coverage END AS semantic_score FROM sem)"""


def semantic_candidates(t):
    pick = lambda m, d: F.coalesce(*[F.when(F.col("feature") == k, v) for k, v in m.items()], F.lit(d))
    c = cut_gains(t).withColumns({"weight": pick({"price": 1.3, "qty": 1.1}, 1.0), "semantic_depth": pick({"price": 0.8, "qty": 0.4}, 0.1), "error_coverage": pick({"disc": 0.9}, 0.2), "n": F.col("n_left") + F.col("n_right")})
    return TR.semantic_terms(c)


@query("tr23_semantic_score", f"WITH {SEMANTIC} SELECT leaf, feature, thr, gain, semantic_score FROM sem2", floats="thr gain semantic_score", ints="leaf")
def _(t):
    return semantic_candidates(t).select("leaf", "feature", "thr", "gain", "semantic_score")


@query("tr23_test_weights", f"""WITH {SCORED}, p AS (SELECT 'price' AS a, 'qty' AS b, abs(corr(price, qty)) AS r FROM scored UNION ALL SELECT 'disc', 'tax', abs(corr(disc, tax)) FROM scored),
tst AS (SELECT * FROM (VALUES (0,'price','qty'),(1,'disc','tax'),(2,'price','disc')) v(test_id, a, b)), w AS (SELECT * FROM (VALUES ('price',1.3),('qty',1.1),('disc',1.0),('tax',1.0)) v(f, w))
SELECT test_id, exp((ln(x.w::DOUBLE)+ln(z.w::DOUBLE))/2) AS base, CASE WHEN test_id < 2 THEN 1.0 ELSE coalesce(r, 0) END AS coherence, exp((ln(x.w::DOUBLE)+ln(z.w::DOUBLE))/2)*(1+0.15*CASE WHEN test_id < 2 THEN 1.0 ELSE coalesce(r, 0) END) AS weight
FROM tst JOIN w x ON x.f = tst.a JOIN w z ON z.f = tst.b LEFT JOIN p ON p.a = tst.a AND p.b = tst.b""", floats="base coherence weight", ints="test_id")
def _(t):
    s = t.spark
    rel = scored(t).agg(F.array(F.struct(F.lit("price").alias("left_feature"), F.lit("qty").alias("right_feature"), F.abs(F.corr("price", "qty")).alias("r")),
                                F.struct(F.lit("disc").alias("left_feature"), F.lit("tax").alias("right_feature"), F.abs(F.corr("disc", "tax")).alias("r"))).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    tests = s.createDataFrame([(0, ["price", "qty"]), (1, ["disc", "tax"]), (2, ["price", "disc"])], "test_id int, features array<string>")
    weights = s.createDataFrame([("price", 1.3), ("qty", 1.1), ("disc", 1.0), ("tax", 1.0)], "feature string, weight double")
    groups = s.createDataFrame([("price", "size"), ("qty", "size"), ("disc", "rates"), ("tax", "rates")], "feature string, grp string")
    return TR.test_weights(tests, weights, rel, groups)


@query("tr24_calibrated_scores", f"""WITH {SEMANTIC} SELECT leaf, feature, thr, CASE WHEN gain <= 1e-12 THEN 0 ELSE gain+greatest(-0.2*gain, least(0.2*gain, gain*lift+extra)) END AS bounded, CASE WHEN gain <= 1e-12 THEN 0 ELSE gain+0.2*gain*tanh((gain*lift+extra)/(0.2*gain)) END AS calibrated,
 CASE WHEN gain <= 1e-12 THEN 0 ELSE gain+1/sqrt(n)*greatest(-1, least(1, lift+extra)) END AS tiebreak FROM sem2""", floats="thr bounded calibrated tiebreak", ints="leaf")
def _(t):
    return TR.calibrated_scores(semantic_candidates(t)).select("leaf", "feature", "thr", "bounded", "calibrated", "tiebreak")


@query("tr25_gain_ratio_of_test", f"WITH {SCOREDCUTS} SELECT leaf, feature, thr, CASE WHEN info <> 0 THEN gain/info ELSE 0 END AS gain_ratio, CASE WHEN h <> 0 THEN gain/h ELSE 0 END AS normalised_gain FROM sc", floats="thr gain_ratio normalised_gain", ints="leaf")
def _(t):
    return cut_gains(t).select("leaf", "feature", "thr", "gain_ratio", "normalised_gain")


UNC = "(-(CASE WHEN p_a > 0 THEN p_a*ln(p_a) ELSE 0 END + CASE WHEN p_n > 0 THEN p_n*ln(p_n) ELSE 0 END + CASE WHEN p_r > 0 THEN p_r*ln(p_r) ELSE 0 END)/ln(3))"


@query("tr26_error_regions", f"""WITH {SCORED}, e AS (SELECT leaf AS node_id, count(*) AS rows, avg((t<>s)::INT) AS disagreement, avg({UNC}) AS uncertainty, coalesce(avg({UNC}) FILTER (t<>s), 0) AS wrong_uncertainty, avg((disc > 0.05)::INT) AS opportunity FROM scored GROUP BY 1),
p AS (SELECT *, rows/(SELECT count(*) FROM scored)*disagreement*(1+0.5*wrong_uncertainty)*(1+0.5*opportunity) AS priority FROM e)
SELECT *, CASE WHEN max(disagreement >= 0.25) OVER () THEN disagreement >= 0.25 ELSE row_number() OVER (ORDER BY round(priority, 12) DESC, node_id) <= 2 END AS eligible FROM p""",
       floats="disagreement uncertainty wrong_uncertainty opportunity priority", ints="node_id rows")
def _(t):
    return TR.error_regions(scored(t), "leaf", "t", "s", TR.normalised_entropy(["p_a", "p_n", "p_r"]), (F.col("disc") > 0.05).cast("double"))


@query("tr27_error_association", f"""WITH {SCORED}, l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS v, t<>s AS bad FROM scored" for f in FEATURES)}),
m AS (SELECT feature, quantile_cont(v, 0.5) FILTER (bad) AS err, quantile_cont(v, 0.5) FILTER (NOT bad) AS ok, quantile_cont(v, 0.75)-quantile_cont(v, 0.25) AS iqr FROM l GROUP BY 1), r AS (SELECT feature, tanh(abs(err-ok)/iqr) AS raw FROM m)
SELECT feature, raw, raw/max(raw) OVER () AS association FROM r""", floats="raw association")
def _(t):
    return TR.error_association(scored(t), FEATURES, F.col("t") != F.col("s"))


@query("tr28_uncertainty", f"WITH {SCORED} SELECT t, s, avg({UNC}) AS uncertainty, max({UNC}) AS worst FROM scored GROUP BY 1, 2", floats="uncertainty worst")
def _(t):
    u = TR.normalised_entropy(["p_a", "p_n", "p_r"])
    return scored(t).groupBy("t", "s").agg(F.avg(u).alias("uncertainty"), F.max(u).alias("worst"))


@query("tr29_split_fidelity", f"WITH {SCOREDCUTS} SELECT leaf, feature, thr, split_fidelity FROM sc", floats="thr split_fidelity", ints="leaf")
def _(t):
    return cut_gains(t).select("leaf", "feature", "thr", "split_fidelity")


ANCHORS = [dict(qty=10.0, price=20000.0, disc=0.08, tax=0.02), dict(qty=40.0, price=70000.0, disc=0.02, tax=0.06)]


@query("tr30_anchor_similarity", f"""WITH {SCORED}, d AS (SELECT {', '.join(f'stddev_pop({f}) AS d_{f}' for f in FEATURES)} FROM scored), s AS (SELECT t, s, greatest({', '.join('exp(-(' + '+'.join(f'abs({f}-{a[f]}::DOUBLE)/d_{f}' for f in FEATURES) + ')/4)' for a in ANCHORS)}) AS sim FROM scored, d)
SELECT t, s, avg(sim) AS mean_similarity, max(sim) AS best FROM s GROUP BY 1, 2""", floats="mean_similarity best")
def _(t):
    rows = scored(t)
    scales = rows.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first().asDict()
    return TR.anchor_similarity(rows, ANCHORS, FEATURES, scales).groupBy("t", "s").agg(F.avg("similarity").alias("mean_similarity"), F.max("similarity").alias("best"))


@query("tr31_guided_candidates")
def _(t):
    rows, pools, _ = searched(t, widest=True)
    corr = scored(t).agg(F.abs(F.corr("price", "qty")).alias("r")).select(F.lit("price").alias("left_feature"), F.lit("qty").alias("right_feature"), "r")
    groups = t.spark.createDataFrame([("price", "size"), ("qty", "size"), ("disc", "rates"), ("tax", "rates")], "feature string, grp string")
    patterns = TR.mask_counts(rows, "node_id", "t", CLASSES, {i: [l for _, l in p] for i, p in pools.items()})
    tests = {i: x for i, x in G.guided_tests(pools, corr, groups).items() if x}
    return G.guided_candidates(patterns, pools, tests, CLASSES).withColumn("gain", F.round("gain", 6))


@query("tr32_candidate_log", f"""WITH {SEMANTIC}, b AS (SELECT leaf AS node_id, count(*) AS candidates, arg_max(test_id, (round(gain, 12), -test_id)) AS bt, max(round(gain, 12)) AS bg, arg_max(test_id, (round(semantic_score, 12), -test_id)) AS ct, arg_max(gain, (round(semantic_score, 12), -test_id)) AS cg,
 quantile_cont((semantic_score-gain)/gain, 0.5) FILTER (gain > 0) AS median_share FROM sem2 GROUP BY 1) SELECT node_id, candidates, bg-cg AS regret, bt <> ct AS switched, median_share FROM b""", floats="regret median_share", ints="node_id candidates")
def _(t):
    from pyspark.sql import Window
    c = semantic_candidates(t)  # at most 24 thresholds per (leaf, feature)
    log = c.withColumn("test_id", F.row_number().over(Window.partitionBy("leaf").orderBy("feature", "thr"))).withColumnRenamed("leaf", "node_id")
    return TR.candidate_log(log)


USED = RUNS + """, used AS (SELECT arm, dataset AS run, 'month_' || split_id AS feature FROM runs WHERE metric='fidelity' AND value > 0.5)"""


@query("tr33_tree_stability", f"""WITH {USED}, st AS (SELECT arm, run, list(feature) AS fs FROM used GROUP BY 1, 2) SELECT a.arm, avg(len(list_intersect(a.fs, b.fs))/len(list_distinct(list_concat(a.fs, b.fs)))) AS mean_jaccard, count(*) AS pairs FROM st a JOIN st b ON a.arm = b.arm AND a.run < b.run GROUP BY 1""", floats="mean_jaccard", ints="pairs")
def _(t):
    used = runs(t).filter("metric = 'fidelity' AND value > 0.5").select("arm", F.col("dataset").alias("run"), F.concat(F.lit("month_"), F.col("split_id").cast("string")).alias("feature"))
    return TR.tree_stability(used)


@query("tr34_path_recovery", f"WITH {SCORED} SELECT s, count(*) AS n, false AS same_test, true AS same_path FROM scored GROUP BY s", ints="n")
def _(t):
    rows = [(i, [sorted({l[0] for l in test["literals"]}) for test, _ in SURROGATE.path(i)]) for i in SURROGATE.leaves()]
    found = TR.path_recovery(t.spark.createDataFrame(rows, "leaf int, tests array<array<string>>"), ["price", "qty"]).first()
    return scored(t).groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumns({"same_test": F.lit(found["same_test"]), "same_path": F.lit(found["same_path"])})


def path_tests(tree):
    out = []
    for i, n in tree.nodes.items():
        if n["literals"]:
            out.append(("/".join("yes" if o else "no" for _, o in tree.path(i)) or "root", TR.test_text(n["m"], n["literals"])))
    return out


@query("tr35_node_differences")
def _(t):
    full, part = grown(t, max_nodes=7).tree, G.grow(scored(t).select("t", "qty", "disc", "tax"), ["qty", "disc", "tax"], "t", CLASSES, G.Growth(max_nodes=7, bins=16, pool=12, min_leaf=20)).tree
    schema = "path string, test string"
    return TR.node_differences(t.spark.createDataFrame(path_tests(full), schema), t.spark.createDataFrame(path_tests(part), schema))


TUNE = SCORED + """, lv AS (SELECT okey % 6 AS fold, c.config, c.max_nodes, avg((CASE c.config WHEN 'a' THEN CASE WHEN price <= 50000 THEN 'R' ELSE 'N' END WHEN 'b' THEN s WHEN 'c' THEN CASE WHEN price <= 55000 THEN CASE WHEN qty <= 30 THEN 'R' ELSE 'A' END ELSE 'N' END ELSE CASE WHEN tax <= 0.04 THEN 'R' ELSE 'N' END END = t)::INT) AS fidelity,
 c.max_nodes - CASE WHEN okey % 6 = 0 THEN 2 ELSE 0 END AS nodes FROM scored, (VALUES ('a', 3), ('b', 5), ('c', 7), ('d', 9)) c(config, max_nodes) GROUP BY 1, 2, 3, 5)"""
CONFIGS = {"a": ("CASE WHEN price <= 50000 THEN 'R' ELSE 'N' END", 3), "b": ("s", 5), "c": ("CASE WHEN price <= 55000 THEN CASE WHEN qty <= 30 THEN 'R' ELSE 'A' END ELSE 'N' END", 7), "d": ("CASE WHEN tax <= 0.04 THEN 'R' ELSE 'N' END", 9)}


def tuning(t):
    """Fidelity per (fold, configuration) of four fixed rule sets of growing size."""
    rows = scored(t).withColumn("fold", F.col("okey") % 6)
    wide = rows.groupBy("fold").agg(*[F.avg((F.expr(e) == F.col("t")).cast("double")).alias(c) for c, (e, _) in CONFIGS.items()])
    size = F.create_map(*[F.lit(x) for c, (_, m) in CONFIGS.items() for x in (c, m)])
    return long_form(wide, ["fold"], list(CONFIGS), "config", "fidelity").withColumn("max_nodes", size[F.col("config")]).withColumn("nodes", F.col("max_nodes") - F.when(F.col("fold") == 0, 2).otherwise(0))


T_CRIT = 2.015048  # one-sided 5 % point of t with 5 degrees of freedom


@query("tr36_lexicographic_choice", f"""WITH {TUNE}, st AS (SELECT config, avg(fidelity) AS mean, stddev_samp(fidelity) AS sd, avg(nodes) AS nodes, stddev_samp(nodes)/avg(nodes) AS cv, max(max_nodes) AS mx FROM lv GROUP BY 1), bst AS (SELECT config FROM st ORDER BY round(mean, 12) DESC, config LIMIT 1),
g AS (SELECT l.config, avg(b.fidelity-l.fidelity) AS delta, var_samp(b.fidelity-l.fidelity) AS v, count(*) AS j FROM lv l JOIN lv b ON b.fold = l.fold AND b.config = (SELECT config FROM bst) GROUP BY 1),
s1 AS (SELECT st.*, delta, CASE WHEN sqrt((1.0::DOUBLE/j+0.5)*v) > 1e-12 THEN delta/sqrt((1.0::DOUBLE/j+0.5)*v) WHEN delta <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END <= {T_CRIT} AS a1 FROM st JOIN g USING (config)),
s2 AS (SELECT *, a1 AND sd <= min(sd) FILTER (a1) OVER () + 0.01 AS a2 FROM s1), s3 AS (SELECT *, a2 AND cv <= min(cv) FILTER (a2) OVER () + 0.05 AS a3 FROM s2), s4 AS (SELECT *, a3 AND nodes <= min(nodes) FILTER (a3) OVER () + 1e-9 AS a4 FROM s3),
w AS (SELECT *, a4 AND row_number() OVER (ORDER BY a4 DESC, mx, config) = 1 AS won FROM s4)
SELECT config, mean, sd, nodes, delta, CASE WHEN won THEN 'WINNER' WHEN NOT a1 THEN 'LOST_FIDELITY' WHEN NOT a2 THEN 'LOST_STABILITY' WHEN NOT a3 THEN 'LOST_STRUCTURE' WHEN NOT a4 THEN 'LOST_COMPLEXITY' ELSE 'LOST_TIE' END AS verdict FROM w""", floats="mean sd nodes delta")
def _(t):
    return G.lexicographic_choice(tuning(t), [], T_CRIT, 0.5)


RESAMPLED = TUNE + f""", sm AS (SELECT a.r*9+b.r*3+c.r AS sample, [a.r, b.r, c.r] AS rs FROM (VALUES (0), (1), (2)) a(r), (VALUES (0), (1), (2)) b(r), (VALUES (0), (1), (2)) c(r)),
sr AS (SELECT sample, unnest(rs) AS r, unnest([0, 1, 2]) AS copy FROM sm), bl AS (SELECT sample, copy || '-' || fold AS fold, config, fidelity, nodes, max_nodes FROM lv JOIN sr ON r = fold % 3 UNION ALL SELECT -1, fold::VARCHAR, config, fidelity, nodes, max_nodes FROM lv),
st AS (SELECT sample, config, avg(fidelity) AS mean, stddev_samp(fidelity) AS sd, avg(nodes) AS nodes, stddev_samp(nodes)/avg(nodes) AS cv, max(max_nodes) AS mx FROM bl GROUP BY 1, 2),
bst AS (SELECT sample, config FROM st QUALIFY row_number() OVER (PARTITION BY sample ORDER BY round(mean, 12) DESC, config) = 1),
g AS (SELECT l.sample, l.config, avg(b.fidelity-l.fidelity) AS delta, coalesce(var_samp(b.fidelity-l.fidelity), 0) AS v, count(*) AS j FROM bl l JOIN bst USING (sample) JOIN bl b ON b.sample = l.sample AND b.fold = l.fold AND b.config = bst.config GROUP BY 1, 2),
s1 AS (SELECT st.*, CASE WHEN sqrt((1.0::DOUBLE/j+0.5)*v) > 1e-12 THEN delta/sqrt((1.0::DOUBLE/j+0.5)*v) WHEN delta <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END <= {T_CRIT} AS a1 FROM st JOIN g USING (sample, config)),
s2 AS (SELECT *, a1 AND sd <= min(sd) FILTER (a1) OVER (PARTITION BY sample) + 0.01 AS a2 FROM s1), s3 AS (SELECT *, a2 AND cv <= min(cv) FILTER (a2) OVER (PARTITION BY sample) + 0.05 AS a3 FROM s2), s4 AS (SELECT *, a3 AND nodes <= min(nodes) FILTER (a3) OVER (PARTITION BY sample) + 1e-9 AS a4 FROM s3),
won AS (SELECT sample, config FROM s4 WHERE a4 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY mx, config) = 1),
sh AS (SELECT config, count(*)/27.0::DOUBLE AS share, row_number() OVER (ORDER BY count(*) DESC, config) AS rk FROM won WHERE sample >= 0 GROUP BY 1)"""


@query("tr37_choice_robustness", f"WITH {RESAMPLED} SELECT config, share AS win_share FROM sh", floats="win_share")
def _(t):
    return G.choice_robustness(tuning(t).withColumn("repeat", F.col("fold") % 3), 3, T_CRIT, 0.5)


@query("tr37_choice_report", f"""WITH {RESAMPLED}, fr AS (SELECT fold % 3 AS r, avg(fidelity) AS f FROM lv WHERE config = (SELECT config FROM won WHERE sample = -1) GROUP BY 1), fs AS (SELECT sample, avg(f) AS f FROM sr JOIN fr USING (r) GROUP BY 1),
fc AS (SELECT f, row_number() OVER (ORDER BY f)/27.0::DOUBLE AS upto FROM fs), ch AS (SELECT w.config AS selected, coalesce(sh.share, 0) AS selected_share FROM won w LEFT JOIN sh USING (config) WHERE sample = -1)
SELECT 'exact' AS method, 27 AS resamples, 10 AS evaluations, selected, selected_share, m.config AS modal, m.share AS modal_share, u.config AS runner_up, u.share AS runner_up_share, m.share - coalesce(u.share, 0) AS margin, m.share - selected_share AS gap, m.config <> selected AS fragile,
 (SELECT min(f) FROM fc WHERE upto >= 0.025) AS fidelity_low, (SELECT min(f) FROM fc WHERE upto >= 0.975) AS fidelity_high FROM ch, (SELECT * FROM sh WHERE rk = 1) m LEFT JOIN (SELECT * FROM sh WHERE rk = 2) u ON true""",
       floats="selected_share modal_share runner_up_share margin gap fidelity_low fidelity_high", ints="resamples evaluations")
def _(t):
    return G.choice_report(tuning(t).withColumn("repeat", F.col("fold") % 3), 3, T_CRIT, 0.5).drop("assessable", "share_low", "share_high")


@query("tr38_capacity_steps", f"""WITH {TUNE}, d AS (SELECT fold, max_nodes, nodes, fidelity - lag(fidelity) OVER (PARTITION BY fold ORDER BY max_nodes) AS d, lag(max_nodes) OVER (PARTITION BY fold ORDER BY max_nodes) AS previous FROM lv),
g AS (SELECT previous, max_nodes, avg(d) AS delta, var_samp(d) AS v, count(d) AS j, avg((nodes >= max_nodes-1)::INT) AS at_cap FROM d WHERE d IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, delta/sqrt((1.0::DOUBLE/j+0.5)*v) AS t FROM g)
SELECT previous, max_nodes, delta, j, at_cap, t, t > {T_CRIT} AND delta > 0 AS supported, CASE WHEN at_cap < 0.5 THEN 'not_saturated' WHEN t > {T_CRIT} AND delta > 0 THEN 'expand' ELSE 'plateau' END AS decision FROM u""", floats="delta at_cap t", ints="previous max_nodes j")
def _(t):
    return G.capacity_steps(tuning(t), T_CRIT, 0.5)


@query("tr11_stop_reasons", f"""WITH {SCORED}, nd AS (SELECT lno*10+leaf AS node_id, t AS label, count(*) AS n FROM scored GROUP BY 1, 2), d AS (SELECT node_id, sum(n) AS rows, max(n)/sum(n) AS fidelity, sum(n)/(SELECT count(*) FROM scored) AS reach FROM nd GROUP BY 1),
l AS (SELECT *, CASE WHEN fidelity >= 0.85 THEN 'PURE' WHEN reach < 0.03 THEN 'MIN_SAMPLES' END AS stop FROM d)
SELECT stop, count(*) AS leaves, round(sum(reach), 6) AS reach, CASE WHEN (SELECT count(*) FROM l WHERE stop IS NULL) = 0 THEN 'stump' WHEN (SELECT count(*) FROM l WHERE stop IS NULL) <= 2 THEN 'very_small' ELSE 'grown' END AS diagnosis FROM l WHERE stop IS NOT NULL GROUP BY 1""", floats="reach", ints="leaves")
def _(t):
    rows = TR.node_distribution(scored(t).withColumn("node", F.col("lno") * 10 + F.col("leaf")), "node", "t")
    log = rows.withColumn("stop", F.when(F.col("fidelity") >= 0.85, "PURE").when(F.col("reach") < 0.03, "MIN_SAMPLES"))
    return G.stop_summary(log)


MEDIANS = SCORED + """, md AS (SELECT status, lno || '/' || leaf AS path, 'price <= ' || (floor(quantile_cont(price, 0.5)/2000)*2000)::BIGINT AS test FROM scored WHERE NOT (status = 'O' AND lno = 7 AND leaf = 3) GROUP BY status, lno, leaf)"""


@query("tr35_node_choices", f"""WITH {MEDIANS} SELECT path, a.test AS test_a, b.test AS test_b, CASE WHEN a.test IS NULL THEN 'only_b' WHEN b.test IS NULL THEN 'only_a' WHEN a.test = b.test THEN 'same' ELSE 'changed' END AS state
FROM (SELECT path, test FROM md WHERE status = 'F') a FULL JOIN (SELECT path, test FROM md WHERE status = 'O') b USING (path)""")
def _(t):
    """Median splits of the same nodes in two halves of the data."""
    from rulelens.functions.ordering import exact_quantiles
    rows = scored(t).withColumn("path", F.concat_ws("/", "lno", "leaf")).filter(~((F.col("status") == "O") & (F.col("path") == "7/3")))
    mid = exact_quantiles(rows, "price", {"m": 0.5}, ["status", "path"])
    tests = mid.select("status", "path", F.concat(F.lit("price <= "), (F.floor(F.col("m") / 2000) * 2000).cast("long").cast("string")).alias("test"))
    return TR.node_differences(tests.filter("status = 'F'").drop("status"), tests.filter("status = 'O'").drop("status"))
