"""Registered queries about synthetic rows and teacher answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions.hashing import uniform
from rulelens.functions.lineage import written
from rulelens.functions.shapes import add
from rulelens.operators import growth as G
from rulelens.operators import sampling as SM
from rulelens.operators import teachers as TE
from rulelens.operators.splits import repeated_folds
from rulelens.plans.bases import CASE_CLASSES, CASE_FEATURES, CLASSES, FEATURES, JUDGED, SCORED, SURROGATE, case_scores, case_teacher, judged, scored, teacher_class, with_teacher
from rulelens.plans.registry import query

PROBS = {"A": "p_a", "N": "p_n", "R": "p_r"}
LKEY = ["okey", "lno", "pkey", "skey", "price"]
N_DRAWS = 2000


def scales(df, features):
    return {f: v or 1.0 for f, v in df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first().asDict().items()}


def marginal(t, n=N_DRAWS, seed=11):
    rows = scored(t)
    return SM.marginal_draws(rows, LKEY, FEATURES, n, seed, SM.column_model(rows, FEATURES))


def summary(df, features):
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 4).alias(f"mean_{f}") for f in features], *[F.round(F.stddev_pop(f), 4).alias(f"std_{f}") for f in features])


@query("sm01_marginal_sampler")
def _(t):
    rows = scored(t)
    model = SM.column_model(rows, FEATURES)
    draws, tried = SM.draw_until(lambda n, r: SM.marginal_draws(rows, LKEY, FEATURES, n, 100 + r, model), SURROGATE.accepts(4), 500)
    return summary(draws, FEATURES).withColumn("tried", F.lit(tried))


@query("sm02_joint_sampler")
def _(t):
    rows = judged(t)
    return summary(SM.joint_draws(rows, ["id"], CASE_FEATURES, N_DRAWS, 5, SM.column_model(rows, CASE_FEATURES), ordinal=["month"]), CASE_FEATURES)


@query("sm03_neighbour_mixes")
def _(t):
    rows = judged(t)
    return summary(SM.neighbour_mixes(rows, "id", CASE_FEATURES, 500, 5, scales(rows, CASE_FEATURES), copied=["nation"]), CASE_FEATURES)


@query("sm04_constrained_sampler")
def _(t):
    return SM.acceptance_rate(marginal(t), (F.col("price") > 10000) & (F.col("qty") <= 40) & (F.col("disc") + F.col("tax") < 0.15))


SIDES = SCORED + f""", lng AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, s FROM scored" for f in FEATURES)}), sc AS (SELECT feature, value, count_if(s='R') AS n_local, count(*) AS n_reference FROM lng GROUP BY 1, 2)"""


def sides(t):
    rows = scored(t)
    return SM.side_counts(rows.filter("s = 'R'"), rows, FEATURES)


@query("sm05_ks_statistics", f"""WITH {SIDES}, c AS (SELECT feature, abs(sum(n_local) OVER w/(sum(n_local) OVER p)::DOUBLE - sum(n_reference) OVER w/(sum(n_reference) OVER p)::DOUBLE) AS g, sum(n_local) OVER p AS nl, sum(n_reference) OVER p AS nr FROM sc
 WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)) SELECT feature, max(g) AS ks, max(nl) AS n_local, max(nr) AS n_reference FROM c GROUP BY 1""", floats="ks", ints="n_local n_reference")
def _(t):
    return SM.ks_statistics(sides(t))


@query("sm05_chi2_statistics", f"""WITH {SIDES}, p AS (SELECT *, sum(n_local) OVER w AS nl, sum(n_reference) OVER w AS nr, count(*) OVER w AS k FROM sc WHERE feature IN ('qty','disc','tax') WINDOW w AS (PARTITION BY feature)),
e AS (SELECT *, (n_local+n_reference)*nl/(nl+nr)::DOUBLE AS el, (n_local+n_reference)*nr/(nl+nr)::DOUBLE AS er FROM p) SELECT feature, sum((n_local-el)**2/el + (n_reference-er)**2/er) AS chi2, max(k)-1 AS df FROM e GROUP BY 1""", floats="chi2", ints="df")
def _(t):
    rows = scored(t)
    return SM.chi2_statistics(SM.side_counts(rows.filter("s = 'R'"), rows, ["qty", "disc", "tax"]))


@query("sm06_teacher_labelling", f"WITH {SCORED} SELECT t AS teacher_class, count(*) AS n, avg(p_a/(p_a+p_n+p_r)) AS p_a, avg(p_r/(p_a+p_n+p_r)) AS p_r FROM scored GROUP BY 1", floats="p_a p_r", ints="n")
def _(t):
    rows = SM.aligned_probabilities(scored(t).withColumns({p: F.col(p) + (F.col("t") == k).cast("int") * 1e-9 for k, p in PROBS.items()}), PROBS)
    return rows.groupBy("teacher_class").agg(F.count(F.lit(1)).alias("n"), F.avg("p_a").alias("p_a"), F.avg("p_r").alias("p_r"))


LOG = """lg AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'semantic' WHEN 'view' THEN 'original' WHEN 'error' THEN 'reused' ELSE 'original' END AS phase, ceil(value)::BIGINT AS samples FROM events)"""


def query_log(t):
    return t.events.select("user_id", F.when(F.col("event_type") == "click", "semantic").when(F.col("event_type") == "error", "reused").otherwise("original").alias("phase"), F.ceil("value").alias("samples"))


@query("sm07_query_accounting", f"""WITH {LOG}, a AS (SELECT user_id, count_if(phase='original') AS original_calls, coalesce(sum(samples) FILTER (phase='original'),0) AS original_samples, count_if(phase='semantic') AS semantic_calls, coalesce(sum(samples) FILTER (phase='semantic'),0) AS semantic_samples,
 coalesce(sum(samples) FILTER (phase='reused'),0) AS reused_samples FROM lg GROUP BY 1) SELECT *, original_samples+semantic_samples-reused_samples AS total_samples, semantic_samples-reused_samples AS extra_samples FROM a""",
       ints="user_id original_calls original_samples semantic_calls semantic_samples reused_samples total_samples extra_samples")
def _(t):
    return SM.query_accounting(query_log(t), ["user_id"])


@query("sm08_reused_answers", f"""WITH {SCORED}, old AS (SELECT DISTINCT qty, disc, tax FROM scored WHERE year(shipdate) < 1998) SELECT year(s.shipdate) AS year, count(*) AS asked, count(old.qty) AS reused FROM scored s LEFT JOIN old ON old.qty=s.qty AND old.disc=s.disc AND old.tax=s.tax WHERE year(s.shipdate) >= 1998 GROUP BY 1""", ints="year asked reused")
def _(t):
    rows = scored(t).withColumn("answer", F.col("leaf"))
    out = SM.reuse_answers(rows.filter(F.year("shipdate") >= 1998), rows.filter(F.year("shipdate") < 1998), ["qty", "disc", "tax"], "answer")
    return out.groupBy(F.year("shipdate").alias("year")).agg(F.count(F.lit(1)).alias("asked"), F.count("answer").alias("reused"))


@query("sm09_diverse_queries")
def _(t):
    rows = judged(t)
    margin = -F.abs(F.col("total") / 200000 + F.col("balance") / 10000 - 1.2)
    return SM.diverse_top(rows, "id", margin, CASE_FEATURES, scales(rows, CASE_FEATURES), 20)


@query("sm10_boundary_points")
def _(t):
    rows = judged(t)
    got = SM.boundary_points(rows, "id", CASE_FEATURES, "cls", case_teacher, scales(rows, CASE_FEATURES), 300)
    return got.groupBy("cls", "boundary_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("moved"), 4).alias("moved"), F.round(F.avg("plausibility"), 4).alias("plausibility"))


@query("sm11_real_synthetic_gap")
def _(t):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    real, synthetic = scored(t).select(*FEATURES), written(marginal(t), "draws")
    ks = SM.ks_statistics(SM.side_counts(synthetic, real, FEATURES)).agg(F.round(F.avg("ks"), 4).alias("mean_ks"))
    weight = N_DRAWS / max(1, real.count())  # both sides weigh the same, every real row takes part
    both = synthetic.select(F.lit(1.0).alias("label"), F.lit(1.0).alias("w"), *FEATURES).unionByName(real.select(F.lit(0.0).alias("label"), F.lit(weight).alias("w"), *FEATURES))
    both = written(both.withColumn("fold", F.pmod(F.xxhash64(*FEATURES), F.lit(3))), "sides")  # every pass of every forest reads it
    both = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)
    held = SM.out_of_fold(both, RandomForestClassifier(numTrees=10, minInstancesPerNode=3, weightCol="w", seed=0), "fold", 3)
    return ks.withColumn("auc", F.lit(round(BinaryClassificationEvaluator(weightCol="w").evaluate(held), 4)))


@query("sm12_label_distance", f"""WITH {SCORED}, a AS (SELECT t, count(*)/(SELECT count(*) FROM scored) AS a FROM scored GROUP BY 1), b AS (SELECT s AS t, count(*)/(SELECT count(*) FROM scored) AS b FROM scored GROUP BY 1)
SELECT 0.5*sum(abs(coalesce(a,0)-coalesce(b,0))) AS tv_distance, count(*) AS classes FROM a FULL JOIN b USING (t)""", floats="tv_distance", ints="classes")
def _(t):
    rows = scored(t)
    return SM.label_distance(rows.select(F.col("t").alias("c")), rows.select(F.col("s").alias("c")), "c")


@query("sm13_plausibility")
def _(t):
    return SM.plausibility(with_teacher(marginal(t)), scored(t), FEATURES, list(PROBS.values()))


SOFT = SCORED + """, rw AS (SELECT skey, okey, lno, pkey, price, qty, y, s, sqrt(greatest(p_a,1e-12)) AS a, sqrt(greatest(p_n,1e-12)) AS n, sqrt(greatest(p_r,1e-12)) AS r FROM scored),
sf AS (SELECT *, a/(a+n+r) AS sa, n/(a+n+r) AS sn, r/(a+n+r) AS sr FROM rw), ee AS (SELECT *, -(sa*ln(sa)+sn*ln(sn)+sr*ln(sr))/ln(3) AS e FROM sf)"""


def weights_by_kind(rows):
    """Rows and thousands of weight per kind, by way of short sums: one sum of 36 million times 0.65 is off in its sixth decimal."""
    parts = rows.groupBy("kind", F.pmod("rid", F.lit(4096))).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return parts.groupBy("kind").agg(F.sum("n").alias("n"), (F.sum("weight") / 1000).alias("weight"))


@query("sm14_soft_targets", f"""WITH {SOFT}, c AS (SELECT 'A' AS label, sa AS p, e FROM ee UNION ALL SELECT 'N', sn, e FROM ee UNION ALL SELECT 'R', sr, e FROM ee), k AS (SELECT *, round(p*(1+0.5*e), 9) AS mass FROM c WHERE p >= 0.03),
m AS (SELECT mass FROM k ORDER BY mass DESC LIMIT (SELECT 4 * count(*) FROM scored)) SELECT 'soft' AS kind, count(*) AS n, sum(mass)*0.35/1000 AS weight FROM m UNION ALL SELECT 'hard', count(*), count(*)*0.65/1000 FROM scored""", floats="weight", ints="n")
def _(t):
    rows = SM.soft_targets(scored(t).withColumn("rid", F.xxhash64(*LKEY, "qty", "disc", "tax", "shipdate")), ["rid"], "y", PROBS)
    return weights_by_kind(rows)


@query("sm15_hybrid_targets", f"""WITH {SCORED}, h AS (SELECT y AS label, 0.45+0.1*conf AS weight, 'true' AS kind FROM scored UNION ALL SELECT 'A', p_a*0.45, 'teacher' FROM scored WHERE p_a >= 0.03 UNION ALL SELECT 'N', p_n*0.45, 'teacher' FROM scored WHERE p_n >= 0.03 UNION ALL SELECT 'R', p_r*0.45, 'teacher' FROM scored WHERE p_r >= 0.03)
SELECT kind, label, count(*) AS n, avg(weight) AS mean_weight FROM h GROUP BY 1, 2""", floats="mean_weight", ints="n")
def _(t):
    return SM.hybrid_targets(scored(t), LKEY, "y", PROBS, F.col("conf")).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean_weight"))


def ml_cases(t):
    """Orders as a feature vector with a numeric label and stratified folds, written once: every fit reads them many times."""
    from pyspark.ml.feature import VectorAssembler
    rows = judged(t)
    code = F.when(F.col("cls") == "bronze", 0.0).when(F.col("cls") == "gold", 1.0).otherwise(2.0)
    s = scales(rows, CASE_FEATURES)
    scaled = rows.select("id", "cls", code.alias("y"), *[(F.col(f) / s[f]).alias(f"x_{f}") for f in CASE_FEATURES])
    names = [f"x_{f}" for f in CASE_FEATURES]
    folded = repeated_folds(scaled, ["id"], "cls", 3, 1, keep=["y", *names]).select("id", "y", "fold", *names)
    return VectorAssembler(inputCols=names, outputCol="features").transform(written(folded, "cases"))


@query("sm16_blend_weights")
def _(t):
    rows = scored(t).withColumns({f"q_{k}": F.when(F.col("s") == k, 0.8).otherwise(0.1) for k in CLASSES})
    grid = SM.blend_weights(rows, {"teacher": PROBS, "rules": {k: f"q_{k}" for k in CLASSES}}, "y", CLASSES)
    return grid.withColumn("utility", F.round("utility", 6))


@query("sm17_out_of_fold")
def _(t):
    from pyspark.ml.classification import LogisticRegression
    held = SM.out_of_fold(ml_cases(t), LogisticRegression(labelCol="y", maxIter=20), "fold", 3)
    per = held.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.max((F.col("prediction") == F.col("y")).cast("int")).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.min("times").alias("min_times"), F.max("times").alias("max_times"), F.round(F.avg("ok"), 4).alias("accuracy"))


@query("sm18_teacher_training")
def _(t):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = ml_cases(t)
    mlp = MultilayerPerceptronClassifier(labelCol="y", layers=[4, 6, 3], seed=7)
    grid = ParamGridBuilder().addGrid(mlp.maxIter, [10, 30]).build()
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    found = CrossValidator(estimator=mlp, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold").fit(data.withColumn("fold", F.col("fold").cast("int")))
    return t.spark.createDataFrame([(p[mlp.maxIter], round(float(a), 4)) for p, a in zip(grid, found.avgMetrics)], "max_iter int, cv_accuracy double")


@query("sm19_uncertainty_draws")
def _(t):
    rows = scored(t).withColumn("rid", F.xxhash64(*LKEY))
    return summary(SM.uncertainty_draws(rows, "rid", list(PROBS.values()), FEATURES, 500, {"price": 0.8}, scales(rows, FEATURES)), FEATURES)


@query("sm20_imposed_dependence")
def _(t):
    rows = judged(t)
    lim = {f: (r[0], r[1]) for f in ("total", "balance") for r in [rows.agg(F.min(f), F.max(f)).first()]}
    out = SM.impose_dependence(rows, ["id"], [("balance", "total", 0.55)], lim)
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("balance", "total"), 4).alias("correlation"), F.min("balance").alias("low"), F.max("balance").alias("high"))


@query("sm21_concept_weights", f"""WITH {JUDGED}, s AS (SELECT avg(total) AS mt, stddev_pop(total) AS st, avg(balance) AS ab, stddev_pop(balance) AS sb FROM judged),
w AS (SELECT cls, 1.0::DOUBLE + CASE WHEN abs(total-mt)/(st+1e-6) <= 1.5 THEN 0.25*0.9+0.2*0.7 ELSE 0 END + CASE WHEN abs(balance-ab)/(sb+1e-6) <= 1.5 THEN 0.25*0.6+0.2*0.5 ELSE 0 END AS raw FROM judged, s)
SELECT cls, count(*) AS n, avg(raw/(SELECT avg(raw) FROM w)) AS mean_weight FROM w GROUP BY 1""", floats="mean_weight", ints="n")
def _(t):
    return SM.concept_weights(judged(t), {"total": (0.9, 0.7), "balance": (0.6, 0.5)}).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean_weight"))


@query("sm21_noisy_copies", f"WITH {JUDGED} SELECT cls, 3*count(*) AS n, count(*)*(1+2*1.15)/1000 AS weight FROM judged GROUP BY 1", floats="weight", ints="n")
def _(t):
    out = SM.noisy_copies(judged(t).withColumn("weight", F.lit(1.0)), ["id"], ["total"], 3)
    return out.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), (F.sum("weight") / 1000).alias("weight"))


@query("tr10_growth_with_queries")
def _(t):
    """Growth that tops up small nodes with labelled synthetic rows of their region."""
    rows = scored(t).select("t", *LKEY, *[f for f in FEATURES if f not in LKEY])
    model = SM.column_model(rows, FEATURES)

    def top_up(tree, node, n):
        draws, _tried = SM.draw_until(lambda k, r: SM.marginal_draws(rows, LKEY, FEATURES, k, f"{node}:{r}", model), tree.accepts(node), n)
        return draws.withColumn("t", teacher_class())

    got = G.grow(rows, FEATURES, "t", CLASSES, G.Growth(max_nodes=5, bins=16, pool=12, min_leaf=20, min_sample=32000, max_queries=4000, batch=2), top_up)
    out = got.tree.score(rows, "guess", "node_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("t")).cast("double")), 6).alias("fidelity"))
    return out.withColumns({"queries": F.lit(got.queries), "nodes": F.lit(len(got.tree.nodes))})


@query("sm18_random_search")
def _(t):
    """Settings of perceptrons and linear models, drawn and judged out of fold on the orders."""
    return TE.random_search(ml_cases(t).select("features", "y", "fold"), "y", "fold", 3, 4, 3, trials=4).trials.withColumn("balanced_accuracy", F.round("balanced_accuracy", 4))


@query("sm18_calibration")
def _(t):
    """A teacher whose probabilities are right by construction (labels are drawn from them), and one that is too sure."""
    rows = repeated_folds(judged(t), ["id"], "cls", 3, 1, keep=CASE_FEATURES)
    powers = {c: F.exp(v) for c, v in case_scores().items()}
    total = add(powers.values())
    right = rows.withColumns({f"p_{c}": v / total for c, v in powers.items()})
    draw = uniform("calibration", "id")
    right = right.withColumn("drawn", F.when(draw < F.col("p_bronze"), "bronze").when(draw < F.col("p_bronze") + F.col("p_gold"), "gold").otherwise("silver"))
    right = written(right.select("drawn", "fold", *[f"p_{c}" for c in CASE_CLASSES]), "right")  # read by both calibrations
    cubes = {c: F.col(f"p_{c}") ** 3 for c in CASE_CLASSES}
    sure = right.withColumns({f"p_{c}": v / add(cubes.values()) for c, v in cubes.items()})
    out = []
    for name, scores in (("right", right), ("too_sure", sure)):
        found = TE.calibrate(scores, {c: f"p_{c}" for c in CASE_CLASSES}, "drawn", "fold", 3)
        out.append((name, found.accepted, *[round(float(found.report[f"{m}_{side}"]), 6) for m in ("ece", "log_loss", "accuracy") for side in ("before", "after")]))
    return t.spark.createDataFrame(out, "teacher string, accepted boolean, ece_before double, ece_after double, log_loss_before double, log_loss_after double, accuracy_before double, accuracy_after double")
