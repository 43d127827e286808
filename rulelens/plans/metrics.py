"""Registered metric queries: predictive scores against labels, fidelity against the closed-form teacher."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators import metrics as M
from rulelens.plans.bases import CLASSES, FEATURES, RUNS, SCORED, runs, scored
from rulelens.plans.registry import query

PROBS = {"A": "p_a", "N": "p_n", "R": "p_r"}
GRID = "grid AS (SELECT a.c AS truth, b.c AS pred FROM (VALUES ('A'),('N'),('R')) a(c), (VALUES ('A'),('N'),('R')) b(c))"


def cells_sql(truth: str, pred: str, src: str = "scored") -> str:
    return f"""{GRID}, cells AS (SELECT g.truth, g.pred, count(x.{truth}) AS n FROM grid g LEFT JOIN {src} x ON x.{truth} = g.truth AND x.{pred} = g.pred GROUP BY 1, 2),
classes AS (SELECT c AS label, (SELECT sum(n) FROM cells WHERE truth = c) AS support, (SELECT sum(n) FROM cells WHERE pred = c) AS predicted,
  (SELECT sum(n) FROM cells WHERE pred = c AND truth = c) AS tp FROM (VALUES ('A'),('N'),('R')) l(c)),
rates AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE/predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE/support ELSE 0 END AS recall,
  CASE WHEN support+predicted > 0 THEN 2*tp::DOUBLE/(support+predicted) ELSE 0 END AS f1 FROM classes)"""


@query("me01_confusion", f"WITH {SCORED}, {cells_sql('y', 's')} SELECT truth, pred, n FROM cells", ints="n")
def _(t):
    return M.confusion(scored(t), "y", "s", CLASSES)


@query("me02_classification_bundle", f"""WITH {SCORED}, {cells_sql('y', 's')},
mino AS (SELECT y FROM scored GROUP BY y ORDER BY count(*), y LIMIT 1)
SELECT sum(tp)/sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(precision) AS precision_macro,
 avg(recall) AS recall_macro, avg(f1) AS macro_f1, sum(precision*support)/sum(support) AS weighted_precision, sum(f1*support)/sum(support) AS weighted_f1,
 max(CASE WHEN label = (SELECT y FROM mino) THEN recall END) AS minority_recall FROM rates""",
       floats="accuracy balanced_accuracy precision_macro recall_macro macro_f1 weighted_precision weighted_f1 minority_recall")
def _(t):
    rows = scored(t)
    minority = M.minority_class(rows, "y").first()["minority"]
    return M.bundle(M.per_class(M.confusion(rows, "y", "s", CLASSES)), minority=minority)


@query("me03_per_class", f"WITH {SCORED}, {cells_sql('y', 's')} SELECT label, support, predicted, tp, precision, recall, f1 FROM rates",
       floats="precision recall f1", ints="support predicted tp")
def _(t):
    return M.per_class(M.confusion(scored(t), "y", "s", CLASSES))


@query("me04_one_vs_rest_rates", f"""WITH {SCORED}, {cells_sql('y', 's')}, tot AS (SELECT sum(support) AS n FROM classes)
SELECT label, tp/greatest(1, support)::DOUBLE AS sensitivity, (n-support-predicted+tp)/greatest(1, n-support)::DOUBLE AS specificity,
 tp/greatest(1, predicted)::DOUBLE AS ppv, (n-support-predicted+tp)/greatest(1, n-predicted)::DOUBLE AS npv, support/n::DOUBLE AS prevalence FROM classes, tot""",
       floats="sensitivity specificity ppv npv prevalence")
def _(t):
    return M.one_vs_rest_rates(M.per_class(M.confusion(scored(t), "y", "s", CLASSES)))


OVR = "ovr AS (" + " UNION ALL ".join(f"SELECT '{k}' AS label, {c} AS score, (y = '{k}')::INT AS hit FROM scored" for k, c in PROBS.items()) + """),
sc AS (SELECT label, score, count(*) AS n, sum(hit) AS pos FROM ovr GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS cp,
  sum(pos) OVER (PARTITION BY label) AS p, sum(n-pos) OVER (PARTITION BY label) AS q FROM sc)"""


@query("me05_auc_average_precision", f"""WITH {SCORED}, {OVR} SELECT label, sum(pos*((q-(cn-cp)) + (n-pos)/2.0::DOUBLE))/max(p*q::DOUBLE) AS auc,
 sum(pos*cp/cn::DOUBLE)/max(p) AS average_precision FROM cum GROUP BY label""", floats="auc average_precision")
def _(t):
    return M.auc_and_average_precision(M.score_counts(scored(t), "y", PROBS))


@query("me06_log_loss_brier", f"""WITH {SCORED}, c AS (SELECT *, least(greatest(p_a,1e-15),1-1e-15) AS a, least(greatest(p_n,1e-15),1-1e-15) AS n, least(greatest(p_r,1e-15),1-1e-15) AS r FROM scored)
SELECT avg(-ln(CASE y WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END/(a+n+r))) AS log_loss,
 avg((p_a-(y='A')::INT)**2+(p_n-(y='N')::INT)**2+(p_r-(y='R')::INT)**2) AS brier_multiclass,
 avg((p_a-(y='A')::INT)**2)*avg((y='A')::INT) + avg((p_n-(y='N')::INT)**2)*avg((y='N')::INT) + avg((p_r-(y='R')::INT)**2)*avg((y='R')::INT) AS brier_weighted FROM c""",
       floats="log_loss brier_multiclass brier_weighted")
def _(t):
    return M.log_loss_and_brier(scored(t), "y", PROBS)


@query("me07_calibration_error", f"""WITH {SCORED}, b AS (SELECT least(floor(conf*10), 9) AS band, count(*) AS n, avg((t=y)::INT) AS acc, avg(conf) AS mc FROM scored GROUP BY 1)
SELECT sum(n*abs(acc-mc))/sum(n) AS ece, count(*) AS bands_used FROM b""", floats="ece", ints="bands_used")
def _(t):
    return M.calibration_error(scored(t), F.col("t") == F.col("y"), F.col("conf"))


@query("me08_calibration_line")
def _(t):
    return M.calibration_line(scored(t), F.col("y") == "R", F.col("p_r"))


THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]


@query("me09_decision_curve", f"""WITH {SCORED}, th AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in THRESHOLDS)}]) AS threshold)
SELECT threshold, sum((y='R' AND p_r >= threshold)::INT)/count(*)::DOUBLE - sum((y<>'R' AND p_r >= threshold)::INT)/count(*)::DOUBLE*threshold/(1-threshold) AS net_benefit
FROM scored, th GROUP BY threshold""", floats="threshold net_benefit")
def _(t):
    return M.decision_curve(scored(t), F.col("y") == "R", F.col("p_r"), THRESHOLDS)


@query("me10_kappa", f"""WITH {SCORED}, {cells_sql('y', 's')}, m AS (SELECT sum(tp)/sum(support) AS po, sum(support*predicted)::DOUBLE/(sum(support)::DOUBLE*sum(support)) AS pe FROM classes)
SELECT (po-pe)/(1-pe) AS kappa FROM m""", floats="kappa")
def _(t):
    return M.kappa(M.per_class(M.confusion(scored(t), "y", "s", CLASSES)))


@query("me11_fidelity_per_class", f"""WITH {SCORED} SELECT t, 'closed_form' AS oracle_name, avg((t=s)::INT) AS fidelity, avg((t<>s)::INT) AS disagreement, count(*) AS n FROM scored GROUP BY t""",
       floats="fidelity disagreement", ints="n")
def _(t):
    return M.fidelity(scored(t), "t", "s", "closed_form", ["t"])


@query("me11_agreement_matrix", f"WITH {SCORED}, {cells_sql('t', 's')} SELECT truth, pred, n FROM cells", ints="n")
def _(t):
    return M.confusion(scored(t), "t", "s", CLASSES)


@query("me12_fidelity_by_confidence", f"""WITH {SCORED} SELECT CASE WHEN conf > 0.7 THEN 'high' ELSE 'low' END AS region, avg((t=s)::INT) AS fidelity, count(*) AS n, avg(conf) AS mean_confidence,
 avg(-(p_a*ln(p_a+1e-10)+p_n*ln(p_n+1e-10)+p_r*ln(p_r+1e-10))) AS mean_entropy FROM scored GROUP BY 1""", floats="fidelity mean_confidence mean_entropy", ints="n")
def _(t):
    return M.fidelity_by_confidence(scored(t), "t", "s", list(PROBS.values()))


ERR = """count(*) AS n, count_if(t=y AND s=y) AS both_correct, count_if(t<>y AND s<>y) AS both_wrong, count_if(t=y AND s<>y) AS teacher_only,
 count_if(t<>y AND s=y) AS surrogate_only, count_if(t<>s) AS disagreement"""


@query("me13_fidelity_by_error", f"WITH {SCORED} SELECT status, {ERR} FROM scored GROUP BY status", ints="n both_correct both_wrong teacher_only surrogate_only disagreement")
def _(t):
    return M.fidelity_by_error(scored(t), "y", "t", "s", ["status"])


@query("me14_fidelity_by_distance", f"""WITH {SCORED}, c AS (SELECT {', '.join(f'quantile_cont({f},0.5) AS m_{f}' for f in FEATURES)} FROM scored),
d AS (SELECT t, s, round(sqrt({'+'.join(f'({f}-m_{f})**2' for f in FEATURES)}),6) AS distance FROM scored, c),
q AS (SELECT quantile_cont(distance,0.25) AS q1, quantile_cont(distance,0.5) AS q2, quantile_cont(distance,0.75) AS q3 FROM d)
SELECT CASE WHEN distance <= q1 THEN 1 WHEN distance <= q2 THEN 2 WHEN distance <= q3 THEN 3 ELSE 4 END AS region, avg((t=s)::INT) AS fidelity, count(*) AS n, avg(distance) AS mean_distance FROM d, q GROUP BY 1""",
       floats="fidelity mean_distance", ints="region n")
def _(t):
    return M.fidelity_by_distance(scored(t), FEATURES, "t", "s")


@query("me15_transitions", f"""WITH {SCORED} SELECT t AS from_class, s AS to_class, count(*) AS n, count_if(t=y) AS teacher_right, count_if(s=y) AS surrogate_right FROM scored WHERE t<>s
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""", ints="n teacher_right surrogate_right")
def _(t):
    return M.transitions(scored(t), "t", "s", "y")


@query("me15_disagreement_examples", f"""WITH {SCORED} SELECT t, s, y, qty, price, conf FROM scored WHERE t <> s ORDER BY conf DESC, price, qty, disc, tax, okey, lno, pkey LIMIT 20""", floats="qty price conf")
def _(t):
    order = [F.desc("conf"), *[F.col(c) for c in ("price", "qty", "disc", "tax", "okey", "lno", "pkey")]]
    return M.examples(scored(t), F.col("t") != F.col("s"), 20, order, ["okey", "lno", "pkey", "skey"]).select("t", "s", "y", "qty", "price", "conf")


@query("me16_disagreement_profile", f"""WITH {SCORED}, l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, (t<>s)::INT AS flag FROM scored" for f in FEATURES)}),
q AS (SELECT feature, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM l WHERE flag=0 GROUP BY 1)
SELECT feature, abs(avg(value) FILTER (flag=1)-avg(value) FILTER (flag=0)) AS mean_gap,
 (avg(value) FILTER (flag=1)-avg(value) FILTER (flag=0))**2/((var_pop(value) FILTER (flag=1)+var_pop(value) FILTER (flag=0))/2) AS f_score, corr(value,flag) AS correlation,
 count_if(flag=1 AND (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1))) AS outliers FROM l JOIN q USING (feature) GROUP BY feature""",
       floats="mean_gap f_score correlation", ints="outliers")
def _(t):
    return M.disagreement_profile(scored(t), FEATURES, F.col("t") != F.col("s"))


@query("me17_subgroups", f"""WITH {SCORED}, l AS (SELECT 'status' AS attribute, status AS "group", y, s FROM scored UNION ALL SELECT 'lno', lno::VARCHAR, y, s FROM scored),
r AS (SELECT attribute, "group", y, count(*) AS n, avg((y=s)::INT) AS rec, count_if(y=s) AS ok FROM l GROUP BY ALL)
SELECT attribute, "group", sum(n) AS n, sum(ok)/sum(n) AS accuracy, avg(rec) AS macro_sensitivity, CASE WHEN sum(n) < 20 THEN 'blocked' ELSE 'allowed' END AS claim FROM r GROUP BY 1, 2""",
       floats="accuracy macro_sensitivity", ints="n")
def _(t):
    return M.subgroup_metrics(scored(t), "y", "s", CLASSES, ["status", "lno"])


@query("me18_bootstrap_accuracy")
def _(t):
    return M.bootstrap_accuracy(scored(t), F.col("s") == F.col("y"))


AGREE = """, g AS (SELECT status, count(*) AS n, count_if(t = s) AS ok FROM scored GROUP BY 1), m AS (SELECT status, t AS label FROM scored UNION SELECT status, s FROM scored),
k AS (SELECT m.status, m.label, count_if(t = label) AS sup, count_if(s = label) AS prd, count_if(t = label AND s = label) AS tp FROM m JOIN scored USING (status) GROUP BY 1, 2),
p AS (SELECT status, sum(sup*prd::DOUBLE) AS chance, avg(CASE WHEN sup+prd > 0 THEN 2*tp::DOUBLE/(sup+prd) END) AS f1 FROM k GROUP BY 1),
v AS (SELECT status, n, ok/n AS acc, (ok/n - chance/n/n)/(1 - chance/n/n) AS kappa, f1 FROM g JOIN p USING (status))"""


@query("me18_agreement_intervals", f"""WITH {SCORED}{AGREE} SELECT status, 'accuracy' AS metric, acc AS value, true AS encloses, true AS as_wide_as_theory FROM v UNION ALL
SELECT status, 'macro_f1', f1, true, NULL FROM v UNION ALL SELECT status, 'kappa', kappa, true, NULL FROM v""", floats="value")
def _(t):
    """Intervals of the surrogate's agreement with its teacher in each status; accuracy's is compared with the normal one."""
    rows = scored(t)
    cells = rows.groupBy("status", F.col("t").alias("truth"), F.col("s").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    found = M.confusion_intervals(cells, ["status"], ["accuracy", "macro_f1", "kappa"], replicas=2000)
    sizes = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    theory = 2 * 1.959964 * F.sqrt(F.col("value") * (1 - F.col("value")) / F.col("n"))
    width = F.when(F.col("metric") == "accuracy", F.abs((F.col("ci_high") - F.col("ci_low")) / theory - 1) < 0.15)
    return found.join(sizes, "status").select("status", "metric", "value", F.col("value").between(F.col("ci_low"), F.col("ci_high")).alias("encloses"), width.alias("as_wide_as_theory"))


@query("me19_utility", f"""WITH {SCORED}, r AS (SELECT status, y, count(*) AS sup, count_if(y=s) AS tp FROM scored GROUP BY 1, 2),
p AS (SELECT status, s, count(*) AS pred FROM scored GROUP BY 1, 2),
k AS (SELECT r.status, r.y, sup, tp, coalesce(pred,0) AS pred, tp/sup::DOUBLE AS rec, 2*tp::DOUBLE/(sup+coalesce(pred,0)) AS f1 FROM r LEFT JOIN p ON p.status=r.status AND p.s=r.y)
SELECT status, 0.4*avg(rec)+0.3*avg(f1)+0.3*sum(tp)/sum(sup)-0.01*5 AS utility FROM k GROUP BY status""", floats="utility")
def _(t):
    rows = M.bundle(M.per_class(M.confusion(scored(t), "y", "s", CLASSES, ["status"]), ["status"]), ["status"]).withColumn("nodes", F.lit(5))
    return M.utility(rows, {"balanced_accuracy": 0.4, "macro_f1": 0.3, "accuracy": 0.3}, 0.01, "nodes").select("status", "utility")


@query("me20_stability", f"""WITH {RUNS} SELECT arm, metric, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value),0) AS std, min(value) AS min, max(value) AS max,
 CASE WHEN avg(value) <> 0 THEN coalesce(stddev_samp(value),0)/abs(avg(value)) END AS cv, max(value)-min(value) AS range FROM runs GROUP BY 1, 2""",
       floats="mean std min max cv range", ints="n")
def _(t):
    return M.stability(runs(t), ["arm", "metric"])


@query("me21_metric_recomputation", f"""WITH {RUNS}, stored AS (SELECT dataset, split_id, arm, metric, CASE WHEN arm='plain' AND split_id=1 THEN value+0.01 ELSE value END AS value FROM runs WHERE arm IN ('core','plain'))
SELECT stored.dataset, stored.split_id, stored.arm, stored.metric, CASE WHEN abs(stored.value-runs.value) > 1e-9 THEN 'mismatch' ELSE 'ok' END AS status
FROM stored JOIN runs USING (dataset, split_id, arm, metric)""", ints="dataset split_id")
def _(t):
    found = runs(t).filter(F.col("arm").isin("core", "plain")).select("dataset", "split_id", "arm", "metric", "value")
    stored = found.withColumn("value", F.when((F.col("arm") == "plain") & (F.col("split_id") == 1), F.col("value") + 0.01).otherwise(F.col("value")))
    return M.metric_mismatches(stored, found, ["dataset", "split_id", "arm", "metric"]).select("dataset", "split_id", "arm", "metric", "status")


@query("me22_frame_differences", f"""WITH {SCORED}, a AS (SELECT skey, count(*)::VARCHAR AS n, sum((s=y)::INT)::VARCHAR AS hits FROM scored GROUP BY 1),
b AS (SELECT skey, count(*)::VARCHAR AS n, sum((t=y)::INT)::VARCHAR AS hits FROM scored GROUP BY 1)
SELECT skey, 'hits' AS column_name, a.hits AS left_value, b.hits AS right_value FROM a JOIN b USING (skey) WHERE abs(a.hits::DOUBLE-b.hits::DOUBLE) > 1
UNION ALL SELECT skey, 'n', a.n, b.n FROM a JOIN b USING (skey) WHERE abs(a.n::DOUBLE-b.n::DOUBLE) > 1""")
def _(t):
    rows = scored(t)
    left = rows.groupBy("skey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s") == F.col("y")).cast("int")).alias("hits"), F.lit(0.1).alias("seconds"))
    right = rows.groupBy("skey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t") == F.col("y")).cast("int")).alias("hits"), F.lit(0.2).alias("seconds"))
    return M.frame_differences(left, right, ["skey"], ignore=["seconds"], tol=1.0)


@query("me23_run_invariants", f"""WITH {RUNS}, r AS (SELECT * FROM runs WHERE NOT (arm='shuffled' AND split_id=2))
SELECT dataset, split_id, count(DISTINCT arm) AS arms, CASE WHEN count(DISTINCT arm) FILTER (arm IN ('teacher','full','core','plain','shuffled')) < 5 THEN 'arms_present' ELSE '' END AS failed
FROM r GROUP BY 1, 2""", ints="dataset split_id arms")
def _(t):
    records = runs(t).filter(~((F.col("arm") == "shuffled") & (F.col("split_id") == 2)))
    return M.run_invariants(records, ["dataset", "split_id"], ["teacher", "full", "core", "plain", "shuffled"], ["n_test", "oracle_name"])


@query("me24_comparability", f"""WITH {RUNS}, r AS (SELECT dataset, split_id, arm, CASE WHEN arm='plain' AND split_id=3 THEN NULL ELSE n_test END AS n_test,
 CASE WHEN arm='core' AND split_id=4 THEN 'other' ELSE oracle_name END AS oracle_name FROM runs WHERE metric='accuracy')
SELECT dataset, split_id, (count(DISTINCT oracle_name) > 1)::INT AS failed, (count(n_test) < count(*))::INT AS unverifiable,
 count(DISTINCT oracle_name) <= 1 AND count(n_test) = count(*) AS comparable FROM r GROUP BY 1, 2""", ints="dataset split_id failed unverifiable")
def _(t):
    records = runs(t).filter("metric = 'accuracy'").withColumns({
        "n_test": F.when((F.col("arm") == "plain") & (F.col("split_id") == 3), None).otherwise(F.col("n_test")),
        "oracle_name": F.when((F.col("arm") == "core") & (F.col("split_id") == 4), "other").otherwise(F.col("oracle_name"))})
    return M.comparability(records, ["dataset", "split_id"], ["n_test", "oracle_name"])


@query("me25_concordance", f"""WITH {SCORED} SELECT 't' AS left_model, 's' AS right_model, avg((t=s)::INT) AS agreement FROM scored UNION ALL SELECT 't', 'y', avg((t=y)::INT) FROM scored
UNION ALL SELECT 's', 'y', avg((s=y)::INT) FROM scored UNION ALL SELECT 'all', 'all', avg((s=y AND t=y)::INT) FROM scored""", floats="agreement")
def _(t):
    return M.concordance(scored(t), ["t", "s", "y"])


@query("me26_teacher_health", f"""WITH {SCORED}, c AS (SELECT lno, y, count(*) AS c FROM scored GROUP BY 1, 2), m AS (SELECT lno, max(c)/sum(c) AS majority_accuracy FROM c GROUP BY 1),
a AS (SELECT lno, avg((t=y)::INT) AS accuracy, count(DISTINCT t) AS predicted_classes FROM scored GROUP BY 1)
SELECT lno, accuracy, predicted_classes, majority_accuracy, predicted_classes = 1 AS degenerate, predicted_classes = 1 OR accuracy <= majority_accuracy+0.01 AS weak FROM a JOIN m USING (lno)""",
       floats="accuracy majority_accuracy", ints="lno predicted_classes")
def _(t):
    return M.teacher_health(scored(t), "y", "t", ["lno"])


@query("me27_cross_validation", f"""WITH {SCORED}, f AS (SELECT okey % 5 AS fold, avg((t=y)::INT) AS t, avg((s=y)::INT) AS s FROM scored GROUP BY 1)
SELECT 't' AS model, avg(t) AS mean_accuracy, stddev_pop(t) AS std_accuracy, count(*) AS folds, NULL::VARCHAR AS reason FROM f
UNION ALL SELECT 's', avg(s), stddev_pop(s), count(*), NULL FROM f UNION ALL SELECT 'surrogate_cv', NULL, NULL, NULL, 'not_applicable'""", floats="mean_accuracy std_accuracy", ints="folds")
def _(t):
    return M.cross_validated(scored(t).withColumn("fold", F.col("okey") % 5), "fold", "y", ["t", "s"], ["surrogate_cv"])


@query("me28_roc_points", f"WITH {SCORED}, {OVR} SELECT label, score AS threshold, (cn-cp)/q::DOUBLE AS fpr, cp/p::DOUBLE AS tpr FROM cum", floats="threshold fpr tpr")
def _(t):
    return M.roc_points(M.score_counts(scored(t), "y", PROBS))


GROUPS = {"size": ["qty", "price"], "rates": ["disc", "tax"]}


@query("me29_group_activation_fidelity", f"""WITH {SCORED}, c AS (SELECT {', '.join(f'quantile_cont({f},0.5) AS m_{f}, stddev_pop({f}) AS d_{f}' for f in FEATURES)} FROM scored),
a AS (SELECT t, s, round((abs((price-m_price)/d_price)+abs((qty-m_qty)/d_qty))/2,6) AS size, round((abs((disc-m_disc)/d_disc)+abs((tax-m_tax)/d_tax))/2,6) AS rates FROM scored, c),
q AS (SELECT quantile_cont(size,0.5) AS qs, quantile_cont(rates,0.5) AS qr FROM a)
SELECT 'size' AS feature_group, avg((t=s)::INT) FILTER (size >= qs) AS fidelity, count_if(size >= qs) AS n FROM a, q UNION ALL
SELECT 'rates', avg((t=s)::INT) FILTER (rates >= qr), count_if(rates >= qr) FROM a, q""", floats="fidelity", ints="n")
def _(t):
    return M.group_activation_fidelity(scored(t), GROUPS, "t", "s")
