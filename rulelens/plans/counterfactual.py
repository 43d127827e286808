"""Registered counterfactual queries: orders judged by a closed-form teacher, candidates in batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from rulelens.functions.neighbours import reference_block
from rulelens.operators import counterfactual as CF
from rulelens.operators import growth as G
from rulelens.operators.derived import gram
from rulelens.operators.splits import stratified_share
from rulelens.operators.trees import RuleTree
from rulelens.plans.bases import CASE_CLASSES, CASE_FEATURES, JUDGED, case_margin, case_teacher, judged
from rulelens.plans.registry import query

CONFIG = {"balance": {"direction": "increase_only", "cost": 2.0}, "month": {"kind": "integer"}, "nation": {"kind": "code", "immutable": True}}

# A seven-leaf rule tree and a shorter one, the two surrogates of the order teacher.
RULES = RuleTree.from_rows([
    dict(node_id=1, parent_id=None, branch=None, m=1, literals=[("total", ">", 240000.0)], prediction=None),
    dict(node_id=2, parent_id=1, branch="yes", m=1, literals=[("balance", ">", 2000.0)], prediction=None), dict(node_id=3, parent_id=1, branch="no", m=1, literals=[("month", ">", 5.0)], prediction=None),
    dict(node_id=4, parent_id=2, branch="yes", m=0, literals=[], prediction="gold"), dict(node_id=5, parent_id=2, branch="no", m=2, literals=[("total", ">", 350000.0), ("balance", ">", 0.0), ("month", "<=", 9.0)], prediction=None),
    dict(node_id=6, parent_id=3, branch="yes", m=1, literals=[("total", ">", 120000.0)], prediction=None), dict(node_id=7, parent_id=3, branch="no", m=0, literals=[], prediction="bronze"),
    dict(node_id=8, parent_id=5, branch="yes", m=0, literals=[], prediction="gold"), dict(node_id=9, parent_id=5, branch="no", m=0, literals=[], prediction="silver"),
    dict(node_id=10, parent_id=6, branch="yes", m=1, literals=[("month", ">", 7.0)], prediction=None), dict(node_id=11, parent_id=6, branch="no", m=0, literals=[], prediction="silver"),
    dict(node_id=12, parent_id=10, branch="yes", m=0, literals=[], prediction="silver"), dict(node_id=13, parent_id=10, branch="no", m=0, literals=[], prediction="bronze")])
SHORT = RuleTree.from_rows([
    dict(node_id=1, parent_id=None, branch=None, m=1, literals=[("total", ">", 260000.0)], prediction=None), dict(node_id=2, parent_id=1, branch="yes", m=0, literals=[], prediction="gold"),
    dict(node_id=3, parent_id=1, branch="no", m=1, literals=[("month", ">", 5.0)], prediction=None), dict(node_id=4, parent_id=3, branch="yes", m=0, literals=[], prediction="silver"), dict(node_id=5, parent_id=3, branch="no", m=0, literals=[], prediction="bronze")])


def tree_case(total, balance, month):
    """SQL of RULES over the given column names."""
    return (f"CASE WHEN {total} > 240000 THEN CASE WHEN {balance} > 2000 THEN 'gold' ELSE CASE WHEN ({total} > 350000)::INT+({balance} > 0)::INT+({month} <= 9)::INT >= 2 THEN 'gold' ELSE 'silver' END END "
            f"ELSE CASE WHEN {month} > 5 THEN CASE WHEN {total} > 120000 THEN CASE WHEN {month} > 7 THEN 'silver' ELSE 'bronze' END ELSE 'silver' END ELSE 'bronze' END END")


def short_case(total, month):
    return f"CASE WHEN {total} > 260000 THEN 'gold' WHEN {month} > 5 THEN 'silver' ELSE 'bronze' END"


def teacher_case(total, balance, month):
    g, s = f"({total}/200000.0::DOUBLE + {balance}/10000.0::DOUBLE - 1.2::DOUBLE)", f"({month}/6.0::DOUBLE - {total}/400000.0::DOUBLE - 0.3::DOUBLE)"
    return f"CASE WHEN {g} >= {s} AND {g} >= 0.2::DOUBLE THEN 'gold' WHEN {s} >= 0.2::DOUBLE THEN 'silver' ELSE 'bronze' END"


def specs(t):
    return CF.fit_specs(judged(t), CASE_FEATURES, CONFIG)


def variants(t):
    """Three arithmetic variants of every order, next to its own values (``o_...``) and class."""
    v = F.col("candidate")
    moved = {"total": F.when(v == 0, F.col("total") * 1.4).when(v == 2, F.col("total") * 0.5).otherwise(F.col("total")),
             "balance": F.when(v == 1, F.col("balance") - 2500).when(v == 2, F.col("balance") * 1.2).otherwise(F.col("balance")),
             "month": F.when(v == 1, F.col("month") + 3.4).otherwise(F.col("month")), "nation": F.when(v == 2, F.col("nation") + 1).otherwise(F.col("nation"))}
    base = judged(t).select("id", "cls", *CASE_FEATURES, *[F.col(f).alias(f"o_{f}") for f in CASE_FEATURES]).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return base.select("id", "cls", "candidate", *[f"o_{f}" for f in CASE_FEATURES], *[c.alias(f) for f, c in moved.items()])


def fixed(t):
    """Repaired variants with their distance."""
    s = specs(t)
    return CF.project(variants(t), s).withColumn("distance", CF.gower(s))


VARIANTS = JUDGED + """, vr AS (SELECT id, cls, v AS candidate, total AS o_total, balance AS o_balance, month AS o_month, nation AS o_nation, CASE v WHEN 0 THEN total*1.4::DOUBLE WHEN 2 THEN total*0.5::DOUBLE ELSE total END AS total,
 CASE v WHEN 1 THEN balance-2500 WHEN 2 THEN balance*1.2::DOUBLE ELSE balance END AS balance, CASE v WHEN 1 THEN month+3.4::DOUBLE ELSE month END AS month, CASE v WHEN 2 THEN nation+1 ELSE nation END AS nation FROM judged, (VALUES (0),(1),(2)) x(v)),
lim AS (SELECT min(total) AS tl, max(total) AS th, min(balance) AS bl, max(balance) AS bh, min(month) AS ml, max(month) AS mh, min(nation) AS nl, max(nation) AS nh FROM judged)"""
FIXED = VARIANTS + """, fx AS (SELECT id, cls, candidate, o_total, o_balance, o_month, o_nation, greatest(tl, least(th, total)) AS total, greatest(o_balance, greatest(bl, least(bh, balance))) AS balance, greatest(ml, least(mh, round_even(greatest(ml, least(mh, month)), 0))) AS month, o_nation AS nation, lim.* FROM vr, lim),
fd AS (SELECT *, (abs(total-o_total)/(th-tl)+abs(balance-o_balance)/(bh-bl)+abs(month-o_month)/(mh-ml)+(nation<>o_nation)::INT)/4 AS distance, (abs(total-o_total) > 1e-9*(th-tl))::INT + (abs(balance-o_balance) > 1e-9*(bh-bl))::INT + (abs(month-o_month) > 1e-9*(mh-ml))::INT AS n_changed FROM fx)"""


@query("cf01_constraints", f"""WITH {JUDGED} SELECT 'total' AS feature, 'continuous' AS kind, min(total) AS low, max(total) AS high, 'both' AS direction, false AS immutable, 1.0 AS cost FROM judged UNION ALL SELECT 'balance', 'continuous', min(balance), max(balance), 'increase_only', false, 2.0 FROM judged
UNION ALL SELECT 'month', 'integer', min(month), max(month), 'both', false, 1.0 FROM judged UNION ALL SELECT 'nation', 'code', min(nation), max(nation), 'both', true, 1.0 FROM judged""", floats="low high cost")
def _(t):
    from rulelens.operators.prep import feature_specs
    return feature_specs(judged(t), CASE_FEATURES, CONFIG).select("feature", "kind", "low", "high", "direction", "immutable", "cost")


@query("cf02_repair", f"WITH {FIXED} SELECT id, candidate, total, balance, month, nation FROM fx", floats="total balance month nation", ints="id candidate")
def _(t):
    return fixed(t).select("id", "candidate", *CASE_FEATURES)


@query("cf02_one_hot_repair", f"""WITH {JUDGED}, r AS (SELECT id, total/500000 AS x, month/12 AS y, nation/24 AS z FROM judged) SELECT id, (x >= y AND x >= z)::INT AS a, (NOT (x >= y AND x >= z) AND y >= z)::INT AS b, (NOT (x >= y AND x >= z) AND NOT y >= z)::INT AS c FROM r""", ints="id a b c")
def _(t):
    rows = judged(t).select("id", (F.col("total") / 500000).alias("a"), (F.col("month") / 12).alias("b"), (F.col("nation") / 24).alias("c"))
    return CF.project(rows, {}, one_hot={"g": ["a", "b", "c"]})


@query("cf03_violations", f"""WITH {VARIANTS}, k AS (SELECT * FROM vr, lim) SELECT id, candidate, 'RANGE' AS code, 'total' AS feature FROM k WHERE total < tl-1e-9 OR total > th+1e-9 UNION ALL SELECT id, candidate, 'RANGE', 'balance' FROM k WHERE balance < bl-1e-9 OR balance > bh+1e-9
UNION ALL SELECT id, candidate, 'RANGE', 'month' FROM k WHERE month < ml-1e-9 OR month > mh+1e-9 UNION ALL SELECT id, candidate, 'RANGE', 'nation' FROM k WHERE nation < nl-1e-9 OR nation > nh+1e-9 UNION ALL SELECT id, candidate, 'INTEGER', 'month' FROM k WHERE abs(month-round(month)) > 1e-6
UNION ALL SELECT id, candidate, 'DIRECTION', 'balance' FROM k WHERE balance < o_balance-1e-9 AND abs(balance-o_balance) > 1e-9*(bh-bl) UNION ALL SELECT id, candidate, 'IMMUTABLE', 'nation' FROM k WHERE nation <> o_nation""", ints="id candidate")
def _(t):
    return CF.violations(variants(t), ["id", "candidate"], specs(t))


CHECKS = [dict(id="co", kind="requires_co_change", feature="total", depends_on="balance", severity="hard"), dict(id="rich_late", kind="incompatible", conditions=[("total", ">", 400000.0), ("month", ">=", 11.0)], severity="soft", weight=2.0),
          dict(id="same_way", kind="monotone", source="total", target="balance", direction="same", severity="soft", weight=0.5)]
RULED = VARIANTS + """, rb AS (SELECT id, candidate, abs(total-o_total) > 1e-9*(th-tl) AND NOT abs(balance-o_balance) > 1e-9*(bh-bl) AS co, total > 400000 AND month >= 11 AS rl, abs(total-o_total) > 1e-9 AND (total-o_total)*(balance-o_balance) < -1e-9 AS sw FROM vr, lim)"""


@query("cf04_declared_rules", f"WITH {RULED} SELECT id, candidate, concat_ws(',', CASE WHEN co THEN 'co' END, CASE WHEN rl THEN 'rich_late' END, CASE WHEN sw THEN 'same_way' END) AS broken_rules FROM rb", ints="id candidate")
def _(t):
    return CF.rule_checks(variants(t), CHECKS, specs(t)).select("id", "candidate", "broken_rules")


@query("cf05_soft_penalties", f"WITH {RULED} SELECT id, candidate, co::INT AS hard_breaks, rl::INT*2.0 + sw::INT*0.5 AS soft_penalty, CASE WHEN co THEN 'INVALID' WHEN rl OR sw THEN 'VALID_WITH_WARNINGS' ELSE 'VALID' END AS semantic_status FROM rb", floats="soft_penalty", ints="id candidate hard_breaks")
def _(t):
    return CF.rule_checks(variants(t), CHECKS, specs(t)).select("id", "candidate", "hard_breaks", "soft_penalty", "semantic_status")


@query("cf06_changed_units", f"WITH {FIXED} SELECT id, candidate, n_changed, concat_ws(',', CASE WHEN abs(total-o_total) > 1e-9*(th-tl) THEN 'total' END, CASE WHEN abs(balance-o_balance) > 1e-9*(bh-bl) THEN 'balance' END, CASE WHEN abs(month-o_month) > 1e-9*(mh-ml) THEN 'month' END) AS changed FROM fd", ints="id candidate n_changed")
def _(t):
    return CF.changed_units(fixed(t), specs(t)).select("id", "candidate", "n_changed", F.concat_ws(",", "changed").alias("changed"))


@query("cf07_gower", f"WITH {FIXED} SELECT id, candidate, distance, (abs(total-o_total)/(th-tl)*0.8+abs(balance-o_balance)/(bh-bl)*1.6+abs(month-o_month)/(mh-ml)*0.8+(nation<>o_nation)::INT*0.8)/4 AS weighted FROM fd", floats="distance weighted", ints="id candidate")
def _(t):
    return fixed(t).withColumn("weighted", CF.gower(specs(t), weighted=True)).select("id", "candidate", "distance", "weighted")


REF = f"ref AS (SELECT id, total/(th-tl) AS a, balance/(bh-bl) AS b, month/(mh-ml) AS c, nation/(nh-nl) AS d FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', id, '42')), id) AS rk FROM judged), lim WHERE rk <= 2000)"


@query("cf08_density", f"""WITH {FIXED}, {REF}, q AS (SELECT id AS qid, total/(th-tl) AS a, balance/(bh-bl) AS b, month/(mh-ml) AS c, nation/(nh-nl) AS d FROM fx WHERE candidate = 0),
loo AS (SELECT x.id, avg(dist) AS m FROM (SELECT x.id, (abs(x.a-y.a)+abs(x.b-y.b)+abs(x.c-y.c)+abs(x.d-y.d))/4 AS dist, row_number() OVER (PARTITION BY x.id ORDER BY (abs(x.a-y.a)+abs(x.b-y.b)+abs(x.c-y.c)+abs(x.d-y.d))/4) AS r FROM ref x JOIN ref y ON x.id <> y.id) x WHERE r <= 5 GROUP BY 1),
k AS (SELECT qid, avg(dist) AS m FROM (SELECT qid, (abs(q.a-y.a)+abs(q.b-y.b)+abs(q.c-y.c)+abs(q.d-y.d))/4 AS dist, row_number() OVER (PARTITION BY qid ORDER BY (abs(q.a-y.a)+abs(q.b-y.b)+abs(q.c-y.c)+abs(q.d-y.d))/4) AS r FROM q JOIN ref y ON y.id <> qid) WHERE r <= 5 GROUP BY 1)
SELECT qid AS id, m AS knn_distance, m <= (SELECT quantile_cont(m, 0.95) FROM loo) AS plausible FROM k""", floats="knn_distance", ints="id")
def _(t):
    ref = reference_block(judged(t), "id", CASE_FEATURES)
    return CF.density(fixed(t).filter("candidate = 0"), ref, "id", specs(t)).select("id", "knn_distance", "plausible")


@query("cf09_proximity")
def _(t):
    rows = judged(t)
    m = gram(rows, CASE_FEATURES)
    inverse = np.linalg.inv((m - np.outer(m[0], m[0]))[1:, 1:])
    p = CF.proximity(fixed(t), specs(t), inverse)
    return p.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("l1", "l2", "weighted_l1", "l0", "mahalanobis")])


@query("cf09_proximity_measures", f"""WITH {FIXED} SELECT id, candidate, abs(total-o_total)/(th-tl)+abs(balance-o_balance)/(bh-bl)+abs(month-o_month)/(mh-ml) AS l1, sqrt(((total-o_total)/(th-tl))**2+((balance-o_balance)/(bh-bl))**2+((month-o_month)/(mh-ml))**2) AS l2,
 abs(total-o_total)/(th-tl)+2*abs(balance-o_balance)/(bh-bl)+abs(month-o_month)/(mh-ml) AS weighted_l1, n_changed AS l0 FROM fd""", floats="l1 l2 weighted_l1", ints="id candidate l0")
def _(t):
    return CF.proximity(fixed(t), specs(t)).select("id", "candidate", "l1", "l2", "weighted_l1", "l0")


def chosen(t, share=1.0):
    """The instance protocol: all orders, or a stratified share of them, as tasks towards every other class."""
    rows = judged(t).select("id", "cls", *CASE_FEATURES)
    tasks = CF.targets(rows if share >= 1 else stratified_share(rows, ["id"], "cls", share), "cls", CASE_CLASSES)
    return tasks.select(F.concat_ws(":", "id", "target").alias("task"), "id", "cls", "target", *[F.col(f).alias(f"o_{f}") for f in CASE_FEATURES])


def target_margin(target):
    out = None
    for c in CASE_CLASSES:
        out = F.when(target == c, case_margin(c)) if out is None else out.when(target == c, case_margin(c))
    return out


def target_probability(target, cols):
    out = None
    for c in CASE_CLASSES:
        p = 1 / (1 + F.exp(-4 * case_margin(c, cols)))
        out = F.when(target == c, p) if out is None else out.when(target == c, p)
    return out


def described(df, s, by=("target",)):
    """Invariant summary of generated candidates: all valid ones obey the model and the constraints."""
    d = df.withColumns({"distance": CF.gower(s), "hard": CF.hard_count(s), "again": case_teacher() == F.col("target")})
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & ~F.col("again")).alias("broken_valid"), F.count_if(F.col("hard") > 0).alias("broken_constraints"), F.round(F.avg("distance"), 4).alias("distance"))


@query("cf10_boundary_distance")
def _(t):
    rows = judged(t).select("id", *CASE_FEATURES).distinct()
    d = CF.boundary_distance(rows, ["id"], specs(t), case_teacher)
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("boundary_distance").alias("found"), F.round(F.avg("boundary_distance"), 4).alias("mean"), F.round(F.max("boundary_distance"), 4).alias("worst"))


@query("cf11_robustness")
def _(t):
    rows = fixed(t).withColumn("target", case_teacher())
    models = {"teacher": case_teacher, "rules": RULES.predict}
    r = CF.robustness(rows, ["id", "candidate"], specs(t), models, "target", samples=8)
    return r.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("robust_teacher", "robust_rules", "robust_joint")])


@query("cf12_donor_search")
def _(t):
    s = specs(t)
    pool = CF.donor_pool(judged(t), "id", "cls", CASE_FEATURES, 3)
    return described(CF.donor_search(chosen(t), pool, s, case_teacher, target_margin, best=1), s)


@query("cf13_loss", f"""WITH {FIXED}, k AS (SELECT *, total/200000.0::DOUBLE + balance/10000.0::DOUBLE - 1.2::DOUBLE AS g, month/6.0::DOUBLE - total/400000.0::DOUBLE - 0.3::DOUBLE AS s FROM fd)
SELECT id, candidate, (1-1/(1+exp(-4*(g-greatest(0.2, s))))) + 0.5*(abs(total-o_total)/(th-tl)*0.8+abs(balance-o_balance)/(bh-bl)*1.6+abs(month-o_month)/(mh-ml)*0.8)/4 + 0.3*n_changed/4 AS loss FROM k""", floats="loss", ints="id candidate")
def _(t):
    s = specs(t)
    rows = CF.changed_units(fixed(t), s)
    p = 1 / (1 + F.exp(-4 * case_margin("gold")))
    return rows.select("id", "candidate", CF.loss(p, CF.gower(s, weighted=True), F.col("n_changed"), 4, F.lit(0.0), F.lit(0.0), CF.hard_count(s)).alias("loss"))


@query("cf14_rule_candidates")
def _(t):
    s = specs(t)
    tasks = CF.targets(judged(t), "cls", CASE_CLASSES).select(F.concat_ws(":", "id", "target").alias("task"), "target", *[F.col(f).alias(f"o_{f}") for f in CASE_FEATURES])
    return described(CF.rule_candidates(tasks, RULES, s, case_teacher), s, ("target", "rule"))


def near(t):
    pool = CF.donor_pool(judged(t), "id", "cls", CASE_FEATURES, 3)
    return CF.neighbourhood(chosen(t), pool, specs(t), case_teacher)


@query("cf15_linear_candidates")
def _(t):
    s = specs(t)
    return described(CF.linear_candidates(chosen(t), near(t), s, case_teacher, target_probability), s)


@query("cf16_neighbourhood")
def _(t):
    n = near(t)
    per = n.groupBy("task", "same").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("d"))
    return per.groupBy("same").agg(F.count(F.lit(1)).alias("tasks"), F.max("c").alias("most"), F.round(F.avg("d"), 4).alias("reach"))


@query("cf17_sensitivity")
def _(t):
    s = specs(t)
    rows = judged(t)
    lim = {f: (r[0], r[1]) for f in ("total", "balance") for r in [rows.agg(F.min(f), F.max(f)).first()]}
    got = CF.sensitivity(chosen(t).select("id", *[F.col(f"o_{f}").alias(f) for f in CASE_FEATURES]).distinct(), "id", s, ["total", "balance"], lim, lambda c: case_margin("gold", c))
    return got.groupBy("feature").agg(F.count(F.lit(1)).alias("crossings"), F.round(F.avg(F.abs(F.col("crossing") - F.col("old")) / F.lit(1.0)), 3).alias("mean_move"))


@query("cf18_sparsify")
def _(t):
    s = specs(t)
    rows = fixed(t).withColumn("target", case_teacher()).filter("target <> cls")
    before = CF.changed_units(rows, s).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum("n_changed").alias("changes_before"))
    after = CF.changed_units(CF.sparsify(rows, s, case_teacher), s).withColumn("kept", case_teacher() == F.col("target"))
    return before.join(after.groupBy("candidate").agg(F.sum("n_changed").alias("changes_after"), F.count_if(~F.col("kept")).alias("lost")), "candidate")


@query("cf19_targets", f"WITH {JUDGED} SELECT id, cls, c AS target FROM judged, (VALUES ('bronze'),('gold'),('silver')) x(c) WHERE c <> cls", ints="id")
def _(t):
    return CF.targets(judged(t), "cls", CASE_CLASSES).select("id", "cls", "target")


DUPES = FIXED + ", dd AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY id, round(total,9), round(balance,9), round(month,9), round(nation,9) ORDER BY distance, candidate) = 1)"


@query("cf20_distinct_candidates", f"WITH {DUPES} SELECT candidate, count(*) AS n, avg(distance) AS distance FROM dd GROUP BY 1", floats="distance", ints="candidate n")
def _(t):
    return CF.distinct_candidates(fixed(t), ["id"], specs(t)).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"))


@query("cf20_dominance", f"""WITH {FIXED} SELECT a.id, a.candidate, EXISTS (SELECT 1 FROM fd b WHERE b.id = a.id AND b.n_changed <= a.n_changed AND b.distance <= a.distance+1e-12 AND (b.n_changed < a.n_changed OR b.distance < a.distance-1e-12)) AS dominated FROM fd a""", ints="id candidate")
def _(t):
    return CF.mark_dominated(CF.changed_units(fixed(t), specs(t)), ["id"]).select("id", "candidate", "dominated")


@query("cf20_diversity", f"""WITH {FIXED}, p AS (SELECT a.id, (abs(a.total-b.total)/(a.th-a.tl)+abs(a.balance-b.balance)/(a.bh-a.bl)+abs(a.month-b.month)/(a.mh-a.ml)+abs(a.nation-b.nation)/(a.nh-a.nl))/4 AS g FROM fd a JOIN fd b ON b.id = a.id AND a.candidate < b.candidate) SELECT id, avg(g) AS mean_pairwise, min(g) AS min_pairwise FROM p GROUP BY 1""", floats="mean_pairwise min_pairwise", ints="id")
def _(t):
    return CF.diversity(fixed(t), ["id"], specs(t))


@query("cf20_near_duplicates", f"""WITH {FIXED}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, candidate) AS r FROM fd), g AS (SELECT a.id, a.r AS ra, b.r AS rb, (abs(a.total-b.total)/(a.th-a.tl)+abs(a.balance-b.balance)/(a.bh-a.bl)+abs(a.month-b.month)/(a.mh-a.ml)+abs(a.nation-b.nation)/(a.nh-a.nl))/4 <= 0.05 AS near FROM o a JOIN o b ON b.id = a.id AND a.r < b.r),
k2 AS (SELECT id, NOT bool_or(near) FILTER (ra=1 AND rb=2) AS keep2 FROM g GROUP BY 1), k3 AS (SELECT g.id, NOT (bool_or(near) FILTER (ra=1 AND rb=3) OR coalesce(bool_or(near AND keep2) FILTER (ra=2 AND rb=3), false)) AS keep3 FROM g JOIN k2 USING (id) GROUP BY 1)
SELECT o.id, o.candidate FROM o JOIN k2 USING (id) JOIN k3 USING (id) WHERE r = 1 OR (r = 2 AND keep2) OR (r = 3 AND keep3)""", ints="id candidate")
def _(t):
    return CF.drop_near_duplicates(fixed(t), ["id"], specs(t), tol=0.05).select("id", "candidate")


@query("cf21_evaluation", f"""WITH {FIXED}, e AS (SELECT *, {teacher_case('total', 'balance', 'month')} AS now FROM fd) SELECT candidate, cls, count(*) AS candidates, avg((now <> cls)::INT) AS validity, avg((now <> cls)::INT) AS feasible, avg(distance) FILTER (now <> cls) AS proximity, avg(n_changed) FILTER (now <> cls) AS sparsity FROM e GROUP BY 1, 2""",
       floats="validity feasible proximity sparsity", ints="candidate candidates")
def _(t):
    rows = fixed(t).withColumn("now", case_teacher()).withColumn("target", F.when(F.col("now") != F.col("cls"), F.col("now")).otherwise(F.lit("none")))
    return CF.aggregate_evaluation(CF.evaluate(rows, ["id", "candidate"], specs(t), case_teacher), ["candidate", "cls"])


@query("cf22_rough_set", f"""WITH {JUDGED}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v, cls FROM judged" for c in CASE_FEATURES)} UNION ALL SELECT 'code', CASE cls WHEN 'gold' THEN 1 WHEN 'silver' THEN 2 ELSE 3 END, cls FROM judged),
e AS (SELECT feature, unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS q FROM l GROUP BY 1), k AS (SELECT feature, count(DISTINCT v) AS k FROM l GROUP BY 1), b AS (SELECT l.feature, cls, CASE WHEN k <= 5 THEN v ELSE (SELECT count(DISTINCT q) FROM e WHERE e.feature = l.feature AND q < v) END AS cell FROM l JOIN k ON k.feature = l.feature),
p AS (SELECT feature, cell, count(DISTINCT cls) AS labels, count(*) AS n FROM b GROUP BY 1, 2) SELECT feature, coalesce(sum(n) FILTER (labels = 1), 0)/sum(n) AS dependency, coalesce(sum(n) FILTER (labels = 1), 0)/sum(n)*CASE feature WHEN 'code' THEN 0.5 ELSE 0 END AS relevance FROM p GROUP BY 1""", floats="dependency relevance")
def _(t):
    code = F.when(F.col("cls") == "gold", 1.0).when(F.col("cls") == "silver", 2.0).otherwise(3.0)
    changes = t.spark.createDataFrame([("code", 5, 10)], "feature string, n long, candidates long")
    return CF.rough_set_relevance(judged(t).withColumn("code", code), "cls", [*CASE_FEATURES, "code"], changes)


METHODS = FIXED + f""", mr AS (SELECT id, CASE candidate WHEN 0 THEN 'raise' WHEN 1 THEN 'shift' ELSE 'halve' END AS method, distance, n_changed, {teacher_case('total', 'balance', 'month')} <> cls AS feasible, CASE WHEN n_changed = 0 THEN 'UNCHANGED' WHEN {teacher_case('total', 'balance', 'month')} <> cls THEN 'FOUND' ELSE 'NOT_FOUND' END AS status FROM fd)"""


@query("cf23_method_summary", f"""WITH {METHODS}, c AS (SELECT method, status, count(*) AS c FROM mr GROUP BY 1, 2), s AS (SELECT method, string_agg(status || '=' || c, ';' ORDER BY status || '=' || c) AS statuses FROM c GROUP BY 1)
SELECT method, count(*) AS tasks, avg(feasible::INT) AS success_rate, avg(distance) FILTER (feasible) AS distance, avg(n_changed) FILTER (feasible) AS sparsity, statuses FROM mr JOIN s USING (method) GROUP BY method, statuses""", floats="success_rate distance sparsity", ints="tasks")
def _(t):
    ok = case_teacher() != F.col("cls")
    rows = CF.changed_units(fixed(t), specs(t)).select(F.col("id").alias("task"), F.when(F.col("candidate") == 0, "raise").when(F.col("candidate") == 1, "shift").otherwise("halve").alias("method"), "distance", "n_changed", ok.alias("feasible"),
                                                       F.when(F.col("n_changed") == 0, "UNCHANGED").when(ok, "FOUND").otherwise("NOT_FOUND").alias("status"))
    return CF.method_summary(rows)


TRIPLE = FIXED + f""", tr AS (SELECT candidate, cls AS class0, {teacher_case('total', 'balance', 'month')} AS class1, {tree_case('o_total', 'o_balance', 'o_month')} AS a0, {tree_case('total', 'balance', 'month')} AS a1, {short_case('o_total', 'o_month')} AS b0, {short_case('total', 'month')} AS b1 FROM fd)"""


def triple(t):
    """Teacher and both surrogates on the originals and on the repaired candidates."""
    rows = fixed(t).withColumns({"class0": F.col("cls"), "class1": case_teacher()})
    now = SHORT.score(RULES.score(rows, "a1", "n1"), "b1", "n2")
    swapped = now.select("candidate", "class0", "class1", "a1", "b1", *[F.col(f"o_{f}").alias(f) for f in CASE_FEATURES])
    return SHORT.score(RULES.score(swapped, "a0", "n1"), "b0", "n2")


@query("cf24_consistency", f"""WITH {TRIPLE}, s AS (SELECT candidate, 'a1' AS surrogate, class0, class1, a1 AS x FROM tr UNION ALL SELECT candidate, 'b1', class0, class1, b1 FROM tr) SELECT candidate, surrogate, count(*) AS generated, count_if(class1 <> class0) AS valid,
 count_if(class1 <> class0 AND x <> class0 AND x = class1)/nullif(count_if(class1 <> class0), 0) AS same_class, count_if(class1 <> class0 AND x <> class0 AND x <> class1)/nullif(count_if(class1 <> class0), 0) AS other_class, count_if(class1 <> class0 AND x = class0)/nullif(count_if(class1 <> class0), 0) AS no_change FROM s GROUP BY 1, 2""",
       floats="same_class other_class no_change", ints="candidate generated valid")
def _(t):
    rows = triple(t).withColumnsRenamed({"class1": "teacher_class", "class0": "original_class"})
    return CF.consistency_indicators(rows, ["a1", "b1"], ["candidate"])


@query("cf25_transfer", f"""WITH {TRIPLE}, c AS (SELECT *, CASE WHEN NOT (a0 = class0 AND b0 = class0) THEN 'SKIPPED' WHEN class1 = class0 THEN 'INVALID' WHEN a1 <> a0 AND b1 <> b0 THEN 'STRONG' WHEN a1 <> a0 OR b1 <> b0 THEN 'WEAK' ELSE 'NO' END AS cat FROM tr)
SELECT candidate, count(*) AS pairs, avg((cat <> 'SKIPPED')::INT) AS initial_agreement, count_if(cat IN ('STRONG','WEAK','NO'))/nullif(count_if(cat <> 'SKIPPED'), 0) AS valid_rate, avg((cat = 'STRONG')::INT) FILTER (cat IN ('STRONG','WEAK','NO')) AS strong, avg((cat = 'WEAK')::INT) FILTER (cat IN ('STRONG','WEAK','NO')) AS weak,
 avg((cat = 'NO')::INT) FILTER (cat IN ('STRONG','WEAK','NO')) AS none, avg((a1 <> a0 AND a1 = class1)::INT) FILTER (cat IN ('STRONG','WEAK','NO')) AS a_aligned, avg((b1 <> b0 AND b1 = class1)::INT) FILTER (cat IN ('STRONG','WEAK','NO')) AS b_aligned FROM c GROUP BY 1""",
       floats="initial_agreement valid_rate strong weak none a_aligned b_aligned", ints="candidate pairs")
def _(t):
    return CF.transfer_categories(triple(t), ["candidate"])


def conditions(leaf):
    """Literals on the way to a leaf (single literals; an m-of-n test counts as one condition named by its text)."""
    out = []
    for test, outcome in RULES.path(leaf):
        if len(test["literals"]) == 1:
            f, op, thr = test["literals"][0]
            out.append((f, op if outcome else {">": "<=", "<=": ">"}[op], thr))
        else:
            out.append((f"{test['m']}-of-{len(test['literals'])}", ">" if outcome else "<=", float(test["m"])))
    return out


def rule_rows(t):
    stats = RULES.score(judged(t), "guess", "rule").groupBy("rule").agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("guess") == F.col("cls")).cast("double")).alias("confidence"))
    rows = [(i, RULES.nodes[i]["prediction"], conditions(i)) for i in RULES.leaves()]
    table = t.spark.createDataFrame(rows, "rule long, prediction string, conditions array<struct<feature:string,op:string,thr:double>>")
    return table.join(stats, "rule", "left").withColumns({"support": F.coalesce("support", F.lit(0)), "confidence": F.round(F.coalesce("confidence", F.lit(0.0)), 9)})


RULE_SQL = JUDGED + f""", lf AS (SELECT CASE WHEN total > 240000 THEN CASE WHEN balance > 2000 THEN 4 ELSE CASE WHEN (total > 350000)::INT+(balance > 0)::INT+(month <= 9)::INT >= 2 THEN 8 ELSE 9 END END ELSE CASE WHEN month > 5 THEN CASE WHEN total > 120000 THEN CASE WHEN month > 7 THEN 12 ELSE 13 END ELSE 11 END ELSE 7 END END AS rule,
 {tree_case('total', 'balance', 'month')} AS guess, cls FROM judged), rs AS (SELECT rule, guess AS prediction, count(*) AS support, round(avg((guess = cls)::INT), 9) AS confidence FROM lf GROUP BY 1, 2),
cd AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', '{op}', {thr}::DOUBLE)" for i in RULES.leaves() for f, op, thr in conditions(i))}) v(rule, feature, op, thr)),
pp AS (SELECT a.rule, b.rule AS other, b.confidence, b.support FROM rs a JOIN rs b ON a.prediction <> b.prediction),
ls AS (SELECT pp.rule, other, feature, op, thr, row_number() OVER (PARTITION BY pp.rule, other, feature ORDER BY op, thr) AS i FROM pp JOIN cd ON cd.rule = pp.rule WHERE NOT EXISTS (SELECT 1 FROM cd x WHERE x.rule = other AND x.feature = cd.feature AND x.op = cd.op AND x.thr = cd.thr)),
rr AS (SELECT pp.rule, other, feature, op, thr, row_number() OVER (PARTITION BY pp.rule, other, feature ORDER BY op, thr) AS i FROM pp JOIN cd ON cd.rule = other WHERE NOT EXISTS (SELECT 1 FROM cd x WHERE x.rule = pp.rule AND x.feature = cd.feature AND x.op = cd.op AND x.thr = cd.thr)),
mt AS (SELECT coalesce(ls.rule, rr.rule) AS rule, coalesce(ls.other, rr.other) AS other, ls.op AS o1, rr.op AS o2 FROM ls FULL JOIN rr ON rr.rule = ls.rule AND rr.other = ls.other AND rr.feature = ls.feature AND rr.i = ls.i),
ch AS (SELECT rule, other, count_if(o2 IS NULL) AS removed, count_if(o1 IS NULL) AS added, count_if(o1 = o2) AS thresholds, count_if(o1 <> o2) AS inversions FROM mt GROUP BY 1, 2),
tt AS (SELECT pp.rule, pp.other, greatest(1, removed+added+thresholds+inversions) AS n_changes, removed, added, thresholds, inversions, row_number() OVER (PARTITION BY pp.rule ORDER BY greatest(1, removed+added+thresholds+inversions), confidence DESC, support DESC, pp.other) AS place FROM pp JOIN ch ON ch.rule = pp.rule AND ch.other = pp.other)"""


@query("cf26_rule_transitions", f"WITH {RULE_SQL} SELECT * FROM tt WHERE place <= 3", ints="rule other n_changes removed added thresholds inversions place")
def _(t):
    return CF.rule_transitions(rule_rows(t), 3)


@query("cf27_global_rules", f"""WITH {RULE_SQL}, f AS (SELECT rule, count(*) AS transitions, min(n_changes) AS fewest_changes FROM tt WHERE place <= 3 GROUP BY 1) SELECT rs.rule, prediction, support AS rows, (SELECT avg((guess = cls)::INT) FROM lf WHERE lf.rule = rs.rule) AS fidelity, support/(SELECT count(*) FROM judged) AS coverage, transitions, fewest_changes, fewest_changes <= 2 AS fragile FROM rs JOIN f USING (rule)""",
       floats="fidelity coverage", ints="rule rows transitions fewest_changes")
def _(t):
    scored = RULES.score(judged(t), "guess", "rule")
    return CF.global_rule_report(scored, CF.rule_transitions(rule_rows(t), 3), "rule", "guess", "cls", fragile_at=2)


def augmentable(t):
    rows = fixed(t).withColumns({"original_class": F.col("cls"), "teacher_class": case_teacher(), "confidence": F.round(1 / (1 + F.exp(-4 * F.abs(case_margin("gold")))), 6), "plausible": F.col("distance") < 0.2, "density_factor": F.lit(1.0)})
    return RULES.score(rows, "surrogate_class", "rule")


@query("cf28_augmentation", f"""WITH {FIXED}, a AS (SELECT id, candidate, cls, {teacher_case('total', 'balance', 'month')} AS tc, {tree_case('total', 'balance', 'month')} AS sc, distance < 0.2 AS pl, round(1/(1+exp(-4*abs((total/200000.0::DOUBLE + balance/10000.0::DOUBLE - 1.2::DOUBLE) - greatest(0.2, month/6.0::DOUBLE - total/400000.0::DOUBLE - 0.3::DOUBLE)))), 6) AS conf FROM fd),
k AS (SELECT *, CASE WHEN sc = cls THEN 'C' WHEN sc = tc THEN 'A' ELSE 'B' END AS type FROM a), r AS (SELECT *, CASE WHEN tc = cls THEN 'not_counterfactual' WHEN conf < 0.6 THEN 'confidence' WHEN NOT pl THEN 'density' END AS reason, round(CASE type WHEN 'A' THEN 1.0 WHEN 'B' THEN 2.0 ELSE 0.3 END*conf, 9) AS raw FROM k),
b AS (SELECT id, candidate FROM r WHERE reason IS NULL ORDER BY raw DESC, conf DESC, id, candidate LIMIT 2000) SELECT type, coalesce(CASE WHEN reason IS NULL AND b.id IS NULL THEN 'over_cap' ELSE reason END, 'kept') AS reason, count(*) AS n FROM r LEFT JOIN b USING (id, candidate) GROUP BY 1, 2""", ints="n")
def _(t):
    out = CF.augmentation(augmentable(t), ["id", "candidate"], cap=2000, weight_total=500.0)
    return out.groupBy("type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("cf29_surrogate_improvement")
def _(t):
    """Grow with and without weighted candidates, judge both on a hold-out, keep the better."""
    rows = judged(t).withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0)
    train, held = rows.filter("NOT held").select("cls", *CASE_FEATURES), rows.filter("held")
    extra = CF.augmentation(augmentable(t), ["id", "candidate"], cap=2000, weight_total=500.0).filter("weight IS NOT NULL").select(F.col("teacher_class").alias("cls"), *CASE_FEATURES)
    out = []
    for name, data in (("control", train), ("augmented", train.unionByName(extra))):
        got = G.grow(data, CASE_FEATURES, "cls", CASE_CLASSES, G.Growth(max_nodes=7, bins=16, pool=12, max_n=2, min_leaf=20))
        out.append(got.tree.score(held, "guess", "node_id").agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("held_rows"), F.round(F.avg((F.col("guess") == F.col("cls")).cast("double")), 6).alias("fidelity"), F.lit(len(got.tree.nodes)).alias("nodes")))
    both = out[0].unionByName(out[1])
    return both.withColumn("selected", F.col("fidelity") == F.max("fidelity").over(Window.partitionBy(F.lit(0))))


@query("cf30_local_trees")
def _(t):
    rows = judged(t)
    spread = rows.agg(*[F.stddev_pop(f).alias(f) for f in CASE_FEATURES]).first().asDict()
    flips = fixed(t).select(F.col("id").alias("instance"), F.col("cls").alias("was"), case_teacher().alias("cls"), *CASE_FEATURES).filter("cls <> was")
    trees = CF.local_trees(rows, rows, "id", CASE_FEATURES, "cls", CASE_CLASSES, spread, size=200, candidates=flips)
    return trees.agg(F.count(F.lit(1)).alias("instances"), F.min("rows").alias("rows"), F.sum("candidates").alias("candidates"), F.round(F.avg("observed_fidelity"), 4).alias("observed_fidelity"), F.round(F.avg("local_fidelity"), 4).alias("fidelity"), F.max("leaves").alias("leaves"))


EST = JUDGED + """, es AS (SELECT (0.2+1.2-balance/10000.0::DOUBLE)*200000.0::DOUBLE AS truth, 200000.0::DOUBLE + (month-6)*12000 AS estimate FROM judged), er AS (SELECT abs(estimate-truth)/(SELECT stddev_pop(total) FROM judged) AS e FROM es)"""


def estimates(t):
    rows = judged(t)
    sd = rows.agg(F.stddev_pop("total")).scalar()
    return rows.select(((F.lit(0.2) + F.lit(1.2) - F.col("balance") / 10000.0) * 200000.0).alias("truth"), (F.lit(200000.0) + (F.col("month") - 6) * 12000).alias("estimate")).withColumn("sd", sd)


@query("cf31_estimate_errors", f"WITH {EST} SELECT count(*) AS estimates, count_if(e <= 0.25) AS close, avg((e <= 0.25)::INT) AS close_share FROM er", floats="close_share", ints="estimates close")
def _(t):
    return CF.estimate_errors(estimates(t), "estimate", "truth", "sd")[0]


@query("cf31_error_histogram", f"WITH {EST}, l AS (SELECT min(e) AS lo, max(e) AS hi FROM er) SELECT least(19, floor((e-lo)/((hi-lo)/20))) AS bin, count(*) AS n FROM er, l GROUP BY 1", ints="bin n")
def _(t):
    return CF.estimate_errors(estimates(t), "estimate", "truth", "sd")[1]
