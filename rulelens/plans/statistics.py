"""Registered statistics queries on results computed from line items (dataset = ship year, split = month)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions.hashing import gaussian
from rulelens.operators import resampling as R
from rulelens.operators import statistics as ST
from rulelens.plans.bases import FEATURES, RUNS, SCORED, SURROGATE, runs, scored
from rulelens.plans.registry import query

CONTRASTS = [dict(name="architecture", a="core", b="plain"), dict(name="incremental", a="full", b="core"), dict(name="negative_control", a="full", b="shuffled"),
             dict(name="total", a="full", b="plain"), dict(name="unfinished", a="full", b="late_arm")]
BY = ["dataset", "contrast", "metric"]

PAIRED = RUNS + f""", decl AS (SELECT * FROM (VALUES {', '.join(f"('{c['name']}', '{c['a']}', '{c['b']}')" for c in CONTRASTS)}) v(contrast, arm_a, arm_b)),
paired AS (SELECT a.dataset, contrast, a.metric, a.split_id, a.value AS a, b.value AS b, round(a.value-b.value, 12) AS d, a.n_test FROM decl JOIN runs a ON a.arm = arm_a JOIN runs b ON b.arm = arm_b AND b.dataset = a.dataset AND b.split_id = a.split_id AND b.metric = a.metric)"""
SIGN_P = """CASE WHEN wins_a+wins_b = 0 THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range((least(wins_a,wins_b)+1)::BIGINT), lambda k: factorial((wins_a+wins_b)::INT)::DOUBLE/(factorial(k::INT)::DOUBLE*factorial((wins_a+wins_b-k)::INT)::DOUBLE)))*pow(0.5, wins_a+wins_b)) END"""
SUMM = PAIRED + f""", s0 AS (SELECT dataset, contrast, metric, count(d) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_diff, quantile_cont(d, 0.5) AS median_diff, count_if(d>0) AS wins_a, count_if(d<0) AS wins_b, count_if(d=0) AS ties,
 stddev_samp(d) AS sd, min(n_test) AS min_test FROM paired GROUP BY 1, 2, 3),
summ AS (SELECT *, CASE WHEN sd > 0 THEN mean_diff/(sd/sqrt(n_pairs)) END AS t_stat, CASE WHEN sd > 0 THEN mean_diff/sd END AS dz, {SIGN_P} AS sign_p FROM s0)"""
RANKED = PAIRED + """, nz AS (SELECT *, abs(d) AS size, rank() OVER (PARTITION BY dataset, contrast, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, contrast, metric, abs(d)) - 1)/2.0::DOUBLE AS r FROM paired WHERE d <> 0),
ranks AS (SELECT dataset, contrast, metric, count(*) AS n_nonzero, coalesce(sum(r) FILTER (d>0), 0) AS w_plus, coalesce(sum(r) FILTER (d<0), 0) AS w_minus FROM nz GROUP BY 1, 2, 3)"""


def paired(t):
    return ST.pairs(runs(t), CONTRASTS)


def summary(t):
    return ST.paired_summary(paired(t), BY)


@query("st01_describe", f"""WITH {RUNS} SELECT dataset, arm, metric, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value),0) AS std, quantile_cont(value,0.5) AS median, min(value) AS min, max(value) AS max FROM runs GROUP BY 1, 2, 3""",
       floats="mean std median min max", ints="dataset n")
def _(t):
    return ST.describe(runs(t), ["dataset", "arm", "metric"])


@query("st02_bootstrap_mean")
def _(t):
    return R.mean_interval(runs(t), "value", ["dataset", "split_id"], ["arm", "metric"])


@query("st02_bootstrap_paired")
def _(t):
    return R.mean_interval(paired(t), "d", ["split_id"], BY)


@query("st03_paired_comparison", f"WITH {SUMM} SELECT dataset, contrast, metric, n_pairs, mean_a, mean_b, mean_diff, median_diff, wins_a, wins_b, ties FROM summ",
       floats="mean_a mean_b mean_diff median_diff", ints="dataset n_pairs wins_a wins_b ties")
def _(t):
    return summary(t).select(*BY, "n_pairs", "mean_a", "mean_b", "mean_diff", "median_diff", "wins_a", "wins_b", "ties")


@query("st04_signed_ranks", f"WITH {RANKED} SELECT dataset, contrast, metric, n_nonzero, w_plus, w_minus FROM ranks", floats="w_plus w_minus", ints="dataset n_nonzero")
def _(t):
    return ST.signed_ranks(paired(t), BY).select(*BY, "n_nonzero", "w_plus", "w_minus")


@query("st04_signed_rank_p")
def _(t):
    return ST.signed_rank_p_values(ST.signed_ranks(paired(t), BY)).select(*BY, "n_nonzero", "w_plus", "exact", "p")


@query("st05_paired_t", f"WITH {SUMM} SELECT dataset, contrast, metric, n_pairs, t_stat FROM summ", floats="t_stat", ints="dataset n_pairs")
def _(t):
    return summary(t).select(*BY, "n_pairs", "t_stat")


@query("st05_paired_t_p")
def _(t):
    return ST.with_t_p(summary(t), "t_stat").select(*BY, "n_pairs", "t_stat", "p")


@query("st06_mcnemar", f"""WITH {SCORED} SELECT lno, count_if(s=y AND t<>y) AS b, count_if(s<>y AND t=y) AS c, count_if(s=y AND t=y) AS "both", count_if(s<>y AND t<>y) AS neither,
 (abs(count_if(s=y AND t<>y)-count_if(s<>y AND t=y))-1)**2/(count_if(s=y AND t<>y)+count_if(s<>y AND t=y))::DOUBLE AS chi2 FROM scored GROUP BY lno""", floats="chi2", ints="lno b c both neither")
def _(t):
    return ST.mcnemar(scored(t), "y", "s", "t", ["lno"]).select("lno", "b", "c", "both", "neither", "chi2")


@query("st06_mcnemar_exact", f"""WITH {SCORED}, g AS (SELECT okey, count_if(s=y AND t<>y) AS wins_a, count_if(s<>y AND t=y) AS wins_b FROM scored GROUP BY okey)
SELECT wins_a AS b, wins_b AS c, count(*) AS orders, max({SIGN_P}) AS exact_p FROM g WHERE wins_a+wins_b > 0 GROUP BY 1, 2""", floats="exact_p", ints="b c orders")
def _(t):
    rows = ST.mcnemar(scored(t), "y", "s", "t", ["okey"]).filter("b + c > 0")
    return rows.groupBy("b", "c").agg(F.count(F.lit(1)).alias("orders"), F.max("exact_p").alias("exact_p"))


@query("st07_effect_sizes", f"""WITH {SUMM}, {RANKED[len(PAIRED) + 2:]}, cd AS (SELECT x.dataset, x.contrast, x.metric, avg(CASE WHEN round(x.a,12) > round(z.b,12) THEN 1 WHEN round(x.a,12) < round(z.b,12) THEN -1 ELSE 0 END) AS cliffs_delta
 FROM paired x JOIN paired z ON z.dataset=x.dataset AND z.contrast=x.contrast AND z.metric=x.metric GROUP BY 1, 2, 3),
e AS (SELECT dataset, contrast, metric, dz, cliffs_delta, (w_plus-w_minus)/(w_plus+w_minus) AS rank_biserial FROM summ JOIN cd USING (dataset, contrast, metric) JOIN ranks USING (dataset, contrast, metric))
SELECT *, CASE WHEN abs(rank_biserial) < 0.1 THEN 'negligible' WHEN abs(rank_biserial) < 0.3 THEN 'small' WHEN abs(rank_biserial) < 0.5 THEN 'medium' ELSE 'large' END AS label FROM e""",
       floats="dz cliffs_delta rank_biserial", ints="dataset")
def _(t):
    p = paired(t)
    out = summary(t).select(*BY, "dz").join(ST.cliffs_delta(p, BY), BY).join(ST.signed_ranks(p, BY).select(*BY, "rank_biserial"), BY)
    return out.withColumn("label", ST.effect_label(F.col("rank_biserial"), "rank_biserial"))


@query("st08_holm", f"""WITH {SUMM}, k AS (SELECT *, CASE WHEN n_pairs >= 8 THEN sign_p END AS p FROM summ), o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p NULLS LAST, contrast, metric) AS r, count(p) OVER (PARTITION BY dataset) AS m FROM k)
SELECT dataset, contrast, metric, p, CASE WHEN p IS NOT NULL THEN least(1.0, max(p*(m-r+1)) OVER (PARTITION BY dataset ORDER BY r)) END AS p_holm FROM o""", floats="p p_holm", ints="dataset")
def _(t):
    rows = summary(t).withColumn("p", F.when(F.col("n_pairs") >= 8, F.col("sign_p")))
    return ST.holm(rows, "p", ["dataset"], ["contrast", "metric"]).select(*BY, "p", "p_holm")


@query("st09_benjamini_hochberg", f"""WITH {SUMM}, k AS (SELECT *, CASE WHEN n_pairs >= 8 THEN sign_p END AS p FROM summ), o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p NULLS LAST, contrast, metric) AS r, count(p) OVER (PARTITION BY dataset) AS m FROM k)
SELECT dataset, contrast, metric, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(p*m/r) OVER (PARTITION BY dataset ORDER BY r DESC)) END AS p_bh FROM o""", floats="p p_bh", ints="dataset")
def _(t):
    rows = summary(t).withColumn("p", F.when(F.col("n_pairs") >= 8, F.col("sign_p")))
    return ST.benjamini_hochberg(rows, "p", ["dataset"], ["contrast", "metric"]).select(*BY, "p", "p_bh")


BLOCKR = RUNS + """, br AS (SELECT *, round(value,12) AS v FROM runs WHERE arm <> 'teacher'), rk AS (SELECT dataset, split_id, metric, arm, count(*) OVER (PARTITION BY dataset, split_id, metric, v) AS ties,
 rank() OVER (PARTITION BY dataset, split_id, metric ORDER BY v DESC) + (count(*) OVER (PARTITION BY dataset, split_id, metric, v)-1)/2.0::DOUBLE AS rk FROM br)"""


@query("st10_friedman", f"""WITH {BLOCKR}, a AS (SELECT metric, arm, sum(rk) AS rs, count(*) AS n, sum(ties*ties-1) AS tt FROM rk GROUP BY 1, 2), f AS (SELECT metric, sum(rs*rs) AS ss, max(n) AS blocks, count(*) AS arms, sum(tt) AS tt FROM a GROUP BY 1)
SELECT metric, blocks, arms, (12.0::DOUBLE/(arms*blocks*(arms+1))*ss - 3*blocks*(arms+1))/(1 - tt/(arms*(arms*arms-1)*blocks)::DOUBLE) AS chi2 FROM f""", floats="chi2", ints="blocks arms")
def _(t):
    return ST.friedman(runs(t).filter("arm <> 'teacher'"), ["metric"], ["dataset", "split_id"])


@query("st10_friedman_p")
def _(t):
    return ST.friedman_p(ST.friedman(runs(t).filter("arm <> 'teacher'"), ["metric"], ["dataset", "split_id"]))


@query("st11_corrected_t", f"WITH {SUMM} SELECT dataset, contrast, metric, CASE WHEN n_pairs >= 3 AND sd > 0 THEN mean_diff/sqrt((1.0::DOUBLE/n_pairs+0.25)*sd*sd) END AS corrected_t FROM summ", floats="corrected_t", ints="dataset")
def _(t):
    return ST.corrected_t(summary(t), 0.25).select(*BY, "corrected_t")


WIL = "(({k}/{n} + 1.96*1.96/(2*{n})) {s} 1.96*sqrt(({k}/{n}*(1-{k}/{n}) + 1.96*1.96/(4*{n}))/{n}))/(1+1.96*1.96/{n})"


@query("st12_wilson", f"""WITH {SCORED}, g AS (SELECT lno, status, count(*)::DOUBLE AS n, count_if(s=y)::DOUBLE AS k FROM scored GROUP BY 1, 2)
SELECT lno, status, k/n AS rate, greatest(0, {WIL.format(k='k', n='n', s='-')}) AS ci_low, least(1, {WIL.format(k='k', n='n', s='+')}) AS ci_high FROM g""", floats="rate ci_low ci_high", ints="lno")
def _(t):
    g = scored(t).groupBy("lno", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == F.col("y")).alias("k"))
    return ST.proportion_interval(g, "k", "n").select("lno", "status", "rate", "ci_low", "ci_high")


@query("st13_contrast_runner", f"""WITH {SUMM}, o AS (SELECT *, CASE WHEN metric='accuracy' THEN sign_p END AS pp FROM summ),
h AS (SELECT dataset, contrast, metric, least(1.0, max(pp*(m-r+1)) OVER (PARTITION BY dataset ORDER BY r)) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pp, contrast, metric) AS r, count(*) OVER (PARTITION BY dataset) AS m FROM o WHERE metric='accuracy')),
b AS (SELECT dataset, contrast, metric, least(1.0, min(sign_p*m/r) OVER (PARTITION BY dataset ORDER BY r DESC)) AS p_bh FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sign_p, contrast, metric) AS r, count(*) OVER (PARTITION BY dataset) AS m FROM summ))
SELECT dataset, contrast, metric, 'ok' AS status, mean_diff, sign_p, p_holm, p_bh FROM summ LEFT JOIN h USING (dataset, contrast, metric) LEFT JOIN b USING (dataset, contrast, metric)
UNION ALL SELECT DISTINCT dataset, 'unfinished', '-', 'not_run', NULL, NULL, NULL, NULL FROM runs""", floats="mean_diff sign_p p_holm p_bh", ints="dataset")
def _(t):
    return ST.contrast_table(runs(t), CONTRASTS, ["accuracy"]).select(*BY, "status", "mean_diff", "sign_p", "p_holm", "p_bh")


INTERVAL = SUMM + ", ivl AS (SELECT *, mean_diff-1.96*sd/sqrt(n_pairs) AS ci_low, mean_diff+1.96*sd/sqrt(n_pairs) AS ci_high FROM summ)"
VERDICT = "CASE WHEN n_pairs < 5 OR ci_low IS NULL THEN 'INSUFFICIENT_DATA' WHEN ci_low > 0 THEN 'REAL_GT_SHUFFLED' WHEN ci_high < 0 THEN 'SHUFFLED_GT_REAL' ELSE 'REAL_APPROX_SHUFFLED' END"


@query("st14_control_verdict", f"WITH {INTERVAL} SELECT dataset, metric, {VERDICT} AS verdict, ci_low, ci_high FROM ivl WHERE contrast='negative_control'", floats="ci_low ci_high", ints="dataset")
def _(t):
    rows = ST.t_interval(summary(t)).filter("contrast = 'negative_control'")
    return rows.select("dataset", "metric", ST.control_verdict(F.col("ci_low"), F.col("ci_high"), F.col("n_pairs")).alias("verdict"), "ci_low", "ci_high")


@query("st15_gain_decomposition", f"""WITH {INTERVAL}, f AS (SELECT * FROM ivl WHERE metric='fidelity')
SELECT dataset, max(mean_diff) FILTER (contrast='architecture') AS architecture, max(mean_diff) FILTER (contrast='incremental') AS incremental, max(mean_diff) FILTER (contrast='total') AS total,
 max(mean_diff) FILTER (contrast='negative_control') AS real_minus_shuffled, max({VERDICT}) FILTER (contrast='negative_control') AS negative_control FROM f GROUP BY 1""",
       floats="architecture incremental total real_minus_shuffled", ints="dataset")
def _(t):
    parts = {"architecture": "architecture", "incremental": "incremental", "total": "total", "real_minus_shuffled": "negative_control"}
    return ST.gain_decomposition(summary(t), "fidelity", parts, "negative_control")


@query("st15_control_win_fraction", f"""WITH {RUNS}, d AS (SELECT a.value-b.value AS d FROM runs a JOIN runs b USING (dataset, split_id, metric) WHERE a.arm='full' AND b.arm IN ('shuffled','plain') AND metric='fidelity'),
m AS (SELECT count(*) AS comparisons, count_if(d>1e-12) AS wins, count_if(d < -1e-12) AS losses, count_if(abs(d)<=1e-12) AS ties, avg(d) AS mean_gain FROM d)
SELECT *, wins/comparisons AS win_fraction, CASE WHEN wins+losses=0 THEN 'NOT_ATTRIBUTED_TIES' WHEN mean_gain > 0 AND wins/comparisons >= 0.8 THEN 'ATTRIBUTED' ELSE 'NOT_ATTRIBUTED' END AS status FROM m""",
       floats="mean_gain win_fraction", ints="comparisons wins losses ties")
def _(t):
    rows = runs(t).filter("metric = 'fidelity'").select("dataset", "split_id", "arm", "value")
    return ST.control_win_fraction(rows.filter("arm = 'full'").drop("arm"), rows.filter("arm IN ('shuffled', 'plain')").drop("arm"), ["dataset", "split_id"])


@query("st16_evidence", f"""WITH {INTERVAL}, r AS ({RANKED[len(PAIRED) + 2:].replace('nz AS', 'WITH nz AS', 1)} SELECT * FROM ranks), e AS (SELECT ivl.*, (w_plus-w_minus)/(w_plus+w_minus) AS rb FROM ivl LEFT JOIN r USING (dataset, contrast, metric)),
f AS (SELECT *, concat_ws(',', CASE WHEN n_pairs >= 10 THEN NULL ELSE 'few_pairs' END, CASE WHEN min_test >= 150 THEN NULL ELSE 'small_test' END, CASE WHEN sign_p < 0.05 THEN NULL ELSE 'p_not_significant' END,
 CASE WHEN ci_low > 0 OR ci_high < 0 THEN NULL ELSE 'interval_has_zero' END, CASE WHEN abs(rb) >= 0.3 THEN NULL ELSE 'small_effect' END) AS reasons FROM e)
SELECT dataset, contrast, metric, CASE WHEN ties = n_pairs AND n_pairs > 0 THEN 'IDENTICAL_RESULTS' WHEN n_pairs < 3 THEN 'MECHANISM_ONLY' WHEN reasons = '' THEN 'STATISTICALLY_SUPPORTED' ELSE 'INDICATIVE' END AS evidence, reasons FROM f""", ints="dataset")
def _(t):
    rows = ST.t_interval(summary(t)).join(ST.signed_ranks(paired(t), BY).select(*BY, "rank_biserial"), BY, "left")
    return ST.evidence(rows, "sign_p", "rank_biserial").select(*BY, "evidence", "reasons")


@query("st17_across_datasets", f"""WITH {SUMM} SELECT contrast, metric, count(*) AS n_datasets, avg(mean_diff) AS mean_of_means, stddev_samp(mean_diff) AS sd_of_means, count_if(mean_diff>0) AS positive, count_if(mean_diff<0) AS negative
FROM summ WHERE dataset NOT IN (SELECT dataset FROM runs GROUP BY 1 HAVING count(DISTINCT split_id) < 12) GROUP BY 1, 2""", floats="mean_of_means sd_of_means", ints="n_datasets positive negative")
def _(t):
    incomplete = runs(t).groupBy("dataset").agg(F.count_distinct("split_id").alias("k")).filter("k < 12").select("dataset")
    return ST.across_datasets(summary(t), incomplete)


@query("st18_hierarchy", f"""WITH {RUNS}, w AS (SELECT dataset, split_id, {', '.join(f"max(value) FILTER (arm='{a}' AND metric='{m}') AS {m[:3]}_{n}" for n, a in (('r', 'full'), ('o', 'core'), ('c', 'plain')) for m in ('accuracy', 'fidelity'))} FROM runs GROUP BY 1, 2)
SELECT dataset, split_id, CASE WHEN acc_r>acc_o AND fid_r>fid_o THEN 'JOINT_GAIN' WHEN (acc_r-acc_o>0 AND fid_r-fid_o<0) OR (fid_r-fid_o>0 AND acc_r-acc_o<0) THEN 'TRADEOFF' WHEN acc_r>acc_o THEN 'ACCURACY_ONLY_GAIN' WHEN fid_r>fid_o THEN 'FIDELITY_ONLY_GAIN'
 WHEN acc_r=acc_o AND fid_r=fid_o THEN 'EQUIVALENT' ELSE 'NO_GAIN' END AS direct,
 CASE WHEN acc_r>acc_o AND acc_o>acc_c AND acc_r>acc_c AND fid_r>fid_o AND fid_r>fid_c THEN 'JOINT_HIERARCHY_SATISFIED' WHEN NOT acc_o>acc_c THEN 'HIERARCHY_INFEASIBLE'
 WHEN (acc_r>acc_o AND fid_r<fid_o) OR (fid_r>fid_o AND acc_r<acc_o) OR (acc_r>acc_c AND fid_r<fid_c) OR (fid_r>fid_c AND acc_r<acc_c) THEN 'TRADEOFF' ELSE 'NOT_SATISFIED' END AS chain FROM w""", ints="dataset split_id")
def _(t):
    return ST.hierarchy(runs(t), ["dataset", "split_id"], "full", "core", "plain").select("dataset", "split_id", "direct", "chain")


@query("st19_acceptance", f"""WITH {RUNS}, c AS (SELECT dataset, split_id, max(value) FILTER (arm='full' AND metric='accuracy') AS acc, max(value) FILTER (arm='full' AND metric='fidelity') AS fid, max(value) FILTER (arm='core' AND metric='accuracy') AS bacc FROM runs GROUP BY 1, 2),
f AS (SELECT dataset, split_id, concat_ws(',', CASE WHEN acc >= bacc-0.01 THEN NULL ELSE 'accuracy_noninferior' END, CASE WHEN fid >= 0.5 THEN NULL ELSE 'fidelity_floor' END) AS failed FROM c)
SELECT dataset, split_id, failed, failed = '' AS accepted FROM f""", ints="dataset split_id")
def _(t):
    wide = lambda arm: runs(t).filter(F.col("arm") == arm).groupBy("dataset", "split_id").pivot("metric", ["accuracy", "fidelity"]).agg(F.max("value"))
    return ST.acceptance(wide("full"), wide("core"), ["dataset", "split_id"], ["accuracy"], fidelity_floor=0.5).select("dataset", "split_id", "failed", "accepted")


CELLS = SCORED + """, cells AS (SELECT year(shipdate) AS dataset, month(shipdate) AS split_id, CASE WHEN status='O' THEN 1 ELSE -1 END AS st, CASE WHEN qty > 25 THEN 1 ELSE -1 END AS big, CASE WHEN lno > 3 THEN 1 ELSE -1 END AS late,
 avg((s=t)::INT) AS value FROM scored GROUP BY 1, 2, 3, 4, 5)"""
EFFECTS = {"st": "st", "big": "big", "late": "late", "stxbig": "st*big", "stxlate": "st*late", "bigxlate": "big*late", "stxbigxlate": "st*big*late"}
FACT = CELLS + ", fe AS (SELECT dataset, split_id, " + ", ".join(f"sum({e}*value)/4 AS {n}" for n, e in EFFECTS.items()) + " FROM cells GROUP BY 1, 2 HAVING count(*) = 8), fl AS (" + \
    " UNION ALL ".join(f"SELECT dataset, split_id, '{n}' AS effect, {n} AS estimate FROM fe" for n in EFFECTS) + ")"


def cells(t):
    sign = lambda c: F.when(c, 1).otherwise(-1)
    rows = scored(t).withColumns({"dataset": F.year("shipdate"), "split_id": F.month("shipdate"), "st": sign(F.col("status") == "O"), "big": sign(F.col("qty") > 25), "late": sign(F.col("lno") > 3)})
    return rows.groupBy("dataset", "split_id", "st", "big", "late").agg(F.avg((F.col("s") == F.col("t")).cast("double")).alias("value"))


@query("st20_factorial_effects", f"WITH {FACT} SELECT * FROM fl", floats="estimate", ints="dataset split_id")
def _(t):
    return ST.factorial_effects(cells(t), ["dataset", "split_id"], ["st", "big", "late"])


@query("st20_effect_summary", f"""WITH {FACT}, m AS (SELECT effect, avg(m) AS macro_mean FROM (SELECT effect, dataset, avg(estimate) AS m FROM fl GROUP BY 1, 2) GROUP BY 1)
SELECT effect, count(*) AS n_units, avg(estimate) AS mean, stddev_samp(estimate)/sqrt(count(*)) AS se, count_if(estimate>1e-9) AS better, count_if(estimate < -1e-9) AS worse, max(macro_mean) AS macro_mean, avg(estimate)/(stddev_samp(estimate)/sqrt(count(*))) AS t_stat
FROM fl JOIN m USING (effect) GROUP BY 1""", floats="mean se macro_mean t_stat", ints="n_units better worse")
def _(t):
    return ST.effect_summary(ST.factorial_effects(cells(t), ["dataset", "split_id"], ["st", "big", "late"]), "dataset")


@query("st21_bootstrap_ratio")
def _(t):
    wide = runs(t).filter("metric = 'fidelity'").groupBy("dataset", "split_id").pivot("arm", ["full", "core"]).agg(F.max("value"))
    return R.ratio_interval(wide, "full", "core", ["split_id", "dataset"], ["dataset"])


@query("st22_variance_components", f"""WITH {PAIRED}, p AS (SELECT contrast, metric, dataset, count(d) AS n, avg(d) AS m, var_pop(d) AS v, sum(d) AS s FROM paired GROUP BY 1, 2, 3), g AS (SELECT contrast, metric, sum(s)/sum(n) AS grand FROM p GROUP BY 1, 2),
a AS (SELECT contrast, metric, count(*) AS datasets, sum(n) AS units, max(grand) AS mean, sum(v*n) AS ssw, sum(n*(m-grand)**2) AS ssb, sum(n*n) AS nn FROM p JOIN g USING (contrast, metric) GROUP BY 1, 2),
k AS (SELECT *, sqrt(ssw/(units-datasets)) AS sigma_within, sqrt(greatest(0, (ssb/(datasets-1) - ssw/(units-datasets))/((units-nn/units::DOUBLE)/(datasets-1)))) AS sigma_between FROM a)
SELECT contrast, metric, datasets, units, mean, sigma_within, sigma_between, ceil((1.959964+0.841621)**2*(sigma_between**2+sigma_within**2/12)/0.05**2) AS datasets_needed FROM k""",
       floats="mean sigma_within sigma_between", ints="datasets units datasets_needed")
def _(t):
    return ST.variance_components(paired(t))


@query("st23_mean_ranks", f"WITH {BLOCKR} SELECT metric, arm, avg(rk) AS mean_rank, count(*) AS blocks FROM rk GROUP BY 1, 2", floats="mean_rank", ints="blocks")
def _(t):
    return ST.mean_ranks(runs(t).filter("arm <> 'teacher'"), ["dataset", "split_id", "metric"], ["metric", "arm"])


@query("st24_individual_table", f"WITH {RUNS} SELECT dataset, arm, printf('%.4f ± %.4f', avg(value), coalesce(stddev_samp(value),0)) AS text FROM runs WHERE metric='accuracy' GROUP BY 1, 2", ints="dataset")
def _(t):
    return ST.formatted(ST.describe(runs(t).filter("metric = 'accuracy'"), ["dataset", "arm"])).select("dataset", "arm", "text")


@query("st24_contrast_pivot", f"""WITH {SUMM} SELECT dataset, max(mean_diff) FILTER (contrast='architecture') AS architecture, max(mean_diff) FILTER (contrast='incremental') AS incremental, max(mean_diff) FILTER (contrast='total') AS total
FROM summ WHERE metric='accuracy' GROUP BY 1""", floats="architecture incremental total", ints="dataset")
def _(t):
    return summary(t).filter("metric = 'accuracy'").groupBy("dataset").pivot("contrast", ["architecture", "incremental", "total"]).agg(F.max("mean_diff"))


SUPPLIERS = """m AS (SELECT l_suppkey AS skey, avg(l_discount) AS disc, avg(l_quantity) AS qty, -avg(l_tax) AS tax, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)"""


@query("st25_pareto_front", f"""WITH {SUPPLIERS} SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.skey <> a.skey AND b.disc >= a.disc-1e-12 AND b.qty >= a.qty-1e-12 AND b.tax >= a.tax-1e-12 AND b.n >= a.n-1e-12
 AND (b.disc > a.disc+1e-12 OR b.qty > a.qty+1e-12 OR b.tax > a.tax+1e-12 OR b.n > a.n+1e-12))""", floats="disc qty tax n", ints="skey")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("skey")).agg(F.avg("l_discount").alias("disc"), F.avg("l_quantity").alias("qty"), (-F.avg("l_tax")).alias("tax"), F.count(F.lit(1)).cast("double").alias("n"))
    return ST.pareto_front(rows, "skey", ["disc", "qty", "tax", "n"])


@query("st26_perturbation_robustness")
def _(t):
    rows = scored(t)
    key = ["okey", "lno", "pkey", "skey", "price"]
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in FEATURES]).first()
    noisy = rows.select("s", *[(F.col(c) + 0.01 * spread[c] * gaussian(f"noise:{c}", *key)).alias(c) for c in FEATURES])
    again = SURROGATE.score(noisy, "s2", "leaf2")
    return again.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("s") == F.col("s2")).cast("double")), 6).alias("unchanged"))


@query("st27_ablation_coverage", f"WITH {RUNS}, w AS (SELECT * FROM (SELECT DISTINCT dataset FROM runs), (VALUES ('full'),('core'),('late_arm')) v(arm)) SELECT dataset, arm FROM w ANTI JOIN (SELECT DISTINCT dataset, arm FROM runs) USING (dataset, arm)", ints="dataset")
def _(t):
    return ST.ablation_coverage(runs(t), ["full", "core", "late_arm"])


@query("st27_ablation_deltas", f"""WITH {RUNS} SELECT a.arm, metric, count(*) AS n, avg(a.value-b.value) AS mean_delta, coalesce(stddev_samp(a.value-b.value),0) AS sd_delta FROM runs a JOIN (SELECT dataset, split_id, metric, value FROM runs WHERE arm='full') b USING (dataset, split_id, metric)
WHERE a.arm <> 'full' GROUP BY 1, 2""", floats="mean_delta sd_delta", ints="n")
def _(t):
    return ST.ablation_deltas(runs(t), "full", ["dataset", "split_id"])


@query("st28_no_effect_rate", f"""WITH {RUNS}, w AS (SELECT dataset, split_id, max(value) FILTER (arm='full' AND metric='accuracy')-max(value) FILTER (arm='core' AND metric='accuracy') AS da,
 max(value) FILTER (arm='full' AND metric='fidelity')-max(value) FILTER (arm='core' AND metric='fidelity') AS df FROM runs GROUP BY 1, 2),
s AS (SELECT dataset, CASE WHEN split_id = 6 THEN 'NO_ATTEMPT' WHEN da > 0.02 OR df > 0.02 THEN 'GAIN_OBSERVED' WHEN da < -0.02 OR df < -0.02 THEN 'HARM_OBSERVED' ELSE 'NO_OBSERVED_GAIN' END AS status FROM w)
SELECT dataset, count_if(status <> 'NO_ATTEMPT') AS attempts, avg((status = 'NO_OBSERVED_GAIN')::INT) FILTER (status <> 'NO_ATTEMPT') AS no_effect_rate FROM s GROUP BY 1""", floats="no_effect_rate", ints="dataset attempts")
def _(t):
    cell = lambda arm, m: F.max(F.when((F.col("arm") == arm) & (F.col("metric") == m), F.col("value")))
    wide = runs(t).groupBy("dataset", "split_id").agg((cell("full", "accuracy") - cell("core", "accuracy")).alias("da"), (cell("full", "fidelity") - cell("core", "fidelity")).alias("df"))
    reports = wide.withColumn("status", ST.gain_status(F.col("da"), F.col("df"), F.col("split_id") != 6, tol=0.02))
    return ST.no_effect_rate(reports, ["dataset"])


CAMPAIGN = RUNS + """, cp AS (SELECT dataset, metric, round(a.value-b.value, 12) AS d FROM runs a JOIN runs b USING (dataset, split_id, metric) WHERE a.arm='full' AND b.arm='shuffled'),
camp AS (SELECT dataset, metric, avg(d) AS mean, count_if(d>0) AS wins, count_if(d=0) AS ties, count_if(d<0) AS losses, count(*) AS n FROM cp GROUP BY 1, 2)"""


@query("st29_campaign_contrast", f"WITH {CAMPAIGN} SELECT * FROM camp", floats="mean", ints="dataset wins ties losses n")
def _(t):
    return ST.campaign_contrast(runs(t), "full", "shuffled")


@query("st29_criteria_counts", f"WITH {CAMPAIGN} SELECT metric, count_if(mean >= 0) AS not_worse, count_if(mean > 0) AS better, count(*) AS datasets FROM camp GROUP BY 1", ints="not_worse better datasets")
def _(t):
    return ST.criteria_counts(ST.campaign_contrast(runs(t), "full", "shuffled"))


@query("st30_budget_confounding", f"""WITH {SCORED}, c AS (SELECT year(shipdate) AS dataset, CASE WHEN lno <= 3 THEN 'full' ELSE 'shuffled' END AS arm, skey, count(*)::DOUBLE AS queries, count(DISTINCT pkey)::DOUBLE AS width FROM scored GROUP BY 1, 2, 3),
w AS (SELECT year(shipdate) AS dataset, avg((s=t)::INT) > 0.4 AS wins_arm FROM scored GROUP BY 1),
r AS (SELECT dataset, avg(queries) FILTER (arm='shuffled')/avg(queries) FILTER (arm='full') AS query_ratio, abs(avg(width) FILTER (arm='shuffled')-avg(width) FILTER (arm='full'))/greatest(1, avg(width) FILTER (arm='full')) AS width_gap FROM c GROUP BY 1)
SELECT dataset, query_ratio, width_gap, wins_arm, (wins_arm AND query_ratio < 0.8) OR (NOT wins_arm AND query_ratio > 1.25) AS budget_confounded, width_gap > 0 AS width_confounded FROM r JOIN w USING (dataset)""",
       floats="query_ratio width_gap", ints="dataset")
def _(t):
    rows = scored(t).withColumns({"dataset": F.year("shipdate"), "arm": F.when(F.col("lno") <= 3, "full").otherwise("shuffled")})
    costs = rows.groupBy("dataset", "arm", "skey").agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("pkey").alias("width"))
    wins = rows.groupBy("dataset").agg((F.avg((F.col("s") == F.col("t")).cast("double")) > 0.4).alias("wins_arm"))
    return ST.budget_confounding(costs, "full", "shuffled", wins)


@query("st31_recovery", f"""WITH {RUNS}, u AS (SELECT metric AS problem, arm AS variant, dataset*100+split_id AS unit, value >= CASE WHEN metric='accuracy' THEN 0.34 ELSE 0.42 END AS recovered FROM runs WHERE arm <> 'teacher'),
p AS (SELECT problem, variant, count(*)::DOUBLE AS n, count_if(recovered)::DOUBLE AS k FROM u GROUP BY 1, 2), b AS (SELECT u.problem, u.variant, count_if(u.recovered AND NOT o.recovered) AS b, count_if(NOT u.recovered AND o.recovered) AS c, avg(u.recovered::INT)-avg(o.recovered::INT) AS delta
 FROM u JOIN u o ON o.problem=u.problem AND o.unit=u.unit AND o.variant='plain' GROUP BY 1, 2)
SELECT problem, variant, n, k, k/n AS rate, greatest(0, {WIL.format(k='k', n='n', s='-')}) AS ci_low, least(1, {WIL.format(k='k', n='n', s='+')}) AS ci_high, b, c, delta, delta >= 0.2 AS ahead FROM p JOIN b USING (problem, variant)""",
       floats="rate ci_low ci_high delta", ints="n k b c")
def _(t):
    cut = F.when(F.col("metric") == "accuracy", 0.34).otherwise(0.42)
    units = runs(t).filter("arm <> 'teacher'").select(F.col("metric").alias("problem"), F.col("arm").alias("variant"), (F.col("dataset") * 100 + F.col("split_id")).alias("unit"), (F.col("value") >= cut).alias("recovered"))
    return ST.recovery(units, "plain")


@query("st32_noninferiority", f"""WITH {INTERVAL}, n AS (SELECT *, greatest(0.01, 1.0::DOUBLE/greatest(1, min_test)) AS tolerance FROM ivl)
SELECT dataset, contrast, metric, tolerance, CASE WHEN abs(mean_diff) < 1.0::DOUBLE/greatest(1, min_test) OR (ci_low <= 0 AND ci_high >= 0) THEN 'inconclusive' WHEN mean_diff >= -tolerance THEN 'accepted' ELSE 'rejected' END AS decision FROM n""", floats="tolerance", ints="dataset")
def _(t):
    return ST.noninferiority(ST.t_interval(summary(t)), "mean_diff", "min_test", 0.01, "ci_low", "ci_high").select(*BY, "tolerance", "decision")
