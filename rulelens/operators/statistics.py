"""Paired statistics on result tables (dataset, arm, split, metric, value).

Statistics are Spark aggregates; tail probabilities are applied to the few rows that come out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.lineage import cut, written
from rulelens.functions.ordering import average_ranks, running_sums
from rulelens.functions.pvalues import binomial_two_sided, chi2_p, normal_p, signed_rank_p, t_p
from rulelens.functions.shapes import add, bin_column, failed_names, hits, long_form, ratio, unions
from rulelens.operators.trees import wilson_bounds

TIE_DIGITS = 12
# fixed values: cut points of the effect labels (small, medium, large)
EFFECT_CUTS = {"cohens_dz": (0.2, 0.5, 0.8), "cliffs_delta": (0.147, 0.33, 0.474), "rank_biserial": (0.1, 0.3, 0.5)}
# fixed values: two-sided normal quantiles for alpha, one-sided for power
Z_ALPHA = {0.05: 1.959964, 0.01: 2.575829}
Z_POWER = {0.8: 0.841621, 0.9: 1.281552}


def describe(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.filter("value IS NOT NULL").groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))


def pairs(results: DataFrame, contrasts: Sequence[Mapping]) -> DataFrame:
    """(dataset, contrast, metric, split_id, a, b, d): declared arm pairs matched on dataset, split and metric."""
    declared = F.broadcast(results.sparkSession.createDataFrame([(c["name"], c["a"], c["b"]) for c in contrasts], "contrast string, arm_a string, arm_b string"))
    keys = ["dataset", "split_id", "metric"]
    a = results.join(declared, results["arm"] == declared["arm_a"]).select(*keys, "contrast", "arm_b", F.col("value").alias("a"), "n_test", F.col("oracle_name").alias("oracle_a"))
    b = results.select(*keys, F.col("arm").alias("arm_b"), F.col("value").alias("b"), F.col("oracle_name").alias("oracle_b"))
    return a.join(b, [*keys, "arm_b"]).filter("a IS NOT NULL AND b IS NOT NULL").drop("arm_b").withColumn("d", F.round(F.col("a") - F.col("b"), TIE_DIGITS))


def paired_summary(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means, median gap, wins and ties, t statistic, standardised gap, and the sign-test tail."""
    d = F.col("d")
    out = paired.groupBy(*by).agg(
        F.count("d").alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.5)).alias("median_diff"),
        hits(d > 0).alias("wins_a"), hits(d < 0).alias("wins_b"), hits(d == 0).alias("ties"), F.stddev_samp("d").alias("sd"), F.min("n_test").alias("min_test"))
    n = F.col("n_pairs")
    return out.withColumns({
        "t_stat": ratio(F.col("mean_diff"), F.col("sd") / F.sqrt(n)), "dz": ratio(F.col("mean_diff"), F.col("sd")),
        "sign_p": F.when(F.col("wins_a") + F.col("wins_b") > 0, binomial_two_sided(F.least("wins_a", "wins_b"), F.col("wins_a") + F.col("wins_b"))).otherwise(1.0)})


def signed_ranks(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """W+ and W- over mid-ranks of the non-zero |d|, and the rank-biserial effect."""
    by = list(by)
    sizes = paired.filter("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), hits(F.col("d") > 0).alias("n_pos"))
    ranked = average_ranks(sizes, "size", "n", by)
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n_nonzero"), F.sum(F.col("avg_rank") * F.col("n_pos")).alias("w_plus"),
                                  F.sum(F.col("avg_rank") * (F.col("n") - F.col("n_pos"))).alias("w_minus"), F.sum(F.col("n") ** 3 - F.col("n")).alias("tie_term"))
    return out.withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def signed_rank_p_values(ranks: DataFrame) -> DataFrame:
    """Exact tail for up to 50 untied differences, normal approximation with tie correction otherwise."""
    n = F.col("n_nonzero")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var), 0.0)
    exact = (F.col("tie_term") == 0) & (n <= 50)
    tagged = ranks.withColumns({"z": z, "exact": exact})
    tagged = tagged.withColumn("p_exact", signed_rank_p(F.when(exact, F.col("w_plus")), F.when(exact, n))).withColumn("p_normal", normal_p(F.col("z")))
    return tagged.withColumn("p", F.coalesce("p_exact", "p_normal")).drop("p_exact", "p_normal")


def mcnemar(df: DataFrame, truth: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts, continuity-corrected chi-square, exact tail below 25 discordant rows."""
    ok1, ok2 = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    out = df.groupBy(*by).agg(hits(ok1 & ~ok2).alias("b"), hits(~ok1 & ok2).alias("c"), hits(ok1 & ok2).alias("both"), hits(~ok1 & ~ok2).alias("neither"))
    n = F.col("b") + F.col("c")
    return out.withColumns({"chi2": F.when(n > 0, (F.abs(F.col("b") - F.col("c")) - 1) ** 2 / n).otherwise(0.0),
                            "exact_p": F.when((n > 0) & (n < 25), binomial_two_sided(F.least("b", "c"), n))})


def effect_label(value: Column, kind: str) -> Column:
    small, medium, large = EFFECT_CUTS[kind]
    x = F.abs(value)
    return F.when(x < small, "negligible").when(x < medium, "small").when(x < large, "medium").otherwise("large")


def cliffs_delta(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """P(a > b) - P(a < b) from one pooled ordering of distinct values (never all pairs)."""
    by = list(by)
    sides = paired.select(*by, F.explode(F.array(F.struct(F.round("a", TIE_DIGITS).alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")),
                                                 F.struct(F.round("b", TIE_DIGITS).alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))).alias("s")).select(*by, "s.*")
    counts = sides.groupBy(*by, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    cum = running_sums(counts, "v", {"cb": "nb"}, by, totals={"tb": "nb"})
    below, above = F.col("cb") - F.col("nb"), F.col("tb") - F.col("cb")
    return cum.groupBy(*by).agg((F.sum(F.col("na") * (below - above)) / (F.sum("na") * F.sum("nb"))).alias("cliffs_delta"))


def holm(df: DataFrame, p: str, family: Sequence[str], order: Sequence[str], name: str = "p_holm") -> DataFrame:
    """Step-down adjustment within a family of declared contrasts; missing p-values stay missing."""
    w = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *order)  # one row per contrast
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.when(F.col(p).isNotNull(), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("__step", step).withColumn(
        name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))))).drop("__step")


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str], order: Sequence[str], name: str = "p_bh") -> DataFrame:
    """Step-up adjustment; missing p-values stay missing."""
    up = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *order)  # one row per contrast
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.when(F.col(p).isNotNull(), F.col(p) * m / F.row_number().over(up))
    return df.withColumn("__step", step).withColumn(
        name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__step").over(up.rowsBetween(0, Window.unboundedFollowing))))).drop("__step")


def block_ranks(results: DataFrame, block: Sequence[str], descending: bool = True) -> DataFrame:
    """Mid-rank of every arm inside its block (a block holds one row per arm)."""
    v = F.round("value", TIE_DIGITS)
    w = Window.partitionBy(*block)
    return results.withColumn("__v", v).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*block, "__v"))).withColumn(
        "rank", F.rank().over(w.orderBy(F.desc("__v") if descending else F.asc("__v"))) + (F.col("ties") - 1) / F.lit(2.0)).drop("__v")


def friedman(results: DataFrame, by: Sequence[str], block: Sequence[str]) -> DataFrame:
    """Tie-corrected chi-square over blocks x arms; only complete blocks count."""
    by = list(by)
    arms = results.groupBy(*by).agg(F.count_distinct("arm").alias("k"))
    full = results.join(arms, by).withColumn("__in", F.count(F.lit(1)).over(Window.partitionBy(*by, *block))).filter(F.col("__in") == F.col("k"))
    ranked = block_ranks(full, [*by, *block])
    per_arm = ranked.groupBy(*by, "arm").agg(F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("blocks"), F.max("k").alias("k"), F.sum(F.col("ties") ** 2 - 1).alias("tie_term"))
    out = per_arm.groupBy(*by).agg(F.sum(F.col("rank_sum") ** 2).alias("ss"), F.max("blocks").alias("blocks"), F.max("k").alias("arms"), F.sum("tie_term").alias("tie_term"))
    n, k = F.col("blocks"), F.col("arms")
    correction = 1 - F.col("tie_term") / (k * (k * k - 1) * n)
    return out.select(*by, "blocks", "arms", ((12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / correction).alias("chi2"))


def friedman_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", chi2_p(F.col("chi2"), F.col("arms") - 1))


def corrected_t(summary: DataFrame, test_over_train: float) -> DataFrame:
    """t for overlapping folds: variance factor 1/k + n_test / n_train."""
    k = F.col("n_pairs")
    return summary.withColumn("corrected_t", F.when((k >= 3) & (F.col("sd") > 0), F.col("mean_diff") / F.sqrt((1 / k + test_over_train) * F.col("sd") ** 2)))


def with_t_p(summary: DataFrame, t: str, name: str = "p") -> DataFrame:
    return summary.withColumn(name, t_p(F.col(t), F.col("n_pairs") - 1))


def proportion_interval(df: DataFrame, k: str, n: str, z: float = 1.96) -> DataFrame:
    low, high = wilson_bounds(F.col(k), F.col(n), z)
    return df.withColumns({"rate": F.col(k) / F.col(n), "ci_low": F.greatest(F.lit(0.0), low), "ci_high": F.least(F.lit(1.0), high)})


def contrast_table(results: DataFrame, contrasts: Sequence[Mapping], primary: Sequence[str]) -> DataFrame:
    """Every declared contrast per dataset: ok rows with statistics, plus not_run and not_comparable rows."""
    paired = pairs(results, contrasts)
    by = ["dataset", "contrast", "metric"]
    teachers = paired.groupBy(*by).agg(F.array_sort(F.collect_set("oracle_a")).alias("oa"), F.array_sort(F.collect_set("oracle_b")).alias("ob"))
    mixed = (F.col("metric") == "fidelity") & (F.col("oa") != F.col("ob"))
    summary = paired_summary(paired, by).join(teachers, by)
    good = summary.filter(~mixed).drop("oa", "ob").withColumn("status", F.lit("ok"))
    good = holm(good.withColumn("__fam", F.when(F.col("metric").isin(*primary), "primary").otherwise("other")).withColumn("__p", F.when(F.col("__fam") == "primary", F.col("sign_p"))),
                "__p", ["dataset", "__fam"], ["contrast", "metric"]).drop("__fam", "__p")
    good = benjamini_hochberg(good, "sign_p", ["dataset"], ["contrast", "metric"])
    bad = summary.filter(mixed).select(*by, F.lit("not_comparable").alias("status"), F.lit("different teachers").alias("reason"))
    names = F.explode(F.array(*[F.lit(c["name"]) for c in contrasts]))
    wanted = results.select("dataset").distinct().withColumn("contrast", names)
    missing = wanted.join(paired.select("dataset", "contrast").distinct(), ["dataset", "contrast"], "left_anti").select(
        "dataset", "contrast", F.lit("-").alias("metric"), F.lit("not_run").alias("status"), F.lit("an arm did not run").alias("reason"))
    return unions([good, bad, missing])


def control_verdict(low: Column, high: Column, n_pairs: Column, min_pairs: int = 5) -> Column:
    """Real against shuffled, read from the interval of the paired difference."""
    return F.when((n_pairs < min_pairs) | low.isNull(), "INSUFFICIENT_DATA").when(low > 0, "REAL_GT_SHUFFLED").when(high < 0, "SHUFFLED_GT_REAL").otherwise("REAL_APPROX_SHUFFLED")


def t_interval(summary: DataFrame, z: float = 1.96) -> DataFrame:
    """Normal-theory interval of the mean difference, for tables checked without resampling."""
    half = z * F.col("sd") / F.sqrt("n_pairs")
    return summary.withColumns({"ci_low": F.col("mean_diff") - half, "ci_high": F.col("mean_diff") + half})


def gain_decomposition(summary: DataFrame, metric: str, parts: Mapping[str, str], control: str) -> DataFrame:
    """One row per dataset: the mean difference of each named contrast and what it may be attributed to."""
    rows = t_interval(summary).filter(F.col("metric") == metric)
    pick = lambda contrast, c: F.max(F.when(F.col("contrast") == contrast, F.col(c)))
    wide = rows.groupBy("dataset").agg(*[pick(c, "mean_diff").alias(n) for n, c in parts.items()], pick(control, "ci_low").alias("__lo"), pick(control, "ci_high").alias("__hi"),
                                       pick(control, "n_pairs").alias("__n"))
    verdict = control_verdict(F.col("__lo"), F.col("__hi"), F.coalesce("__n", F.lit(0)))
    return wide.withColumn("negative_control", verdict).drop("__lo", "__hi", "__n")


def control_win_fraction(real: DataFrame, controls: DataFrame, keys: Sequence[str], min_share: float = 0.8, min_gain: float = 0.0) -> DataFrame:
    """Share of (fold, control) comparisons won by the real variant; ties count against it."""
    both = real.withColumnRenamed("value", "real").join(controls.withColumnRenamed("value", "control"), list(keys)).withColumn("d", F.col("real") - F.col("control"))
    out = both.agg(F.count(F.lit(1)).alias("comparisons"), hits(F.col("d") > 1e-12).alias("wins"), hits(F.col("d") < -1e-12).alias("losses"), hits(F.abs("d") <= 1e-12).alias("ties"), F.avg("d").alias("mean_gain"))
    share_won = F.col("wins") / F.col("comparisons")
    status = F.when(F.col("wins") + F.col("losses") == 0, "NOT_ATTRIBUTED_TIES").when((F.col("mean_gain") > min_gain) & (share_won >= min_share), "ATTRIBUTED").otherwise("NOT_ATTRIBUTED")
    return out.withColumns({"win_fraction": share_won, "status": status})


def evidence(table: DataFrame, p: str, effect: str, min_units: int = 10, min_test: int = 150, alpha: float = 0.05, min_effect: float = 0.3) -> DataFrame:
    """Mechanism only, indicative, or statistically supported, with the reasons that held it back."""
    checks = {"few_pairs": F.col("n_pairs") >= min_units, "small_test": F.col("min_test") >= min_test, "p_not_significant": F.col(p) < alpha,
              "interval_has_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0), "small_effect": F.abs(F.col(effect)) >= min_effect}
    failed = failed_names(checks)
    level = (F.when((F.col("ties") == F.col("n_pairs")) & (F.col("n_pairs") > 0), "IDENTICAL_RESULTS").when(F.col("n_pairs") < 3, "MECHANISM_ONLY")
             .when(failed == "", "STATISTICALLY_SUPPORTED").otherwise("INDICATIVE"))
    return table.withColumns({"evidence": level, "reasons": failed})


def across_datasets(summary: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Mean per dataset first, then statistics over datasets (the dataset is the unit)."""
    kept = summary.join(excluded, "dataset", "left_anti") if excluded is not None else summary
    return kept.groupBy("contrast", "metric").agg(F.count(F.lit(1)).alias("n_datasets"), F.avg("mean_diff").alias("mean_of_means"), F.stddev_samp("mean_diff").alias("sd_of_means"),
                                                  hits(F.col("mean_diff") > 0).alias("positive"), hits(F.col("mean_diff") < 0).alias("negative"))


def joint_verdict(acc_r: Column, acc_o: Column, acc_c: Column, fid_r: Column, fid_o: Column, fid_c: Column) -> Column:
    """Two-level verdict over accuracy and fidelity of full, plain and baseline arms."""
    chain = (acc_r > acc_o) & (acc_o > acc_c) & (acc_r > acc_c) & (fid_r > fid_o) & (fid_r > fid_c)
    trade_o = ((acc_r > acc_o) & (fid_r < fid_o)) | ((fid_r > fid_o) & (acc_r < acc_o))
    trade_c = ((acc_r > acc_c) & (fid_r < fid_c)) | ((fid_r > fid_c) & (acc_r < acc_c))
    unknown = add([c.isNull().cast("int") for c in (acc_r, acc_o, acc_c, fid_r, fid_o, fid_c)]) > 0
    return (F.when(unknown, "INSUFFICIENT_EVIDENCE").when(chain, "JOINT_HIERARCHY_SATISFIED").when(~(acc_o > acc_c), "HIERARCHY_INFEASIBLE")
            .when(trade_o | trade_c, "TRADEOFF").otherwise("NOT_SATISFIED"))


def direct_verdict(d_acc: Column, d_fid: Column) -> Column:
    return (F.when(d_acc.isNull() | d_fid.isNull(), "INSUFFICIENT_EVIDENCE").when((d_acc > 0) & (d_fid > 0), "JOINT_GAIN")
            .when(((d_acc > 0) & (d_fid < 0)) | ((d_fid > 0) & (d_acc < 0)), "TRADEOFF").when(d_acc > 0, "ACCURACY_ONLY_GAIN").when(d_fid > 0, "FIDELITY_ONLY_GAIN")
            .when((d_acc == 0) & (d_fid == 0), "EQUIVALENT").otherwise("NO_GAIN"))


def hierarchy(results: DataFrame, unit: Sequence[str], full: str, plain: str, baseline: str) -> DataFrame:
    cell = lambda arm, metric: F.max(F.when((F.col("arm") == arm) & (F.col("metric") == metric), F.col("value")))
    wide = results.groupBy(*unit).agg(*[cell(a, m).alias(f"{m[:3]}_{n}") for n, a in (("r", full), ("o", plain), ("c", baseline)) for m in ("accuracy", "fidelity")])
    c = {k: F.col(k) for k in ("acc_r", "acc_o", "acc_c", "fid_r", "fid_o", "fid_c")}
    return wide.withColumns({"direct": direct_verdict(c["acc_r"] - c["acc_o"], c["fid_r"] - c["fid_o"]),
                             "chain": joint_verdict(c["acc_r"], c["acc_o"], c["acc_c"], c["fid_r"], c["fid_o"], c["fid_c"])})


def acceptance(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 0.01, fidelity_floor: float = 0.9) -> DataFrame:
    """Named non-inferiority checks of a candidate against a baseline, the failed ones, and the verdict."""
    old = baseline.select(*keys, *[F.col(m).alias(f"{m}__base") for m in metrics])
    joined = candidate.join(old, list(keys))
    checks = {f"{m}_noninferior": F.col(m) >= F.col(f"{m}__base") - tolerance for m in metrics}
    checks["fidelity_floor"] = F.col("fidelity") >= fidelity_floor
    return joined.withColumn("failed", failed_names(checks)).withColumn("accepted", F.col("failed") == "").drop(*[f"{m}__base" for m in metrics])


def factorial_effects(cells: DataFrame, unit: Sequence[str], factors: Sequence[str], value: str = "value") -> DataFrame:
    """Main effects and interactions of a two-level design per unit; factors are -1/+1 columns, incomplete units drop out."""
    unit = list(unit)
    size = 2 ** len(factors)
    effects: dict[str, Column] = {}
    for mask in range(1, size):
        names = [f for j, f in enumerate(factors) if mask >> j & 1]
        sign = F.lit(1.0)
        for f in names:
            sign = sign * F.col(f)
        effects["x".join(names)] = F.sum(sign * F.col(value)) / (size / 2)
    per = cells.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n"), *[e.alias(n) for n, e in effects.items()]).filter(F.col("__n") == size)
    return long_form(per, unit, list(effects), "effect", "estimate")


def effect_summary(effects: DataFrame, dataset: str) -> DataFrame:
    per = effects.groupBy("effect", dataset).agg(F.avg("estimate").alias("m")).groupBy("effect").agg(F.avg("m").alias("macro_mean"))
    out = effects.groupBy("effect").agg(F.count(F.lit(1)).alias("n_units"), F.avg("estimate").alias("mean"), (F.stddev_samp("estimate") / F.sqrt(F.count(F.lit(1)))).alias("se"),
                                        hits(F.col("estimate") > 1e-9).alias("better"), hits(F.col("estimate") < -1e-9).alias("worse"))
    return out.join(per, "effect").withColumn("t_stat", ratio(F.col("mean"), F.col("se")))


def variance_components(paired: DataFrame, delta: float = 0.05, per_dataset: int = 12, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Between- and within-dataset spread of paired differences and the datasets needed for a given power."""
    by = ["contrast", "metric"]
    per = paired.groupBy(*by, "dataset").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v"), F.sum("d").alias("s"))
    grand = per.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("grand"))
    agg = per.join(grand, by).groupBy(*by).agg(F.count(F.lit(1)).alias("datasets"), F.sum("n").alias("units"), F.max("grand").alias("mean"), F.sum(F.col("v") * F.col("n")).alias("ssw"),
                                               F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"), F.sum(F.col("n") ** 2).alias("nn"))
    m, n = F.col("datasets"), F.col("units")
    msw, msb = F.col("ssw") / (n - m), F.col("ssb") / (m - 1)
    n0 = (n - F.col("nn") / n) / (m - 1)
    out = agg.filter((m >= 2) & (n > m)).withColumns({"sigma_within": F.sqrt(msw), "sigma_between": F.sqrt(F.greatest(F.lit(0.0), (msb - msw) / n0))})
    need = (Z_ALPHA[alpha] + Z_POWER[power]) ** 2 * (F.col("sigma_between") ** 2 + F.col("sigma_within") ** 2 / per_dataset) / delta ** 2
    return out.select(*by, "datasets", "units", "mean", "sigma_within", "sigma_between", F.ceil(need).alias("datasets_needed"))


def mean_ranks(results: DataFrame, block: Sequence[str], by: Sequence[str]) -> DataFrame:
    return block_ranks(results, block).groupBy(*by).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("blocks"))


def formatted(table: DataFrame, digits: int = 4) -> DataFrame:
    return table.withColumn("text", F.format_string(f"%.{digits}f ± %.{digits}f", "mean", "std"))


GRID_CELLS = 512  # cells of the grid at most, over all metrics
BLOCK_ROWS, RIVAL_ROWS = 4096, 1 << 16  # rows of a block, and rows they are compared with in one group


def _beaten(rows: np.ndarray, rivals: np.ndarray, eps: float) -> np.ndarray:
    """Which rows some rival beats: nowhere worse and somewhere better."""
    out = np.zeros(len(rows), dtype=bool)
    step = max(1, (1 << 21) // max(1, len(rivals)))
    for lo in range(0, len(rows), step):
        x = rows[lo:lo + step]
        worse, better = np.zeros((len(x), len(rivals)), dtype=bool), np.zeros((len(x), len(rivals)), dtype=bool)
        for j in range(x.shape[1]):
            gap = rivals[:, j][None, :] - x[:, j][:, None]
            worse |= gap < -eps
            better |= gap > eps
        out[lo:lo + step] = (better & ~worse).any(axis=1)
    return out


def _grid(df: DataFrame, metrics: Sequence[str], eps: float) -> list[list[float]]:
    """Cut points of each metric, so that all cells together are ``GRID_CELLS`` at most; no two nearer than ``eps``."""
    slices = max(2, int(GRID_CELLS ** (1 / len(metrics)) + 1e-9))
    found = df.agg(*[F.percentile_approx(m, [i / slices for i in range(1, slices)], 1000).alias(f"c{i}") for i, m in enumerate(metrics)]).first()
    cuts = []
    for i in range(len(metrics)):
        kept: list[float] = []
        for c in found[f"c{i}"] or []:
            if not kept or c > kept[-1] + 2 * eps:
                kept.append(c)
        cuts.append(kept)
    return cuts


def pareto_front(df: DataFrame, key: str, metrics: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Rows no other row beats on every metric; rows with a missing metric are compared with nothing and stay.

    A grid over the metrics prunes first: where an occupied cell lies above another on every metric, all of its rows beat all of
    the other's. The rows left are reduced inside blocks of their cell; a block is then compared only with rows of cells that lie
    nowhere below its own, in groups of bounded size. Only cut points and one count a cell pass the driver.
    """
    cols, metrics = [key, *metrics], list(metrics)
    rows = df.select(*cols)
    there = reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) for m in metrics])
    apart, rows = rows.filter(~there), rows.filter(there)
    cuts = _grid(rows, metrics, eps)
    sizes = [len(c) + 1 for c in cuts]
    cell, lowest = F.lit(0), F.lit(0)  # a rival may be worse by eps, so it may lie in the cell below a cut
    for i, (c, n) in enumerate(zip(cuts, sizes)):
        cell, lowest = cell * n + bin_column(metrics[i], c), lowest * n + bin_column(f"__low{i}", c)
    celled = rows.withColumns({f"__low{i}": F.col(m) - eps for i, m in enumerate(metrics)}).select(*cols, cell.cast("int").alias("__cell"), lowest.cast("int").alias("__under"))
    counts = {r["__cell"]: r["n"] for r in celled.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # GRID_CELLS rows at most
    if not counts:
        return apart
    names = np.array(sorted(counts))
    at = np.stack(np.unravel_index(names, sizes), axis=1)
    # above on every metric, and by two steps on one, so that the difference exceeds eps
    lost = [((at > a).all(axis=1) & (at > a + 1).any(axis=1)).any() for a in at]
    alive = names[~np.array(lost)]
    spark = df.sparkSession
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64(key, *metrics), n).cast("int")

    def numbers(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[metrics].to_numpy(dtype=float)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        # a row that beats another has a larger sum, so the rows with larger sums decide
        pdf = pdf.iloc[(-numbers(pdf).sum(axis=1)).argsort(kind="stable")]
        kept = pdf.iloc[:0]
        for lo in range(0, len(pdf), 256):
            piece = pdf.iloc[lo:lo + 256]
            piece = piece[~_beaten(numbers(piece), np.concatenate([numbers(kept), numbers(piece)]), eps)]
            kept = pd.concat([kept, piece])
        return kept

    split = F.broadcast(spark.createDataFrame([(int(c), -(-counts[c] // BLOCK_ROWS)) for c in alive], "__cell int, __blocks int"))  # GRID_CELLS rows at most
    blocked = celled.join(split, "__cell").withColumn("__block", block(F.col("__blocks"))).drop("__blocks")
    local = written(blocked.groupBy("__cell", "__block").applyInPandas(lambda pdf: inside(pdf)[[*cols, "__cell", "__under"]], f"{kind}, __cell int, __under int"), "local-fronts")

    count = lambda c: {r[c]: r["n"] for r in local.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}  # GRID_CELLS rows at most
    left, asking = count("__cell"), count("__under")
    live, low = np.array(sorted(left)), np.array(sorted(asking))
    at = np.stack(np.unravel_index(live, sizes), axis=1)
    above = [live[(at >= a).all(axis=1)] for a in np.stack(np.unravel_index(low, sizes), axis=1)]  # the cell itself included
    plan = [(int(c), -(-asking[c] // BLOCK_ROWS), -(-sum(left[b] for b in over) // RIVAL_ROWS)) for c, over in zip(low, above)]
    parts = F.broadcast(spark.createDataFrame(plan, "__under int, __blocks int, __chunks int"))  # GRID_CELLS rows at most
    pairs = spark.createDataFrame([(int(b), int(c)) for c, over in zip(low, above) for b in over], "__cell int, __under int")  # pairs of cells, not of rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = local.drop("__cell").join(parts, "__under").withColumn("__block", block(F.col("__blocks"))).withColumn("__chunk", every("__chunks")).select("__under", "__block", "__chunk", *cols)
    rivals = local.select(F.col("__cell").alias("__cell"), *[F.col(m).alias(m) for m in metrics], F.xxhash64(key, *metrics).alias("__h")).join(pairs, "__cell").join(parts, "__under")
    rivals = rivals.withColumn("__chunk", F.pmod("__h", F.col("__chunks")).cast("int")).withColumn("__block", every("__blocks")).select("__under", "__block", "__chunk", *metrics)
    by = ["__under", "__block", "__chunk"]

    def lose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a.loc[_beaten(numbers(a), numbers(b), eps), [key]]

    beaten = asked.groupBy(*by).cogroup(rivals.groupBy(*by)).applyInPandas(lose, f"`{key}` {rows.schema[key].dataType.simpleString()}")
    return local.join(beaten.distinct(), key, "left_anti").select(*cols).unionByName(apart)


def ablation_coverage(results: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required variants that a dataset lacks."""
    wanted = results.select("dataset").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in required])))
    return wanted.join(results.select("dataset", "arm").distinct(), ["dataset", "arm"], "left_anti")


def ablation_deltas(results: DataFrame, baseline: str, unit: Sequence[str]) -> DataFrame:
    """Mean paired loss of every variant against the baseline on the same units."""
    base = results.filter(F.col("arm") == baseline).select(*unit, "metric", F.col("value").alias("base"))
    both = results.filter(F.col("arm") != baseline).join(base, [*unit, "metric"])
    return both.groupBy("arm", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") - F.col("base")).alias("mean_delta"), F.coalesce(F.stddev_samp(F.col("value") - F.col("base")), F.lit(0.0)).alias("sd_delta"))


def gain_status(d_acc: Column, d_fid: Column, attempted: Column, tol: float = 0.0) -> Column:
    gain, harm = (d_acc > tol) | (d_fid > tol), (d_acc < -tol) | (d_fid < -tol)
    return (F.when(~attempted, "NO_ATTEMPT").when(gain, "GAIN_OBSERVED").when(harm, "HARM_OBSERVED").otherwise("NO_OBSERVED_GAIN"))


def no_effect_rate(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    tried = F.col("status") != "NO_ATTEMPT"
    return reports.groupBy(*by).agg(hits(tried).alias("attempts"), F.avg(F.when(tried, (F.col("status") == "NO_OBSERVED_GAIN").cast("double"))).alias("no_effect_rate"))


def campaign_contrast(results: DataFrame, arm: str, reference: str, replicate: str | None = None) -> DataFrame:
    """Per dataset: mean difference and wins/ties/losses over units; replicates are averaged within a unit first."""
    unit = ["dataset", "split_id", "metric"]
    base = results.groupBy(*unit, "arm").agg(F.avg("value").alias("value")) if replicate else results.select(*unit, "arm", "value")
    a = base.filter(F.col("arm") == arm).select(*unit, F.col("value").alias("a"))
    b = base.filter(F.col("arm") == reference).select(*unit, F.col("value").alias("b"))
    d = F.round(F.col("a") - F.col("b"), TIE_DIGITS)
    return a.join(b, unit).groupBy("dataset", "metric").agg(F.avg(d).alias("mean"), hits(d > 0).alias("wins"), hits(d == 0).alias("ties"), hits(d < 0).alias("losses"), F.count(F.lit(1)).alias("n"))


def criteria_counts(per_dataset: DataFrame) -> DataFrame:
    return per_dataset.groupBy("metric").agg(hits(F.col("mean") >= 0).alias("not_worse"), hits(F.col("mean") > 0).alias("better"), F.count(F.lit(1)).alias("datasets"))


def budget_confounding(costs: DataFrame, arm: str, control: str, wins: DataFrame, low: float = 0.8, high: float = 1.25, width_gap: float = 0.0) -> DataFrame:
    """A win over a control that spent less, a loss to one that spent more, or a different derived width."""
    cell = lambda a, c: F.avg(F.when(F.col("arm") == a, F.col(c)))
    rho = cell(control, "queries") / cell(arm, "queries")
    gap = F.abs(cell(control, "width") - cell(arm, "width")) / F.greatest(F.lit(1.0), cell(arm, "width"))
    per = costs.groupBy("dataset").agg(rho.alias("query_ratio"), gap.alias("width_gap")).join(wins.select("dataset", "wins_arm"), "dataset")
    budget = (F.col("wins_arm") & (F.col("query_ratio") < low)) | (~F.col("wins_arm") & (F.col("query_ratio") > high))
    return per.withColumns({"budget_confounded": budget, "width_confounded": F.col("width_gap") > width_gap})


def recovery(units: DataFrame, baseline: str) -> DataFrame:
    """Share of units recovered per (problem, variant) with its interval, and paired counts against the baseline."""
    per = proportion_interval(units.groupBy("problem", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recovered").cast("long")).alias("k")), "k", "n")
    base = units.filter(F.col("variant") == baseline).select("problem", "unit", F.col("recovered").alias("base"))
    both = units.join(base, ["problem", "unit"])
    pairs_ = both.groupBy("problem", "variant").agg(hits(F.col("recovered") & ~F.col("base")).alias("b"), hits(~F.col("recovered") & F.col("base")).alias("c"),
                                                    (F.avg(F.col("recovered").cast("double")) - F.avg(F.col("base").cast("double"))).alias("delta"))
    return per.join(pairs_, ["problem", "variant"]).withColumn("ahead", F.col("delta") >= 0.2)


def noninferiority(df: DataFrame, delta: str, n: str, tolerance: float, low: str, high: str) -> DataFrame:
    """Tolerance is never finer than 1/n; a gap below that resolution or an interval around zero decides nothing."""
    resolution = 1 / F.greatest(F.lit(1), F.col(n))
    tol = F.greatest(F.lit(tolerance), resolution)
    open_ = (F.abs(F.col(delta)) < resolution) | ((F.col(low) <= 0) & (F.col(high) >= 0))
    return df.withColumns({"tolerance": tol, "decision": F.when(open_, "inconclusive").when(F.col(delta) >= -tol, "accepted").otherwise("rejected")})
