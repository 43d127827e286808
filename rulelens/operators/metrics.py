"""Predictive metrics (against labels) and fidelity metrics (against a named teacher); the two never mix.

Everything reduces to counts first: a confusion table, per-score counts, or per-band sums.  Those tables have a
size set by classes, distinct scores or bands, so the scan feeds map-side partial aggregates only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rulelens.functions.hashing import poisson_one, uniform
from rulelens.functions.ordering import exact_quantiles, running_sums, top_k
from rulelens.functions.shapes import add, all_hold, failed_names, hits, long_form, ratio, rows_of_structs, share, unions

EPS = 1e-15


def _labels(labels: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(x) for x in labels]))


def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """k x k counts with absent cells as 0, per group of ``by``."""
    by = list(by)
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1)
    grid = groups.select(*by, _labels(labels).alias("truth")).select(*by, "truth", _labels(labels).alias("pred"))
    return grid.join(counts, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted count, hits, precision, recall, F1 (zero division = 0) from confusion cells."""
    by = list(by)
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    parts = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    sums = cells.select(*by, F.explode(parts).alias("p")).select(*by, "p.*").groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    return sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted"), 0.0),
        "recall": ratio(F.col("tp"), F.col("support"), 0.0),
    }).withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0.0))


def bundle(classes: DataFrame, by: Sequence[str] = (), minority: str | None = None, macro_over: str = "labels") -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores.

    Balanced accuracy averages over classes present in the truth.  ``macro_over`` is "labels" (fixed list) or
    "present" (classes with support), the two conventions in use.
    """
    keep = F.lit(True) if macro_over == "labels" else F.col("support") > 0
    n = F.sum("support")
    out = classes.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(keep, F.col("precision"))).alias("precision_macro"),
        F.avg(F.when(keep, F.col("recall"))).alias("recall_macro"),
        F.avg(F.when(keep, F.col("f1"))).alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.max(F.when(F.col("label") == minority, F.when(F.col("support") > 0, F.col("recall")))).alias("minority_recall"),
    )
    return out if minority is not None else out.drop("minority_recall")


def minority_class(df: DataFrame, label: str) -> DataFrame:
    """Rarest class; ties go to the first in class order."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by(label, F.struct("n", label)).alias("minority"))


def one_vs_rest_rates(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity, specificity, predictive values and prevalence; denominators floored at 1."""
    total = classes.groupBy(*by).agg(F.sum("support").alias("total"))
    joined = classes.join(total, list(by)) if by else classes.withColumn("total", total.scalar())
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("total") - tp - fp - fn
    one = F.lit(1)
    return joined.select(*by, "label",
        (tp / F.greatest(one, tp + fn)).alias("sensitivity"), (tn / F.greatest(one, tn + fp)).alias("specificity"),
        (tp / F.greatest(one, tp + fp)).alias("ppv"), (tn / F.greatest(one, tn + fn)).alias("npv"),
        (F.col("support") / F.col("total")).alias("prevalence"))


def score_counts(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(label, score, n, pos): one row per distinct score of each one-vs-rest problem."""
    cells = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("score"), F.when(F.col(truth) == k, 1).otherwise(0).alias("hit"))
                      for k, c in scores.items()])
    return df.select(F.explode(cells).alias("c")).select("c.*").groupBy("label", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("pos"))


def score_sums(counts: DataFrame) -> DataFrame:
    """Counts at or above each score, with the positives and negatives of the label."""
    return running_sums(counts.withColumn("neg", F.col("n") - F.col("pos")), "score", {"cum_n": "n", "cum_pos": "pos"}, ["label"], descending=True, totals={"pos_all": "pos", "neg_all": "neg"})


def auc_and_average_precision(counts: DataFrame) -> DataFrame:
    """Tie-aware ROC AUC and average precision per label from distinct-score counts."""
    down = score_sums(counts)
    neg = F.col("n") - F.col("pos")
    cum_neg = F.col("cum_n") - F.col("cum_pos")
    # negatives strictly below a score = N - negatives at or above it
    below = F.col("neg_all") - cum_neg
    return down.groupBy("label").agg(
        (F.sum(F.col("pos") * (below + neg / 2)) / F.max(F.col("pos_all") * F.col("neg_all"))).alias("auc"),
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.max("pos_all")).alias("average_precision"))


def roc_points(counts: DataFrame) -> DataFrame:
    """(label, threshold, fpr, tpr), one row per distinct score."""
    return score_sums(counts).select("label", F.col("score").alias("threshold"),
        ((F.col("cum_n") - F.col("cum_pos")) / F.col("neg_all")).alias("fpr"), (F.col("cum_pos") / F.col("pos_all")).alias("tpr"))


def log_loss_and_brier(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """Clipped and renormalised log-loss, per-class Brier weighted by support, and multiclass Brier."""
    clip = {k: F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(c))) for k, c in scores.items()}
    total = add(clip.values())
    chosen = add([F.when(F.col(truth) == k, v).otherwise(0.0) for k, v in clip.items()]) / total
    square = {k: (F.col(c) - F.when(F.col(truth) == k, 1.0).otherwise(0.0)) ** 2 for k, c in scores.items()}
    aggs = [F.avg(-F.log(chosen)).alias("log_loss"), F.avg(add(square.values())).alias("brier_multiclass")]
    aggs += [add([F.avg(v) * share(F.col(truth) == k) for k, v in square.items()]).alias("brier_weighted")]
    return df.agg(*aggs)


def calibration_error(df: DataFrame, correct: Column, confidence: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bands, the last band closed on the right."""
    band = F.least(F.floor(confidence * bins), F.lit(bins - 1)).alias("band")
    bands = df.select(band, F.when(correct, 1.0).otherwise(0.0).alias("hit"), confidence.alias("conf")).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("mean_conf"))
    return bands.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean_conf"))) / F.sum("n")).alias("ece"),
                     F.count(F.lit(1)).alias("bands_used"))


def decision_curve(df: DataFrame, positive: Column, probability: Column, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit at each threshold, all thresholds in one pass."""
    n = F.count(F.lit(1))
    structs = []
    for thr in thresholds:
        tp, fp = hits(positive & (probability >= thr)), hits(~positive & (probability >= thr))
        structs.append(F.struct(F.lit(thr).alias("threshold"), (tp / n - fp / n * F.lit(thr / (1 - thr))).alias("net_benefit")))
    return rows_of_structs(df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("s")), [F.col("s")])


def kappa(classes: DataFrame) -> DataFrame:
    """Agreement beyond chance."""
    n = F.sum("support")
    observed = F.sum("tp") / n
    expected = F.sum(F.col("support") * F.col("predicted")) / (n * n)
    return classes.agg(observed.alias("po"), expected.alias("pe")).select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fidelity(df: DataFrame, teacher: str, surrogate: str, oracle_name: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement with a named teacher; without a name the number has no meaning."""
    if not oracle_name or not oracle_name.strip():
        raise ValueError("fidelity needs a named teacher")
    same = F.col(teacher) == F.col(surrogate)
    return df.groupBy(*by).agg(F.lit(oracle_name).alias("oracle_name"), share(same).alias("fidelity"), share(~same).alias("disagreement"),
                               F.count(F.lit(1)).alias("n"))


def fidelity_by_confidence(df: DataFrame, teacher: str, surrogate: str, probs: Sequence[str], cut: float = 0.7) -> DataFrame:
    top = F.greatest(*probs)
    entropy = -add([F.col(p) * F.log(F.col(p) + 1e-10) for p in probs])
    region = F.when(top > cut, "high").otherwise("low").alias("region")
    return df.groupBy(region).agg(share(F.col(teacher) == F.col(surrogate)).alias("fidelity"), F.count(F.lit(1)).alias("n"),
                                  F.avg(top).alias("mean_confidence"), F.avg(entropy).alias("mean_entropy"))


def fidelity_by_error(df: DataFrame, truth: str, teacher: str, surrogate: str, by: Sequence = ()) -> DataFrame:
    """Counts of both right, both wrong, only one right, and any disagreement."""
    t_ok, s_ok, same = F.col(teacher) == F.col(truth), F.col(surrogate) == F.col(truth), F.col(teacher) == F.col(surrogate)
    kinds = {"both_correct": t_ok & s_ok & same, "both_wrong": ~t_ok & ~s_ok, "teacher_only": t_ok & ~s_ok & ~same,
             "surrogate_only": ~t_ok & s_ok & ~same, "disagreement": ~same}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[hits(c).alias(k) for k, c in kinds.items()])


def fidelity_by_distance(df: DataFrame, features: Sequence[str], teacher: str, surrogate: str) -> DataFrame:
    """Fidelity in the quartiles of the distance to the median centre."""
    medians = exact_quantiles(long_form(df, [], features), "value", {"mid": 0.5}, ["feature"]).collect()
    centre = {r["feature"]: r["mid"] for r in medians}
    distance = F.sqrt(add([(F.col(f) - centre[f]) ** 2 for f in features]))
    rows = df.withColumn("distance", F.round(distance, 6))
    cuts = exact_quantiles(rows, "distance", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    region = F.when(F.col("distance") <= cuts["q1"], 1).when(F.col("distance") <= cuts["q2"], 2).when(F.col("distance") <= cuts["q3"], 3).otherwise(4)
    return rows.groupBy(region.alias("region")).agg(share(F.col(teacher) == F.col(surrogate)).alias("fidelity"),
                                                    F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


def transitions(df: DataFrame, teacher: str, surrogate: str, truth: str, k: int = 10) -> DataFrame:
    """Most frequent teacher -> surrogate class changes and who was right."""
    pairs = df.filter(F.col(teacher) != F.col(surrogate)).groupBy(F.col(teacher).alias("from_class"), F.col(surrogate).alias("to_class")).agg(
        F.count(F.lit(1)).alias("n"), hits(F.col(teacher) == F.col(truth)).alias("teacher_right"), hits(F.col(surrogate) == F.col(truth)).alias("surrogate_right"))
    return pairs.orderBy(F.desc("n"), "from_class", "to_class").limit(k)


def disagreement_profile(df: DataFrame, features: Sequence[str], flag: Column) -> DataFrame:
    """Per feature: mean gap, F-score, correlation with disagreement, and values outside the agreement IQR fence."""
    rows = long_form(df.withColumn("flag", flag.cast("int")), ["flag"], features)
    fences = exact_quantiles(rows.filter("flag = 0"), "value", {"q1": 0.25, "q3": 0.75}, ["feature"])
    on, off = F.col("flag") == 1, F.col("flag") == 0
    width = F.col("q3") - F.col("q1")
    out = rows.join(F.broadcast(fences), "feature")  # one row per column
    outside = (F.col("value") < F.col("q1") - 1.5 * width) | (F.col("value") > F.col("q3") + 1.5 * width)
    v_on, v_off = F.when(on, F.col("value")), F.when(off, F.col("value"))
    return out.groupBy("feature").agg(
        F.abs(F.avg(v_on) - F.avg(v_off)).alias("mean_gap"),
        (((F.avg(v_on) - F.avg(v_off)) ** 2) / ((F.var_pop(v_on) + F.var_pop(v_off)) / 2)).alias("f_score"),
        F.corr("value", "flag").alias("correlation"), hits(on & outside).alias("outliers"))


def subgroup_metrics(df: DataFrame, truth: str, pred: str, labels: Sequence[str], attributes: Sequence[str], min_n: int = 20) -> DataFrame:
    """Accuracy and macro sensitivity per subgroup value; small groups block the claim."""
    rows = long_form(df.select(truth, pred, *[F.col(a).cast("string").alias(a) for a in attributes]), [truth, pred], attributes, "attribute", "group")
    cells = confusion(rows, truth, pred, labels, ["attribute", "group"])
    by = ["attribute", "group"]
    scores = per_class(cells, by).groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
                                                    F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("macro_sensitivity"))
    return scores.withColumn("claim", F.when(F.col("n") < min_n, "blocked").otherwise("allowed"))


def poisson_replicas(df: DataFrame, key: Sequence[str], replicas: int, seed: int) -> DataFrame:
    """Each row once per replica with a Poisson(1) weight ``w``: a bootstrap without collecting or indexing rows."""
    keyed = df.withColumn("__h", F.xxhash64(*key)).drop(*key)
    each = keyed.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return each.withColumn("w", poisson_one(uniform(seed, "__h", "replica"))).drop("__h").filter("w > 0")


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def _scores(t: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of confusion tables (..., truth, prediction); classes with neither rows nor predictions count in no macro mean."""
    support, predicted, tp, n = t.sum(axis=-1), t.sum(axis=-2), np.diagonal(t, axis1=-2, axis2=-1), t.sum(axis=(-2, -1))
    recall, precision, f1 = _divided(tp, support), _divided(tp, predicted), _divided(2 * tp, support + predicted)
    there, met = support > 0, support + predicted > 0
    macro = lambda v, keep: _divided((v * keep).sum(axis=-1), keep.sum(axis=-1))
    accuracy, chance = _divided(tp.sum(axis=-1), n), _divided((support * predicted).sum(axis=-1), n * n)
    s, c = tp.sum(axis=-1) * n - (support * predicted).sum(axis=-1), np.sqrt((n * n - (predicted**2).sum(axis=-1)) * (n * n - (support**2).sum(axis=-1)))
    return {
        "accuracy": accuracy, "balanced_accuracy": macro(recall, there), "macro_precision": macro(precision, met), "macro_recall": macro(recall, met), "macro_f1": macro(f1, met),
        "weighted_f1": _divided((f1 * support).sum(axis=-1), n), "kappa": np.where(chance < 1, _divided(accuracy - chance, 1 - chance), np.nan), "correlation": np.where(c > 0, _divided(s, c), np.nan),
    }


INTERVAL = "metric string, value double, mean double, std double, ci_low double, ci_high double, replicas long"


def confusion_intervals(cells: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] | None = None, more: Mapping[str, Callable[[np.ndarray], np.ndarray]] | None = None,
                        replicas: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(by, metric, value, mean, std, ci_low, ci_high, replicas): percentile bootstrap of metrics of a confusion table (truth, pred, n).

    Rows drawn with replacement change a confusion table only through its cells, whose counts are multinomial; so cells are
    drawn (as conditional binomials) instead of rows, and the work does not grow with them. Agreement with a teacher is the
    same with the teacher's class as truth. ``more`` names functions of tables (replicas, truth, pred). A metric without a value
    in a replica (kappa of one class) leaves that replica out. A group's draws depend on its key and the seed only. A group
    without rows has no interval.
    """
    by = list(by)
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.schema.fields if f.name in by) + INTERVAL

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["truth"].dropna(), *pdf["pred"].dropna()})
        place = {x: i for i, x in enumerate(names)}
        rows = pdf.dropna(subset=["truth", "pred"])
        table = np.zeros((len(names), len(names)))
        np.add.at(table, (rows["truth"].map(place).to_numpy(int), rows["pred"].map(place).to_numpy(int)), rows["n"].to_numpy(float))
        n = int(table.sum())
        if not n:
            return pd.DataFrame(columns=[*by, "metric", "value", "mean", "std", "ci_low", "ci_high", "replicas"])
        key = [pdf[c].iloc[0] for c in by]
        rng = np.random.Generator(np.random.Philox(zlib.crc32(repr([seed, *map(str, key)]).encode())))
        drawn = rng.multinomial(n, table.ravel() / n, size=replicas).reshape(replicas, *table.shape).astype(float)
        whole, each = _scores(table), _scores(drawn)
        for name, f in (more or {}).items():
            whole[name], each[name] = f(table[None])[0], f(drawn)
        out = []
        for name in [*(metrics or _scores(table)), *(more or {})]:
            values = each[name][np.isfinite(each[name])]
            low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2]) if len(values) else (np.nan, np.nan)
            out.append((*key, name, float(whole[name]), values.mean() if len(values) else np.nan, values.std(ddof=1) if len(values) > 1 else np.nan, low, high, len(values)))
        return pd.DataFrame(out, columns=[*by, "metric", "value", "mean", "std", "ci_low", "ci_high", "replicas"])

    return cells.groupBy(*by).applyInPandas(draw, shape)  # a group is a table of classes x classes cells


def bootstrap_accuracy(df: DataFrame, correct: Column, replicas: int = 50, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of accuracy, from the counts of right and wrong rows."""
    cells = df.groupBy(F.lit("right").alias("truth"), F.when(correct, "right").otherwise("wrong").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return confusion_intervals(cells, metrics=["accuracy"], replicas=replicas, level=level, seed=seed).select("ci_low", "ci_high", "mean", "replicas")


def utility(metrics: DataFrame, weights: dict[str, float], penalty: float = 0.0, complexity: str | None = None) -> DataFrame:
    value = add([F.lit(w) * F.col(m) for m, w in weights.items()])
    return metrics.withColumn("utility", value - F.lit(penalty) * F.col(complexity) if complexity else value)


def stability(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Run-to-run spread of every metric."""
    return runs.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")).withColumns({
            "cv": ratio(F.col("std"), F.abs(F.col("mean"))), "range": F.col("max") - F.col("min")})


def metric_mismatches(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Stored metric rows that do not follow from the predictions."""
    both = stored.withColumnRenamed("value", "stored").join(recomputed.withColumnRenamed("value", "recomputed"), list(keys), "full_outer")
    gap = F.abs(F.col("stored") - F.col("recomputed"))
    return both.withColumn("gap", gap).withColumn("status", F.when(F.col("stored").isNull(), "not_stored").when(
        F.col("recomputed").isNull(), "not_recomputed").when(gap > tol, "mismatch").otherwise("ok"))


def frame_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = (), tol: float = 0.0) -> DataFrame:
    """Cell-level differences of two result tables, ignoring e.g. timing columns."""
    keys = list(keys)

    def cells(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in keys and c not in ignore]
        return long_form(df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]), keys, cols, "column_name", "cell")

    both = cells(a).withColumnRenamed("cell", "left_value").join(cells(b).withColumnRenamed("cell", "right_value"), [*keys, "column_name"], "full_outer")
    l, r = F.col("left_value").try_cast("double"), F.col("right_value").try_cast("double")
    near = F.coalesce(F.abs(l - r) <= tol, F.lit(False))
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")) & ~near)


def run_invariants(records: DataFrame, unit: Sequence[str], expected_arms: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Per unit: every expected arm present and the named properties equal across arms."""
    present = F.collect_set("arm")
    checks = {f"same_{c}": F.count_distinct(F.col(c)) == 1 for c in same}
    checks["arms_present"] = F.size(F.array_except(F.array(*[F.lit(a) for a in expected_arms]), present)) == 0
    return records.groupBy(*unit).agg(F.count_distinct("arm").alias("arms"), failed_names(checks).alias("failed"))


def comparability(records: DataFrame, unit: Sequence[str], properties: Sequence[str], relaxed: Sequence[str] = ()) -> DataFrame:
    """A property must be known and equal for every arm; unknown means not comparable."""
    rows = long_form(records.select(*unit, "arm", *[F.col(p).cast("string").alias(p) for p in properties]), [*unit, "arm"], properties, "property", "value")
    state = F.when(F.count("value") < F.count(F.lit(1)), "unverifiable").when(F.count_distinct("value") == 1, "equal").otherwise("different")
    per = rows.groupBy(*unit, "property").agg(state.alias("state")).filter(~F.col("property").isin(*relaxed) if relaxed else F.lit(True))
    return per.groupBy(*unit).agg(hits(F.col("state") == "different").alias("failed"), hits(F.col("state") == "unverifiable").alias("unverifiable")).withColumn(
        "comparable", (F.col("failed") == 0) & (F.col("unverifiable") == 0))


def concordance(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pairwise and total agreement of several models on the same rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    first = F.col(models[0])
    total = all_hold({m: F.col(m) == first for m in models})
    structs = [F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model"), share(F.col(a) == F.col(b)).alias("agreement")) for a, b in pairs]
    structs.append(F.struct(F.lit("all").alias("left_model"), F.lit("all").alias("right_model"), share(total).alias("agreement")))
    return df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def teacher_health(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), tolerance: float = 0.01) -> DataFrame:
    """Single predicted class, or no better than always predicting the majority class."""
    by = list(by)
    classes = df.groupBy(*by, truth).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg((F.max("c") / F.sum("c")).alias("majority_accuracy"))
    model = df.groupBy(*by).agg(share(F.col(truth) == F.col(pred)).alias("accuracy"), F.count_distinct(pred).alias("predicted_classes"))
    joined = model.join(classes, by)
    degenerate = F.col("predicted_classes") == 1
    return joined.withColumns({"degenerate": degenerate, "weak": degenerate | (F.col("accuracy") <= F.col("majority_accuracy") + tolerance)})


def group_activation_fidelity(df: DataFrame, groups: dict[str, Sequence[str]], teacher: str, surrogate: str) -> DataFrame:
    """Fidelity on the rows whose mean |value - median| / std over a feature group reaches its median."""
    features = sorted({f for fs in groups.values() for f in fs})
    rows = long_form(df, [], features)
    centre = {r["feature"]: r["mid"] for r in exact_quantiles(rows, "value", {"mid": 0.5}, ["feature"]).collect()}
    spread = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first().asDict()
    scale = {f: v if v and v > 1e-12 else 1.0 for f, v in spread.items()}
    act = {g: F.round(add([F.abs((F.col(f) - centre[f]) / scale[f]) for f in fs]) / len(fs), 6) for g, fs in groups.items()}
    tagged = df.withColumns({f"act_{g}": c for g, c in act.items()})
    cuts = exact_quantiles(long_form(tagged, [], [f"act_{g}" for g in groups]), "value", {"cut": 0.5}, ["feature"]).collect()
    cut = {r["feature"]: r["cut"] for r in cuts}
    same = F.col(teacher) == F.col(surrogate)
    structs = [F.struct(F.lit(g).alias("feature_group"), F.avg(F.when(F.col(f"act_{g}") >= cut[f"act_{g}"], same.cast("double"))).alias("fidelity"),
                        hits(F.col(f"act_{g}") >= cut[f"act_{g}"]).alias("n")) for g in groups]
    return tagged.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def calibration_line(df: DataFrame, positive: Column, probability: Column, rounds: int = 8) -> DataFrame:
    """Intercept and slope of label ~ logit(p): Newton steps, each one aggregate over the rows."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), probability))
    rows = df.select(F.log(p / (1 - p)).alias("x"), F.when(positive, 1.0).otherwise(0.0).alias("y"))
    # Rows with the same logit and label behave alike, so the loop runs on the grouped table.
    grouped = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    a = b = 0.0
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        v, g, x, w = mu * (1 - mu), F.col("y") - mu, F.col("x"), F.col("w")
        s = grouped.agg(F.sum(w * g).alias("g0"), F.sum(w * g * x).alias("g1"), F.sum(w * v).alias("h00"), F.sum(w * v * x).alias("h01"),
                        F.sum(w * v * x * x).alias("h11")).first()
        det = s.h00 * s.h11 - s.h01 ** 2
        if det <= 0:
            break
        da, db = (s.h11 * s.g0 - s.h01 * s.g1) / det, (s.h00 * s.g1 - s.h01 * s.g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    n = grouped.agg(F.sum("w").cast("long").alias("n"))
    out = n.select(F.lit(a).alias("intercept"), F.lit(b).alias("slope"), "n")
    return out


def examples(df: DataFrame, keep: Column, k: int, order: Sequence[Column], salt: Sequence[str]) -> DataFrame:
    """A reproducible handful of rows, e.g. of disagreements."""
    return top_k(df.filter(keep), k, order, salt=salt)


def cross_validated(df: DataFrame, fold: str, truth: str, models: Sequence[str], not_applicable: Sequence[str] = ()) -> DataFrame:
    """Per-model mean and spread of fold accuracy; surrogates can be marked not applicable."""
    folds = df.groupBy(fold).agg(*[share(F.col(m) == F.col(truth)).alias(m) for m in models])
    per = long_form(folds, [fold], models, "model", "accuracy").groupBy("model").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.coalesce(F.stddev_pop("accuracy"), F.lit(0.0)).alias("std_accuracy"), F.count(F.lit(1)).alias("folds"))
    skipped = [m for m in not_applicable]
    if not skipped:
        return per.withColumn("reason", F.lit(None).cast("string"))
    extra = per.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in skipped])).alias("model"), F.lit("not_applicable").alias("reason"))
    return unions([per, extra])
