"""Fitted column transforms: statistics come from the training rows, transforms are generated projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.hashing import uniform
from rulelens.functions.lineage import cut
from rulelens.functions.ordering import average_ranks, exact_quantiles, quantile_grid, value_counts, with_hash_rank
from rulelens.functions.shapes import FEW_ROWS, add, bin_column, join_small, long_form
from rulelens.operators.trees import entropy

MAX_MASK_BITS = 60


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    rows = long_form(train.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    return {r["feature"]: r["mid"] for r in exact_quantiles(rows, "value", {"mid": 0.5}, ["feature"]).collect()}


def columns_with_missing(train: DataFrame, columns: Sequence[str]) -> list[str]:
    row = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def impute(df: DataFrame, medians: Mapping[str, float], flagged: Sequence[str]) -> DataFrame:
    """Training medians for missing numbers, plus a 0/1 flag for columns that had missing values in training."""
    flags = {f"missing_{c}": F.col(c).isNull().cast("int") for c in flagged}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def fit_scales(train: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Mean, population deviation, minimum and maximum in one aggregate."""
    row = train.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
    return {c: {n: row[f"{n}_{c}"] for n in ("avg", "std", "min", "max")} for c in columns}


def standardise(df: DataFrame, scales: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - s["avg"]) / (s["std"] if s["std"] and s["std"] > 1e-12 else 1.0) for c, s in scales.items()})


def min_max(df: DataFrame, scales: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - s["min"]) / ((s["max"] - s["min"]) or 1.0) for c, s in scales.items()})


def fit_levels(train: DataFrame, columns: Sequence[str], min_count: int, max_levels: int) -> DataFrame:
    """(feature, value, n, kept): levels that get their own column; the rest share the rare one."""
    rows = long_form(train.select(*[F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(c) for c in columns]), [], columns)
    counts = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") >= min_count)
    size = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("n") < min_count).alias("rare"))
    # Candidates are bounded: only the most frequent max_levels of each feature reach the ranking window.
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    ranked = frequent.join(size, "feature").withColumn("place", F.row_number().over(order))
    room = F.when((F.col("rare") > 0) | (F.col("levels") > max_levels), F.lit(max_levels - 1)).otherwise(F.lit(max_levels))
    return ranked.withColumn("kept", F.col("place") <= room).select("feature", "value", "n", "kept")


def one_hot(df: DataFrame, levels: DataFrame) -> tuple[DataFrame, list[dict]]:
    """0/1 columns per kept level and one for rare levels seen in training; unseen levels give zeros everywhere.

    Returns the projection and its lineage.  At most max_levels names per column are collected.
    """
    kept: dict[str, list[str]] = {}
    for r in levels.filter("kept").orderBy("feature", "value").collect():
        kept.setdefault(r["feature"], []).append(r["value"])
    out, lineage = {}, []
    for c, names in kept.items():
        value = F.coalesce(F.col(c).cast("string"), F.lit("__missing__"))
        for v in names:
            out[f"{c}_{v}"] = (value == v).cast("int")
            lineage.append({"encoded": f"{c}_{v}", "source": c})
    return df.withColumns(out), lineage


def rare_flag(df: DataFrame, column: str, train_levels: DataFrame, kept: Sequence[str]) -> DataFrame:
    """1 for a training level without its own column; the level table is joined, so its size does not matter."""
    rare = train_levels.filter((F.col("feature") == column) & ~F.col("value").isin(*kept)).select(F.col("value").alias(column), F.lit(1).alias(f"{column}_rare"))
    return df.join(rare, column, "left").withColumn(f"{column}_rare", F.coalesce(f"{column}_rare", F.lit(0)))


def frequency_encode(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Training relative frequency of the value, 0 when unseen."""
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    total = train.agg(F.count(F.lit(1))).scalar()
    freq = counts.select(column, (F.col("c") / total).alias(f"{column}_freq"))
    return df.join(freq, column, "left").withColumn(f"{column}_freq", F.coalesce(f"{column}_freq", F.lit(0.0)))


def oversample(df: DataFrame, key: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Every class up to the largest: whole copies plus a hash-ordered remainder (exact counts, no collecting)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max("n")).scalar()
    plan = sizes.withColumn("goal", top)
    ranked = join_small(with_hash_rank(df, seed, key, [label]), plan, [label])
    copies = F.floor(F.col("goal") / F.col("n")) + F.when(F.col("hash_rank") <= F.pmod("goal", "n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).drop("n", "goal", "hash_rank")


def undersample(df: DataFrame, key: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Every class down to the smallest, in hash order."""
    low = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return with_hash_rank(df, seed, key, [label]).filter(F.col("hash_rank") <= low).drop("hash_rank")


def one_hot_groups(df: DataFrame, columns: Sequence[str], separator: str = "_") -> DataFrame:
    """Groups of 0/1 columns with a common prefix whose rows always sum to one."""
    binary = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in columns]).first()
    groups: dict[str, list[str]] = {}
    for c in columns:
        if binary[c] and separator in c:
            groups.setdefault(c.rsplit(separator, 1)[0], []).append(c)
    groups = {g: cs for g, cs in groups.items() if len(cs) >= 2}
    sums = [F.struct(F.lit(g).alias("grp"), F.lit(",".join(cs)).alias("columns"), F.min(add([F.col(c) for c in cs])).alias("low"),
                     F.max(add([F.col(c) for c in cs])).alias("high")) for g, cs in groups.items()]
    return df.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*").withColumn("one_hot", (F.col("low") == 1) & (F.col("high") == 1))


def decode_one_hot(df: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    """The category whose column is largest (first on ties)."""
    top = F.greatest(*columns)
    out = None
    for c, category in columns.items():
        out = F.when(F.col(c) == top, category) if out is None else out.when(F.col(c) == top, category)
    return df.withColumn(group, out)


def encode_one_hot(df: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: (F.col(group) == category).cast("int") for c, category in columns.items()})


def feature_specs(train: DataFrame, columns: Sequence[str], config: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Kind, range and its source, direction, cost and mutability per column; config beats training data."""
    config = config or {}
    rows = long_form(train.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns).filter("value IS NOT NULL")
    values = value_counts(rows, "value", ["feature"])
    per = values.groupBy("feature").agg(F.min("value").alias("train_low"), F.max("value").alias("train_high"), F.count(F.lit(1)).alias("distinct_values"),
                                        F.bool_and(F.col("value").isin(0.0, 1.0)).alias("zero_one"), F.bool_and(F.abs(F.col("value") - F.round("value")) <= 1e-9).alias("whole"))
    guess = F.when(F.col("zero_one"), "binary").when(F.col("whole") & (F.col("distinct_values") > 2), "integer").otherwise("continuous")

    def given(key: str, kind: str) -> Column:
        pairs = [(c, v[key]) for c, v in config.items() if key in v]
        return F.create_map(*[F.lit(x) for p in pairs for x in p])[F.col("feature")].cast(kind) if pairs else F.lit(None).cast(kind)

    return per.select("feature", F.coalesce(given("kind", "string"), guess).alias("kind"),
                      F.coalesce(given("low", "double"), F.col("train_low")).alias("low"), F.coalesce(given("high", "double"), F.col("train_high")).alias("high"),
                      F.when(given("low", "double").isNotNull() | given("high", "double").isNotNull(), "config").otherwise("train").alias("source"),
                      F.coalesce(given("direction", "string"), F.lit("both")).alias("direction"), F.coalesce(given("immutable", "boolean"), F.lit(False)).alias("immutable"),
                      F.coalesce(given("cost", "double"), F.lit(1.0)).alias("cost"))


# ---------------------------------------------------------------- correlation groups

def rank_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by mid-ranks; ranks are found per distinct value and joined back column by column, so rows stay whole."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    counts = value_counts(long_form(rows.drop(key), [], columns), "value", ["feature"])
    ranks = cut(average_ranks(counts, "value", "n", ["feature"]).select("feature", "value", "avg_rank"))  # read once a column
    sizes = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}  # one row a column
    for c in columns:
        mine = ranks.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("avg_rank").alias(f"__r_{c}"))
        rows = rows.join(F.broadcast(mine) if sizes.get(c, 0) <= FEW_ROWS else mine, c, "left")
    return rows.select(key, *[F.col(f"__r_{c}").alias(c) for c in columns])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left_feature, right_feature, r) for every pair, in one aggregate."""
    pairs = [F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.corr(a, b).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return correlations(rank_columns(df, key, columns), columns)


def linkage_groups(matrix: np.ndarray, wanted: int) -> list[list[int]]:
    """Average-linkage merge of columns until ``wanted`` groups remain (matrix is columns x columns)."""
    groups = [[i] for i in range(len(matrix))]
    while len(groups) > wanted:
        gaps = {(a, b): np.mean(matrix[np.ix_(groups[a], groups[b])]) for a, b in combinations(range(len(groups)), 2)}
        a, b = min(gaps, key=lambda k: (gaps[k], k))
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


def correlated_groups(df: DataFrame, key: str, columns: Sequence[str], wanted: int) -> list[list[str]]:
    """Groups of at least two columns by |Spearman|; only the column x column matrix reaches the driver."""
    r = {(x["left_feature"], x["right_feature"]): abs(x["r"] or 0.0) for x in spearman(df, key, columns).collect()}
    m = np.array([[0.0 if a == b else 1.0 - r.get((a, b), r.get((b, a), 0.0)) for b in columns] for a in columns])
    return [[columns[i] for i in g] for g in linkage_groups(m, wanted) if len(g) > 1]


def group_means(df: DataFrame, groups: Mapping[str, Sequence[str]], scales: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Mean z-score of each group of columns."""

    def z(c: str) -> Column:
        s = scales[c]["std"]
        return (F.col(c) - scales[c]["avg"]) / (s if s and s > 1e-12 else 1.0)

    return df.withColumns({g: add([z(c) for c in cs]) / len(cs) for g, cs in groups.items()})


# ---------------------------------------------------------------- information about the label

def binned_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], bins: int) -> DataFrame:
    """(keep, feature, bin): equal-frequency bins with edges from exact quantiles; few distinct values stay apart.

    The edges (columns x bins numbers) become a CASE per column, evaluated before the rows are made long.
    """
    edges = {c: sorted(set(q)) for c, q in quantile_cuts(df, columns, [i / bins for i in range(1, bins)]).items()}
    wide = df.select(*keep, *[bin_column(c, edges.get(c, [])).alias(c) for c in columns])
    return long_form(wide, list(keep), columns, value="bin").filter("bin IS NOT NULL")


def mutual_information(binned: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information (nats) between each binned feature and the label, from contingency counts."""
    by = [*by, "feature"]
    cells = binned.groupBy(*by, "bin", label).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*by, "bin").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy(*by, label).agg(F.sum("n").alias("ny"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("nt"))
    joined = cells.join(rows, [*by, "bin"]).join(cols, [*by, label]).join(total, by)
    return joined.groupBy(*by).agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mi"))


def select_top(mi: DataFrame, base: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Base columns always stay; the k best of the others join them."""
    order = Window.partitionBy(*by, "is_base").orderBy(F.desc(F.round("mi", 9)), "feature")  # one row per feature
    ranked = mi.withColumn("is_base", F.col("feature").isin(*base)).withColumn("place", F.row_number().over(order))
    return ranked.withColumn("selected", F.col("is_base") | (F.col("place") <= k)).drop("place")


def selection_stability(selected: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Share of folds in which a feature is selected."""
    return selected.groupBy("feature").agg(F.avg(F.col("selected").cast("double")).alias("frequency")).withColumn("stable", F.col("frequency") >= threshold)


def quantile_cuts(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles per column (columns x probabilities numbers)."""
    rows = long_form(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    found: dict[str, list[float]] = {}
    for r in quantile_grid(value_counts(rows, "value", ["feature"]), "value", probs, ["feature"]).orderBy("feature", "prob").collect():
        found.setdefault(r["feature"], []).append(r["quantile"])
    return found


def _gain(yes: Sequence[Column], total: Sequence[Column]) -> Column:
    no = [t - y for t, y in zip(total, yes)]
    ny, nt = add(yes), add(total)
    return F.when((ny > 0) & (ny < nt), entropy(total) - ny / nt * entropy(yes) - (nt - ny) / nt * entropy(no)).otherwise(0.0)


def single_screen(df: DataFrame, target: str, labels: Sequence[str], columns: Sequence[str], cuts: Mapping[str, Sequence[float]], group_size: int) -> DataFrame:
    """Best gain over the given cuts per column, rank, and the consecutive group it falls in; one pass over the rows."""
    t = [F.count_if(F.col(target) == l) for l in labels]
    structs = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("i"), F.array(*[F.count_if((F.col(c) > q) & (F.col(target) == l)) for l in labels]).alias("yes"), F.array(*t).alias("total"))
               for i, c in enumerate(columns) for q in cuts[c]]
    rows = df.agg(F.array(*structs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    k = range(len(labels))
    gain = _gain([F.col("yes")[j] for j in k], [F.col("total")[j] for j in k])
    best = rows.withColumn("gain", gain).groupBy("feature", "i").agg(F.greatest(F.lit(0.0), F.max("gain")).alias("gain"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("gain", 12)), "i"))  # one row per column
    return best.withColumn("place", place).select("feature", "gain", "place", F.floor((F.col("place") - 1) / group_size).alias("grp"))


def pair_screen(df: DataFrame, target: str, labels: Sequence[str], columns: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Best gain of a two-literal conjunction per pair of columns.

    Rows first collapse to distinct bit patterns (one bit per column and cut); all pair tests then read the patterns.
    """
    bits = [(c, q) for c in columns for q in cuts[c]]
    if len(bits) > MAX_MASK_BITS:
        half = max(1, (MAX_MASK_BITS // max(len(cuts[c]) for c in columns)) // 2)
        blocks = [list(columns[i:i + half]) for i in range(0, len(columns), half)]
        parts = [pair_screen(df, target, labels, a + b, cuts) for a, b in combinations(blocks, 2)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["left_feature", "right_feature"])
    mask = add([F.when(F.col(c) > q, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")) for j, (c, q) in enumerate(bits)])
    patterns = df.select(mask.alias("mask"), target).groupBy("mask").agg(*[F.count_if(F.col(target) == l).alias(f"n_{l}") for l in labels])
    where = {c: [j for j, (d, _) in enumerate(bits) if d == c] for c in columns}
    tests = [(a, b, (1 << x) | (1 << y), (x_on << x) | (y_on << y)) for a, b in combinations(columns, 2) for x in where[a] for y in where[b] for x_on in (1, 0) for y_on in (1, 0)]
    schema = "array<struct<left_feature:string,right_feature:string,care:long,want:long>>"
    literal_tests = F.from_json(F.lit(json.dumps([dict(zip(("left_feature", "right_feature", "care", "want"), x)) for x in tests])), schema)
    hit = patterns.select("*", F.explode(literal_tests).alias("x")).select("*", "x.*")
    yes = F.col("mask").bitwiseAND(F.col("care")) == F.col("want")
    counts = hit.groupBy("left_feature", "right_feature", "care", "want").agg(*[F.sum(F.when(yes, F.col(f"n_{l}")).otherwise(0)).alias(f"y_{l}") for l in labels],
                                                                             *[F.sum(f"n_{l}").alias(f"t_{l}") for l in labels])
    gain = _gain([F.col(f"y_{l}") for l in labels], [F.col(f"t_{l}") for l in labels])
    return counts.withColumn("gain", gain).groupBy("left_feature", "right_feature").agg(F.greatest(F.lit(0.0), F.max("gain")).alias("gain"))


def disjoint_pairs(pairs: Sequence[tuple[str, str, float]], order: Sequence[str], group_size: int, wanted: int) -> list[list[str]]:
    """Greedy groups from ranked pairs, never reusing a column (columns^2 rows on the driver)."""
    place = {c: i for i, c in enumerate(order)}
    ranked = sorted(pairs, key=lambda p: (-round(p[2], 12), place[p[0]], place[p[1]]))
    used: set[str] = set()
    groups = []
    for _ in range(wanted):
        members: list[str] = []
        for a, b, _gain_value in ranked:
            if len(members) + 2 <= group_size and not {a, b} & used:
                members += [a, b]
                used |= {a, b}
        for c in order:
            if len(members) < group_size and c not in used:
                members.append(c)
                used.add(c)
        if len(members) >= 2:
            groups.append(sorted(members))
    return groups


def synergy_test(pairs: DataFrame, singles: Mapping[str, float], groups: Mapping[str, str], permutations: int = 200, seed: int = 34) -> DataFrame:
    """Same-group minus other-pair synergy and its permutation p-value.

    Permuted group labels come from ordering columns by a hash of (permutation, column).
    """
    columns = sorted(groups)
    single = F.create_map(*[F.lit(x) for kv in singles.items() for x in kv])
    syn = pairs.withColumn("synergy", F.col("gain") - F.greatest(single[F.col("left_feature")], single[F.col("right_feature")])).select("left_feature", "right_feature", "synergy")
    spark = pairs.sparkSession
    names = spark.createDataFrame([(c, groups[c], i) for i, c in enumerate(columns)], "feature string, grp string, i int")
    drawn = names.select("feature", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    place = F.row_number().over(Window.partitionBy("perm").orderBy(F.when(F.col("perm") == 0, F.lit(0.0)).otherwise(uniform(seed, "perm", "feature")), "feature")) - 1  # one row per column
    labels = drawn.withColumn("i", place).join(names.select("i", "grp"), "i").select("perm", "feature", "grp")
    left = labels.select("perm", F.col("feature").alias("left_feature"), F.col("grp").alias("g1"))
    right = labels.select("perm", F.col("feature").alias("right_feature"), F.col("grp").alias("g2"))
    same = syn.join(left, "left_feature").join(right, ["perm", "right_feature"])
    per = same.groupBy("perm").agg((F.avg(F.when(F.col("g1") == F.col("g2"), F.col("synergy"))) - F.avg(F.when(F.col("g1") != F.col("g2"), F.col("synergy")))).alias("gap"))
    observed = per.filter("perm = 0").select("gap").scalar()
    return per.filter("perm > 0").agg(F.max(observed).alias("observed_gap"), ((F.count_if(F.col("gap") >= observed) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
                                      F.count(F.lit(1)).alias("permutations"))


def group_alignment(corr: DataFrame, groups: Mapping[str, Sequence[str]], columns: Sequence[str], nulls: int = 200, seed: int = 5) -> DataFrame:
    """Mean |correlation| inside declared groups against random groups of the same sizes."""
    spark = corr.sparkSession
    both = corr.select("left_feature", "right_feature", F.abs("r").alias("r"))
    members = spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "grp string, feature string").withColumn("draw", F.lit(0))
    pool = spark.createDataFrame([(g, len(cs), c) for g, cs in groups.items() for c in columns], "grp string, size int, feature string")
    drawn = pool.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(nulls)))).withColumn("place", F.row_number().over(Window.partitionBy("grp", "draw").orderBy(uniform(seed, "grp", "draw", "feature"), "feature"))) \
        .filter("place <= size").select("grp", "feature", "draw")
    allm = members.unionByName(drawn)
    left, right = allm.withColumnRenamed("feature", "left_feature"), allm.withColumnRenamed("feature", "right_feature")
    pairs = left.join(right, ["grp", "draw"]).join(both, ["left_feature", "right_feature"])
    per = pairs.groupBy("grp", "draw").agg(F.avg("r").alias("mean_r"))
    null = per.filter("draw > 0").groupBy("grp").agg(F.avg("mean_r").alias("null_mean"), F.stddev_pop("mean_r").alias("null_std"))
    return per.filter("draw = 0").join(null, "grp").select("grp", "mean_r", ((F.col("mean_r") - F.col("null_mean")) / F.greatest("null_std", F.lit(1e-9))).alias("z"))
