"""Typing, profiling and validating a table.

A profile is built from one (column, value, count) table, so every column is typed in the same job and a hot value
costs one row.  Two rule sets for kinds exist side by side: the schema rules and the contract rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.lineage import cut
from rulelens.functions.ordering import quantile_grid, running_sums, with_hash_rank, exact_quantiles
from rulelens.functions.shapes import add, as_text, hits, long_form, ratio, share, side_by_side, unions

# fixed values: missing markers of the contract rules and of the schema rules
CONTRACT_MISSING = ("", "?", "na", "n/a", "null")
SCHEMA_MISSING = ("", "?", "na", "n/a", "nan", "null", "none")
# fixed values: tokens read as booleans, the true one of each set first
BOOLEAN_SETS = (("1", "0"), ("true", "false"), ("yes", "no"), ("y", "n"), ("t", "f"), ("sim", "nao", "não"))
# fixed values: thresholds of the kind rules
CODE_MAX_UNIQUE, DISCRETE_MAX_UNIQUE, DATE_SHARE, ID_SHARE, TEXT_LENGTH = 10, 20, 0.9, 0.98, 40
LONG_VALUE = 256


def null_markers(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = CONTRACT_MISSING) -> DataFrame:
    """Missing markers become NULL (trimmed, any case)."""
    return df.withColumns({c: F.when(F.lower(F.trim(c)).isin(*tokens), None).otherwise(F.col(c)) for c in columns})


def unique_names(names: Sequence[str | None]) -> tuple[list[str], list[str]]:
    """Names after filling blanks and numbering repeats, plus the repeated ones."""
    seen: dict[str, int] = {}
    out, repeated = [], []
    for i, raw in enumerate(names):
        name = (raw or "").strip() or f"coluna_{i}"
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            repeated.append(name)
            name = f"{name}__{seen[name]}"
        out.append(name)
    return out, repeated


def finite_number(c: str) -> Column:
    v = F.trim(c).try_cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def numeric_text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns whose present values are all finite numbers (one aggregate over the table)."""
    row = df.agg(*[F.bool_and(finite_number(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = numeric_text_columns(df, columns)
    return df.withColumns({c: F.trim(c).try_cast("double") for c in ok}) if ok else df


def column_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column_name, value, n): distinct values with counts; very long text is replaced by its digest and length."""
    rows = long_form(as_text(df.select(*keep, *columns), columns), keep, columns, "column_name", "value")
    short = F.when(F.length("value") > LONG_VALUE, F.concat(F.sha2("value", 256), F.lit(":"), F.length("value"))).otherwise(F.col("value"))
    sized = rows.withColumns({"size": F.length("value"), "value": short})
    return sized.groupBy(*keep, "column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))


def parses_as_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c)).isNotNull()


def profile(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, missing, distinct values, parse shares, lengths, share of the commonest value."""
    by = [*by, "column_name"]
    v, n = F.col("value"), F.col("n")
    there = v.isNotNull()
    num = F.trim(v).try_cast("double")
    is_num = there & num.isNotNull() & ~F.isnan(num) & (F.abs(num) < float("inf"))
    low = F.lower(F.trim(v))
    in_set = [F.count_if(there & low.isin(*s)) == F.count_if(there) for s in BOOLEAN_SETS]
    return values.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~there, n)), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("n_present"), F.count_if(there).alias("n_unique"),
        F.coalesce(F.bool_and(F.when(there, is_num)), F.lit(False)).alias("all_numeric"),
        F.coalesce(F.bool_and(F.when(is_num, F.abs(num - F.round(num)) <= 1e-9)), F.lit(False)).alias("integer_like"),
        ratio(F.sum(F.when(there & parses_as_date(v), n).otherwise(0)), F.sum(F.when(there, n))).alias("date_share"),
        ratio(F.count_if(there & parses_as_date(v)), F.count_if(there)).alias("date_share_distinct"),
        ratio(F.sum(F.when(there, n * F.col("size"))), F.sum(F.when(there, n))).alias("mean_length"),
        F.max(F.when(there, n)).alias("top_count"),
        (add([F.when(c, 1).otherwise(0) for c in in_set]) > 0).alias("boolean_tokens"))


def schema_kind(p: DataFrame) -> DataFrame:
    """Schema rules: boolean tokens, few integer codes (ambiguous), numbers, dates, else categories."""
    code = F.col("integer_like") & (F.col("n_unique") <= CODE_MAX_UNIQUE)
    kind = (F.when(F.col("n_present") == 0, "categorical").when((F.col("n_unique") <= 2) & F.col("boolean_tokens"), "boolean")
            .when(F.col("all_numeric") & code, "categorical").when(F.col("all_numeric"), "numeric")
            .when(F.col("date_share_distinct") >= DATE_SHARE, "datetime").otherwise("categorical"))
    ambiguous = (F.col("n_present") == 0) | (F.col("all_numeric") & code & ~((F.col("n_unique") <= 2) & F.col("boolean_tokens")))
    return p.withColumns({"kind": kind, "ambiguous": ambiguous})


def step_regularity(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, regular_share): share of gaps between sorted distinct values equal to the median gap."""
    nums = values.filter(F.col("column_name").isin(*columns)).select("column_name", F.trim("value").try_cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    gaps = running_sums(nums.withColumn("one", F.lit(1)), "x", {"seen": "one"}, ["column_name"], following=["x"]).filter("next_x IS NOT NULL").withColumn(
        "gap", F.col("next_x") - F.col("x"))
    counts = gaps.groupBy("column_name", "gap").agg(F.count(F.lit(1)).alias("n"))
    mid = exact_quantiles(counts, "gap", {"median_gap": 0.5}, ["column_name"], weight="n")
    near = F.abs(F.col("gap") - F.col("median_gap")) <= 1e-9 + 1e-5 * F.abs("median_gap")
    return counts.join(F.broadcast(mid), "column_name").groupBy("column_name").agg((F.sum(F.when(near, F.col("n")).otherwise(0)) / F.sum("n")).alias("regular_share"))


def contract_kind(values: DataFrame, p: DataFrame) -> DataFrame:
    """Contract rules: constant, date, binary, discrete, id-like, continuous, free text, category."""
    unique_share = ratio(F.col("n_unique"), F.col("n_present"), 0.0)
    maybe_id = F.col("all_numeric") & F.col("integer_like") & (F.col("n_unique") > DISCRETE_MAX_UNIQUE) & (F.col("n_present") >= 20) & (unique_share >= ID_SHARE)
    suspects = [r["column_name"] for r in p.filter(maybe_id).select("column_name").collect()]  # column names only
    steps = step_regularity(values, suspects) if suspects else None
    q = p.join(steps, "column_name", "left") if steps is not None else p.withColumn("regular_share", F.lit(None).cast("double"))
    kind = (F.when(F.col("n_unique") <= 1, "constant").when(~F.col("all_numeric") & (F.col("date_share") >= DATE_SHARE), "datetime")
            .when(F.col("n_unique") == 2, "binary").when(F.col("all_numeric") & (F.col("n_unique") <= DISCRETE_MAX_UNIQUE), "numeric_discrete")
            .when(F.col("all_numeric") & (F.col("regular_share") >= 0.95), "id_like").when(F.col("all_numeric"), "numeric_continuous")
            .when((F.col("n_present") >= 20) & (unique_share >= ID_SHARE), "id_like")
            .when((F.col("mean_length") > TEXT_LENGTH) & (unique_share > 0.5), "free_text").otherwise("categorical"))
    return q.withColumn("kind", kind)


def treatment(kind: Column, cardinality: Column, rows: Column) -> Column:
    """Drop, one-hot, frequency-encode or use as it is."""
    wide = cardinality > F.greatest(F.lit(50), F.floor(rows * 0.5))
    return (F.when(kind.isin("constant", "id_like", "free_text", "datetime"), "drop")
            .when(kind.isin("categorical", "binary") & wide, "frequency").when(kind.isin("categorical", "binary"), "one_hot").otherwise("use"))


def contract(df: DataFrame, columns: Sequence[str], target: str, overrides: Mapping[str, str] | None = None,
             tokens: Sequence[str] = CONTRACT_MISSING) -> DataFrame:
    """One row per column: kind, missing rate, cardinality, treatment.  Rows without a target are left out."""
    clean = null_markers(as_text(df, columns), columns, tokens).filter(F.col(target).isNotNull())
    values = column_values(clean, columns)
    typed = contract_kind(values, profile(values))
    decided = treatment(F.col("kind"), F.col("n_unique"), F.col("n_rows"))
    forced = {"ignore": "drop", "categorical": "one_hot", "numeric": "use"}
    for name, choice in (overrides or {}).items():
        decided = F.when(F.col("column_name") == name, forced.get(choice, "use")).otherwise(decided)
    decided = F.when(F.col("column_name") == target, "target").otherwise(decided)
    return typed.select("column_name", "kind", (F.col("n_missing") / F.col("n_rows")).alias("missing_rate"), F.col("n_unique").alias("cardinality"),
                        decided.alias("treatment"), "n_rows")


def contract_warnings(columns: DataFrame, df: DataFrame, target: str, high_missing: float = 0.4, imbalance: float = 3.0, small_n: int = 100) -> DataFrame:
    """(code, column_name, detail) rows: column rules plus table rules."""
    other = columns.filter(F.col("column_name") != target)

    def rule(code: str, cond: Column, detail: Column) -> DataFrame:
        return other.filter(cond).select(F.lit(code).alias("code"), "column_name", detail.cast("double").alias("detail"))

    classes = class_distribution(df.filter(F.col(target).isNotNull()), target).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("rows"))
    spread = classes.filter(F.col("hi") / F.col("lo") >= imbalance).select(F.lit("class_imbalance").alias("code"), F.lit(target).alias("column_name"), (F.col("hi") / F.col("lo")).alias("detail"))
    small = classes.filter(F.col("rows") < small_n).select(F.lit("small_sample").alias("code"), F.lit(target).alias("column_name"), F.col("rows").cast("double").alias("detail"))
    return unions([rule("constant_column", F.col("kind") == "constant", F.col("cardinality")), rule("id_like_column", F.col("kind") == "id_like", F.col("cardinality")),
                   rule("high_missing_rate", F.col("missing_rate") > high_missing, F.col("missing_rate")), spread, small])


def target_by_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns (at least two values) whose value set lies inside the class-label table."""
    present = values.filter("value IS NOT NULL")
    strange = present.join(labels.select(F.col("label").alias("value")), "value", "left_anti").select("column_name").distinct()
    enough = present.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values")).filter("distinct_values >= 2")
    return enough.join(strange, "column_name", "left_anti")


def target_by_name(columns: Sequence[str], target: str | int | None = None) -> tuple[str, bool]:
    """(name, confirmed): an explicit name or index, else a conventional name, else the last column."""
    if isinstance(target, int):
        return columns[target], True
    if target is not None:
        if target not in columns:
            raise ValueError(f"no column named {target!r}")
        return target, True
    lower = {c.lower(): c for c in columns}
    for usual in ("target", "class", "classe", "label", "y"):
        if usual in lower:
            return lower[usual], False
    return columns[-1], False


def build_schema(p: DataFrame, declared: DataFrame | None = None, ontology: DataFrame | None = None) -> DataFrame:
    """Kind per column with its source: declared first, then ontology, then inferred."""
    typed = schema_kind(p).withColumnRenamed("kind", "inferred")
    for name, table in (("declared", declared), ("ontology", ontology)):
        typed = typed.join(table.select("column_name", F.col("kind").alias(name)), "column_name", "left") if table is not None else typed.withColumn(name, F.lit(None).cast("string"))
    source = F.when(F.col("declared").isNotNull(), "declared").when(F.col("ontology").isNotNull(), "ontology").otherwise("inferred")
    return typed.select("column_name", F.coalesce("declared", "ontology", "inferred").alias("kind"), source.alias("source"), "ambiguous", "n_missing", "n_unique")


def class_order(df: DataFrame, label: str, declared: Sequence[str] = ()) -> DataFrame:
    """(label, code): declared order if given, numeric order when all labels are numbers, else text order."""
    labels = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    numeric = F.bool_and(finite_number("label")).over(whole)
    place = F.array_position(F.array(*[F.lit(x) for x in declared]), F.col("label")) if declared else F.lit(0)
    keys = labels.withColumns({"num": F.when(numeric, F.col("label").try_cast("double")), "place": place})
    return keys.withColumn("code", F.row_number().over(whole.orderBy("place", "num", "label")) - 1).select("label", "code", "n")


def apply_schema(df: DataFrame, kinds: Mapping[str, str], ordinal: Mapping[str, Sequence[str]], target: str) -> DataFrame:
    """Typed projection: numbers, 0/1 flags, epoch seconds, ordinal ranks, text; the target comes last."""
    truthy = [s[0] for s in BOOLEAN_SETS]

    def typed(c: str) -> Column:
        kind = kinds[c]
        if kind == "numeric":
            return F.trim(F.col(c).cast("string")).try_cast("double")
        if kind == "boolean":
            return F.when(F.lower(F.trim(c)).isin(*truthy), 1).when(F.col(c).isNotNull(), 0)
        if kind == "datetime":
            stamp = F.try_to_timestamp(F.col(c).cast("string"))
            return F.unix_timestamp(stamp).cast("double")
        if kind == "ordinal":
            place = F.array_position(F.array(*[F.lit(v) for v in ordinal[c]]), F.trim(c))
            return F.when(place > 0, place - 1)
        return F.trim(F.col(c).cast("string"))

    names = [c for c in kinds if c != target] + [target]
    return df.select(*[typed(c).alias(c) for c in names])


def schema_issues(df: DataFrame, kinds: Mapping[str, str], target: str, order: Sequence[str], values: DataFrame, ordinal: Mapping[str, Sequence[str]] | None = None,
                  trained_order: Sequence[str] | None = None) -> DataFrame:
    """(code, severity, column_name, detail) rows from the column-value table; no second pass over the rows."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column_name")]
    v = values.withColumn("kind", kind)
    there = F.col("value").isNotNull()
    num_bad = there & ~finite_number("value")
    per = v.groupBy("column_name", "kind").agg(
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(there).alias("unique"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"),
        F.count_if(num_bad).alias("bad_numbers"), F.count_if(there & ~parses_as_date(F.col("value"))).alias("bad_dates"), F.count_if(there & (F.col("n") == 1)).alias("singletons"))
    id_like = (F.col("kind") == "categorical") & (F.col("unique") >= F.greatest(F.lit(5), F.floor(0.5 * F.col("present"))))
    feature = F.col("column_name") != target
    rules = [("MISSING_VALUES", "critical", feature & (F.col("missing") > 0), "missing"), ("TYPE_NUMERIC_INVALID", "critical", feature & (F.col("kind") == "numeric") & (F.col("bad_numbers") > 0), "bad_numbers"),
             ("TYPE_BOOLEAN_INVALID", "critical", feature & (F.col("kind") == "boolean") & (F.col("unique") > 2), "unique"),
             ("TYPE_DATETIME_INVALID", "critical", feature & (F.col("kind") == "datetime") & (F.col("bad_dates") > 0), "bad_dates"), ("ID_LIKE_COLUMN", "critical", feature & id_like, "unique"),
             ("RARE_SINGLETON_CATEGORIES", "warning", feature & (F.col("kind") == "categorical") & ~id_like & (F.col("singletons") > 0), "singletons"),
             ("CONSTANT_COLUMN", "warning", feature & (F.col("unique") <= 1) & (F.col("present") > 0), "unique"), ("TARGET_HAS_MISSING", "critical", ~feature & (F.col("missing") > 0), "missing"),
             ("TARGET_SINGLE_CLASS", "critical", ~feature & (F.col("unique") < 2), "unique")]
    cells = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(d).cast("long").alias("detail"))) for code, sev, cond, d in rules]))
    found = [per.select("column_name", F.explode(cells).alias("i")).select("i.code", "i.severity", "column_name", "i.detail")]
    for c, allowed in (ordinal or {}).items():
        strange = values.filter((F.col("column_name") == c) & there & ~F.col("value").isin(*allowed))
        found.append(strange.groupBy("column_name").agg(F.count(F.lit(1)).alias("detail")).select(F.lit("UNKNOWN_CATEGORIES").alias("code"), F.lit("critical").alias("severity"), "column_name", "detail"))
    classes = values.filter((F.col("column_name") == target) & there)
    wrong = classes.agg(F.count_if(~F.col("value").isin(*order)).alias("extra"), F.count(F.lit(1)).alias("seen")).withColumn("detail", F.col("extra") + F.abs(F.col("seen") - F.col("extra") - len(order)))
    found.append(wrong.filter("detail > 0").select(F.lit("CLASS_ORDER_INVALID").alias("code"), F.lit("critical").alias("severity"), F.lit(target).alias("column_name"), "detail"))
    if trained_order is not None and list(trained_order) != list(order):
        found.append(df.sparkSession.range(1).select(F.lit("CLASS_ORDER_CHANGES_TRAINED_MODEL").alias("code"), F.lit("critical").alias("severity"), F.lit(target).alias("column_name"), F.lit(len(order)).cast("long").alias("detail")))
    issues = unions(found)
    features = len([c for c in kinds if c != target])
    ids = issues.filter("code = 'ID_LIKE_COLUMN'").agg(F.count(F.lit(1)).alias("detail")).filter((F.col("detail") >= 2) & (F.col("detail") >= 0.5 * features))
    return unions([issues, ids.select(F.lit("LIKELY_NOT_A_DATASET").alias("code"), F.lit("critical").alias("severity"), F.lit(None).cast("string").alias("column_name"), "detail")])


def class_distribution(df: DataFrame, label: str, rare: float = 0.05) -> DataFrame:
    """Counts and shares per class, the rare-class flag, and the max/min ratio."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    total = F.sum("n").over(whole)
    return counts.withColumns({"share": F.col("n") / total, "rare": F.col("n") / total < rare, "imbalance_ratio": F.max("n").over(whole) / F.min("n").over(whole)})


def usable_rows(df: DataFrame, target: str, min_rows: int = 2) -> DataFrame:
    """Rows with a target whose class has enough rows (the small classes are found by a grouped count)."""
    present = df.filter(F.col(target).isNotNull())
    tiny = present.groupBy(target).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") < min_rows).select(target)
    return present.join(tiny, target, "left_anti")


def duplicate_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fully duplicated rows after the first; grouping by a row digest keeps the shuffle narrow."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return df.groupBy(digest.alias("d")).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"),
                                                                                        F.count_if(F.col("extra") > 0).alias("groups"))


def conflicting_groups(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Groups of equal features carrying different labels (grouped by features and label first)."""
    pairs = df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*features).agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).filter("labels > 1")


def inspection(df: DataFrame, features: Sequence[str], label: str, n_max: int = 10 ** 9, min_per_class: int = 10) -> DataFrame:
    """One row describing a candidate table: size, classes, missing share, suspicious columns, eligibility."""
    p = profile(column_values(df, features))
    n = F.max("n_rows")
    cols = p.agg(n.alias("n"), F.count(F.lit(1)).alias("p"), (F.sum("n_missing") / F.sum("n_rows")).alias("missing_overall"),
                 F.count_if(F.col("n_unique") <= 1).alias("constant_columns"), F.count_if((F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 20)).alias("id_like_columns"),
                 F.count_if(F.col("column_name").rlike("date|time|month")).alias("time_like_columns"),
                 F.count_if(F.col("all_numeric")).alias("numeric_columns"), F.max(F.col("n_missing") / F.col("n_rows")).alias("worst_missing"))
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("classes"), F.min("c").alias("smallest"))
    joined = cols.withColumns({"classes": classes.select("classes").scalar(), "smallest_class": classes.select("smallest").scalar()})
    return joined.withColumns({"size_ok": (F.col("n") <= n_max) & (F.col("smallest_class") >= min_per_class), "missing_ok": F.col("worst_missing") <= 0.3})


# ---------------------------------------------------------------- single-column leakage

def with_folds(df: DataFrame, key: Sequence[str], label: str, k: int, seed: int) -> DataFrame:
    """Stratified fold number per row, by pseudo-random order inside each class."""
    return with_hash_rank(df, seed, key, [label], "__r").withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k))).drop("__r")


def numeric_leakage(df: DataFrame, features: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """Cross-validated accuracy of the best single threshold per feature.

    ``df`` carries ``fold``.  Only the (feature, fold, value, class) counts leave the scan; up to 64 distinct values
    are tried as they are, otherwise 63 quantiles of the distinct values.
    """
    long = long_form(df.select("fold", label, *[F.col(f).cast("double").alias(f) for f in features]), ["fold", label], features).filter("value IS NOT NULL")
    cells = cut(long.groupBy("feature", "fold", "value", F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")))  # read by every later step
    models = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("model")
    tagged = cells.select("*", models).withColumn("train", F.col("fold") != F.col("model"))
    train = tagged.filter("train")
    unique = cut(train.groupBy("feature", "model", "value").agg(F.lit(1).alias("n")))  # read three times
    size = unique.groupBy("feature", "model").agg(F.count(F.lit(1)).alias("size"))
    size = F.broadcast(size)  # one row per column and fold
    few = unique.join(size.filter("size <= 64"), ["feature", "model"]).select("feature", "model", F.col("value").alias("edge"))
    many = unique.join(size.filter("size > 64"), ["feature", "model"])
    grid = [0.02 + 0.96 * i / 62 for i in range(63)]
    spaced = quantile_grid(many, "value", grid, ["feature", "model"]).select("feature", "model", F.col("quantile").alias("edge")).distinct()
    edges = few.unionByName(spaced)
    order = Window.partitionBy("feature", "model").orderBy("edge")  # at most 64 edges
    thresholds = edges.withColumn("thr", (F.col("edge") + F.lead("edge").over(order)) / 2).filter("thr IS NOT NULL").groupBy("feature", "model").agg(F.sort_array(F.collect_list("thr")).alias("thrs"))
    thresholds = cut(thresholds)  # a row for each column and fold, read twice
    binned = tagged.join(F.broadcast(thresholds), ["feature", "model"]).withColumn("bin", F.size(F.filter("thrs", lambda t: t < F.col("value"))))
    counts = cut(binned.groupBy("feature", "model", "train", "bin", "y").agg(F.sum("n").alias("n")))  # at most 64 bins per feature and model
    totals = counts.groupBy("feature", "model", "train", "y").agg(F.sum("n").alias("total"))
    # every (threshold, class) pair: rows on the left = bins up to the threshold index
    steps = thresholds.select("feature", "model", F.posexplode("thrs").alias("at", "thr"))
    grid_rows = steps.join(totals, ["feature", "model"])
    left = grid_rows.join(counts.select("feature", "model", "train", "y", "bin", "n"), ["feature", "model", "train", "y"], "left").groupBy("feature", "model", "thr", "train", "y", "total").agg(
        F.coalesce(F.sum(F.when(F.col("bin") <= F.col("at"), F.col("n"))), F.lit(0)).alias("l"))
    sides = left.groupBy("feature", "model", "thr").agg(
        *[F.min_by("y", F.struct(-side, F.col("y"))).alias(f"{name}_label") for name, side in (("left", F.when(F.col("train"), F.col("l")).otherwise(-1)), ("right", F.when(F.col("train"), F.col("total") - F.col("l")).otherwise(-1)))],
        F.max(F.when(F.col("train"), F.col("l"))).alias("hit_l"), F.max(F.when(F.col("train"), F.col("total") - F.col("l"))).alias("hit_r"))
    best = sides.groupBy("feature", "model").agg(F.min_by(F.struct("thr", "left_label", "right_label"), F.struct(-(F.col("hit_l") + F.col("hit_r")), F.col("thr"))).alias("b")).select("feature", "model", "b.*")
    held = tagged.filter("NOT train").join(F.broadcast(best), ["feature", "model"])  # one row per column and fold
    guess = F.when(F.col("value") <= F.col("thr"), F.col("left_label")).otherwise(F.col("right_label"))
    fold_acc = held.groupBy("feature", "model").agg((F.sum(F.when(guess == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))
    return fold_acc.groupBy("feature").agg(F.avg("acc").alias("cv_accuracy")).withColumn("leak", F.col("cv_accuracy") > 0.98)


def categorical_leakage(df: DataFrame, features: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """Cross-validated accuracy of category -> majority class, with the overall majority for unseen categories."""
    long = long_form(as_text(df.select("fold", label, *features), features), ["fold", label], features).filter("value IS NOT NULL")
    cells = long.groupBy("feature", "fold", "value", F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    tagged = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("model"))
    train = tagged.filter("fold <> model")

    def majority(keys: list[str], name: str) -> DataFrame:
        per = train.groupBy(*keys, "y").agg(F.sum("n").alias("c"))
        return per.groupBy(*keys).agg(F.min_by("y", F.struct(-F.col("c"), F.col("y"))).alias(name))

    held = tagged.filter("fold = model").join(majority(["feature", "model", "value"], "own"), ["feature", "model", "value"], "left").join(F.broadcast(majority(["feature", "model"], "overall")), ["feature", "model"])
    ok = F.coalesce("own", "overall") == F.col("y")
    fold_acc = held.groupBy("feature", "model").agg((F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))
    return fold_acc.groupBy("feature").agg(F.avg("acc").alias("cv_accuracy")).withColumn("leak", F.col("cv_accuracy") > 0.98)


def column_health(df: DataFrame, columns: Sequence[str], threshold: float = 1e-4) -> DataFrame:
    """Spread, commonest-value share, distinct and missing counts, and the earlier column each one equals."""
    rows = long_form(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    per = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    n_there = F.when(F.col("value").isNotNull(), F.col("n"))
    stats = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.count("value").alias("n_distinct"), (F.max(n_there) / F.sum(n_there)).alias("top_share"),
                                       (1 - F.sum(n_there) / F.sum("n")).alias("missing_share"))
    spread = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.stddev_pop(F.col(c).cast("double")).alias("std")) for c in columns]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    same = df.agg(F.array(*[F.struct(F.lit(b).alias("feature"), F.lit(a).alias("other"), F.lit(columns.index(a)).alias("i"), F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias("eq")) for a, b in pairs]).alias("s")) \
        .select(F.explode("s").alias("s")).select("s.*").filter("eq").groupBy("feature").agg(F.min_by("other", "i").alias("duplicate_of"))
    return stats.join(spread, "feature").join(same, "feature", "left").withColumn("near_constant", F.col("std") <= threshold)


def align(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Columns by name and in the model's order; never by position."""
    missing = [c for c in wanted if c not in df.columns]
    repeated = sorted({c for c in wanted if list(wanted).count(c) > 1})
    if missing or repeated:
        raise ValueError(f"missing columns {missing}, repeated columns {repeated}")
    return df.select(*wanted)


def record_like(people: DataFrame, test_ids: DataFrame, min_properties: int = 3) -> DataFrame:
    """Individuals of a property table (individual, key, value) that look like data rows or collide with test ids."""
    per = people.groupBy("individual").agg(F.count(F.lit(1)).alias("properties"), F.max(F.col("key").isin("id", "identifier", "key").cast("int")).alias("has_id"))
    named = F.lower("individual").rlike(r"^(row|record|sample|patient|subject|case)[_-]?\d+$")
    hit = test_ids.select(F.col("test_id").alias("individual")).distinct().withColumn("leak", F.lit(True))
    out = per.join(hit, "individual", "left").withColumn("record", named | (F.col("has_id") == 1) | (F.col("properties") >= min_properties))
    return out.withColumn("status", F.when(F.col("leak"), "REJECT_TEST_INSTANCE_LEAKAGE").when(F.col("record"), "REJECT_DATASET_RECORDS").otherwise("SAFE")).drop("leak")


def order_relations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Violation rate of a <= b over rows where both are known."""
    structs = [F.struct(F.lit(a).alias("lower"), F.lit(b).alias("upper"), hits(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
                        F.avg((F.col(a) > F.col(b)).cast("double")).alias("violation_rate")) for a, b in pairs]
    return df.agg(F.array(*structs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def protocol_audit(train: DataFrame, test: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Row counts, order-free content digests and missing counts of the evaluated rows."""

    def digest(df: DataFrame, role: str) -> DataFrame:
        h = F.xxhash64(*columns)
        return df.agg(F.lit(role).alias("role"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids"), F.bit_xor(h).alias("content"),
                      F.bit_xor(F.xxhash64(key)).alias("id_content"), add([F.count_if(F.col(c).isNull()) for c in columns]).alias("missing"))

    return digest(train, "train").unionByName(digest(test, "test"))


def canonical(df: DataFrame, c: str) -> Column:
    """A cell as text that does not depend on the engine: numbers with nine decimals, missing ones marked."""
    kind = dict(df.dtypes)[c]
    numeric = kind in ("double", "float") or kind.startswith("decimal")
    return F.coalesce(F.col(c).try_cast("decimal(38,9)").cast("string") if numeric else F.col(c).cast("string"), F.lit("\\N"))


def rows_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Aggregate: the sum of 60-bit hashes of the rows, so that neither order nor partitions matter, and a row that occurs twice
    counts twice."""
    text = F.concat_ws("|", *[canonical(df, c) for c in columns])
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")


def order_digest(names: Sequence[str]) -> str:
    """Digest of names in their order."""
    return hashlib.md5("|".join(map(str, names)).encode()).hexdigest()


def locked_protocol(rows: DataFrame, reloaded: DataFrame, key: str, label: str, features: Sequence[str], reloaded_features: Sequence[str], classes: Sequence[str], teacher_classes: Sequence[str]) -> DataFrame:
    """One row: digests of the evaluated rows, their ids, labels, contents, feature order and class order, for the rows as they were
    locked and as they were read again, and what agrees.

    Contents are compared with the features in one order, so that a changed order shows in the feature digest alone.
    """
    def side(df: DataFrame, own: Sequence[str], name: str) -> DataFrame:
        missing = F.coalesce(F.sum(add([F.when(F.col(c).isNull(), 1).otherwise(0) for c in own])), F.lit(0)).cast("long")
        found = {"rows": F.count(F.lit(1)), "ids": rows_digest(df, [key]), "labels": rows_digest(df, [key, label]), "content": rows_digest(df, [key, *sorted(own)]), "missing": missing}
        return df.agg(*[v.alias(f"{k}_{name}") for k, v in found.items()])

    both = side_by_side([side(rows, features, "locked"), side(reloaded, reloaded_features, "read")])
    same = {f"same_{k}": F.col(f"{k}_locked") == F.col(f"{k}_read") for k in ("rows", "ids", "labels", "content", "missing")}
    orders = {"features_locked": order_digest(features), "features_read": order_digest(reloaded_features), "classes_locked": order_digest(classes), "classes_teacher": order_digest(teacher_classes)}
    same |= {"same_features": F.col("features_locked") == F.col("features_read"), "same_classes": F.col("classes_locked") == F.col("classes_teacher")}
    return both.withColumns({k: F.lit(v) for k, v in orders.items()}).withColumns(same)


def file_kind(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """Whether a stored text holds several identifiers, one, or none."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    return files.withColumn("identifiers", F.size(ids)).withColumn(
        "kind", F.when(F.col("identifiers") > 1, "multi").when(F.col("identifiers") == 1, "single").otherwise("not_applicable"))


def transform_contract(df: DataFrame, key: Sequence[str], transform, originals: Sequence[str]) -> DataFrame:
    """Determinism, untouched originals and row independence of a projection, as maximal absolute differences."""
    once = transform(df)
    derived = [c for c in once.columns if c not in df.columns]
    again = transform(df.repartition(*key)).select(*key, *[F.col(c).alias(f"{c}__2") for c in [*originals, *derived]])
    before = df.select(*key, *[F.col(c).alias(f"{c}__0") for c in originals])
    joined = once.join(again, list(key)).join(before, list(key))
    gap = lambda a, b: F.coalesce(F.max(F.abs(F.col(a) - F.col(b))), F.lit(0.0))
    return joined.agg(F.greatest(*[gap(c, f"{c}__2") for c in derived], F.lit(0.0)).alias("determinism_gap"), F.greatest(*[gap(c, f"{c}__0") for c in originals], F.lit(0.0)).alias("original_gap"),
                      F.count(F.lit(1)).alias("rows"), add([F.count_if(F.col(c).isNull() != F.col(f"{c}__2").isNull()) for c in derived]).alias("null_changes"))
