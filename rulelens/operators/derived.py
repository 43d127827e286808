"""Columns derived from ontology specifications: fitted on training rows, applied as generated projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.ordering import exact_quantiles
from rulelens.functions.shapes import add, long_form, share
from rulelens.operators.prep import fit_scales

FLOOR = 1e-12


# ---------------------------------------------------------------- specifications

def hierarchy_specs(parents: Mapping[str, str]) -> list[dict]:
    """Mean z-score of columns that share a parent (two or more)."""
    groups: dict[str, list[str]] = {}
    for column, parent in sorted(parents.items()):
        groups.setdefault(parent, []).append(column)
    return [dict(name=f"{p}_mean", kind="aggregate", sources=cs) for p, cs in sorted(groups.items()) if len(cs) >= 2]


def family_specs(roles: Mapping[str, Mapping[str, str]]) -> list[dict]:
    """Contrasts between the mean, worst and error columns of a measurement family."""
    out = []
    for fam, r in sorted(roles.items()):
        if "mean" in r and "worst" in r:
            pair = [r["worst"], r["mean"]]
            out += [dict(name=f"{fam}_worst_minus_mean", kind="difference", sources=pair), dict(name=f"{fam}_relative_worst_delta", kind="relative_delta", sources=pair),
                    dict(name=f"{fam}_family_contrast", kind="contrast", sources=pair)]
            if "error" in r:
                out.append(dict(name=f"{fam}_normalized_error", kind="normalised_error", sources=[r["error"], r["mean"], r["worst"]]))
        if "mean" in r and "error" in r:
            out.append(dict(name=f"{fam}_error_ratio", kind="ratio", sources=[r["error"], r["mean"]]))
    return out


def declared_specs(declarations: DataFrame, columns: Mapping[str, str]) -> tuple[list[dict], DataFrame]:
    """Relations "op:other[:p:q]" declared on entities; returns the valid ones and a table of rejected declarations.

    ``declarations``: (entity, value), one row per annotation of a schema entity.
    """
    parts = F.split("value", ":")
    col_of = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    other = F.trim(F.try_element_at(parts, F.lit(2)))
    p, q = (F.when(F.size(parts) == 4, F.try_element_at(parts, F.lit(i)).try_cast("double")).otherwise(1.0) for i in (3, 4))
    d = declarations.select("entity", "value", F.lower(F.trim(parts[0])).alias("op"), other.alias("other"), F.size(parts).alias("k"), p.alias("p"), q.alias("q"), col_of[F.col("entity")].alias("left"), col_of[other].alias("right"))
    reason = (F.when(~F.col("k").isin(2, 4) | ~F.col("op").isin("ratio", "product", "difference", "sum"), "malformed_declaration").when(F.col("p").isNull() | F.col("q").isNull(), "non_numeric_exponent")
              .when((F.col("p") == 0) | (F.col("q") == 0), "invalid_exponent").when(F.col("right").isNull() | F.col("left").isNull() | (F.col("left") == F.col("right")), "operand_not_mapped_to_a_column"))
    tagged = d.withColumn("reason", reason)
    good = [dict(name=f"{r['entity']}_{r['op']}_{r['other']}", kind=f"declared_{r['op']}", sources=[r["left"], r["right"]], p=r["p"], q=r["q"]) for r in tagged.filter("reason IS NULL").orderBy("entity", "value").collect()]
    return good, tagged.filter("reason IS NOT NULL").select("entity", "value", "reason")


def bound_specs(bounds: Mapping[str, tuple[float | None, float | None]], train: DataFrame | None = None, calibrate: Sequence[str] = ()) -> list[dict]:
    """0/1 flags for declared bounds; without one, training quartiles where allowed."""
    found = dict(bounds)
    missing = [c for c in calibrate if found.get(c, (None, None)) == (None, None)]
    if missing and train is not None:
        rows = long_form(train.select(*[F.col(c).cast("double").alias(c) for c in missing]), [], missing)
        for r in exact_quantiles(rows, "value", {"lo": 0.25, "hi": 0.75}, ["feature"]).collect():
            found[r["feature"]] = (r["lo"], r["hi"])
    out = []
    for c, (lo, hi) in sorted(found.items()):
        if lo is not None:
            out.append(dict(name=f"{c}_within_min", kind="ge", sources=[c], limit=float(lo)))
        if hi is not None:
            out.append(dict(name=f"{c}_within_max", kind="le", sources=[c], limit=float(hi)))
    return out


def expression(spec: Mapping, scales: Mapping[str, Mapping[str, float]] | None = None) -> Column:
    """Column of one specification; denominators are floored at 1e-12."""
    s = [F.col(c).cast("double") for c in spec["sources"]]
    floor = lambda x: F.greatest(x, F.lit(FLOOR))
    kind = spec["kind"]
    if kind == "aggregate":
        z = [(F.col(c) - scales[c]["avg"]) / (scales[c]["std"] if scales[c]["std"] and scales[c]["std"] > FLOOR else 1.0) for c in spec["sources"]]
        return add(z) / len(z)
    if kind == "difference":
        return s[0] - s[1]
    if kind == "relative_delta":
        return (s[0] - s[1]) / floor(F.abs(s[1]))
    if kind == "contrast":
        return (s[0] - s[1]) / floor(F.abs(s[0]) + F.abs(s[1]))
    if kind == "normalised_error":
        return F.abs(s[0]) / floor(F.abs(s[1]) + F.abs(s[2]))
    if kind == "ratio":
        return s[0] / floor(F.abs(s[1]))
    if kind in ("ge", "le"):
        return F.when(s[0] >= spec["limit"] if kind == "ge" else s[0] <= spec["limit"], 1.0).when(s[0].isNotNull(), 0.0)
    a, b = F.pow(s[0], F.lit(float(spec["p"]))), F.pow(s[1], F.lit(float(spec["q"])))
    if kind == "declared_ratio":
        return a / F.when(F.abs(b) > FLOOR, b).otherwise(F.lit(FLOOR))
    return {"declared_product": a * b, "declared_difference": a - b, "declared_sum": a + b}[kind]


def apply_specs(df: DataFrame, specs: Sequence[Mapping], scales: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Fitted specifications on any split; a missing source column is an error."""
    lacking = sorted({c for s in specs for c in s["sources"] if c not in df.columns})
    if lacking:
        raise ValueError(f"missing source columns {lacking}")
    return df.withColumns({s["name"]: expression(s, scales) for s in specs})


def missing_values(df: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """NULL counts in the source columns, checked before applying the specifications."""
    cols = sorted({c for s in specs for c in s["sources"]})
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("missing")) for c in cols]).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def category_codes(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(value, code): values mapped to their semantic group, only when complete and 1 < groups < values.

    ``values``: distinct values of a column; ``groups``: (value, grp).
    """
    both = values.join(groups, "value", "left")
    shape = both.agg(F.count(F.lit(1)).alias("n"), F.count("grp").alias("m"), F.count_distinct("grp").alias("g"))
    ok = shape.select((F.col("n") == F.col("m")) & (F.col("g") > 1) & (F.col("g") < F.col("n"))).scalar()
    names = both.filter("grp IS NOT NULL").groupBy("grp").agg(F.min("value").alias("first"))
    coded = names.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("grp")))  # one row per semantic group
    return both.join(coded, "grp").filter(ok).select("value", "grp", "code")


def refit_by_fold(df: DataFrame, fold: str, columns: Sequence[str]) -> DataFrame:
    """(fold, feature, centre, scale) from the other folds: totals minus the fold's own sums, in one pass."""
    long = long_form(df.select(fold, *[F.col(c).cast("double").alias(c) for c in columns]), [fold], columns).filter("value IS NOT NULL")
    own = long.groupBy(fold, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    total = own.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "s", "ss")])
    rest = own.join(total, "feature").select(fold, "feature", (F.col("t_n") - F.col("n")).alias("n"), (F.col("t_s") - F.col("s")).alias("s"), (F.col("t_ss") - F.col("ss")).alias("ss"))
    centre = F.col("s") / F.col("n")
    return rest.select(fold, "feature", centre.alias("centre"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - centre * centre)).alias("scale"))


# ---------------------------------------------------------------- audits

def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Second-moment matrix of [1, columns] in one aggregate (columns x columns numbers)."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    k = len(cols)
    row = df.agg(*[F.avg(cols[i] * cols[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    return m


def r_squared(moments: np.ndarray, target: int, on: Sequence[int]) -> float | None:
    """R2 of one column on others from the moment matrix (row 0 is the intercept)."""
    mean = moments[0]
    cov = moments - np.outer(mean, mean)
    if cov[target, target] <= 0:
        return None
    a, b = cov[np.ix_(on, on)], cov[on, target]
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    return float(max(0.0, min(1.0, (coef @ b) / cov[target, target])))


def novelty(df: DataFrame, specs: Sequence[Mapping], originals: Sequence[str], low_variance: float = 0.98, near: float = 0.999) -> tuple[list[dict], list[dict]]:
    """Keep a derived column unless its name clashes, it is constant or nearly, or it repeats an earlier column.

    ``df`` already carries the derived columns.  Statistics come from two jobs; the in-order decision is on the driver.
    """
    names = [s["name"] for s in specs]
    every = [*originals, *[n for n in names if n not in originals]]
    long = long_form(df.select(*[F.col(c).cast("double").alias(c) for c in every]), [], every)
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    tops = {r["feature"]: r for r in counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("top"), F.count(F.lit(1)).alias("k")).collect()}
    moving = [c for c in every if tops[c]["k"] > 1]
    pairs = list(combinations(moving, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
                 *[F.max(F.abs(F.col(a).cast("double") - F.col(b).cast("double"))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    corr = {frozenset(p): row[f"c{i}"] for i, p in enumerate(pairs)}
    diff = {frozenset(p): row[f"d{i}"] for i, p in enumerate(pairs)}
    kept, audit, known = [], [], list(originals)
    for s in specs:
        n, reason, twin = s["name"], None, None
        if n in known:
            reason = "name_collision"
        elif tops[n]["k"] <= 1:
            reason = "constant"
        elif tops[n]["top"] >= low_variance:
            reason = "low_variance"
        else:
            for other in known:
                d = diff.get(frozenset((n, other)))
                if d is not None and d <= 1e-8:
                    reason, twin = "deterministic_duplicate", other
                    break
            if reason is None:
                for other in known:
                    c = corr.get(frozenset((n, other)))
                    if c is not None and abs(c) >= near:
                        reason, twin = "near_duplicate", other
                        break
        audit.append(dict(feature=n, accepted=reason is None, reason=reason, duplicate_of=twin))
        if reason is None:
            kept.append(s)
            known.append(n)
    return kept, audit


def information_audit(df: DataFrame, specs: Sequence[Mapping], originals: Sequence[str], by_name: Sequence[Sequence[str]] = ()) -> list[dict]:
    """R2 on the sources and on all originals, and what kind of information a derived column carries."""
    names = [s["name"] for s in specs]
    m = gram(df, [*originals, *names])
    place = {c: i + 1 for i, c in enumerate([*originals, *names])}
    groups = {tuple(sorted(g)) for g in by_name}
    out = []
    for s in specs:
        on_all = r_squared(m, place[s["name"]], [place[c] for c in originals])
        on_own = r_squared(m, place[s["name"]], [place[c] for c in s["sources"]])
        replicable = tuple(sorted(s["sources"])) in groups
        kind = "replicable_by_names" if replicable else "new_information" if on_all is not None and on_all < 0.999 else "linear_only"
        out.append(dict(feature=s["name"], kind=s["kind"], r2_sources=on_own, r2_all=on_all, classification=kind))
    return out


def union_columns(df: DataFrame, concepts: Mapping[str, Sequence[str]], family: Mapping[str, str], unresolved: Sequence[str] = ()) -> tuple[DataFrame, list[dict]]:
    """OR of the binary columns of a concept; mixed families, open extensions, tautologies and repeats are dropped."""
    audit, wanted, seen = [], {}, set()
    unsafe = {family[c] for c in unresolved if c in family}
    for concept, cols in sorted(concepts.items()):
        attrs = tuple(sorted(cols))
        fams = {family[c] for c in attrs}
        reason = ("mixed_families" if len(fams) != 1 else "incomplete_extension" if fams & unsafe else "too_small" if len(attrs) < 2 else "duplicate" if attrs in seen else None)
        if reason is None:
            seen.add(attrs)
            wanted[concept] = attrs
        audit.append(dict(concept=concept, reason=reason))
    if not wanted:
        return df, audit
    made = df.withColumns({f"any_{c}": F.greatest(*a) for c, a in wanted.items()})
    ends = made.agg(*[f(f"any_{c}").alias(f"{n}_{c}") for c in wanted for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for c in list(wanted):
        if ends[f"lo_{c}"] == ends[f"hi_{c}"]:
            made = made.drop(f"any_{c}")
            next(a for a in audit if a["concept"] == c)["reason"] = "constant"
    return made, audit


# ---------------------------------------------------------------- domains and coherence

def applicable_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None, bool]], min_coverage: float = 0.99) -> DataFrame:
    """(feature, low, high, is_integer, in_range, whole, applies): a bound counts only if nearly all training rows comply."""
    structs = []
    for c, (lo, hi, integer) in bounds.items():
        ok = F.lit(True)
        ok = ok & (F.col(c) >= lo) if lo is not None else ok
        ok = ok & (F.col(c) <= hi) if hi is not None else ok
        structs.append(F.struct(F.lit(c).alias("feature"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), F.lit(integer).alias("is_integer"),
                                F.avg(F.when(F.col(c).isNotNull(), ok.cast("double"))).alias("in_range"), F.avg((F.abs(F.col(c) - F.round(c)) <= 1e-9).cast("double")).alias("whole")))
    out = df.agg(F.array(*structs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumns({"range_applies": F.col("in_range") >= min_coverage, "integer_applies": F.col("is_integer") & (F.col("whole") >= min_coverage)})


def validity(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None, bool]]) -> Column:
    ok = F.lit(True)
    for c, (lo, hi, integer) in bounds.items():
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
        if integer:
            ok = ok & (F.abs(F.col(c) - F.round(c)) <= 1e-9)
    return ok


def project_to_domain(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None, bool]]) -> DataFrame:
    """Round and clip to the declared domain."""
    out = {}
    for c, (lo, hi, integer) in bounds.items():
        v = F.round(c) if integer else F.col(c)
        v = F.greatest(F.lit(float(lo)), v) if lo is not None else v
        out[c] = F.least(F.lit(float(hi)), v) if hi is not None else v
    return df.withColumns(out)


def control_validity(real: DataFrame, control: DataFrame, real_columns: Sequence[str], control_columns: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Same width, finite values, and a spread at most ``factor`` times the real one."""
    widest = lambda df, cols, name: df.agg(F.greatest(F.lit(0.0), *[F.stddev_pop(c) for c in cols]).alias(name), add([F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(c) == float("inf"))) for c in cols]).alias(f"{name}_bad"))
    r, c = widest(real, real_columns, "real"), widest(control, control_columns, "control")
    out = c.withColumn("real", r.select("real").scalar())
    return out.select("real", "control", F.col("control_bad").alias("not_finite"), F.lit(len(real_columns) == len(control_columns)).alias("same_width"),
                      ((F.col("control") <= factor * F.col("real")) & (F.col("control_bad") == 0) & F.lit(len(real_columns) == len(control_columns))).alias("valid"))


def coherence(df: DataFrame, specs: Sequence[Mapping], scales: Mapping[str, Mapping[str, float]] | None = None, tol: float = 1e-8) -> DataFrame:
    """Share and size of rows whose stored derived value differs from the recomputed one (in deviations)."""
    spread = fit_scales(df, [s["name"] for s in specs])
    gaps = [F.abs(F.col(s["name"]) - expression(s, scales)) / max(spread[s["name"]]["std"] or 0.0, FLOOR) for s in specs]
    row_max = F.round(F.greatest(*gaps) if len(gaps) > 1 else gaps[0], 9).alias("worst")
    rows = df.select(row_max, (add(gaps) / len(gaps)).alias("mean_gap"))
    tail = exact_quantiles(rows, "worst", {"p90": 0.9}).first()["p90"]
    return rows.agg(share(F.col("worst") > tol).alias("violation_rate"), F.avg("mean_gap").alias("mean_gap")).withColumn("p90", F.lit(tail))


def domain_report(synthetic: DataFrame, train: DataFrame, features: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """Out-of-range rate, excess in deviations, broken integers, and categories unseen in training."""
    s = fit_scales(train, list(features))
    whole = train.agg(*[F.bool_and(F.abs(F.col(c) - F.round(c)) <= 1e-9).alias(c) for c in features]).first()
    excess = {c: (F.greatest(F.lit(s[c]["min"]) - F.col(c), F.lit(0.0)) + F.greatest(F.col(c) - s[c]["max"], F.lit(0.0))) / max(s[c]["std"] or 0.0, FLOOR) for c in features}
    outside, broken = F.lit(False), F.lit(False)
    for c in features:
        outside = outside | (excess[c] > 0)
        if whole[c]:
            broken = broken | (F.abs(F.col(c) - F.round(c)) > 1e-9)
    rows = synthetic
    strange = F.lit(False)
    for c in categories:
        known = train.select(c).distinct().withColumn(f"__known_{c}", F.lit(True))
        rows = rows.join(known, c, "left")
        strange = strange | F.col(f"__known_{c}").isNull()
    return rows.agg(F.count(F.lit(1)).alias("rows"), share(outside).alias("out_of_range"), F.avg(add(excess.values()) / len(features)).alias("mean_excess"),
                    F.max(F.greatest(*excess.values())).alias("max_excess"), share(broken).alias("broken_integers"), share(strange).alias("unseen_categories"))
