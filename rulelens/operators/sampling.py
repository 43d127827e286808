"""Synthetic rows and teacher queries.  Every draw is a hash of (seed, row number), so reruns and retries agree."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, functions as F

from rulelens.functions.hashing import gaussian, pick, uniform
from rulelens.functions.lineage import written
from rulelens.functions.neighbours import nearest
from rulelens.functions.ordering import first_by_hash, running_sums, top_k, with_hash_rank
from rulelens.functions.shapes import add, hits, join_small, long_form, share, unions
from rulelens.operators.trees import normalised_entropy

TINY = 1e-12


def column_model(df: DataFrame, features: Sequence[str], max_discrete: int = 20) -> dict[str, dict]:
    """Per column: discrete or continuous, spread, range and kernel width (statistics of at most one row per column)."""
    long = long_form(df.select(*[F.col(f).cast("double").alias(f) for f in features]), [], features).filter("value IS NOT NULL")
    values = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"), F.bool_and(F.abs(F.col("value") - F.round("value")) <= 1e-9).alias("whole"),
                                        F.min("value").alias("low"), F.max("value").alias("high"))
    spread = df.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    out = {}
    for r in per.collect():
        limit = min(max_discrete, max(2, int(r["rows"] ** 0.5)))
        sd = spread[r["feature"]] or 0.0
        out[r["feature"]] = dict(discrete=r["k"] <= limit and (r["whole"] or r["k"] <= 8), low=r["low"], high=r["high"], sd=sd, width=max(1.06 * max(sd, 1e-9) * max(2, r["rows"]) ** -0.2, 1e-6))
    return out


def indexed(df: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """Rows numbered 1..n in hash order, for joining draws to rows."""
    return with_hash_rank(df.select(*dict.fromkeys([*key, *columns])), seed, key, name="row_no").select("row_no", *columns)


def marginal_draws(df: DataFrame, key: Sequence[str], features: Sequence[str], n: int, seed: int, model: Mapping[str, dict]) -> DataFrame:
    """n rows, each column drawn on its own: an observed value, plus kernel noise when it is continuous.

    Draw (i, column) picks a row number; one equi-join on (row number, column) fetches all values.
    """
    rows = indexed(df, key, features, seed)
    total = rows.agg(F.count(F.lit(1))).scalar()
    long = long_form(rows.select("row_no", *[F.col(f).cast("double").alias(f) for f in features]), ["row_no"], features)
    names = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    wanted = df.sparkSession.range(n).select(F.col("id").alias("draw"), names).withColumn("row_no", pick(f"{seed}:row", total, "draw", "feature") + 1)
    width = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(0.0 if model[f]["discrete"] else float(model[f]["width"])))])
    got = wanted.join(long, ["row_no", "feature"]).withColumn("value", F.col("value") + width[F.col("feature")] * gaussian(f"{seed}:noise", "draw", "feature"))
    return got.groupBy("draw").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])


class Shortfall(ValueError):
    """A region gave fewer draws than were asked for."""


def draw_until(draw: Callable[[int, int], DataFrame], accept: Column, wanted: int, rounds: int = 16, first: int = 6, most: int = 1 << 32, partial: bool = False) -> tuple[DataFrame, int]:
    """Rejection sampling: grow the batch by the observed acceptance until ``wanted`` rows pass.

    Returns exactly ``wanted`` rows, the first ones by round and draw, and the number tried. If ``rounds`` batches (or ``most``
    draws) do not give as many, the region is empty or too rare: an error that says how many passed, or those rows with
    ``partial``.
    """
    parts, have, tried, batch = [], 0, 0, max(64, wanted * first)
    for r in range(rounds):
        ok = draw(batch, r).filter(accept).withColumn("__round", F.lit(r))
        n = ok.count()
        parts.append(ok)
        have, tried = have + n, tried + batch
        if have >= wanted or tried >= most:
            break
        # by the acceptance seen so far; while nothing has passed, four times as many
        batch = min(most - tried, max(64, int((wanted - have) * 1.3 * tried / have)) if have else 4 * batch)
    if have < wanted and not partial:
        raise Shortfall(f"{have} of {wanted} draws passed in {tried} tries: the region is empty or too rare")
    return unions(parts).orderBy("__round", "draw").limit(wanted).drop("__round"), tried


def joint_draws(df: DataFrame, key: Sequence[str], features: Sequence[str], n: int, seed: int, model: Mapping[str, dict], groups: Sequence[Sequence[str]] = (), ordinal: Sequence[str] = (),
                noise: float = 0.25, resample: float = 0.2, flip: float = 0.05) -> DataFrame:
    """Whole observed rows, perturbed: noise on continuous columns, group-wise resampling, binary flips, ordinal steps."""
    rows = indexed(df, key, features, seed)
    total = rows.agg(F.count(F.lit(1))).scalar()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (pick(f"{seed}:base", total, "id") + 1).alias("row_no"), (pick(f"{seed}:donor", total, "id") + 1).alias("donor_no"))
    donors = rows.select(F.col("row_no").alias("donor_no"), *[F.col(f).alias(f"d_{f}") for f in features])
    both = draws.join(rows, "row_no").join(donors, "donor_no")
    grouped = {f: i for i, g in enumerate(groups) for f in g}
    out = {}
    for f in features:
        m, v, d = model[f], F.col(f).cast("double"), F.col(f"d_{f}").cast("double")
        u = uniform(f"{seed}:{'g' + str(grouped[f]) if f in grouped else f}", "draw")
        if f in grouped:
            out[f] = F.when(u < resample, d).otherwise(v)
        elif f in ordinal:
            step = F.when(u < resample / 2, -1.0).when(u >= 1 - resample / 2, 1.0).otherwise(0.0)
            out[f] = F.greatest(F.lit(m["low"]), F.least(F.lit(m["high"]), v + step))
        elif m["discrete"] and m["low"] == 0 and m["high"] == 1:
            out[f] = F.when(u < flip, 1 - v).otherwise(v)
        elif m["discrete"]:
            out[f] = F.when(u < resample, d).otherwise(v)
        else:
            out[f] = F.greatest(F.lit(m["low"]), F.least(F.lit(m["high"]), v + noise * max(m["sd"], TINY) * gaussian(f"{seed}:{f}", "draw")))
    return both.select("draw", *[c.alias(f) for f, c in out.items()])


def neighbour_mixes(df: DataFrame, key: str, features: Sequence[str], n: int, seed: int, scales: Mapping[str, float], k: int = 5, copied: Sequence[str] = ()) -> DataFrame:
    """Convex mixes of a row and one of its k nearest rows; copied columns come whole from either."""
    base = with_hash_rank(df.select(key, *features), seed, [key]).filter(F.col("hash_rank") <= n).drop("hash_rank")
    near = nearest(df, base, features, k, key, key, scales, skip_self=True)
    chosen = near.withColumn("want", pick(f"{seed}:nb", k, key) + 1).filter("rank = want").select(key, F.col("neighbour"))
    other = df.select(F.col(key).alias("neighbour"), *[F.col(f).cast("double").alias(f"n_{f}") for f in features])
    both = base.join(chosen, key).join(other, "neighbour")
    t = uniform(f"{seed}:mix", key)
    cols = [F.when(uniform(f"{seed}:{f}", key) < 0.5, F.col(f).cast("double")).otherwise(F.col(f"n_{f}")).alias(f) if f in copied
            else (F.col(f).cast("double") + t * (F.col(f"n_{f}") - F.col(f).cast("double"))).alias(f) for f in features]
    return both.select(F.col(key).alias("draw"), *cols)


def acceptance_rate(draws: DataFrame, accept: Column) -> DataFrame:
    return draws.agg(F.count(F.lit(1)).alias("tried"), hits(accept).alias("accepted"), share(accept).alias("rate"))


# ---------------------------------------------------------------- comparing real and synthetic rows

def side_counts(local: DataFrame, reference: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, n_local, n_reference)."""
    by = list(by)

    def tagged(df: DataFrame, l: int) -> DataFrame:
        rows = long_form(df.select(*by, *[F.col(f).cast("double").alias(f) for f in features]), by, features)
        return rows.withColumns({"l": F.lit(l), "r": F.lit(1 - l)})

    both = tagged(local, 1).unionByName(tagged(reference, 0)).filter("value IS NOT NULL")
    return both.groupBy(*by, "feature", "value").agg(F.sum("l").alias("n_local"), F.sum("r").alias("n_reference"))


def ks_statistics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature: largest gap of the two cumulative shares."""
    keys = [*by, "feature"]
    cum = running_sums(counts, "value", {"cl": "n_local", "cr": "n_reference"}, keys, totals={"nl": "n_local", "nr": "n_reference"})
    return cum.groupBy(*keys).agg(F.max(F.abs(F.col("cl") / F.col("nl") - F.col("cr") / F.col("nr"))).alias("ks"), F.max("nl").alias("n_local"), F.max("nr").alias("n_reference"))


def chi2_statistics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square of the 2 x values table per feature, with its degrees of freedom."""
    keys = [*by, "feature"]
    total = counts.groupBy(*keys).agg(F.sum("n_local").alias("nl"), F.sum("n_reference").alias("nr"), (F.count(F.lit(1)) - 1).alias("df"))
    both = join_small(counts, total, keys)
    n, rows = F.col("nl") + F.col("nr"), F.col("n_local") + F.col("n_reference")
    el, er = rows * F.col("nl") / n, rows * F.col("nr") / n
    return both.groupBy(*keys).agg(F.sum((F.col("n_local") - el) ** 2 / el + (F.col("n_reference") - er) ** 2 / er).alias("chi2"), F.max("df").alias("df"))


def label_distance(real: DataFrame, synthetic: DataFrame, label: str) -> DataFrame:
    """Total variation between the two label shares."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumn(name, F.col("__n") / df.agg(F.count(F.lit(1))).scalar()).drop("__n")

    both = shares(real, "a").join(shares(synthetic, "b"), label, "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).alias("tv_distance"), F.count(F.lit(1)).alias("classes"))


def plausibility(synthetic: DataFrame, train: DataFrame, features: Sequence[str], probs: Sequence[str], margin: float = 0.2) -> DataFrame:
    """Out-of-range, exact-copy, uniqueness and near-boundary shares of synthetic rows."""
    lim = train.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    outside = F.lit(False)
    for c in features:
        outside = outside | (F.col(c) < lim[f"lo_{c}"]) | (F.col(c) > lim[f"hi_{c}"])
    digest = F.xxhash64(*[F.col(c).cast("double") for c in features])
    seen = train.select(*[F.col(c).cast("double").alias(c) for c in features]).distinct().withColumn("seen", F.lit(True))
    top2 = F.sort_array(F.array(*probs), asc=False)
    rows = synthetic.select(*[F.col(c).cast("double").alias(c) for c in features], *probs).join(seen, list(features), "left")
    return rows.agg(F.count(F.lit(1)).alias("rows"), share(outside).alias("out_of_range"), share(F.col("seen").isNotNull()).alias("copies"),
                    (F.count_distinct(digest) / F.count(F.lit(1))).alias("unique_share"), share(top2[0] - top2[1] < margin).alias("near_boundary"))


# ---------------------------------------------------------------- teacher answers

def aligned_probabilities(df: DataFrame, probs: Mapping[str, str]) -> DataFrame:
    """Clip to (0, 1], normalise, and name the best class (first on ties)."""
    clipped = {c: F.greatest(F.lit(TINY), F.least(F.lit(1.0), F.col(c))) for c in probs.values()}
    total = add(clipped.values())
    out = df.withColumns({c: v / total for c, v in clipped.items()})
    top, pick_class = F.greatest(*probs.values()), None
    for label, c in probs.items():
        pick_class = F.when(F.col(c) == top, label) if pick_class is None else pick_class.when(F.col(c) == top, label)
    return out.withColumn("teacher_class", pick_class)


def query_accounting(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls, samples and reused samples per phase, and what the teacher really received."""
    phase = lambda p, v: F.coalesce(F.sum(F.when(F.col("phase") == p, v)), F.lit(0))
    out = log.groupBy(*by).agg(phase("original", F.lit(1)).alias("original_calls"), phase("original", F.col("samples")).alias("original_samples"), phase("semantic", F.lit(1)).alias("semantic_calls"),
                               phase("semantic", F.col("samples")).alias("semantic_samples"), phase("reused", F.col("samples")).alias("reused_samples"))
    return out.withColumn("total_samples", F.col("original_samples") + F.col("semantic_samples") - F.col("reused_samples")).withColumn(
        "extra_samples", F.col("total_samples") - F.col("original_samples"))


def reuse_answers(asked: DataFrame, answered: DataFrame, features: Sequence[str], answer: str) -> DataFrame:
    """Queries with the known answer where the same row was asked before; the rest keep a NULL answer.

    Answers are reduced to one row per distinct query before the join, so repeated queries cannot multiply.
    """
    known = answered.groupBy(*features).agg(F.first(answer).alias(answer))
    return asked.select(*[c for c in asked.columns if c != answer]).join(known, list(features), "left")


def diverse_top(df: DataFrame, key: str, score: Column, features: Sequence[str], scales: Mapping[str, float], k: int, weight: float = 0.5) -> DataFrame:
    """k rows that are uncertain and far from each other: each step takes the best of all rows that are left.

    A row's value is its score plus ``weight`` times its distance to the chosen rows, as a share of the largest such distance;
    ties go to the smallest key. Only the chosen rows reach the driver. ``key`` is unique; rows without a value come last.
    """
    scaled = [(F.col(f).cast("double") / (float(scales[f]) + 1e-9)).alias(f) for f in features]
    rows = df.select(F.col(key).cast("long").alias(key), F.round(score, 9).cast("double").alias("score"), *scaled).persist(StorageLevel.MEMORY_AND_DISK)
    chosen: list[Row] = []
    while len(chosen) < k:
        left, value = rows, F.col("score")
        if chosen:
            gaps = [F.sqrt(add([(F.col(f) - F.lit(c[f])) * (F.col(f) - F.lit(c[f])) for f in features])) for c in chosen]
            left = rows.filter(~F.col(key).isin([c[key] for c in chosen])).withColumn("gap", F.least(*gaps) if len(gaps) > 1 else gaps[0])
            widest = left.agg(F.max("gap")).first()[0] or 0.0
            value = F.col("score") + F.lit(weight) * F.col("gap") / F.lit(widest + TINY)
        best = left.agg(F.max(F.struct(value.alias("value"), (-F.col(key)).alias("first"), key, "score", *features)).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
    rows.unpersist()
    return df.sparkSession.createDataFrame([(c[key], i + 1, c["score"]) for i, c in enumerate(chosen)], f"{key} long, place int, score double")


def bisect(pairs: DataFrame, features: Sequence[str], teacher: Callable[[Mapping[str, Column]], Column], source_class: str, steps: int = 12) -> DataFrame:
    """Boundary point between a row (``f``) and one of another class (``o_f``): halvings of the segment in one expression."""

    def at(x: Column) -> dict[str, Column]:
        return {f: F.col(f).cast("double") + x * (F.col(f"o_{f}").cast("double") - F.col(f).cast("double")) for f in features}

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        same = teacher(at(mid)) == F.col(source_class)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    out = pairs.withColumn("step", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["hi"]))
    return out.withColumns({f"b_{f}": c for f, c in at(F.col("step")).items()})


def boundary_points(df: DataFrame, key: str, features: Sequence[str], label: str, teacher: Callable, scales: Mapping[str, float], anchors: int, seed: int = 3, max_distance: float = 5.0) -> DataFrame:
    """Boundary rows between a bounded set of anchors and their nearest row of another class, with their plausibility."""
    df = written(df.select(key, label, *features), "rows")  # read for each search and join, so nothing before is made again
    base = written(first_by_hash(df, seed, [key], anchors), "anchors")
    near = nearest(df, base, features, 1, key, key, scales, corpus_label=label, query_label=label).filter(F.col("distance") <= max_distance).select(key, "neighbour")
    other = df.select(F.col(key).alias("neighbour"), *[F.col(f).alias(f"o_{f}") for f in features])
    cut = bisect(F.broadcast(base.join(near, key)).join(other, "neighbour"), features, teacher, label)  # as many rows as anchors at most
    moved = F.sqrt(add([((F.col(f"b_{f}") - F.col(f)) / float(scales[f])) ** 2 for f in features]))
    kept = cut.withColumn("boundary_class", teacher({f: F.col(f"b_{f}") for f in features})).filter(F.col("boundary_class") != F.col(label)).withColumn("moved", moved)
    points = written(kept.select(key, label, "boundary_class", "moved", *[F.col(f"b_{f}").alias(f) for f in features]), "points")
    manifold = nearest(df, points, features, 1, key, key, scales).select(key, F.col("distance").alias("manifold"))
    return points.join(manifold, key).withColumn("plausibility", F.exp(-F.col("manifold")) * F.exp(-0.15 * F.col("moved")))


# ---------------------------------------------------------------- soft targets

def temperature_scaled(probs: Sequence[str], temperature: float) -> list[Column]:
    powers = [F.pow(F.greatest(F.col(p), F.lit(TINY)), F.lit(1.0 / temperature)) for p in probs]
    total = add(powers)
    return [p / total for p in powers]


def heaviest(df: DataFrame, mass: str, room: int, seed, key: Sequence[str]) -> DataFrame:
    """The ``room`` rows of largest mass (a multiple of 1e-9); of those whose mass is where the room ends, the first in hash order.

    Rows are counted by cells of masses, and by mass only inside the cell where the room ends, so neither table grows with the rows.
    """
    cell = F.rint(F.col(mass) * 1e4)  # at most 100,001 masses each

    def end(counts: DataFrame, value: str, left: int) -> Row | None:
        cum = running_sums(counts, value, {"cum": "n"}, descending=True)
        return cum.filter(F.col("cum") > left).orderBy(F.desc(value)).first()

    last = end(df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cell", room)
    if last is None:
        return df
    left = room - (last["cum"] - last["n"])
    edge = end(df.filter(cell == last["cell"]).groupBy(mass).agg(F.count(F.lit(1)).alias("n")), mass, left)
    left -= edge["cum"] - edge["n"]
    # one number decides: only rows of that very mass are ranked
    part = with_hash_rank(df.filter(F.col(mass) == edge[mass]), seed, key).filter(F.col("hash_rank") <= left).drop("hash_rank")
    return df.filter(F.col(mass) > edge[mass]).unionByName(part)


def soft_targets(df: DataFrame, key: Sequence[str], hard: str, probs: Mapping[str, str], temperature: float = 2.0, soft_weight: float = 0.35, hard_weight: float = 1.0, emphasis: float = 0.5,
                 min_probability: float = 0.03, max_factor: float = 5.0) -> DataFrame:
    """Hard rows plus weighted soft rows, at most (max_factor - 1) x n of them, heaviest first.

    A row gives at most one soft row a label, so with no more labels than max_factor - 1 the cap leaves nothing out and is not looked for.
    """
    k = len(probs)
    soft = dict(zip(probs, temperature_scaled(list(probs.values()), temperature)))
    entropy = -add([p * F.log(F.greatest(p, F.lit(TINY))) for p in soft.values()]) / F.log(F.lit(float(k)))
    base = df.select(*key, F.col(hard).alias("__hard"), entropy.alias("__e"), *[c.alias(f"__s_{l}") for l, c in soft.items()])
    cells = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(i).alias("i"), F.col(f"__s_{l}").alias("p")) for i, l in enumerate(probs)])
    each = base.select(*key, "__e", F.explode(cells).alias("c")).select(*key, "__e", "c.*").filter(F.col("p") >= min_probability)
    each = each.withColumn("lift", 1 + emphasis * F.col("__e"))
    if k > max_factor - 1:
        room = max(0, math.floor(df.count() * (max_factor - 1)))
        each = heaviest(each.withColumn("mass", F.round(F.col("p") * F.col("lift"), 9)), "mass", room, "edge", [*key, "i"])
    soft_rows = each.select(*key, "label", (F.col("p") * soft_weight * F.col("lift")).alias("weight")).withColumn("kind", F.lit("soft"))
    hard_rows = base.select(*key, F.col("__hard").alias("label"), F.lit(max(0.0, 1 - soft_weight) * hard_weight).alias("weight")).withColumn("kind", F.lit("hard"))
    return hard_rows.unionByName(soft_rows)


def hybrid_targets(df: DataFrame, key: Sequence[str], truth: str, probs: Mapping[str, str], confidence: Column, weights: tuple[float, float, float] = (0.45, 0.45, 0.10), min_probability: float = 0.03) -> DataFrame:
    """True label, teacher mass and semantic confidence as weighted rows."""
    total = sum(weights)
    truth_rows = df.select(*key, F.col(truth).alias("label"), (weights[0] / total + F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * weights[2] / total).alias("weight"), F.lit("true").alias("kind"))
    cells = F.array(*[F.struct(F.lit(l).alias("label"), F.col(c).alias("p")) for l, c in probs.items()])
    soft = df.select(*key, F.explode(cells).alias("c")).filter(F.col("c.p") >= min_probability).select(*key, F.col("c.label").alias("label"), (F.col("c.p") * weights[1] / total).alias("weight"), F.lit("teacher").alias("kind"))
    return truth_rows.unionByName(soft)


# ---------------------------------------------------------------- teachers fitted with spark.ml

def out_of_fold(df: DataFrame, estimator, fold: str, k: int) -> DataFrame:
    """Every row scored exactly once, by a model that never saw it."""
    return unions([estimator.fit(df.filter(F.col(fold) != i)).transform(df.filter(F.col(fold) == i)) for i in range(k)])


def blend_weights(df: DataFrame, components: Mapping[str, Mapping[str, str]], truth: str, labels: Sequence[str], step: float = 0.25) -> DataFrame:
    """Accuracy of every simplex mixture of class probabilities, all mixtures in one pass."""
    names = list(components)
    parts = round(1 / step)

    def simplex(left: int, slots: int):
        if slots == 1:
            yield (left,)
            return
        for a in range(left + 1):
            for rest in simplex(left - a, slots - 1):
                yield (a, *rest)

    structs = []
    for w in simplex(parts, len(names)):
        mix = {l: add([F.lit(w[i] * step) * F.col(components[n][l]) for i, n in enumerate(names)]) for l in labels}
        top, guess = F.greatest(*mix.values()), None
        for l, c in mix.items():
            guess = F.when(c == top, l) if guess is None else guess.when(c == top, l)
        structs.append(F.struct(*[F.lit(w[i] * step).alias(f"w_{n}") for i, n in enumerate(names)], F.avg((guess == F.col(truth)).cast("double")).alias("utility")))
    return df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def uncertainty_draws(df: DataFrame, key: str, probs: Sequence[str], features: Sequence[str], n: int, centrality: Mapping[str, float], spread: Mapping[str, float], seed: int = 8) -> DataFrame:
    """Noisy copies of the n most uncertain rows; central columns move less."""
    top = top_k(df.withColumn("u", F.round(normalised_entropy(list(probs)), 9)).select(key, "u", *features), n, [F.desc("u"), F.col(key)], salt=[key])
    return top.select(key, "u", *[(F.col(f) + 0.1 * (1 - 0.5 * centrality.get(f, 0.0)) * float(spread[f]) * gaussian(f"{seed}:{f}", key)).alias(f) for f in features])


def impose_dependence(df: DataFrame, key: Sequence[str], pairs: Sequence[tuple[str, str, float]], limits: Mapping[str, tuple[float, float]], seed: int = 44) -> DataFrame:
    """Move a dependent column toward its base column, then clip to the observed range; pairs apply in order."""
    out = df
    for i, (dependent, base, strength) in enumerate(pairs):
        s = out.agg(F.avg(base).alias("m"), F.stddev_pop(base).alias("b"), F.stddev_pop(dependent).alias("d")).first()
        z = (F.col(base) - s["m"]) / (s["b"] + 1e-6)
        d = s["d"] + 1e-6
        noise = 0.12 * gaussian(f"{seed}:{i}", *key) * d * 0.08
        out = out.withColumn(dependent, F.col(dependent) * (1 - 0.45 * strength) + strength * z * d + noise)
    return out.withColumns({f: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(f))) for f, (lo, hi) in limits.items()})


def concept_weights(df: DataFrame, mapping: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Row weights raised for every priority column within 1.5 deviations, scaled to mean one."""
    s = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in mapping for n, f in (("avg", F.avg), ("std", F.stddev_pop))]).first()
    near = {c: F.abs(F.col(c) - s[f"avg_{c}"]) / (s[f"std_{c}"] + 1e-6) <= 1.5 for c in mapping}
    raw = 1.0 + add([F.when(near[c], 0.25 * m + 0.20 * z).otherwise(0.0) for c, (m, z) in mapping.items()])
    tagged = df.withColumn("__raw", raw)
    return tagged.withColumn("weight", F.col("__raw") / F.greatest(tagged.agg(F.avg("__raw")).scalar(), F.lit(1e-6))).drop("__raw")


def noisy_copies(df: DataFrame, key: Sequence[str], columns: Sequence[str], copies: int, seed: int = 42, noise: float = 0.03, boost: float = 1.15) -> DataFrame:
    """The rows and ``copies - 1`` noisy repeats with a higher weight."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    moved = {c: F.when(F.col("copy") > 0, F.col(c) + noise * gaussian(f"{seed}:{c}", *key, "copy")).otherwise(F.col(c)) for c in columns}
    return each.withColumns(moved).withColumn("weight", F.when(F.col("copy") > 0, F.col("weight") * boost).otherwise(F.col("weight")))
