"""Growing trees: the driver keeps the tree, each step over rows is one Spark job for all nodes in flight.

Thresholds come from exact quantiles found once.  Rows are then read as bin numbers, and a level costs one grouped
count per (node, feature, bin, class), whose size depends on the tree and the bins, not on the rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement, product
from statistics import NormalDist

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.lineage import cut
from rulelens.functions.ordering import quantile_grid, value_counts
from rulelens.functions.pvalues import chi2_tail
from rulelens.functions.shapes import add, bin_column, long_form, side_by_side
from rulelens.operators.trees import RuleTree, class_columns, evaluate_tests, gains, mask_counts, test_text

Teacher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Growth:
    """Settings of the best-first surrogate."""

    max_nodes: int = 15
    max_depth: int | None = None
    min_leaf: int = 5
    min_sample: int = 0
    max_queries: int = 0
    min_gain: float = 1e-4
    purity_epsilon: float = 0.05
    max_n: int = 3
    beam: int = 4
    top_features: int = 8
    pool: int = 24
    bins: int = 32
    alpha: float = 0.05
    batch: int = 8


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Cut points per feature: midpoints when there are few distinct values, exact quantiles otherwise."""
    rows = long_form(df.select(*[F.col(f).cast("double").alias(f) for f in features]), [], features)
    counts = cut(value_counts(rows, "value", ["feature"]))  # read three times below
    few = [r["feature"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= bins).collect()]
    edges: dict[str, list[float]] = {}
    if few:
        values: dict[str, list[float]] = {}
        for r in counts.filter(F.col("feature").isin(few)).select("feature", "value").collect():  # at most bins values each
            values.setdefault(r["feature"], []).append(r["value"])
        edges |= {f: [(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:])] for f, v in values.items()}
    many = [f for f in features if f not in few]
    if many:
        grid = quantile_grid(counts.filter(F.col("feature").isin(many)), "value", [i / bins for i in range(1, bins)], ["feature"], written=True)
        for r in grid.collect():
            edges.setdefault(r["feature"], []).append(r["quantile"])
    return {f: sorted(set(edges.get(f, []))) for f in features}


def with_bins(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Bin numbers as ``__b_<feature>`` columns, -1 for a missing value; found once, read by every level."""
    return df.withColumns({f"__b_{f}": F.coalesce(bin_column(f, e), F.lit(-1)) for f, e in edges.items()})


def binned_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], others: Sequence[str]) -> DataFrame:
    """Rows counted as ``__n`` by their bins and ``others``, with bin numbers and one value of each bin.

    Cuts of a tree are edges, so the smallest value of a bin takes every branch that the bin's other values take. The table is
    bounded by the bins and the distinct ``others``, not by the rows; it is what every search step reads.
    """
    counted = with_bins(df.select(*edges, *others), edges).groupBy(*[f"__b_{f}" for f in edges], *others)
    return counted.agg(F.count(F.lit(1)).alias("__n"), *[F.min(f).alias(f) for f in edges])


def histograms(rows: DataFrame, node: Column, label: str, labels: Sequence[str], edges: Mapping[str, Sequence[float]], weight: Column | None = None) -> dict[int, dict[str, np.ndarray]]:
    """node -> feature -> array[bin, class]; the last bin holds missing values.  One job, bounded result."""
    features = list(edges)
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__b_{f}").alias("b")) for i, f in enumerate(features)])
    w = weight if weight is not None else F.lit(1.0)
    each = rows.select(node.alias("node_id"), F.col(label).alias("y"), w.alias("w"), F.explode(cells).alias("c"))
    found = each.groupBy("node_id", "c.f", "c.b", "y").agg(F.sum("w").alias("n")).collect()
    place = {l: j for j, l in enumerate(labels)}
    out: dict[int, dict[str, np.ndarray]] = {}
    for r in found:
        f = features[r["f"]]
        tables = out.setdefault(r["node_id"], {g: np.zeros((len(edges[g]) + 2, len(labels))) for g in features})
        tables[f][r["b"], place[r["y"]]] += r["n"]
    return out


def bits(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > 0)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


def gain_of(yes: np.ndarray, total: np.ndarray) -> np.ndarray:
    no = total - yes
    n, ny = total.sum(axis=-1), yes.sum(axis=-1)
    return bits(total) - ny / n * bits(yes) - (n - ny) / n * bits(no)


def wilson_low(p: float, n: float, z: float = 1.96) -> float:
    return ((p + z * z / (2 * n)) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def literal_pool(tables: Mapping[str, np.ndarray], edges: Mapping[str, Sequence[float]], cfg: Growth, gain_weight: Mapping[str, float] | None = None) -> list[tuple[float, tuple]]:
    """Ranked (score, literal) candidates of one node from its histograms."""
    spread = {}
    for i, (f, t) in enumerate(tables.items()):
        mass, e = t[:-1].sum(axis=1), list(edges[f])
        if not e or mass.sum() == 0:
            continue
        mids = np.array([e[0]] + [(a + b) / 2 for a, b in zip(e, e[1:])] + [e[-1]])
        mean = (mids * mass).sum() / mass.sum()
        spread[f] = (((mids - mean) ** 2 * mass).sum() / mass.sum(), -i)
    order = list(tables)
    found = []
    for f in sorted(spread, key=lambda g: spread[g], reverse=True)[: cfg.top_features]:
        t = tables[f]
        total = t.sum(axis=0)
        left = t[:-1].cumsum(axis=0)[:-1]
        ok = (left.sum(axis=1) >= cfg.min_leaf) & ((total - left).sum(axis=1) >= cfg.min_leaf)
        scores = gain_of(left, np.broadcast_to(total, left.shape))
        lift = (gain_weight or {}).get(f, 1.0)
        for j in np.flatnonzero(ok):
            for op in (">", "<="):
                found.append((float(scores[j]) * lift, (f, op, float(edges[f][j]))))
    found.sort(key=lambda x: (-round(x[0], 12), order.index(x[1][0]), x[1][2], x[1][1] != ">"))
    return found[: cfg.pool]


def one_per_direction(ranked: Sequence[tuple[float, tuple]]) -> list[tuple[float, tuple]]:
    """The best literal of every feature in both directions; complementary cuts tie, so both must stay available."""
    seen: set[tuple] = set()
    return [x for x in ranked if not ((x[1][0], x[1][1]) in seen or seen.add((x[1][0], x[1][1])))]


def differs(n11: float, n10: float, n01: float, n00: float, alpha: float) -> bool:
    """Do two tests split the rows differently (chi-square on their overlap)?"""
    den = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    if den == 0:
        return n10 + n01 > 0
    n = n11 + n10 + n01 + n00
    return chi2_tail(n * (n11 * n00 - n10 * n01) ** 2 / den, 1) < alpha


def beam_search(patterns: DataFrame, pools: Mapping[int, list[tuple[float, tuple]]], labels: Sequence[str], cfg: Growth) -> dict[int, tuple[float, int, list[tuple]]]:
    """Best m-of-n test per node.  Every round is one small job over the pattern table for all nodes together."""
    spark = patterns.sparkSession
    cols = list(class_columns(labels).values())
    best = {node: (pool[0][0], 1, [0]) for node, pool in pools.items()}
    beams = {node: [best[node]] for node in pools}
    for _ in range(cfg.max_n - 1):
        trial, rows = {}, []
        for node, beam in beams.items():
            pool = [l for _, l in pools[node]]
            seen = set()
            for score, m, members in beam:
                used = {pool[j][0] for j in members}
                for j, lit in enumerate(pool):
                    if lit[0] in used:
                        continue
                    for m2 in (m, m + 1):
                        members2 = [*members, j]
                        key = (m2, frozenset(members2))
                        if key in seen:
                            continue
                        seen.add(key)
                        test_id = len(rows)
                        trial[test_id] = (node, m2, members2)
                        rows.append((int(node), test_id, m2, sum(1 << x for x in members2), m, sum(1 << x for x in members)))
        if not rows:
            break
        tests = spark.createDataFrame(rows, "node_id long, test_id int, m int, bits long, base_m int, base_bits long")
        made: dict[int, list[tuple[float, int, list[int]]]] = {}
        for r in evaluate_tests(patterns, tests, labels).collect():
            yes, total = np.array([r[f"l_{c}"] for c in cols], float), np.array([r[f"t_{c}"] for c in cols], float)
            if yes.sum() < cfg.min_leaf or (total - yes).sum() < cfg.min_leaf or not differs(r["n11"], r["n10"], r["n01"], r["n00"], cfg.alpha):
                continue
            node, m2, members2 = trial[r["test_id"]]
            made.setdefault(node, []).append((float(gain_of(yes, total)), m2, members2))
        beams = {}
        for node, options in made.items():
            options.sort(key=lambda x: (-round(x[0], 12), len(x[2]), x[1], x[2]))
            if options[0][0] > best[node][0] + 1e-12:
                best[node] = options[0]
                beams[node] = options[: cfg.beam]
        if not beams:
            break
    return {node: (score, m, [pools[node][j][1] for j in members]) for node, (score, m, members) in best.items()}


@dataclass
class Grown:
    tree: RuleTree
    log: list[dict]
    queries: int = 0


def grow(df: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], cfg: Growth = Growth(), top_up: Callable | None = None,
         gain_weight: Mapping[str, float] | None = None) -> Grown:
    """Best-first surrogate of ``label`` (the teacher's class).

    Nodes leave the queue by reach x error.  Splits of several waiting nodes are searched in one batch; since a node's
    split does not depend on the others, the result equals one-by-one growth.  ``top_up(tree, node, n)`` may return
    extra labelled rows for a node with fewer than ``min_sample`` rows.
    """
    edges = bin_edges(df, features, cfg.bins)
    df = binned_counts(df, edges, [label]).persist(StorageLevel.MEMORY_AND_DISK)
    root = df.groupBy(label).agg(F.sum("__n").alias("n")).collect()
    counts0 = np.array([next((r["n"] for r in root if r[label] == l), 0) for l in labels], float)
    tree = RuleTree({1: dict(node_id=1, parent_id=None, branch=None, m=0, literals=[], prediction=labels[int(counts0.argmax())])})
    state = {1: dict(counts=counts0, reach=1.0, depth=0)}
    queue, serial, log, ready, queries = [], 0, [], {}, 0

    def priority(i: int) -> float:
        c = state[i]["counts"]
        return state[i]["reach"] * (1 - c.max() / c.sum()) if c.sum() else 0.0

    def search(ids: list[int]) -> None:
        """Histograms, pools, patterns and beams for a batch of nodes."""
        nonlocal queries
        rows = df.withColumn("node_id", tree.node_column()).filter(F.col("node_id").isin(ids))
        for i in ids:
            short = int(cfg.min_sample - state[i]["counts"].sum())
            if short > 0 and top_up is not None and queries < cfg.max_queries:
                wanted = min(short, cfg.max_queries - queries)
                extra = top_up(tree, i, wanted)
                queries += wanted
                rows = rows.unionByName(binned_counts(extra, edges, [label]).withColumn("node_id", F.lit(i).cast("long")))
        tables = histograms(rows, F.col("node_id"), label, labels, edges, F.col("__n"))
        pools = {}
        for i in ids:
            if i not in tables:
                ready[i] = dict(stop="NO_ROWS")
                continue
            total = next(iter(tables[i].values())).sum(axis=0)
            if (total > 0).sum() < 2:
                ready[i] = dict(stop="SINGLE_CLASS")
            elif wilson_low(total.max() / total.sum(), total.sum()) >= 1 - cfg.purity_epsilon:
                ready[i] = dict(stop="PURE")
            elif cfg.min_sample and total.sum() < min(cfg.min_sample, counts0.sum()):
                ready[i] = dict(stop="MIN_SAMPLES")
            else:
                pool = literal_pool(tables[i], edges, cfg, gain_weight)
                if pool:
                    pools[i] = pool
                else:
                    ready[i] = dict(stop="NO_VALID_SPLIT")
        if not pools:
            return
        patterns = mask_counts(rows, "node_id", label, labels, {i: [l for _, l in p] for i, p in pools.items()}, F.col("__n")).persist()
        found = beam_search(patterns, pools, labels, cfg)
        sides = evaluate_tests(patterns, patterns.sparkSession.createDataFrame(
            [(int(i), 0, m, sum(1 << [l for _, l in pools[i]].index(x) for x in lits), 0, 0) for i, (_, m, lits) in found.items()],
            "node_id long, test_id int, m int, bits long, base_m int, base_bits long"), labels).collect()
        patterns.unpersist()
        cols = list(class_columns(labels).values())
        for r in sides:
            score, m, lits = found[r["node_id"]]
            yes, total = np.array([r[f"l_{c}"] for c in cols], float), np.array([r[f"t_{c}"] for c in cols], float)
            gain = float(gain_of(yes, total))
            ready[r["node_id"]] = dict(stop="MIN_GAIN", gain=gain) if gain < cfg.min_gain else dict(stop=None, gain=gain, m=m, literals=lits, yes=yes, no=total - yes)

    heapq.heappush(queue, (-priority(1), serial, 1))
    next_id, made = 2, 1
    while queue and made + 2 <= cfg.max_nodes:
        neg, _, i = heapq.heappop(queue)
        entry = dict(node_id=i, priority=-neg, depth=state[i]["depth"], reach=state[i]["reach"])
        if cfg.max_depth is not None and state[i]["depth"] >= cfg.max_depth:
            log.append(entry | dict(stop="MAX_DEPTH"))
            continue
        if i not in ready:
            room = (cfg.max_nodes - made) // 2  # no more nodes than this can still be split
            waiting = [k for _, _, k in heapq.nsmallest(min(cfg.batch, room) - 1, queue) if k not in ready] if room > 1 else []
            search([i, *waiting])
        got = ready[i]
        log.append(entry | {k: got.get(k) for k in ("stop", "gain")})
        if got["stop"]:
            continue
        tree.nodes[i].update(m=got["m"], literals=got["literals"])
        share = got["yes"].sum() / (got["yes"].sum() + got["no"].sum())
        for branch, c, part in (("no", got["no"], 1 - share), ("yes", got["yes"], share)):
            tree.nodes[next_id] = dict(node_id=next_id, parent_id=i, branch=branch, m=0, literals=[], prediction=labels[int(c.argmax())])
            state[next_id] = dict(counts=c, reach=state[i]["reach"] * part, depth=state[i]["depth"] + 1)
            serial += 1
            heapq.heappush(queue, (-priority(next_id), serial, next_id))
            next_id += 1
        made += 2
    log += [dict(node_id=i, priority=-p, depth=state[i]["depth"], reach=state[i]["reach"], stop="MAX_NODES", gain=None) for p, _, i in queue]
    df.unpersist()
    return Grown(tree, log, queries)


def log_table(spark, log: Sequence[Mapping]) -> DataFrame:
    rows = [(int(e["node_id"]), float(e["priority"]), int(e["depth"]), float(e["reach"]), e.get("stop"), None if e.get("gain") is None else float(e["gain"])) for e in log]
    return spark.createDataFrame(rows, "node_id long, priority double, depth int, reach double, stop string, gain double")


def stop_summary(log: DataFrame) -> DataFrame:
    """Leaves per stop reason, with the diagnosis of a tree that never split."""
    per = log.filter("stop IS NOT NULL").groupBy("stop").agg(F.count(F.lit(1)).alias("leaves"), F.round(F.sum("reach"), 6).alias("reach"))
    split = log.filter("stop IS NULL").agg(F.count(F.lit(1))).scalar()
    return per.withColumn("diagnosis", F.when(split == 0, "stump").when(split <= 2, "very_small").otherwise("grown"))


# ---------------------------------------------------------------- gain-ratio tree with missing values

@dataclass
class GainRatioTree:
    """n-ary tree; node dicts carry kind (numeric/categorical/leaf), feature, thr, priors per branch and class counts."""

    nodes: dict[int, dict]
    labels: list[str]

    def children(self, i: int) -> dict[str, int]:
        return {n["branch"]: k for k, n in self.nodes.items() if n["parent_id"] == i}

    def leaves(self) -> list[int]:
        parents = {n["parent_id"] for n in self.nodes.values()}
        return [i for i in self.nodes if i not in parents]

    def weight(self, i: int, above: Callable[[int], Column] | None = None) -> Column:
        """Share of a row that reaches a node: 1/0 on known values, branch priors on missing ones; ``above`` gives the parent's."""
        n = self.nodes[i]
        if n["parent_id"] is None:
            return F.lit(1.0)
        up = self.nodes[n["parent_id"]]
        v = F.col(up["feature"])
        if up["kind"] == "numeric":
            here = v <= up["thr"] if n["branch"] == "left" else v > up["thr"]
        else:
            here = v.cast("string") == n["branch"]
        step = F.when(v.isNull(), F.lit(float(up["priors"][n["branch"]]))).when(here, 1.0).otherwise(0.0)
        return (above or self.weight)(n["parent_id"]) * step

    def spread(self, df: DataFrame, ids: Sequence[int]) -> DataFrame:
        """One row per (row, reached node) with its weight."""
        cells = F.array(*[F.struct(F.lit(i).cast("long").alias("node_id"), self.weight(i).alias("w")) for i in ids])
        return df.select("*", F.explode(F.filter(cells, lambda c: c["w"] > 1e-12)).alias("__c")).select(*df.columns, "__c.node_id", "__c.w")

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Class shares mixed over the reached leaves, and the best class (first in class order on ties)."""
        cols, out = {}, df
        for depth in sorted({n["depth"] for n in self.nodes.values()}):  # a level's weights come from those of the level above
            out = out.withColumns({f"__w_{i}": self.weight(i, lambda up: F.col(f"__w_{up}")) for i, n in self.nodes.items() if n["depth"] == depth})
        for j, l in enumerate(self.labels):
            parts = []
            for i in self.leaves():
                c = self.nodes[i]["counts"]
                parts.append(F.col(f"__w_{i}") * F.lit(float(c[j] / c.sum()) if c.sum() else 1.0 / len(self.labels)))
            cols[f"share_{l}"] = add(parts)
        out = out.withColumns(cols).drop(*[f"__w_{i}" for i in self.nodes])
        top = F.greatest(*cols)
        pick = None
        for l in self.labels:
            pick = F.when(F.col(f"share_{l}") == top, l) if pick is None else pick.when(F.col(f"share_{l}") == top, l)
        return out.withColumn("prediction", pick)

    def table(self, spark) -> DataFrame:
        rows = [(i, n["parent_id"], n["branch"], n["kind"], n.get("feature"), n.get("thr"), self.labels[int(n["counts"].argmax())], float(n["counts"].sum()), n.get("gain", 0.0), n["depth"], n.get("stop"))
                for i, n in self.nodes.items()]
        return spark.createDataFrame(rows, "node_id long, parent_id long, branch string, kind string, feature string, thr double, prediction string, n double, gain double, depth int, stop string")


def numeric_split(table: np.ndarray, edges: Sequence[float], min_leaf: float) -> dict | None:
    """Best penalised cut of one node and feature from its histogram; the last row holds missing values."""
    known, missing = table[:-1], table[-1].sum()
    total = known.sum(axis=0)
    w, all_w = total.sum(), total.sum() + missing
    if w <= 0:
        return None
    block = known[:len(edges) + 1]
    left = block.cumsum(axis=0)[:-1]
    pure_same = np.array([len({int(c) for r in (a, b) for c in np.flatnonzero(r > 0)}) == 1 for a, b in zip(block, block[1:])], bool)
    usable = ~pure_same if len(pure_same) else np.zeros(0, bool)
    nl = left.sum(axis=1)
    raw = w / all_w * gain_of(left, np.broadcast_to(total, left.shape)) if len(left) else np.zeros(0)
    cuts = int(usable.sum())
    gain = np.maximum(0.0, raw - (math.log2(cuts) / all_w if cuts > 1 else 0.0))
    info = bits(np.stack([nl, w - nl, np.full_like(nl, missing)], axis=1)) if len(left) else np.zeros(0)
    ok = usable & (nl >= min_leaf) & (w - nl >= min_leaf) & (info > 1e-12)
    if not ok.any():
        return None
    ratio_ = np.where(ok, gain / np.where(info > 1e-12, info, 1.0), -1.0)
    j = max(np.flatnonzero(ok), key=lambda k: (round(ratio_[k], 12), round(gain[k], 12), -k))
    return dict(kind="numeric", gain=float(gain[j]), ratio=float(ratio_[j]), thr=float(edges[j]), priors={"left": float(nl[j] / w), "right": float(1 - nl[j] / w)})


def value_sizes(rows: DataFrame, categorical: Sequence[str], label: str) -> DataFrame:
    """(node_id, feature, value, label, n): weighted rows of every value in every node, NULL for the missing ones."""
    long = long_form(rows.select("node_id", "w", label, *[F.col(c).cast("string").alias(c) for c in categorical]), ["node_id", "w", label], categorical)
    return long.groupBy("node_id", "feature", "value", label).agg(F.sum("w").alias("n"))


def categorical_splits(sizes: DataFrame, label: str, min_leaf: float) -> dict[tuple[int, str], dict]:
    """Gain and ratio of branching on every value, for each node and column that may be branched on.

    Entropies come from sums of n log n, so one row a node and column is collected, however many values the column has.
    """
    xlogx = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    known, n = F.col("value").isNotNull(), F.col("n")
    each = sizes.groupBy("node_id", "feature", "value").agg(F.sum("n").alias("s"), F.sum(xlogx(n)).alias("t"))
    size, term = F.when(known, F.col("s")), F.when(known, xlogx(F.col("s")))
    per = each.groupBy("node_id", "feature").agg(F.count(size).alias("k"), F.min(size).alias("least"), F.sum(size).alias("w"), F.sum(term).alias("sizes"), F.sum(term - F.col("t")).alias("inside"),
                                                 F.coalesce(F.sum(F.when(~known, F.col("s"))), F.lit(0.0)).alias("missing"))
    classes = sizes.filter(known).groupBy("node_id", "feature", label).agg(F.sum("n").alias("n")).groupBy("node_id", "feature").agg(F.sum(xlogx(n)).alias("classes"))
    w, missing = F.col("w"), F.col("missing")
    gain = w / (w + missing) * (F.log2(w) - (F.col("classes") + F.col("inside")) / w)
    info = F.log2(w + missing) - (F.col("sizes") + xlogx(missing)) / (w + missing)
    found = per.filter((F.col("k") >= 2) & (F.col("least") >= min_leaf)).join(classes, ["node_id", "feature"]).select("node_id", "feature", gain.alias("gain"), F.when(info > 1e-12, gain / info).otherwise(0.0).alias("ratio"))
    return {(r["node_id"], r["feature"]): dict(kind="categorical", gain=r["gain"], ratio=r["ratio"], thr=None) for r in found.collect()}


def branch_shares(sizes: DataFrame, chosen: Mapping[int, str]) -> dict[int, dict[str, float]]:
    """The values of each node's chosen column with their shares: the branches that the tree is about to get."""
    wanted = sizes.sparkSession.createDataFrame(list(chosen.items()), "node_id long, feature string")
    each = sizes.filter("value IS NOT NULL").join(wanted, ["node_id", "feature"]).groupBy("node_id", "value").agg(F.sum("n").alias("s"))
    out: dict[int, dict[str, float]] = {}
    for r in each.collect():
        out.setdefault(r["node_id"], {})[r["value"]] = r["s"]
    return {i: {v: float(s[v] / sum(s.values())) for v in sorted(s)} for i, s in out.items()}


def grow_gain_ratio(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, labels: Sequence[str], max_depth: int = 4, min_leaf: float = 2.0,
                    min_split: float = 4.0, bins: int = 64, max_nodes_in_flight: int = 32) -> GainRatioTree:
    """Level-wise supervised growth: all nodes of a level share one numeric and one categorical count job."""
    labels = list(labels)
    edges = bin_edges(df, numeric, bins) if numeric else {}
    df = binned_counts(df, edges, [*categorical, label]).persist(StorageLevel.MEMORY_AND_DISK)  # read once per level
    place = {l: j for j, l in enumerate(labels)}
    zero = np.zeros(len(labels))
    tree = GainRatioTree({1: dict(parent_id=None, branch=None, kind="leaf", depth=0, counts=zero, used=frozenset())}, labels)
    level, next_id = [1], 2
    while level:
        following = []
        for start in range(0, len(level), max_nodes_in_flight):
            ids = level[start:start + max_nodes_in_flight]
            rows = tree.spread(df, ids).withColumn("w", F.col("w") * F.col("__n"))
            tables = histograms(rows, F.col("node_id"), label, labels, edges, F.col("w")) if edges else {}
            sizes = cut(value_sizes(rows, categorical, label)) if categorical else None  # counted values, read up to three times
            cats = categorical_splits(sizes, label, min_leaf) if categorical else {}
            counts = {i: zero.copy() for i in ids}
            for r in rows.filter(F.col(label).isin(labels)).groupBy("node_id", label).agg(F.sum("w").alias("n")).collect():  # a row for each node and class
                counts[r["node_id"]][place[r[label]]] += r["n"]
            chosen: dict[int, dict] = {}
            for i in ids:
                n = tree.nodes[i]
                n["counts"] = counts[i]
                total = n["counts"].sum()
                if (n["counts"] > 1e-12).sum() <= 1:
                    n["stop"] = "PURE"
                elif total < min_split:
                    n["stop"] = "MIN_SAMPLES"
                elif n["depth"] >= max_depth:
                    n["stop"] = "MAX_DEPTH"
                else:
                    options = [dict(s, feature=f) for f in numeric if (s := numeric_split(tables[i][f], edges[f], min_leaf))]
                    options += [dict(s, feature=f) for f in categorical if f not in n["used"] and (s := cats.get((i, f)))]
                    options = [o for o in options if o["gain"] > 1e-12]
                    if not options:
                        n["stop"] = "NO_VALID_SPLIT"
                        continue
                    mean = sum(o["gain"] for o in options) / len(options)
                    best = min((o for o in options if o["gain"] + 1e-12 >= mean), key=lambda o: (-round(o["ratio"], 12), -round(o["gain"], 12), o["feature"]))
                    chosen[i] = best
            shares = branch_shares(sizes, {i: o["feature"] for i, o in chosen.items() if o["kind"] == "categorical"}) if any(o["kind"] == "categorical" for o in chosen.values()) else {}
            for i, best in chosen.items():
                n, priors = tree.nodes[i], shares[i] if best["kind"] == "categorical" else best["priors"]
                n.update(kind=best["kind"], feature=best["feature"], thr=best["thr"], priors=priors, gain=best["gain"])
                used = n["used"] | ({best["feature"]} if best["kind"] == "categorical" else set())
                for b in priors:
                    tree.nodes[next_id] = dict(parent_id=i, branch=b, kind="leaf", depth=n["depth"] + 1, counts=zero, used=used)
                    following.append(next_id)
                    next_id += 1
        level = following
    df.unpersist()
    return tree


def extra_errors(n: float, e: float, confidence: float = 0.25) -> float:
    """Pessimistic allowance on top of ``e`` observed errors among ``n`` rows."""
    if n <= 0:
        return 0.0
    if e < 1:
        none = n * (1 - confidence ** (1 / n))
        return none if e <= 1e-12 else none + e * (extra_errors(n, 1.0, confidence) - none)
    if e + 0.5 >= n:
        return max(n - e, 0.0)
    z = NormalDist().inv_cdf(1 - confidence)
    f = (e + 0.5) / n
    upper = (f + z * z / (2 * n) + z * math.sqrt(max(f / n - f * f / n + z * z / (4 * n * n), 0.0))) / (1 + z * z / n)
    return upper * n - e


def prune_pessimistic(tree: GainRatioTree, confidence: float = 0.25) -> tuple[GainRatioTree, list[dict]]:
    """Replace a subtree by a leaf when the leaf's estimated error is at most the subtree's plus 0.1."""
    nodes = {i: dict(n) for i, n in tree.nodes.items()}
    out, audit = GainRatioTree(nodes, tree.labels), []

    def drop(i: int) -> None:
        for k in out.children(i).values():
            drop(k)
            del nodes[k]

    def visit(i: int) -> float:
        c = nodes[i]["counts"]
        wrong = c.sum() - c.max()
        as_leaf = wrong + extra_errors(c.sum(), wrong, confidence)
        kids = out.children(i)
        if not kids:
            return as_leaf
        below = sum(visit(k) for k in kids.values())
        if as_leaf <= below + 0.1:
            audit.append(dict(node_id=i, leaf_error=as_leaf, subtree_error=below))
            drop(i)
            nodes[i].update(kind="leaf", feature=None, thr=None, priors={}, gain=0.0, stop="PRUNED")
            return as_leaf
        return below

    visit(next(i for i, n in nodes.items() if n["parent_id"] is None))
    return out, audit


# ---------------------------------------------------------------- guided candidates and capacity choice

def guided_tests(pools: Mapping[int, list[tuple[float, tuple]]], relatedness: DataFrame, groups: DataFrame, threshold: float = 0.5, max_n: int = 3, per_feature: int = 8) -> dict[int, list[tuple[int, list[int]]]]:
    """m-of-n candidates from components of related features (same group or relatedness above the threshold).

    The feature tables are columns x columns; components come from repeated minimum-label joins on them.
    """
    names = sorted({l[0] for pool in pools.values() for _, l in pool})
    spark = relatedness.sparkSession
    near = relatedness.filter(F.col("r") >= threshold).select("left_feature", "right_feature")
    same = groups.join(groups.select("grp", F.col("feature").alias("right_feature")), "grp").select(F.col("feature").alias("left_feature"), "right_feature")
    edges = near.unionByName(same).filter(F.col("left_feature").isin(names) & F.col("right_feature").isin(names))
    label = {f: f for f in names}
    links = [(r["left_feature"], r["right_feature"]) for r in edges.collect()]  # columns x columns at most
    for _ in names:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    out: dict[int, list[tuple[int, list[int]]]] = {}
    for node, pool in pools.items():
        options: dict[str, dict[str, int]] = {}
        for j, (_, lit) in enumerate(pool):
            options.setdefault(lit[0], {}).setdefault(lit[1], j)
        tests = []
        for root in sorted(set(label.values())):
            members = [f for f in options if label[f] == root][:per_feature]
            for k in range(2, min(max_n, len(members)) + 1):
                for combo in combinations(members, k):
                    for chosen in product(*[options[f].values() for f in combo]):
                        tests += [(m, list(chosen)) for m in sorted({1, math.ceil(k / 2), k})]
        out[node] = tests
    return out


def guided_candidates(patterns: DataFrame, pools: Mapping[int, list[tuple[float, tuple]]], tests: Mapping[int, list[tuple[int, list[int]]]], labels: Sequence[str], budget: int = 20, min_leaf: int = 5) -> DataFrame:
    """Scored guided tests, at most ``budget`` per node, evaluated on the pattern table in one job."""
    spark = patterns.sparkSession
    rows, texts = [], []
    for node, items in tests.items():
        for m, members in items:
            rows.append((int(node), len(rows), m, sum(1 << j for j in members), m, 0))
            texts.append((len(rows) - 1, test_text(m, [pools[node][j][1] for j in members])))
    found = evaluate_tests(patterns, spark.createDataFrame(rows, "node_id long, test_id int, m int, bits long, base_m int, base_bits long"), labels)
    scored = gains(found, labels, min_leaf).join(F.broadcast(spark.createDataFrame(texts, "test_id int, test string")), "test_id")
    order = Window.partitionBy("node_id").orderBy(F.desc(F.round("gain", 12)), F.bit_count("bits"), "m", "test")  # declared tests of one node
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).select("node_id", "place", "test", "gain", "n_left", "n_right")


def lexicographic_choice(results: DataFrame, by: Sequence[str], t_critical: float, ratio_: float, std_tolerance: float = 0.01, structure_tolerance: float = 0.05) -> DataFrame:
    """Staged choice among candidates with paired fold results (config, fold, fidelity, nodes, max_nodes).

    Best mean fidelity; then those not significantly worse; then steadier; then structurally steadier; then fewer nodes.
    """
    by = list(by)
    stats = results.groupBy(*by, "config").agg(F.avg("fidelity").alias("mean"), F.coalesce(F.stddev_samp("fidelity"), F.lit(0.0)).alias("sd"), F.avg("nodes").alias("nodes"),
                                               (F.coalesce(F.stddev_samp("nodes"), F.lit(0.0)) / F.avg("nodes")).alias("structure_cv"), F.max("max_nodes").alias("max_nodes"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per candidate
    best = stats.withColumn("best", F.first("config").over(w.orderBy(F.desc(F.round("mean", 12)), "config")))
    top = results.join(best.select(*by, "best").distinct(), by) if by else results.withColumn("best", best.select("best").distinct().scalar())
    top = top.filter(F.col("config") == F.col("best")).select(*by, "fold", F.col("fidelity").alias("top"))
    d = F.col("top") - F.col("fidelity")
    gap = results.join(top, [*by, "fold"]).groupBy(*by, "config").agg(F.avg(d).alias("delta"), F.var_samp(d).alias("v"), F.count(F.lit(1)).alias("j"))
    denom = F.sqrt((1 / F.col("j") + ratio_) * F.coalesce("v", F.lit(0.0)))
    t = F.when(denom > 1e-12, F.col("delta") / denom).when(F.col("delta") <= 1e-12, 0.0).otherwise(float("inf"))
    staged = best.join(gap.withColumn("t", t), [*by, "config"]).withColumn("s1", F.col("t") <= t_critical)
    staged = staged.withColumn("s2", F.col("s1") & (F.col("sd") <= F.min(F.when(F.col("s1"), F.col("sd"))).over(w) + std_tolerance))
    staged = staged.withColumn("s3", F.col("s2") & (F.col("structure_cv") <= F.min(F.when(F.col("s2"), F.col("structure_cv"))).over(w) + structure_tolerance))
    staged = staged.withColumn("s4", F.col("s3") & (F.col("nodes") <= F.min(F.when(F.col("s3"), F.col("nodes"))).over(w) + 1e-9))
    order = w.orderBy(F.desc(F.col("s4").cast("int")), "max_nodes", "config")
    staged = staged.withColumn("winner", (F.row_number().over(order) == 1) & F.col("s4"))
    verdict = (F.when(F.col("winner"), "WINNER").when(~F.col("s1"), "LOST_FIDELITY").when(~F.col("s2"), "LOST_STABILITY").when(~F.col("s3"), "LOST_STRUCTURE")
               .when(~F.col("s4"), "LOST_COMPLEXITY").otherwise("LOST_TIE"))
    return staged.select(*by, "config", "mean", "sd", "nodes", "delta", verdict.alias("verdict"))


def _resamples(repeats: int, exact_limit: int, draws: int, seed: int) -> tuple[list[tuple[int, ...]], list[int], bool]:
    """Multisets of CV repeats, how many ordered resamples each stands for, and whether they are all there are."""
    if math.comb(2 * repeats - 1, repeats) <= exact_limit:
        samples = list(combinations_with_replacement(range(repeats), repeats))
        return samples, [math.factorial(repeats) // math.prod(math.factorial(c.count(r)) for r in set(c)) for c in samples], True
    rng = np.random.default_rng(seed)
    drawn = Counter(tuple(sorted(rng.integers(0, repeats, repeats).tolist())) for _ in range(draws))
    return list(drawn), list(drawn.values()), False


def _choices(results: DataFrame, samples: Sequence[tuple[int, ...]], weights: Sequence[int], t_critical: float, ratio_: float) -> DataFrame:
    """(sample, weight, config): what the staged choice takes on each resample; all of them in one job keyed by the sample."""
    rows = [(s, r, copy, float(w)) for s, (chosen, w) in enumerate(zip(samples, weights)) for copy, r in enumerate(chosen)]
    plan = F.broadcast(results.sparkSession.createDataFrame(rows, "sample int, repeat int, copy int, weight double"))
    blown = results.join(plan, "repeat").withColumn("fold", F.concat_ws("-", "copy", "fold"))
    won = lexicographic_choice(blown, ["sample"], t_critical, ratio_).filter("verdict = 'WINNER'").select("sample", "config")
    return won.join(plan.select("sample", "weight").distinct(), "sample")


def choice_robustness(results: DataFrame, repeats: int, t_critical: float, ratio_: float, exact_limit: int = 20_000, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Win share of each candidate over every multiset of CV repeats, weighted as ordered resamples.

    Each distinct multiset is evaluated once, all of them in one job keyed by the multiset.  Beyond ``exact_limit``
    multisets, ``draws`` resamples stand in for the enumeration.
    """
    samples, weights, _ = _resamples(repeats, exact_limit, draws, seed)
    per = _choices(results, samples, weights, t_critical, ratio_).groupBy("config").agg(F.sum("weight").alias("w"))
    return per.withColumn("win_share", F.col("w") / per.agg(F.sum("w")).scalar()).drop("w")


def choice_report(results: DataFrame, repeats: int, t_critical: float, ratio_: float, exact_limit: int = 20_000, draws: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row on how far the choice of a setting hangs on the CV repeats.

    ``selected``: the choice on all repeats, and its share of the resamples; ``modal`` and ``runner_up``: the settings chosen most
    and second most often (ties: smaller name), with their shares and the margin between them; ``fragile``: the choice on all
    repeats is not the modal one; ``fidelity_low`` and ``fidelity_high``: interval of the chosen setting's mean fidelity over the
    resamples (smallest value that the share of resamples reaches); ``share_low`` and ``share_high``: Wilson interval of the
    selected one's share where resamples were drawn (NULL where all were enumerated). Nothing is grown again. Fewer than two
    repeats, or no choice at all: not assessable, NULL elsewhere.
    """
    samples, weights, exact = _resamples(repeats, exact_limit, draws, seed)
    chosen = cut(_choices(results, samples, weights, t_critical, ratio_))  # a row for each resample
    selected = lexicographic_choice(results, [], t_critical, ratio_).filter("verdict = 'WINNER'").select(F.col("config").alias("selected"))
    shares = chosen.groupBy("config").agg(F.sum("weight").alias("w"))
    places = Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), "config")  # a row for each setting
    ranked = shares.withColumn("rank", F.row_number().over(places)).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))
    best = ranked.agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{name}{tail}") for r, name in ((1, "modal"), (2, "runner_up")) for c, tail in (("config", ""), ("share", "_share"))], F.sum("w").alias("total"))

    folds = results.groupBy("repeat", "config").agg(F.avg("fidelity").alias("f"))
    counted = [(s, r, chosen_.count(r)) for s, chosen_ in enumerate(samples) for r in set(chosen_)]
    plan = F.broadcast(results.sparkSession.createDataFrame(counted, "sample int, repeat int, times int"))
    means = folds.join(plan, "repeat").join(selected.withColumnRenamed("selected", "config"), "config").groupBy("sample").agg((F.sum(F.col("f") * F.col("times")) / repeats).alias("f"))
    upto = Window.partitionBy(F.lit(0)).orderBy("f", "sample").rowsBetween(Window.unboundedPreceding, 0)  # a row for each resample
    cum = means.join(chosen.select("sample", "weight"), "sample").withColumn("upto", F.sum("weight").over(upto) / F.sum("weight").over(Window.partitionBy(F.lit(0))))
    half = (1 - level) / 2
    fidelity = cum.agg(*[F.min(F.when(F.col("upto") >= q - 1e-12, F.col("f"))).alias(name) for q, name in ((half, "fidelity_low"), (1 - half, "fidelity_high"))])

    out = side_by_side([best, fidelity, selected])
    mine = ranked.select(F.col("config").alias("selected"), F.col("share").alias("selected_share"))
    out = out.join(mine, "selected", "left").withColumn("selected_share", F.coalesce("selected_share", F.lit(0.0)))
    p, n, z = F.col("selected_share"), F.col("total"), NormalDist().inv_cdf(1 - half)
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ends = {"share_low": F.lit(None).cast("double"), "share_high": F.lit(None).cast("double")} if exact else {"share_low": centre - spread, "share_high": centre + spread}
    out = out.withColumns({
        "margin": F.col("modal_share") - F.coalesce("runner_up_share", F.lit(0.0)), "gap": F.col("modal_share") - p, "fragile": F.col("modal") != F.col("selected"),
        "assessable": F.col("modal").isNotNull() & F.lit(repeats >= 2), "method": F.lit("exact" if exact else "drawn"), "resamples": F.lit(sum(weights)).cast("long"), "evaluations": F.lit(len(samples)).cast("long"), **ends})
    facts = ["selected", "selected_share", "modal", "modal_share", "runner_up", "runner_up_share", "margin", "gap", "fragile", "fidelity_low", "fidelity_high", "share_low", "share_high"]
    return out.select("assessable", "method", "resamples", "evaluations", *[F.when(F.col("assessable"), F.col(c)).alias(c) for c in facts])


def capacity_steps(results: DataFrame, t_critical: float, ratio_: float, saturation: float = 0.5) -> DataFrame:
    """Paired gain between consecutive node budgets; expand only when saturated and the gain is supported."""
    w = Window.partitionBy("fold").orderBy("max_nodes")  # one row per node budget
    d = results.withColumns({"before": F.lag("fidelity").over(w), "previous": F.lag("max_nodes").over(w)}).filter("before IS NOT NULL").withColumn("d", F.col("fidelity") - F.col("before"))
    per = d.groupBy("previous", "max_nodes").agg(F.avg("d").alias("delta"), F.var_samp("d").alias("v"), F.count("d").alias("j"), F.avg((F.col("nodes") >= F.col("max_nodes") - 1).cast("double")).alias("at_cap"))
    se = F.sqrt((1 / F.col("j") + ratio_) * F.col("v"))
    t = F.when(se > 1e-12, F.col("delta") / se).when(F.col("delta") <= 1e-12, 0.0).otherwise(float("inf"))
    out = per.withColumn("t", t).withColumn("supported", (F.col("t") > t_critical) & (F.col("delta") > 0))
    return out.withColumn("decision", F.when(F.col("at_cap") < saturation, "not_saturated").when(F.col("supported"), "expand").otherwise("plateau")).drop("v")
