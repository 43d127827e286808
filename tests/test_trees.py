"""Rule trees, split search and growth against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.operators import growth as G
from rulelens.operators import trees as TR
from rulelens.plans.bases import CLASSES, FEATURES, SURROGATE, scored


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c)


def small(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, n).astype(float)
    z = rng.normal(size=n).round(2)
    y = np.where((x > 12) & (z > 0), "a", np.where(x > 5, "b", "c"))
    rows = [(0, float(a), float(b), str(c)) for a, b, c in zip(x, z, y)]
    return rows, spark.createDataFrame(rows, "node long, x double, z double, y string")


def test_scoring_agrees_with_rules_and_paths(spark, tables):
    rows = scored(tables)
    for leaf in SURROGATE.leaves():
        assert rows.filter(SURROGATE.accepts(leaf)).count() == rows.filter(F.col("leaf") == leaf).count()
    got = {r["node_id"]: r for r in TR.rules(SURROGATE.table(spark), spark).collect()}
    assert set(got) == set(SURROGATE.leaves()) and got[3]["prediction"] == "N" and got[4]["length"] == 2


def test_missing_feature_casts_no_vote(spark):
    df = spark.createDataFrame([(None, 2.0), (5.0, None)], "a double, b double")
    got = [r[0] for r in df.select(TR.m_of_n(1, [("a", ">", 1.0), ("b", "<=", 1.0)])).collect()]
    assert got == [False, True]


@pytest.mark.parametrize("limit", [0, 10 ** 9])
def test_gains_match_brute_force(spark, monkeypatch, limit):
    from rulelens.functions import ordering
    monkeypatch.setattr(ordering, "SMALL_ROWS", limit)
    rows, df = small(spark)
    counts = TR.value_class_counts(df, "node", "y", ["x", "z"], ["a", "b", "c"])
    cuts = TR.gains(TR.boundaries(counts, "node", ["a", "b", "c"]), ["a", "b", "c"], 1).collect()
    assert cuts
    for r in cuts:
        k = 1 if r["feature"] == "x" else 2
        left = [q for q in rows if q[k] <= r["thr"]]
        right = [q for q in rows if q[k] > r["thr"]]
        c = lambda part: [sum(q[3] == l for q in part) for l in "abc"]
        want = entropy(c(rows)) - len(left) / len(rows) * entropy(c(left)) - len(right) / len(rows) * entropy(c(right))
        assert r["gain"] == pytest.approx(want) and r["n_left"] == len(left)
    # no better cut exists outside the boundaries
    best = max(r["gain"] for r in cuts if r["feature"] == "x")
    for thr in sorted({q[1] for q in rows})[:-1]:
        left, right = [q for q in rows if q[1] <= thr], [q for q in rows if q[1] > thr]
        c = lambda part: [sum(q[3] == l for q in part) for l in "abc"]
        assert entropy(c(rows)) - len(left) / len(rows) * entropy(c(left)) - len(right) / len(rows) * entropy(c(right)) <= best + 1e-9


def test_mask_search_equals_direct_counts(spark):
    rows, df = small(spark)
    pool = [("x", ">", 12.0), ("z", ">", 0.0), ("x", "<=", 5.0)]
    patterns = TR.mask_counts(df, "node", "y", ["a", "b", "c"], {0: pool})
    tests = spark.createDataFrame([(0, 1, 2, 0b011, 1, 0b001)], "node_id long, test_id int, m int, bits long, base_m int, base_bits long")
    r = TR.evaluate_tests(patterns, tests, ["a", "b", "c"]).first()
    hit = [q for q in rows if q[1] > 12 and q[2] > 0]
    assert r["l_n_a"] == sum(q[3] == "a" for q in hit) == len(hit)
    assert r["n01"] == 0 and r["n11"] == len(hit)


def test_growth_recovers_a_known_rule_and_batches_do_not_matter(spark):
    rows, df = small(spark)
    one = G.grow(df, ["x", "z"], "y", ["a", "b", "c"], G.Growth(max_nodes=9, batch=1, min_leaf=2, bins=32, purity_epsilon=0.0))
    many = G.grow(df.repartition(5), ["x", "z"], "y", ["a", "b", "c"], G.Growth(max_nodes=9, batch=8, min_leaf=2, bins=32, purity_epsilon=0.0))
    shape = lambda t: sorted((n["branch"] or "", n["m"], tuple(map(tuple, n["literals"])), n["prediction"]) for n in t.nodes.values())
    assert shape(one.tree) == shape(many.tree)
    acc = one.tree.score(df, "p", "n").filter("p = y").count() / len(rows)
    assert acc > 0.95


def test_gain_ratio_tree_shares_missing_rows(spark):
    rows, df = small(spark)
    holes = df.withColumn("x", F.when(F.col("z") < 1.5, F.col("x")))
    tree = G.grow_gain_ratio(holes, ["x", "z"], [], "y", ["a", "b", "c"], max_depth=3, bins=32)
    out = tree.probabilities(holes).select((F.col("share_a") + F.col("share_b") + F.col("share_c")).alias("s"), "prediction").collect()
    assert all(r["s"] == pytest.approx(1.0) for r in out)
    total = sum(tree.nodes[i]["counts"].sum() for i in tree.leaves())
    assert total == pytest.approx(len(rows))  # fractional weights keep the mass
    pruned, _ = G.prune_pessimistic(tree)
    assert len(pruned.nodes) <= len(tree.nodes)


def test_branches_on_a_column_of_many_values(spark):
    """300 values decide the class; a column of two values is nearly as good, and one with a single row cannot be branched on."""
    rows = [(f"v{i % 300}", "ab"[i % 2], f"u{i}", "xyz"[(i % 300) % 3]) for i in range(1800)] + [(None, "a", "u0", "x"), (None, None, None, "y")]
    df = spark.createDataFrame(rows, "wide string, two string, single string, y string").repartition(3)
    tree = G.grow_gain_ratio(df, [], ["wide", "two", "single"], "y", ["x", "y", "z"], max_depth=2)
    assert tree.nodes[1]["feature"] == "wide" and len(tree.nodes[1]["priors"]) == 300 and sum(tree.nodes[1]["priors"].values()) == pytest.approx(1.0)
    assert tree.probabilities(df.dropna()).filter("prediction <> y").count() == 0
    assert sum(tree.nodes[i]["counts"].sum() for i in tree.leaves()) == pytest.approx(len(rows))

    found = G.categorical_splits(G.value_sizes(df.withColumns({"node_id": F.lit(1).cast("long"), "w": F.lit(1.0)}), ["wide", "two", "single"], "y"), "y", 2.0)
    assert set(found) == {(1, "wide"), (1, "two")}
    for j, name in ((0, "wide"), (1, "two")):
        table = {}
        for r in rows:
            table.setdefault(r[j], [0, 0, 0])["xyz".index(r[3])] += 1
        missing = sum(table.pop(None, [0]))
        sizes = [sum(v) for v in table.values()]
        w = sum(sizes)
        whole = [sum(v[c] for v in table.values()) for c in range(3)]
        gain = w / (w + missing) * (entropy(whole) - sum(s / w * entropy(v) for s, v in zip(sizes, table.values())))
        assert found[1, name]["gain"] == pytest.approx(gain, abs=1e-12) and found[1, name]["ratio"] == pytest.approx(gain / entropy([*sizes, missing]), abs=1e-12)


def test_route_fractionally(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (None, 1.0)], "x double, w double")
    got = sorted((r["branch"], r["w"]) for r in TR.route_fractionally(df, "x", 2.0, 0.25).collect())
    assert got == [("left", 0.25), ("left", 1.0), ("right", 0.75), ("right", 1.0)]


def test_equal_leaves_collapse_in_both_forms(spark):
    from rulelens.plans.trees import EQUAL
    assert sorted(EQUAL.pruned().nodes) == [1, 2, 3]
    assert sorted(r["node_id"] for r in TR.prune_equal_leaves(EQUAL.table(spark)).collect()) == [1, 2, 3]


def test_choice_report_enumerates_or_draws(spark):
    """Setting a wins the repeats 0 and 1, b is better in repeat 2 by far: every multiset is judged by plain means."""
    fid = {"a": [0.90, 0.91, 0.50], "b": [0.60, 0.62, 0.95]}
    rows = [(r * 2 + k, r, c, f[r] + 0.01 * k, 5 if c == "a" else 9, 9) for c, f in fid.items() for r in range(3) for k in range(2)]
    results = spark.createDataFrame(rows, "fold int, repeat int, config string, fidelity double, nodes int, max_nodes int")
    report = lambda **more: G.choice_report(results, 3, 0.0, 0.5, **more).first()  # t = 0: only the best mean stays
    wins, means = {"a": 0, "b": 0}, []
    for s in itertools.product(range(3), repeat=3):
        score = {c: sum(f[r] + 0.005 for r in s) / 3 for c, f in fid.items()}
        wins[max(sorted(score), key=lambda c: round(score[c], 12))] += 1
        means.append(score["a"])
    full = {c: sum(f) for c, f in fid.items()}
    assert full["a"] > full["b"] and wins["a"] > wins["b"] > 0
    r = report()
    assert (r["method"], r["resamples"], r["evaluations"], r["selected"], r["modal"], r["runner_up"], r["fragile"]) == ("exact", 27, 10, "a", "a", "b", False)
    assert r["selected_share"] == pytest.approx(wins["a"] / 27) and r["margin"] == pytest.approx((wins["a"] - wins["b"]) / 27) and r["gap"] == pytest.approx(0)
    assert r["fidelity_low"] == pytest.approx(sorted(means)[0]) and r["fidelity_high"] == pytest.approx(sorted(means)[26]) and r["share_low"] is None
    d = report(exact_limit=1, draws=400)
    assert d["method"] == "drawn" and d["resamples"] == 400 and d["evaluations"] == 10 and d["share_low"] < wins["a"] / 27 < d["share_high"]
    alone = G.choice_report(results.filter("repeat = 0"), 1, 0.0, 0.5).first()
    assert not alone["assessable"] and alone["modal"] is None


def test_growth_reads_counted_bins_instead_of_rows(spark, monkeypatch):
    """A level costs what the bins cost: the table that is searched does not grow with the rows, the tree is that of all rows."""
    seen, inner = [], G.histograms

    def histograms(rows, *args, **kw):
        seen.append(rows.count())
        return inner(rows, *args, **kw)

    monkeypatch.setattr(G, "histograms", histograms)
    one = spark.range(140).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("z"), F.when(F.col("id") % 4 == 0, "u").otherwise("v").alias("c"))
    rows = one.withColumn("y", F.when((F.col("x") > 3) & (F.coalesce("z", F.lit(0.0)) > 1), "a").otherwise("b"))
    many = rows.crossJoin(spark.range(40).select(F.lit(0).alias("copy"))).drop("copy")
    trees = [G.grow_gain_ratio(df, ["x", "z"], ["c"], "y", ["a", "b"], max_depth=2) for df in (rows, many)]
    assert max(seen) <= 140 * 4  # a row that lacks z reaches several nodes
    assert [(n.get("feature"), n.get("thr")) for n in trees[1].nodes.values()] == [(n.get("feature"), n.get("thr")) for n in trees[0].nodes.values()]
    assert [n["counts"].sum() for n in trees[1].nodes.values()] == pytest.approx([40 * n["counts"].sum() for n in trees[0].nodes.values()])
    assert trees[1].probabilities(many).groupBy("prediction").agg((F.count(F.lit(1)) / 40).cast("long")).collect() == trees[0].probabilities(rows).groupBy("prediction").count().collect()
    seen.clear()
    grown = G.grow(many, ["x", "z"], "y", ["a", "b"], G.Growth(max_nodes=5))
    assert max(seen) <= 140 and grown.log[0]["reach"] == 1.0 and len(grown.tree.nodes) > 1


@pytest.mark.parametrize("edges", [[], [0.5], [1.0, 2.5, 3.0]])
def test_bins_of_nulls_nans_and_edges(spark, edges):
    from rulelens.functions.shapes import bin_column
    values = [None, float("nan"), -0.0, 0.5, 1.0, 2.6, 3.0, 9.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(bin_column("v", edges).alias("b")).collect()
    assert [r["b"] for r in got] == [None if v is None else len(edges) if v != v else sum(e < v for e in edges) for v in values]


def test_split_choice_scans_the_rows_once_for_each_kind_of_column(spark, tables, monkeypatch):
    """Counts are written before they are read again; nothing that is chosen from them goes back to the line items."""
    from rulelens.plans import trees as P
    assert not P.numeric_best(tables).inputFiles()
    cols = ["leaf", "feature", "gain", "gain_ratio"]
    both = P.numeric_best(tables).select(*cols).unionByName(P.categorical_best(tables).select(*cols))
    chosen = TR.choose_split(both, "leaf")
    assert not chosen.inputFiles() and chosen.count() == 3
