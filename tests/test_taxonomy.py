"""Depths of hierarchies: contracted paths and solved layers against one walk in plain Python."""

import functools

import numpy as np
import pytest

from rulelens.operators import ontology as ON


def walked(edges):
    parents = {}
    for a, b in set(edges):
        parents.setdefault(a, set()).add(b)
        parents.setdefault(b, set())

    @functools.cache
    def depth(n):
        found = [depth(p) for p in parents[n]]
        return (1 + max(x for x, _ in found), 1 + min(y for _, y in found)) if found else (0, 0)

    for n in sorted(parents):
        depth(n)
    return {n: depth(n) for n in parents}


def depths(spark, edges):
    return {r["node"]: (r["longest"], r["shortest"]) for r in ON.taxonomy_depth(spark.createDataFrame(edges, "src string, dst string")).collect()}


def test_depths_of_random_hierarchies(spark):
    rng = np.random.default_rng(1)
    edges = [(f"n{i:03d}", f"n{int(rng.integers(max(0, i - 9), i)):03d}") for i in range(1, 60) for _ in range(int(rng.choice([1, 1, 1, 2, 3])))]
    edges += [("x", "y"), ("x", "y")]  # a second root, and a repeated edge
    assert depths(spark, edges) == walked(edges)


def test_a_long_chain_writes_few_rows(spark, monkeypatch):
    n, written, cut = 5000, [], ON.cut
    monkeypatch.setattr(ON, "cut", lambda df: written.append(out := cut(df)) or out)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(n - 1)]
    assert depths(spark, edges) == {f"c{i}": (n - 1 - i,) * 2 for i in range(n)}
    assert sum(df.count() for df in written) < 12 * n  # the pairs of ancestors are n * n / 2


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("a", "r"), ("b", "a"), ("b", "r")], [("a", "a")], [("r", "s"), ("a", "b"), ("b", "a")]])
def test_a_cycle_is_an_error(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        depths(spark, edges)


def test_no_edges(spark):
    assert depths(spark, []) == {}
