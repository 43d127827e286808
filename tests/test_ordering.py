"""Ordered helpers: the ranged path must equal plain windows and brute force, whatever the partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.functions import ordering as O


@pytest.fixture(params=["plain", "ranged"])
def path(request, monkeypatch):
    if request.param == "ranged":
        monkeypatch.setattr(O, "SMALL_ROWS", 0)
    return request.param


def rows(spark, n=400, parts=3):
    rng = np.random.default_rng(3)
    data = [("hot" if rng.random() < 0.7 else "cold", float(round(rng.normal(), 1)), int(rng.integers(1, 5))) for _ in range(n)]
    return data, spark.createDataFrame(data, "g string, v double, w long").repartition(parts)


def test_running_sums(spark, path):
    data, df = rows(spark)
    counts = df.groupBy("g", "v").agg(F.sum("w").alias("n"))
    got = {(r["g"], r["v"]): (r["cum"], r["total"], r["next_v"]) for r in O.running_sums(counts, "v", {"cum": "n"}, ["g"], following=["v"], totals={"total": "n"}).collect()}
    for g in ("hot", "cold"):
        values = sorted({v for k, v, _ in data if k == g})
        mass = [sum(w for k, x, w in data if k == g and x == v) for v in values]
        for i, v in enumerate(values):
            assert got[(g, v)] == (sum(mass[: i + 1]), sum(mass), values[i + 1] if i + 1 < len(values) else None)


def test_running_sums_descending_without_groups(spark, path):
    data, df = rows(spark)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: r["cum"] for r in O.running_sums(counts, "v", {"cum": "n"}, descending=True).collect()}
    for v, c in got.items():
        assert c == sum(x >= v for _, x, _ in data)


def test_exact_quantiles(spark, path):
    data, df = rows(spark)
    got = {r["g"]: r for r in O.exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.93}, ["g"]).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v, _ in data if k == g]
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.93)):
            assert got[g][name] == pytest.approx(np.quantile(values, p))
    whole = O.exact_quantiles(df, "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.quantile([v for _, v, _ in data], 0.5))


def test_quantile_grid(spark, path):
    data, df = rows(spark)
    probs = [0.02 + 0.96 * i / 62 for i in range(63)]
    got = {(r["g"], round(r["prob"], 9)): r["quantile"] for r in O.quantile_grid(O.value_counts(df, "v", ["g"]), "v", probs, ["g"]).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v, _ in data if k == g]
        for p in probs:
            assert got[(g, round(p, 9))] == pytest.approx(np.quantile(values, p))
    with pytest.raises(ValueError):
        O.quantile_grid(O.value_counts(df, "v", ["g"]), "v", [0.1, 0.2, 0.9], ["g"])


def test_average_ranks(spark, path):
    data, df = rows(spark)
    got = {r["v"]: r["avg_rank"] for r in O.average_ranks(O.value_counts(df, "v"), "v").collect()}
    values = sorted(v for _, v, _ in data)
    for v in set(values):
        places = [i + 1 for i, x in enumerate(values) if x == v]
        assert got[v] == sum(places) / len(places)


def test_hash_rank_is_a_permutation_independent_of_partitioning(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    one = {(r["id"], r["hash_rank"]) for r in O.with_hash_rank(df, 5, ["id"], ["g"]).collect()}
    two = {(r["id"], r["hash_rank"]) for r in O.with_hash_rank(df.repartition(7, "g"), 5, ["id"], ["g"]).collect()}
    assert one == two
    a = sorted(k for i, k in one if i % 3 == 0)
    assert a == list(range(1, len(a) + 1))


def test_top_k_equals_a_full_sort(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = [(r["id"], r["rank"]) for r in O.top_k(df, 12, [F.desc("x"), F.col("id")], salt=["id"]).orderBy("rank").collect()]
    want = [r["id"] for r in df.orderBy(F.desc("x"), "id").limit(12).collect()]
    assert [i for i, _ in got] == want and [r for _, r in got] == list(range(1, 13))


def test_quantiles_by_brackets_of_awkward_groups(spark):
    """Ties, a hot value, one row, missing values and a null group; brackets enclose every wanted rank."""
    rng = np.random.default_rng(11)
    groups = {"even": list(map(float, range(1001))), "hot": [5.0] * 900 + rng.normal(size=450).tolist(), "one": [2.5], None: rng.integers(0, 9, 700).astype(float).tolist(), "wide": rng.lognormal(0, 4, 20_000).tolist()}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = {"p0": 0.0, "p1": 0.013, "p5": 0.5, "p9": 0.975, "top": 1.0}
    got = {r["g"]: r for r in O.exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (g, name)
    whole = O.exact_quantiles(df, "v", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(np.median([v for vs in groups.values() for v in vs]), rel=1e-12)
