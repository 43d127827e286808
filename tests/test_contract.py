"""Typing, splits and preparation: rules, leakage and invariances."""

import pytest
from pyspark.sql import functions as F

from rulelens.operators import contract as C
from rulelens.operators import prep as P
from rulelens.operators import splits as S
from rulelens.plans.bases import cases
from rulelens.plans.splits import HOLDOUT  # noqa: F401  (the module must import on its own)


def test_names_are_filled_and_numbered():
    assert C.unique_names(["a", " ", "a", "a"]) == (["a", "coluna_1", "a__2", "a__3"], ["a", "a"])


def test_target_by_name():
    assert C.target_by_name(["x", "Label"]) == ("Label", False)
    assert C.target_by_name(["x", "z"]) == ("z", False)
    assert C.target_by_name(["x", "z"], "x") == ("x", True)
    with pytest.raises(ValueError):
        C.target_by_name(["x"], "q")


def kinds(spark, values, name="c"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    v = C.column_values(C.null_markers(df, [name]), [name])
    return C.contract_kind(v, C.profile(v)).first()["kind"], C.schema_kind(C.profile(v)).first()["kind"]


@pytest.mark.parametrize("values, contract, schema", [
    (["1"] * 30, "constant", "boolean"), (["0", "1"] * 9, "binary", "boolean"), (["sim", "NÃO"] * 9, "binary", "boolean"), (["sí", "no"] * 9, "binary", "categorical"), ([str(i) for i in range(60)], "id_like", "numeric"), ([str(i * i * 1.5) for i in range(60)], "numeric_continuous", "numeric"),
    (["yes", "no", "?"] * 10, "binary", "boolean"), ([f"2024-01-{d:02d}" for d in range(1, 29)], "datetime", "datetime"), ([str(i % 5) for i in range(60)], "numeric_discrete", "categorical"),
    ([f"word number {i % 7}" for i in range(60)], "categorical", "categorical"), ([f"k{i}x" for i in range(60)], "id_like", "categorical"),
])
def test_kind_rules(spark, values, contract, schema):
    assert kinds(spark, values) == (contract, schema)


def test_row_order_and_partitions_do_not_change_the_contract(spark, tables):
    from rulelens.plans.bases import RAW_COLUMNS, raw_text
    a = C.contract(raw_text(tables), RAW_COLUMNS, "status").orderBy("column_name").collect()
    b = C.contract(raw_text(tables).repartition(6).orderBy(F.desc("id")), RAW_COLUMNS, "status").orderBy("column_name").collect()
    assert a == b


def test_fit_uses_training_rows_only(spark, tables):
    rows = cases(tables)
    train, test = rows.filter("year < 2000"), rows.filter("year >= 2000")
    scales = P.fit_scales(train, ["total"])
    moved = P.fit_scales(train.unionByName(test.limit(0)), ["total"])
    assert scales["total"]["avg"] == pytest.approx(moved["total"]["avg"])
    out = P.standardise(train, scales).agg(F.avg("total"), F.stddev_pop("total")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1)


def test_unseen_levels_give_zeros(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",)], "k string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    encoded, lineage = P.one_hot(test, P.fit_levels(train, ["k"], 2, 10))
    assert [x["encoded"] for x in lineage] == ["k_a", "k_b"]
    assert [tuple(r) for r in encoded.select("k_a", "k_b").collect()] == [(1, 0), (0, 0), (0, 0)]


def test_holdout_is_disjoint_stratified_and_stable(spark, tables):
    rows = cases(tables)
    a = S.holdout(rows, ["id"], "label", [1])
    b = S.holdout(rows.repartition(7), ["id"], "label", [1])
    assert a.exceptAll(b).count() == 0
    assert S.overlap(a.filter("role = 'train'"), a.filter("role = 'test'"), ["id"]).first()["shared"] == 0
    for r in a.groupBy("label").agg(F.avg((F.col("role") == "test").cast("int")).alias("s")).collect():
        assert r["s"] == pytest.approx(0.25, abs=0.01)


def test_folds_cover_every_row_once(spark, tables):
    f = S.repeated_folds(cases(tables), ["id"], "label", 5, 2)
    assert f.groupBy("id", "repeat").count().filter("count <> 1").count() == 0
    per = f.filter("repeat = 0").groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per)


def test_resampling_equalises_classes(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 17, "a").otherwise("b"))
    assert {r["count"] for r in P.oversample(df, ["id"], "y").groupBy("y").count().collect()} == {83}
    assert {r["count"] for r in P.undersample(df, ["id"], "y").groupBy("y").count().collect()} == {17}


def test_alignment_refuses_missing_columns(tables):
    with pytest.raises(ValueError):
        C.align(tables.orders, ["o_orderkey", "nope"])


def test_leaking_column_is_found(spark):
    df = spark.range(200).withColumns({"y": F.when(F.col("id") % 2 == 0, "a").otherwise("b"), "leak": (F.col("id") % 2).cast("double"), "noise": F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")})
    got = {r["feature"]: r["leak"] for r in C.numeric_leakage(C.with_folds(df, ["id"], "y", 5, 1), ["leak", "noise"], "y").collect()}
    assert got == {"leak": True, "noise": False}


def test_boolean_tokens_of_the_schema_rules(spark):
    rows = [("1", "sim", "si", "t"), ("0", "não", "no", "f"), ("1", "nao", "si", "f")]
    df = spark.createDataFrame(rows, "bit string, pt string, es string, tf string")
    kinds = {r["column_name"]: r["kind"] for r in C.schema_kind(C.profile(C.column_values(df, df.columns))).collect()}
    assert kinds["bit"] == kinds["tf"] == "boolean" and kinds["es"] == "categorical"


def test_locked_protocol_sees_every_change(spark):
    rows = [(i, "ab"[i % 2], i * 0.1, None if i % 5 == 0 else f"s{i % 3}") for i in range(60)]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "id long, y string, x double, c string")

    def audit(other, features=("x", "c"), classes=("a", "b")):
        r = C.locked_protocol(df, other, "id", "y", ["x", "c"], list(features), ["a", "b"], list(classes)).first()
        return {k[5:] for k in r.asDict() if k.startswith("same_") and not r[k]}

    assert audit(df.repartition(5).orderBy(F.desc("x"))) == set()
    assert audit(df.select("c", "x", "y", "id"), ("c", "x")) == {"features"} and audit(df, classes=("b", "a")) == {"classes"}
    assert audit(df.withColumn("y", F.when(F.col("id") == 3, "a").otherwise(F.col("y")))) == {"labels"}
    assert audit(df.withColumn("x", F.when(F.col("id") == 3, 9.0).otherwise(F.col("x")))) == {"content"}
    assert audit(df.withColumn("c", F.when(F.col("id") != 5, F.col("c")).otherwise(F.lit("s0")))) == {"content", "missing"}
    assert audit(df.distinct()) == {"rows", "ids", "labels", "content"}  # a repeated row does not cancel itself
    assert audit(df.filter("id < 0")) == {"rows", "ids", "labels", "content", "missing"}


def test_leakage_finds_distinct_values_and_thresholds_once(spark, monkeypatch):
    """What several steps read is written; a column that gives the class away is still found."""
    kept, inner = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: kept.append(tuple(df.columns)) or inner(df))
    df = spark.range(300).select((F.col("id") % 5).alias("fold"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("y"), (F.col("id") % 2).alias("leak"), (F.col("id") * 37 % 101).alias("noise"))
    got = {r["feature"]: r["leak"] for r in C.numeric_leakage(df, ["leak", "noise"], "y").collect()}
    assert got == {"leak": True, "noise": False}
    assert {("feature", "model", "value", "n"), ("feature", "model", "thrs")} <= set(kept)
