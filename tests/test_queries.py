"""Every registered query runs on the small tables; those with SQL must give the same rows as DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or two per family; the full set runs in the driver's own check
CHOSEN = ["me02_classification_bundle", "me05_auc_average_precision", "dq05_contract_kinds", "dq18_numeric_leakage", "fe03_one_hot", "fe16_pair_screen", "sp01_holdout", "st07_effect_sizes", "st13_contrast_runner", "tr07_literal_ranking",
          "tr17_split_choice", "on01_feature_matching", "on05_closure", "sm05_ks_statistics", "sm14_soft_targets", "cf03_violations", "cf08_density", "cf26_rule_transitions", "ex03_rule_examples", "src02_text_scan", "src11_consolidation", "ss01_stream_scoring", "ss02_windowed_fidelity", "ss04_query_budget", "ex05_similar_examples"]
ROWS_ONLY = ["me08_calibration_line", "src05_record_scan", "src07_results_integrity", "ss03_windowed_drift", "sm10_boundary_points", "cf30_local_trees"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 250


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else getattr(v, "item", lambda v=v: v)() for v in r))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SMALL}/{n}.parquet'")
    got, want = plain(entry.queries()[name](spark, SMALL).toPandas()), plain(con.execute(entry.oracle_sql()[name]).df())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=1e-5) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
