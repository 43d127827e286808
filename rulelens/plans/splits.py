"""Registered split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators import splits as S
from rulelens.plans.bases import CASES, cases
from rulelens.plans.registry import query

HOLDOUT = CASES + """, seeded AS (SELECT id, label, seed, row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat_ws('|', id, seed, 'holdout')), id, seed) AS r, count(*) OVER (PARTITION BY seed, label) AS n
 FROM cases, (VALUES (11),(22)) s(seed)), holdout AS (SELECT id, label, 'seed' || seed AS split_id, CASE WHEN r <= round(n*0.25) THEN 'test' ELSE 'train' END AS role FROM seeded)"""


@query("sp01_holdout", f"WITH {HOLDOUT} SELECT * FROM holdout", ints="id")
def _(t):
    return S.holdout(cases(t), ["id"], "label", [11, 22])


@query("sp02_repeated_folds", f"""WITH {CASES} SELECT id, label, repeat, (row_number() OVER (PARTITION BY repeat, label ORDER BY md5(concat_ws('|', id, repeat, '42')), id, repeat) - 1) % 5 AS fold
FROM cases, (VALUES (0),(1)) r(repeat)""", ints="id repeat fold")
def _(t):
    return S.repeated_folds(cases(t), ["id"], "label")


@query("sp03_disjoint", "SELECT 0 AS shared", ints="shared")
def _(t):
    split = S.holdout(cases(t), ["id"], "label", [11])
    return S.overlap(split.filter("role = 'train'"), split.filter("role = 'test'"), ["id"])


@query("sp04_split_identity")
def _(t):
    return S.identity(S.holdout(cases(t), ["id"], "label", [11, 22]), "id")


@query("sp05_stratified_share", f"""WITH {CASES}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', id, '42')), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM cases),
k AS (SELECT id, label FROM r WHERE r <= greatest(1, ceil(n*0.1))) SELECT id, label FROM k ORDER BY md5(concat_ws('|', id, '42:all')), id LIMIT 1000""", ints="id")
def _(t):
    return S.stratified_share(cases(t).select("id", "label"), ["id"], "label", 0.1, maximum=1000)


@query("sp06_three_way", f"""WITH {CASES}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', id, '7')), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM cases),
v AS (SELECT *, greatest(1, least(ceil(n*0.2), n-2)) AS v FROM r), s AS (SELECT *, greatest(1, least(ceil(n*0.2), n-v-1)) AS s FROM v)
SELECT id, label, CASE WHEN r <= v THEN 'validation' WHEN r <= v+s THEN 'selection' ELSE 'train' END AS role FROM s""", ints="id")
def _(t):
    return S.three_way(cases(t), ["id"], "label")


@query("sp07_entity_overlap", f"""WITH {CASES}, tr AS (SELECT DISTINCT cust FROM cases WHERE year < 2000), te AS (SELECT cust, count(*) AS n FROM cases WHERE year >= 2000 GROUP BY 1)
SELECT count(tr.cust) AS shared_entities, sum(CASE WHEN tr.cust IS NOT NULL THEN n ELSE 0 END)/sum(n) AS test_share, count(tr.cust) > 0 AS leakage FROM te LEFT JOIN tr USING (cust)""", floats="test_share", ints="shared_entities")
def _(t):
    rows = cases(t)
    return S.entity_overlap(rows.filter("year < 2000"), rows.filter("year >= 2000"), "cust")


@query("sp08_temporal_check", """WITH e AS (SELECT ts, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS role FROM events)
SELECT epoch(max(ts) FILTER (role='train'))::BIGINT AS train_end, epoch(min(ts) FILTER (role='test'))::BIGINT AS test_start, CASE WHEN max(ts) FILTER (role='train') < min(ts) FILTER (role='test') THEN 'prospective' ELSE 'overlap' END AS verdict FROM e""",
       ints="train_end test_start")
def _(t):
    at = F.col("ts").cast("timestamp_ntz")
    rows = t.events.select((at - F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), F.when(at < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("test").alias("role"))
    ends = S.temporal_check(rows, "role", "at")  # compared as they are, in no time zone; only the reported ends are whole seconds, halves to even
    part = lambda c, unit: F.extract(F.lit(unit), F.col(c)).cast("decimal(20,6)")
    seconds = lambda c: ((part(c, "DAY") * 24 + part(c, "HOUR")) * 60 + part(c, "MINUTE")) * 60 + part(c, "SECOND")
    return ends.withColumns({c: F.rint(seconds(c).cast("double")) for c in ("train_end", "test_start")})


@query("sp09_evaluation_strategy", """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), m AS (SELECT sum(n) AS n, max(n) AS hi, min(n) AS lo FROM c)
SELECT n, hi/lo AS imbalance_ratio, CASE WHEN n < 200 THEN 'repeated_stratified_cv' ELSE 'stratified_holdout_bootstrap' END AS mode, CASE WHEN hi/lo >= 3 THEN 'balanced_accuracy' ELSE 'accuracy' END AS primary_metric,
 greatest(2, least(5, lo)) AS folds, 1/n AS resolution FROM m""", floats="imbalance_ratio resolution", ints="n folds")
def _(t):
    return S.evaluation_strategy(t.events, "event_type")
