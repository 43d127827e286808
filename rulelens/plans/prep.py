"""Registered feature-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators import prep as P
from rulelens.plans.bases import CASES, CLASSES, FEATURES, OBSERVED, SCORED, cases, observed, scored
from rulelens.plans.registry import query

GAPPY = CASES + ", gappy AS (SELECT id, year, CASE WHEN balance < 0 THEN NULL ELSE balance END AS balance, total, month FROM cases)"


def gappy(t):
    return cases(t).select("id", "year", F.when(F.col("balance") >= 0, F.col("balance")).alias("balance"), "total", "month")


@query("fe01_impute", f"""WITH {GAPPY}, m AS (SELECT quantile_cont(balance, 0.5) AS b, quantile_cont(total, 0.5) AS tt FROM gappy WHERE year < 2000)
SELECT id, coalesce(balance, b) AS balance, coalesce(total, tt) AS total, (balance IS NULL)::INT AS missing_balance FROM gappy, m WHERE year >= 2000""", floats="balance total", ints="id missing_balance")
def _(t):
    rows = gappy(t)
    train = rows.filter("year < 2000")
    cols = ["balance", "total"]
    return P.impute(rows.filter("year >= 2000"), P.fit_medians(train, cols), P.columns_with_missing(train, cols)).select("id", "balance", "total", "missing_balance")


@query("fe02_standardise", f"""WITH {CASES}, m AS (SELECT avg(total) AS a, stddev_pop(total) AS s, avg(month) AS am, stddev_pop(month) AS sm FROM cases WHERE year < 2000)
SELECT id, (total-a)/s AS total, (month-am)/sm AS month FROM cases, m WHERE year >= 2000""", floats="total month", ints="id")
def _(t):
    rows = cases(t)
    return P.standardise(rows.filter("year >= 2000"), P.fit_scales(rows.filter("year < 2000"), ["total", "month"])).select("id", "total", "month")


@query("fe02_min_max", f"""WITH {CASES}, m AS (SELECT min(total) AS lo, max(total) AS hi, min(balance) AS bl, max(balance) AS bh FROM cases WHERE year < 2000)
SELECT id, (total-lo)/(hi-lo) AS total, (balance-bl)/(bh-bl) AS balance FROM cases, m WHERE year >= 2000""", floats="total balance", ints="id")
def _(t):
    rows = cases(t)
    return P.min_max(rows.filter("year >= 2000"), P.fit_scales(rows.filter("year < 2000"), ["total", "balance"])).select("id", "total", "balance")


@query("fe03_one_hot", """WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part WHERE p_size <= 40 GROUP BY 1), k AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS r FROM c WHERE n >= 5),
top AS (SELECT v FROM k WHERE r <= 9), s AS (SELECT p.p_brand, CASE WHEN top.v IS NOT NULL THEN 'p_brand_' || top.v WHEN c.v IS NOT NULL THEN 'p_brand_rare' END AS encoded FROM part p LEFT JOIN top ON top.v = p.p_brand LEFT JOIN c ON c.v = p.p_brand WHERE p_size > 40)
SELECT encoded, count(*) AS n FROM s WHERE encoded IS NOT NULL GROUP BY 1""", ints="n")
def _(t):
    train, test = t.part.filter("p_size <= 40"), t.part.filter("p_size > 40")
    levels = P.fit_levels(train, ["p_brand"], min_count=5, max_levels=10)
    encoded, lineage = P.one_hot(test, levels)
    names = [x["encoded"] for x in lineage]
    seen = train.select(F.lit("p_brand").alias("feature"), F.col("p_brand").alias("value")).distinct()
    encoded = P.rare_flag(encoded, "p_brand", seen, [n[len("p_brand_"):] for n in names])
    totals = encoded.agg(*[F.sum(c).alias(c) for c in [*names, "p_brand_rare"]])
    return totals.unpivot([], [*names, "p_brand_rare"], "encoded", "n").filter("n > 0")


@query("fe04_frequency_encode", """WITH tr AS (SELECT p_brand, count(*)/(SELECT count(*) FROM part WHERE p_size <= 25) AS f FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p_partkey, coalesce(f, 0) AS p_brand_freq FROM part LEFT JOIN tr USING (p_brand) WHERE p_size > 25""", floats="p_brand_freq", ints="p_partkey")
def _(t):
    return P.frequency_encode(t.part.filter("p_size > 25"), t.part.filter("p_size <= 25"), "p_brand").select("p_partkey", "p_brand_freq")


@query("fe05_lineage", "SELECT 'p_type_' || p_type AS encoded, 'p_type' AS source FROM part GROUP BY p_type")
def _(t):
    _, lineage = P.one_hot(t.part, P.fit_levels(t.part, ["p_type"], 1, 100))
    return t.spark.createDataFrame([(x["encoded"], x["source"]) for x in lineage], "encoded string, source string")


@query("fe06_oversample", "SELECT l_returnflag AS label, max(n) OVER () AS n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)", ints="n")
def _(t):
    rows = observed(t).select("okey", "lno", "pkey", "skey", "price", "y")
    return P.oversample(rows, ["okey", "lno", "pkey", "skey", "price"], "y").groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("fe07_undersample", "SELECT l_returnflag AS label, min(n) OVER () AS n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)", ints="n")
def _(t):
    rows = observed(t).select("okey", "lno", "pkey", "skey", "price", "y")
    return P.undersample(rows, ["okey", "lno", "pkey", "skey", "price"], "y").groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# fixed values: the six part types
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def dummies(t):
    cols = {f"type_{v}": (F.col("p_type") == v).cast("int") for v in TYPES}
    cols |= {"size_big": (F.col("p_size") > 25).cast("int"), "size_huge": (F.col("p_size") > 40).cast("int")}
    return t.part.withColumns(cols)


@query("fe08_one_hot_groups", """SELECT 'type' AS grp, 'type_ECONOMY,type_LARGE,type_MEDIUM,type_PROMO,type_SMALL,type_STANDARD' AS columns, 1 AS low, 1 AS high, true AS one_hot UNION ALL
SELECT 'size', 'size_big,size_huge', min((p_size > 25)::INT+(p_size > 40)::INT), max((p_size > 25)::INT+(p_size > 40)::INT), false FROM part""", ints="low high")
def _(t):
    return P.one_hot_groups(dummies(t), [f"type_{v}" for v in TYPES] + ["size_big", "size_huge"])


@query("fe09_one_hot_round_trip", "SELECT p_partkey, p_type AS type, true AS same FROM part", ints="p_partkey")
def _(t):
    names = {f"type_{v}": v for v in TYPES}
    back = P.decode_one_hot(dummies(t), "type", names)
    again = P.encode_one_hot(back.select("p_partkey", "type", *[F.col(c).alias(f"{c}__was") for c in names]), "type", names)
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"{c}__was"))
    return again.select("p_partkey", "type", same.alias("same"))


@query("fe10_feature_specs", f"""WITH {OBSERVED} SELECT 'qty' AS feature, 'integer' AS kind, 0.0::DOUBLE AS low, max(qty) AS high, 'config' AS source, 'increase_only' AS direction, false AS immutable, 1.0::DOUBLE AS cost FROM observed UNION ALL
SELECT 'price', 'continuous', min(price), max(price), 'train', 'both', false, 1.0 FROM observed UNION ALL SELECT 'disc', 'continuous', min(disc), max(disc), 'train', 'both', false, 2.0 FROM observed UNION ALL
SELECT 'late', 'binary', min((tax > 0.04)::INT), max((tax > 0.04)::INT), 'train', 'both', true, 1.0 FROM observed""", floats="low high cost")
def _(t):
    rows = observed(t).withColumn("late", (F.col("tax") > 0.04).cast("int"))
    return P.feature_specs(rows, ["qty", "price", "disc", "late"], {"qty": {"low": 0.0, "direction": "increase_only"}, "disc": {"cost": 2.0}, "late": {"immutable": True}})


NUMERIC = ["total", "balance", "month", "year", "nation", "scaled"]


def wide(t):
    return cases(t).withColumn("scaled", F.sqrt("total") + F.col("month"))


@query("fe11_correlated_group_means")
def _(t):
    rows = wide(t)
    groups = {f"mean_{i}": g for i, g in enumerate(P.correlated_groups(rows, "id", NUMERIC, 4))}
    return P.group_means(rows, groups, P.fit_scales(rows, NUMERIC)).agg(*[F.round(F.stddev_pop(g), 6).alias(g) for g in groups], F.count(F.lit(1)).alias("n"))


@query("fe11_spearman", f"""WITH {CASES}, r AS (SELECT {', '.join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0::DOUBLE AS {c}" for c in ('total', 'balance', 'month', 'nation'))} FROM cases)
{' UNION ALL '.join(f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, corr({a}, {b}) AS r FROM r" for a, b in (('total','balance'),('total','month'),('total','nation'),('balance','month'),('balance','nation'),('month','nation')))}""", floats="r")
def _(t):
    return P.spearman(cases(t), "id", ["total", "balance", "month", "nation"])


@query("fe12_declared_group_means", f"""WITH {OBSERVED}, m AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM observed)
SELECT y, avg(((qty-a_qty)/s_qty + (price-a_price)/s_price)/2) AS size, avg(((disc-a_disc)/s_disc + (tax-a_tax)/s_tax)/2) AS rates FROM observed, m GROUP BY y""", floats="size rates")
def _(t):
    rows = observed(t)
    out = P.group_means(rows, {"size": ["qty", "price"], "rates": ["disc", "tax"]}, P.fit_scales(rows, FEATURES))
    return out.groupBy("y").agg(F.avg("size").alias("size"), F.avg("rates").alias("rates"))


def mi_sql(src: str, label: str, cols, by: str = "") -> str:
    b = by + ", " if by else ""
    using = f"({by + ', ' if by else ''}feature)"
    return f"""l AS ({' UNION ALL '.join(f"SELECT {b}'{c}' AS feature, {c}::DOUBLE AS v, {label} AS y FROM {src}" for c in cols)}),
e AS (SELECT feature, unnest(quantile_cont(v, [{', '.join(str(i / 8) for i in range(1, 8))}])) AS q FROM l GROUP BY 1), eu AS (SELECT DISTINCT feature, q FROM e),
lb AS (SELECT l.*, (SELECT count(*) FROM eu WHERE eu.feature = l.feature AND eu.q < l.v) AS bin FROM l),
n AS (SELECT {b}feature, bin, y, count(*)::DOUBLE AS n FROM lb GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY {b}feature, bin) AS nx, sum(n) OVER (PARTITION BY {b}feature, y) AS ny, sum(n) OVER (PARTITION BY {b}feature) AS nt FROM n),
mi AS (SELECT {b}feature, sum(n/nt*ln(n*nt/(nx*ny))) AS mi FROM w GROUP BY ALL)"""


@query("fe13_mutual_information", f"""WITH {SCORED}, {mi_sql('scored', 't', FEATURES)}, r AS (SELECT *, feature = 'qty' AS is_base, row_number() OVER (PARTITION BY feature = 'qty' ORDER BY round(mi, 9) DESC, feature) AS place FROM mi)
SELECT feature, mi, is_base, is_base OR place <= 2 AS selected FROM r""", floats="mi")
def _(t):
    mi = P.mutual_information(P.binned_long(scored(t), ["t"], FEATURES, 8), "t")
    return P.select_top(mi, ["qty"], 2)


@query("fe14_selection_stability", f"""WITH {SCORED}, f AS (SELECT *, okey % 5 AS fold FROM scored), {mi_sql('f', 't', FEATURES, 'fold')},
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mi, 9) DESC, feature) AS place FROM mi) SELECT feature, avg((place <= 2)::INT) AS frequency, avg((place <= 2)::INT) >= 0.6 AS stable FROM r GROUP BY 1""", floats="frequency")
def _(t):
    rows = scored(t).withColumn("fold", F.col("okey") % 5)
    mi = P.mutual_information(P.binned_long(rows, ["fold", "t"], FEATURES, 8), "t", ["fold"])
    return P.selection_stability(P.select_top(mi, [], 2, ["fold"]))


def ent(cols) -> str:
    n = "(" + "+".join(cols) + ")"
    return "-(" + "+".join(f"CASE WHEN {c} > 0 THEN {c}::DOUBLE/{n}*log2({c}::DOUBLE/{n}) ELSE 0 END" for c in cols) + ")"


def gain_sql(yes, total) -> str:
    no = [f"({t}-{y})" for t, y in zip(total, yes)]
    ny, nt = "(" + "+".join(yes) + ")", "(" + "+".join(total) + ")"
    return f"CASE WHEN {ny} > 0 AND {ny} < {nt} THEN {ent(total)} - {ny}::DOUBLE/{nt}*({ent(yes)}) - ({nt}-{ny})::DOUBLE/{nt}*({ent(no)}) ELSE 0 END"


Y3, T3 = [f"y{c}" for c in CLASSES], [f"t{c}" for c in CLASSES]


@query("fe15_single_screen", f"""WITH {SCORED}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {i} AS i, {c} AS v, t FROM scored" for i, c in enumerate(FEATURES))}),
q AS (SELECT feature, unnest(quantile_cont(v, [{', '.join(str(k / 10) for k in range(1, 10))}])) AS q FROM l GROUP BY 1),
c AS (SELECT l.feature, i, q, {', '.join(f"count_if(v > q AND t = '{k}') AS y{k}, count_if(t = '{k}') AS t{k}" for k in CLASSES)} FROM l JOIN q USING (feature) GROUP BY 1, 2, 3),
g AS (SELECT feature, i, greatest(0, max({gain_sql(Y3, T3)})) AS gain FROM c GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (ORDER BY round(gain, 12) DESC, i) AS place FROM g)
SELECT feature, gain, place, floor((place-1)/2) AS grp FROM p""", floats="gain", ints="place grp")
def _(t):
    rows = scored(t)
    return P.single_screen(rows, "t", CLASSES, FEATURES, P.quantile_cuts(rows, FEATURES, [k / 10 for k in range(1, 10)]), 2)


@query("fe16_pair_screen", f"""WITH {SCORED}, q AS (SELECT {', '.join(f'quantile_cont({c}, [0.3, 0.5, 0.7]) AS {c}' for c in FEATURES)} FROM scored),
pairs AS ({' UNION ALL '.join(f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, unnest(q.{a}) AS qa, q.{b} AS qbs FROM q" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])}),
cut AS (SELECT left_feature, right_feature, qa, unnest(qbs) AS qb FROM pairs), sense AS (SELECT a.x AS sa, b.x AS sb FROM (VALUES (true),(false)) a(x), (VALUES (true),(false)) b(x)),
w AS ({' UNION ALL '.join(f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, {a} AS va, {b} AS vb, t FROM scored" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])}),
c AS (SELECT left_feature, right_feature, qa, qb, sa, sb, {', '.join(f"count_if((va > qa) = sa AND (vb > qb) = sb AND t = '{k}') AS y{k}, count_if(t = '{k}') AS t{k}" for k in CLASSES)} FROM w JOIN cut USING (left_feature, right_feature), sense GROUP BY ALL)
SELECT left_feature, right_feature, greatest(0, max({gain_sql(Y3, T3)})) AS gain FROM c GROUP BY 1, 2""", floats="gain")
def _(t):
    rows = scored(t)
    return P.pair_screen(rows, "t", CLASSES, FEATURES, P.quantile_cuts(rows, FEATURES, [0.3, 0.5, 0.7]))


@query("fe17_pair_synergy")
def _(t):
    rows = scored(t)
    cuts = P.quantile_cuts(rows, FEATURES, [0.3, 0.5, 0.7])
    singles = {r["feature"]: r["gain"] for r in P.single_screen(rows, "t", CLASSES, FEATURES, cuts, 2).collect()}
    return P.synergy_test(P.pair_screen(rows, "t", CLASSES, FEATURES, cuts), singles, {"qty": "size", "price": "size", "disc": "rates", "tax": "rates"})


@query("fe18_group_alignment")
def _(t):
    return P.group_alignment(P.spearman(wide(t), "id", NUMERIC), {"money": ["total", "scaled", "balance"], "time": ["month", "year"]}, NUMERIC)
