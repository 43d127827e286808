"""Registered queries of the data contract: typing, profiling, validation, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions.lineage import written
from rulelens.functions.shapes import long_form
from rulelens.operators import contract as C
from rulelens.plans.bases import CASES, OBSERVED, RAW_COLUMNS, RAW_TEXT, cases, observed, raw_text
from rulelens.plans.registry import query

MISS = "('', '?', 'na', 'n/a', 'null')"
CLEAN = RAW_TEXT + ", clean AS (SELECT id, " + ", ".join(f"CASE WHEN lower(trim({c})) IN {MISS} THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS) + " FROM raw)"
LONG = CLEAN + ", vals AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM clean" for c in RAW_COLUMNS) + """),
dv AS (SELECT column_name, value, count(*) AS n, try_cast(trim(value) AS DOUBLE) AS num, regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(value AS TIMESTAMP) IS NOT NULL AS isdate FROM vals GROUP BY 1, 2),
prof AS (SELECT column_name, sum(n) AS n_rows, coalesce(sum(n) FILTER (value IS NULL),0) AS n_missing, coalesce(sum(n) FILTER (value IS NOT NULL),0) AS n_present, count(value) AS n_unique,
  coalesce(bool_and(num IS NOT NULL) FILTER (value IS NOT NULL), false) AS all_numeric, coalesce(bool_and(abs(num-round(num)) <= 1e-9) FILTER (num IS NOT NULL), false) AS integer_like,
  sum(n) FILTER (isdate)/sum(n) FILTER (value IS NOT NULL) AS date_share, count_if(isdate)/count(value) AS date_share_distinct,
  sum(n*length(value)) FILTER (value IS NOT NULL)/sum(n) FILTER (value IS NOT NULL) AS mean_length,
  coalesce(bool_and(lower(trim(value)) IN ('yes','no')) FILTER (value IS NOT NULL) OR bool_and(trim(value) IN ('1','0')) FILTER (value IS NOT NULL)
   OR bool_and(lower(trim(value)) IN ('sim','nao','não')) FILTER (value IS NOT NULL), false) AS yesno FROM dv GROUP BY 1)"""


def clean(t):
    return C.null_markers(raw_text(t), RAW_COLUMNS)


def values(t):
    return C.column_values(clean(t), RAW_COLUMNS)


@query("dq01_missing_markers", CLEAN.join(["WITH ", " SELECT id, " + ", ".join(f"coalesce({c}, 'NULL') AS {c}" for c in RAW_COLUMNS) + " FROM clean"]))
def _(t):
    return clean(t).select("id", *[F.coalesce(c, F.lit("NULL")).alias(c) for c in RAW_COLUMNS])


@query("dq02_unique_names", """SELECT 'l_orderkey' AS name, sum(l_orderkey)::DOUBLE AS total FROM lineitem UNION ALL SELECT 'coluna_1', sum(l_quantity) FROM lineitem UNION ALL
SELECT 'qty', sum(l_tax) FROM lineitem UNION ALL SELECT 'qty__2', sum(l_discount) FROM lineitem""", floats="total")
def _(t):
    names, _ = C.unique_names(["l_orderkey", " ", "qty", "qty"])
    renamed = t.lineitem.select("l_orderkey", "l_quantity", "l_tax", "l_discount").toDF(*names)
    return long_form(renamed.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names]), [], names, "name", "total")


@query("dq03_numeric_coercion", f"WITH {CLEAN} SELECT count(price) AS price_n, avg(try_cast(trim(price) AS DOUBLE)) AS price_mean, sum(try_cast(trim(grade) AS DOUBLE)) AS grade_sum, max(mixed) AS mixed_max FROM clean",
       floats="price_mean grade_sum", ints="price_n")
def _(t):
    typed = C.coerce_numeric(clean(t), RAW_COLUMNS)
    return typed.agg(F.count("price").alias("price_n"), F.avg("price").alias("price_mean"), F.sum("grade").alias("grade_sum"), F.max("mixed").alias("mixed_max"))


@query("dq04_schema_kinds", f"""WITH {LONG} SELECT column_name, CASE WHEN n_present=0 THEN 'categorical' WHEN n_unique<=2 AND yesno THEN 'boolean' WHEN all_numeric AND integer_like AND n_unique<=10 THEN 'categorical'
 WHEN all_numeric THEN 'numeric' WHEN date_share_distinct>=0.9 THEN 'datetime' ELSE 'categorical' END AS kind,
 n_present=0 OR (all_numeric AND integer_like AND n_unique<=10 AND NOT (n_unique<=2 AND yesno)) AS ambiguous, n_unique, n_missing FROM prof""", ints="n_unique n_missing")
def _(t):
    return C.schema_kind(C.profile(values(t))).select("column_name", "kind", "ambiguous", "n_unique", "n_missing")


KIND = LONG + """, nums AS (SELECT DISTINCT column_name, num FROM dv WHERE num IS NOT NULL), gaps AS (SELECT column_name, num - lag(num) OVER (PARTITION BY column_name ORDER BY num) AS gap FROM nums),
med AS (SELECT column_name, quantile_cont(gap, 0.5) AS m FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
reg AS (SELECT g.column_name, avg((abs(gap-m) <= 1e-9+1e-5*abs(m))::INT) AS regular FROM gaps g JOIN med USING (column_name) WHERE gap IS NOT NULL GROUP BY 1),
kinds AS (SELECT prof.*, CASE WHEN n_unique<=1 THEN 'constant' WHEN NOT all_numeric AND date_share>=0.9 THEN 'datetime' WHEN n_unique=2 THEN 'binary' WHEN all_numeric AND n_unique<=20 THEN 'numeric_discrete'
  WHEN all_numeric AND integer_like AND n_present>=20 AND n_unique/n_present>=0.98 AND regular>=0.95 THEN 'id_like' WHEN all_numeric THEN 'numeric_continuous'
  WHEN n_present>=20 AND n_unique/n_present>=0.98 THEN 'id_like' WHEN mean_length>40 AND n_unique/n_present>0.5 THEN 'free_text' ELSE 'categorical' END AS kind FROM prof LEFT JOIN reg USING (column_name)),
treated AS (SELECT *, CASE WHEN column_name='status' THEN 'target' WHEN kind IN ('constant','id_like','free_text','datetime') THEN 'drop' WHEN kind IN ('categorical','binary') AND n_unique > greatest(50, floor(n_rows*0.5)) THEN 'frequency'
  WHEN kind IN ('categorical','binary') THEN 'one_hot' ELSE 'use' END AS treatment FROM kinds)"""


@query("dq05_contract_kinds", f"WITH {KIND} SELECT column_name, kind, n_unique, n_present FROM kinds", ints="n_unique n_present")
def _(t):
    v = values(t)
    return C.contract_kind(v, C.profile(v)).select("column_name", "kind", "n_unique", "n_present")


@query("dq06_treatment", f"WITH {KIND} SELECT column_name, CASE WHEN column_name='status' THEN 'one_hot' ELSE treatment END AS treatment FROM treated")
def _(t):
    v = values(t)
    typed = C.contract_kind(v, C.profile(v))
    return typed.select("column_name", C.treatment(F.col("kind"), F.col("n_unique"), F.col("n_rows")).alias("treatment"))


TARGETED = KIND.replace("FROM raw)", "FROM raw WHERE id % 13 <> 0)")


@query("dq07_contract", f"WITH {TARGETED} SELECT column_name, kind, n_missing/n_rows AS missing_rate, n_unique AS cardinality, CASE WHEN column_name='grade' THEN 'drop' ELSE treatment END AS treatment, n_rows FROM treated",
       floats="missing_rate", ints="cardinality n_rows")
def _(t):
    return C.contract(raw_text(t), RAW_COLUMNS, "status", overrides={"grade": "ignore"})


@query("dq07_contract_warnings", f"""WITH {TARGETED} SELECT 'constant_column' AS code, column_name, n_unique::DOUBLE AS detail FROM kinds WHERE kind='constant' UNION ALL
SELECT 'id_like_column', column_name, n_unique FROM kinds WHERE kind='id_like' UNION ALL SELECT 'high_missing_rate', column_name, n_missing/n_rows FROM kinds WHERE n_missing/n_rows > 0.4""", floats="detail")
def _(t):
    table = C.contract(raw_text(t), RAW_COLUMNS, "status")
    return C.contract_warnings(table, clean(t), "status")


@query("dq08_target_by_values", f"""WITH {CLEAN}, v AS (SELECT 'status' AS column_name, status AS value FROM clean UNION ALL SELECT 'flag', flag FROM clean UNION ALL SELECT 'same', same FROM clean),
labels AS (SELECT DISTINCT o_orderstatus AS label FROM orders)
SELECT column_name, count(DISTINCT value) AS distinct_values FROM v GROUP BY 1 HAVING count(DISTINCT value) >= 2 AND bool_and(value IS NULL OR value IN (SELECT label FROM labels))""", ints="distinct_values")
def _(t):
    labels = t.orders.select(F.col("o_orderstatus").alias("label")).distinct()
    return C.target_by_values(C.column_values(clean(t), ["status", "flag", "same"]), labels)


@query("dq09_schema", f"""WITH {LONG}, k AS (SELECT column_name, CASE WHEN n_unique<=2 AND yesno THEN 'boolean' WHEN all_numeric AND integer_like AND n_unique<=10 THEN 'categorical'
 WHEN all_numeric THEN 'numeric' WHEN date_share_distinct>=0.9 THEN 'datetime' ELSE 'categorical' END AS kind, n_missing, n_unique FROM prof)
SELECT column_name, CASE column_name WHEN 'grade' THEN 'ordinal' WHEN 'code' THEN 'categorical' ELSE kind END AS kind,
 CASE column_name WHEN 'grade' THEN 'ontology' WHEN 'code' THEN 'declared' ELSE 'inferred' END AS source, n_missing, n_unique FROM k""", ints="n_missing n_unique")
def _(t):
    declared = t.spark.createDataFrame([("code", "categorical")], "column_name string, kind string")
    ontology = t.spark.createDataFrame([("grade", "ordinal"), ("code", "numeric")], "column_name string, kind string")
    return C.build_schema(C.profile(values(t)), declared, ontology).select("column_name", "kind", "source", "n_missing", "n_unique")


@query("dq10_class_order", """SELECT l_linenumber::VARCHAR AS label, row_number() OVER (ORDER BY l_linenumber) - 1 AS code, count(*) AS n FROM lineitem GROUP BY l_linenumber""", ints="code n")
def _(t):
    return C.class_order(t.lineitem, "l_linenumber")


@query("dq10_declared_class_order", """SELECT l_returnflag AS label, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS code, count(*) AS n FROM lineitem GROUP BY 1""", ints="code n")
def _(t):
    return C.class_order(t.lineitem, "l_returnflag", declared=["R", "A", "N"])


@query("dq11_apply_schema", f"""WITH {CLEAN} SELECT try_cast(trim(price) AS DOUBLE) AS price, CASE WHEN flag='yes' THEN 1 ELSE 0 END AS flag, epoch(day::TIMESTAMP) AS day,
 CASE WHEN priority IS NOT NULL THEN left(priority,1)::INT-1 END AS priority, same, status FROM clean""", floats="price day", ints="flag priority")
def _(t):
    # fixed values: the five order priorities, most urgent first
    ranks = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    kinds = {"status": "categorical", "price": "numeric", "flag": "boolean", "day": "datetime", "priority": "ordinal", "same": "categorical"}
    return C.apply_schema(clean(t), kinds, {"priority": ranks}, "status")


@query("dq12_schema_issues", f"""WITH {LONG}, i AS (
 SELECT 'MISSING_VALUES' AS code, 'critical' AS severity, column_name, n_missing AS detail FROM prof WHERE column_name <> 'status' AND n_missing > 0 UNION ALL
 SELECT 'TYPE_NUMERIC_INVALID', 'critical', 'mixed', (SELECT count(*) FROM dv WHERE column_name='mixed' AND value IS NOT NULL AND num IS NULL) UNION ALL
 SELECT 'ID_LIKE_COLUMN', 'critical', 'code', n_unique FROM prof WHERE column_name='code' UNION ALL SELECT 'CONSTANT_COLUMN', 'warning', 'same', 1 UNION ALL
 SELECT 'TARGET_HAS_MISSING', 'critical', 'status', n_missing FROM prof WHERE column_name='status' UNION ALL
 SELECT 'UNKNOWN_CATEGORIES', 'critical', 'grade', (SELECT count(*) FROM dv WHERE column_name='grade' AND value NOT IN ('0','1','2')) UNION ALL
 SELECT 'CLASS_ORDER_INVALID', 'critical', 'status', 1 UNION ALL SELECT 'CLASS_ORDER_CHANGES_TRAINED_MODEL', 'critical', 'status', 2)
SELECT * FROM i""", ints="detail")
def _(t):
    kinds = {"status": "categorical", "price": "numeric", "mixed": "numeric", "day": "datetime", "flag": "boolean", "code": "categorical", "grade": "ordinal",
             "same": "categorical", "priority": "categorical"}
    return C.schema_issues(clean(t), kinds, "status", ["F", "O"], values(t), {"grade": ["0", "1", "2"]}, trained_order=["O", "F"])


@query("dq13_class_distribution", """SELECT event_type AS label, count(*) AS n, count(*)/(SELECT count(*) FROM events) AS share, count(*)/(SELECT count(*) FROM events) < 0.05 AS rare,
 max(count(*)) OVER ()/min(count(*)) OVER () AS imbalance_ratio FROM events GROUP BY 1""", floats="share imbalance_ratio", ints="n")
def _(t):
    return C.class_distribution(t.events, "event_type")


@query("dq14_usable_rows", f"""WITH {CLEAN}, k AS (SELECT *, CASE WHEN id = 1 THEN 'solo' ELSE status END AS target FROM clean) SELECT target, count(*) AS n FROM k WHERE target IS NOT NULL
 GROUP BY 1 HAVING count(*) >= 2""", ints="n")
def _(t):
    rows = clean(t).withColumn("target", F.when(F.col("id") == 1, "solo").otherwise(F.col("status")))
    return C.usable_rows(rows, "target").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("dq15_duplicate_rows", """WITH g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*)-1 AS extra FROM lineitem GROUP BY ALL)
SELECT sum(extra) AS duplicate_rows, count_if(extra>0) AS groups FROM g""", ints="duplicate_rows groups")
def _(t):
    return C.duplicate_count(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


@query("dq16_conflicting_duplicates", """SELECT l_quantity, l_discount, l_tax, count(DISTINCT l_returnflag) AS labels, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_returnflag) > 1""",
       floats="l_quantity l_discount l_tax", ints="labels rows")
def _(t):
    return C.conflicting_groups(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_returnflag")


@query("dq17_inspection", f"""WITH {LONG} SELECT max(n_rows) AS n, count(*) AS p, sum(n_missing)/sum(n_rows) AS missing_overall, count_if(n_unique<=1) AS constant_columns, count_if(n_unique=n_rows AND n_rows>20) AS id_like_columns,
 0 AS time_like_columns, count_if(all_numeric) AS numeric_columns, max(n_missing/n_rows) AS worst_missing, (SELECT count(DISTINCT flag) FROM clean) AS classes, (SELECT min(c) FROM (SELECT count(*) AS c FROM clean GROUP BY flag)) AS smallest_class,
 true AS size_ok, max(n_missing/n_rows) <= 0.3 AS missing_ok FROM prof WHERE column_name <> 'flag'""", floats="missing_overall worst_missing",
       ints="n p constant_columns id_like_columns time_like_columns numeric_columns classes smallest_class")
def _(t):
    return C.inspection(clean(t), [c for c in RAW_COLUMNS if c != "flag"], "flag")


def folded(t):
    """Orders with stratified folds and a column that gives the label away."""
    leak = F.when(F.col("label") == "F", 10).when(F.col("label") == "O", 20).otherwise(30) + F.pmod("id", F.lit(3))
    return C.with_folds(cases(t).withColumn("leak", F.when(F.col("id") % 97 == 0, 0).otherwise(leak)), ["id"], "label", 5, 1701)


FOLDED = CASES + """, folded AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR || '|1701'), id) - 1) % 5 AS fold,
  CASE WHEN id % 97 = 0 THEN 0 ELSE CASE label WHEN 'F' THEN 10 WHEN 'O' THEN 20 ELSE 30 END + id % 3 END AS leak FROM cases)"""


@query("dq18_numeric_leakage", f"""WITH {FOLDED}, l AS (SELECT 'total' AS feature, total AS v, label AS y, fold FROM folded UNION ALL SELECT 'month', month, label, fold FROM folded UNION ALL SELECT 'leak', leak, label, fold FROM folded),
m AS (SELECT unnest(range(5)) AS model), u AS (SELECT DISTINCT feature, model, v FROM l, m WHERE fold <> model),
sz AS (SELECT feature, model, count(*) AS k, quantile_cont(v, [{', '.join(repr(0.02 + 0.96 * i / 62) for i in range(63))}]) AS q FROM u GROUP BY 1, 2),
e AS (SELECT u.feature, u.model, v AS edge FROM u JOIN sz USING (feature, model) WHERE k <= 64 UNION SELECT feature, model, unnest(q) FROM sz WHERE k > 64),
th AS (SELECT feature, model, (edge + lead(edge) OVER (PARTITION BY feature, model ORDER BY edge))/2 AS thr FROM e QUALIFY lead(edge) OVER (PARTITION BY feature, model ORDER BY edge) IS NOT NULL),
c AS (SELECT th.feature, model, thr, y, count_if(v <= thr) AS lc, count_if(v > thr) AS rc FROM th JOIN l ON l.feature = th.feature AND l.fold <> th.model GROUP BY 1, 2, 3, 4),
s AS (SELECT feature, model, thr, first(y ORDER BY lc DESC, y) AS ll, first(y ORDER BY rc DESC, y) AS rl, max(lc)+max(rc) AS hit FROM c GROUP BY 1, 2, 3),
b AS (SELECT feature, model, first(thr ORDER BY hit DESC, thr) AS thr, first(ll ORDER BY hit DESC, thr) AS ll, first(rl ORDER BY hit DESC, thr) AS rl FROM s GROUP BY 1, 2),
a AS (SELECT b.feature, model, avg((CASE WHEN v <= thr THEN ll ELSE rl END = y)::INT) AS acc FROM b JOIN l ON l.feature = b.feature AND l.fold = b.model GROUP BY 1, 2)
SELECT feature, avg(acc) AS cv_accuracy, avg(acc) > 0.98 AS leak FROM a GROUP BY 1""", floats="cv_accuracy")
def _(t):
    return C.numeric_leakage(folded(t), ["total", "month", "leak"], "label")


@query("dq19_categorical_leakage", f"""WITH {FOLDED}, l AS (SELECT 'segment' AS feature, segment AS v, label AS y, fold FROM folded UNION ALL SELECT 'priority', priority, label, fold FROM folded UNION ALL SELECT 'leak', leak::VARCHAR, label, fold FROM folded),
m AS (SELECT unnest(range(5)) AS model), c AS (SELECT feature, model, v, y, count(*) AS n FROM l, m WHERE fold <> model GROUP BY ALL), o AS (SELECT feature, model, v, first(y ORDER BY n DESC, y) AS own FROM c GROUP BY 1, 2, 3),
g AS (SELECT feature, model, y, sum(n) AS n FROM c GROUP BY 1, 2, 3), f AS (SELECT feature, model, first(y ORDER BY n DESC, y) AS overall FROM g GROUP BY 1, 2),
a AS (SELECT l.feature, f.model, avg((coalesce(own, overall) = l.y)::INT) AS acc FROM l JOIN f ON f.feature = l.feature AND f.model = l.fold LEFT JOIN o ON o.feature = l.feature AND o.model = l.fold AND o.v = l.v GROUP BY 1, 2)
SELECT feature, avg(acc) AS cv_accuracy, avg(acc) > 0.98 AS leak FROM a GROUP BY 1""", floats="cv_accuracy")
def _(t):
    return C.categorical_leakage(folded(t), ["segment", "priority", "leak"], "label")


HEALTH = ["qty", "tax", "qty_copy", "flat", "gap"]


@query("dq20_column_health", f"""WITH {OBSERVED}, w AS (SELECT qty, tax, qty AS qty_copy, 1.0::DOUBLE AS flat, CASE WHEN disc > 0.05 THEN disc END AS gap FROM observed),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM w" for c in HEALTH)}), p AS (SELECT feature, v, count(*) AS n FROM l GROUP BY 1, 2),
s AS (SELECT feature, sum(n) AS rows, count(v) AS n_distinct, max(n) FILTER (v IS NOT NULL)/sum(n) FILTER (v IS NOT NULL) AS top_share, 1-sum(n) FILTER (v IS NOT NULL)/sum(n) AS missing_share FROM p GROUP BY 1),
d AS (SELECT feature, stddev_pop(v) AS std FROM l GROUP BY 1)
SELECT feature, rows, n_distinct, top_share, missing_share, std, CASE WHEN feature='qty_copy' THEN 'qty' END AS duplicate_of, std <= 1e-4 AS near_constant FROM s JOIN d USING (feature)""",
       floats="top_share missing_share std", ints="rows n_distinct")
def _(t):
    wide = observed(t).select("qty", "tax", F.col("qty").alias("qty_copy"), F.lit(1.0).alias("flat"), F.when(F.col("disc") > 0.05, F.col("disc")).alias("gap"))
    return C.column_health(wide, HEALTH)


@query("dq21_align", "SELECT l_tax, l_quantity, l_discount FROM lineitem", floats="l_tax l_quantity l_discount")
def _(t):
    return C.align(t.lineitem, ["l_tax", "l_quantity", "l_discount"])


@query("dq22_record_like", """WITH p AS (SELECT c_name AS individual, 'segment' AS key FROM customer UNION ALL SELECT c_name, 'nation' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, 'id' FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT s_name, 'nation' FROM supplier UNION ALL SELECT 'row_' || s_suppkey, 'nation' FROM supplier),
g AS (SELECT individual, count(*) AS properties, max((key='id')::INT) AS has_id FROM p GROUP BY 1), ids AS (SELECT c_name FROM customer WHERE c_nationkey = 3)
SELECT individual, properties, has_id, regexp_matches(lower(individual), '^(row|record|sample|patient|subject|case)[_-]?[0-9]+$') OR has_id=1 OR properties >= 3 AS record,
 CASE WHEN individual IN (SELECT c_name FROM ids) THEN 'REJECT_TEST_INSTANCE_LEAKAGE' WHEN regexp_matches(lower(individual), '^(row|record|sample|patient|subject|case)[_-]?[0-9]+$') OR has_id=1 OR properties >= 3 THEN 'REJECT_DATASET_RECORDS' ELSE 'SAFE' END AS status FROM g""",
       ints="properties has_id")
def _(t):
    def props(df, name, key):
        return df.select(name.alias("individual"), F.lit(key).alias("key"))

    c, s = t.customer, t.supplier
    people = props(c, F.col("c_name"), "segment").unionByName(props(c.filter("c_custkey % 2 = 0"), F.col("c_name"), "nation")).unionByName(props(c.filter("c_custkey % 5 = 0"), F.col("c_name"), "id")) \
        .unionByName(props(s, F.col("s_name"), "nation")).unionByName(props(s, F.concat(F.lit("row_"), F.col("s_suppkey")), "nation"))
    return C.record_like(people, c.filter("c_nationkey = 3").select(F.col("c_name").alias("test_id")))


@query("dq23_protocol_audit")
def _(t):
    rows = cases(t)
    return C.protocol_audit(rows.filter("month <= 9"), rows.filter("month > 9"), "id", ["total", "balance", "segment", "label"])


def _digest_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"coalesce(({p})::VARCHAR, '\\N')" for p in parts)
    return f"coalesce(sum(('0x' || substr(md5({text}), 1, 15))::HUGEINT), 0)::VARCHAR"


LOCKED = {"balance": "CASE WHEN balance >= 0 THEN balance END", "segment": "segment", "total": "total"}
_AS_TEXT = {"balance": "balance::DECIMAL(38,9)", "segment": "segment", "total": "total::DECIMAL(38,9)"}


@query("dq23_locked_protocol", f"""WITH {CASES}, l AS (SELECT id, label, {', '.join(f'{v} AS {c}' for c, v in LOCKED.items())} FROM cases WHERE month > 9),
d AS (SELECT count(*) AS n, {_digest_sql('id')} AS ids, {_digest_sql('id', 'label')} AS labels, {_digest_sql('id', *_AS_TEXT.values())} AS content, count(*) - count(balance) AS missing FROM l)
SELECT n AS rows_locked, ids AS ids_locked, labels AS labels_locked, content AS content_locked, missing AS missing_locked, n AS rows_read, ids AS ids_read, labels AS labels_read, content AS content_read, missing AS missing_read,
 md5('total|balance|segment') AS features_locked, md5('segment|balance|total') AS features_read, md5('F|O|P') AS classes_locked, (SELECT md5(string_agg(label, '|' ORDER BY label)) FROM (SELECT DISTINCT label FROM l) q) AS classes_teacher,
 true AS same_rows, true AS same_ids, true AS same_labels, true AS same_content, true AS same_missing, false AS same_features, (SELECT string_agg(label, '|' ORDER BY label) = 'F|O|P' FROM (SELECT DISTINCT label FROM l) q) AS same_classes FROM d""",
       ints="rows_locked rows_read missing_locked missing_read")
def _(t):
    """Orders of the last quarter, locked and then read again from a file with the features in another order."""
    locked = cases(t).filter("month > 9").select("id", "label", *[F.expr(v).alias(c) for c, v in LOCKED.items()])
    read = written(locked.select("segment", "balance", "total", "label", "id").repartition("segment"), "locked")
    found = [r["label"] for r in locked.select("label").distinct().orderBy("label").collect()]  # class names
    return C.locked_protocol(locked, read, "id", "label", ["total", "balance", "segment"], ["segment", "balance", "total"], ["F", "O", "P"], found)


@query("dq24_order_relations", """SELECT 'l_discount' AS lower, 'l_tax' AS upper, count(*) AS n, avg((l_discount > l_tax)::INT) AS violation_rate FROM lineitem UNION ALL
SELECT 'l_tax', 'l_quantity', count(*), avg((l_tax > l_quantity)::INT) FROM lineitem""", floats="violation_rate", ints="n")
def _(t):
    return C.order_relations(t.lineitem, [("l_discount", "l_tax"), ("l_tax", "l_quantity")])


@query("dq25_file_kind", """SELECT page_id, len(list_distinct(regexp_extract_all(html, '[a-z]+[.]example[.][a-z]+'))) AS identifiers,
 CASE WHEN len(list_distinct(regexp_extract_all(html, '[a-z]+[.]example[.][a-z]+'))) > 1 THEN 'multi' WHEN len(list_distinct(regexp_extract_all(html, '[a-z]+[.]example[.][a-z]+'))) = 1 THEN 'single' ELSE 'not_applicable' END AS kind FROM pages""",
       ints="identifiers")
def _(t):
    return C.file_kind(t.pages, "html", "[a-z]+[.]example[.][a-z]+").select("page_id", "identifiers", "kind")


@query("dq26_transform_contract", f"WITH {CASES} SELECT 0.0::DOUBLE AS determinism_gap, 0.0::DOUBLE AS original_gap, count(*) AS rows, 0 AS null_changes FROM cases", floats="determinism_gap original_gap", ints="rows null_changes")
def _(t):
    def derive(df):
        return df.withColumns({"per_month": F.col("total") / F.col("month"), "gap": F.when(F.col("balance") > 0, F.col("total") / F.col("balance"))})

    return C.transform_contract(cases(t), ["id"], derive, ["total", "balance"])
