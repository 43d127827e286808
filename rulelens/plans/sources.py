"""Registered queries that read and write files: each writes rows Spark derives from the tables, then reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions.lineage import new_folder
from rulelens.functions.shapes import unions
from rulelens.operators import prep as P
from rulelens.plans.bases import FEATURES, RUNS, SCORED, judged, runs, scored
from rulelens.plans.prep import mi_sql
from rulelens.plans.registry import query
from rulelens.sources import results as RS
from rulelens.sources import tabular as TB


@query("src01_delimited_scan", "SELECT s_nationkey, ';' AS separator, count(*) AS n, sum(s_acctbal) AS balance FROM supplier GROUP BY 1", floats="balance", ints="s_nationkey n")
def _(t):
    folder = new_folder(t.spark, "delimited")
    t.supplier.write.option("header", True).option("sep", ";").csv(folder)
    df, meta = TB.read_delimited(t.spark, folder, t.supplier.schema)
    return df.groupBy("s_nationkey").agg(F.lit(meta["separator"]).alias("separator"), F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))


@query("src02_text_scan", "SELECT lpad(c_custkey::VARCHAR, 7, '0') AS code, c_mktsegment AS name, c_mktsegment AS name__2, 'name' AS repeated FROM customer")
def _(t):
    folder = new_folder(t.spark, "text")
    t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("code"), F.col("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("third")).write.option("header", False).option("sep", "|").csv(f"{folder}/body")
    TB.enclosed(t.spark.read.text(f"{folder}/body"), "code|name|name").write.text(f"{folder}/all")
    df, repeated = TB.read_text_columns(t.spark, f"{folder}/all")
    return df.withColumn("repeated", F.lit(",".join(repeated)))


@query("src03_arff_scan")
def _(t):
    folder = new_folder(t.spark, "arff")
    rows = judged(t).select(F.concat_ws(",", F.col("total").cast("string"), F.when(F.col("balance") < 0, "?").otherwise(F.col("balance").cast("string")), F.concat(F.lit("'"), F.col("segment"), F.lit("'")), "cls").alias("value"))
    head = ["% target=cls", "@relation orders", "@attribute total numeric", "@attribute balance REAL", "@attribute 'market segment' {AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD,MACHINERY}", "@attribute cls {bronze,silver,gold}", "@data"]
    t.spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{folder}/a_head")
    rows.write.text(f"{folder}/b_rows")
    df, meta = TB.read_arff(t.spark, f"{folder}/*")
    return df.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("balances"), F.round(F.avg("total"), 4).alias("total"), F.count_distinct("market segment").alias("segments"), F.lit(meta["target"]).alias("target"), F.lit(len(meta["attributes"])).alias("attributes"))


@query("src04_parquet_scan", "SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS qty FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24 GROUP BY 1", floats="qty", ints="n")
def _(t):
    return t.lineitem.filter("l_discount > 0.05 AND l_quantity < 24").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("qty"))


@query("src05_record_scan")
def _(t):
    folder = new_folder(t.spark, "records")
    block = F.concat(F.lit('<rdf:Description rdf:about="http://example.org/o#Record_'), F.col("id"), F.lit('"><balance rdf:datatype="double">'), F.col("balance"), F.lit('</balance><segment rdf:resource="http://example.org/o#'), F.col("segment"),
                     F.lit('"/><rdf:type rdf:resource="http://example.org/o#'), F.col("cls"), F.lit('"/></rdf:Description>'))
    TB.enclosed(judged(t).select(block.alias("value")), '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', "</rdf:RDF>").write.text(folder)
    df = TB.read_records(t.spark, folder, "rdf:Description", ["balance", "segment"], "Record_(\\d+)", "rdf:type")
    return df.groupBy("label", "segment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("ids"), F.round(F.avg(F.col("balance").cast("double")), 4).alias("balance"))


@query("src06_results_sink")
def _(t):
    folder = new_folder(t.spark, "sink")
    table = runs(t)
    RS.save_result(folder, {"raw": table}, {"scheme": "monthly", "teacher": "closed_form"}, partition_by=["dataset"])
    return t.spark.read.parquet(f"{folder}/raw").groupBy("dataset", "arm").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("value"))


@query("src07_results_integrity")
def _(t):
    folder = new_folder(t.spark, "store")
    RS.save_result(folder, {"raw": runs(t)}, {"scheme": "monthly"}, partition_by=["dataset"])
    runs(t).filter("arm = 'core'").drop("dataset").write.mode("append").parquet(f"{folder}/raw/dataset=1999")  # a file the manifest does not know
    return RS.integrity(t.spark, folder, ["raw"]).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query("src08_counterfactual_export")
def _(t):
    from rulelens.plans.counterfactual import fixed
    folder = new_folder(t.spark, "cf")
    # the candidates of one instance are the three variants
    nested = fixed(t).groupBy("id", "cls").agg(F.array_sort(F.collect_list(F.struct("candidate", "distance", "total", "balance", F.lit("variant").alias("method")))).alias("candidates"))
    RS.export_candidates(nested, folder)
    flat = t.spark.read.option("header", True).schema("id long, cls string, place int, candidate int, distance double, total double, balance double, method string").csv(f"{folder}/flat")
    return flat.groupBy("cls", "candidate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("distance"))


@query("src09_row_diagnostics", f"WITH {SCORED} SELECT okey, lno, pkey, y, t, s, t = y AS t_correct, s = y AS s_correct FROM scored", ints="okey lno pkey")
def _(t):
    return RS.row_diagnostics(scored(t), ["okey", "lno", "pkey"], "y", ["t", "s"])


DERIVED = SCORED + ", dr AS (SELECT *, price/qty AS per_unit, disc-tax AS gap, 3*qty+1 AS scaled FROM scored)"


def derived(t):
    return scored(t).withColumns({"per_unit": F.col("price") / F.col("qty"), "gap": F.col("disc") - F.col("tax"), "scaled": 3 * F.col("qty") + 1})


@query("src10_feature_audit", f"""WITH {DERIVED}, {mi_sql('dr', 't', ['per_unit', 'gap', 'scaled'])}, c AS (SELECT {', '.join(f"abs(corr({d}, {o})) AS {d}_{o}" for d in ('per_unit', 'gap', 'scaled') for o in FEATURES)}, {', '.join(f'var_pop({d}) AS v_{d}' for d in ('per_unit', 'gap', 'scaled'))} FROM dr),
a AS ({' UNION ALL '.join(f"SELECT '{d}' AS feature, v_{d} AS variance, greatest({', '.join(f'{d}_{o}' for o in FEATURES)}) AS max_correlation FROM c" for d in ('per_unit', 'gap', 'scaled'))})
SELECT feature, variance/1000000 AS variance, max_correlation, mi, CASE WHEN mi > 0.05 THEN 1.0 ELSE 0.0 END AS frequency, CASE WHEN max_correlation >= 0.999 THEN 'redundant' WHEN mi > 0.05 THEN 'keep' ELSE 'unstable' END AS decision FROM a JOIN mi USING (feature)""", floats="variance max_correlation mi frequency")
def _(t):
    names = ["per_unit", "gap", "scaled"]
    rows = derived(t)
    mi = P.mutual_information(P.binned_long(rows, ["t"], names, 8), "t")
    selection = mi.select("feature", F.when(F.col("mi") > 0.05, 1.0).otherwise(0.0).alias("frequency"))
    return RS.feature_audit(rows, names, FEATURES, mi, selection).drop("closest").withColumn("variance", F.col("variance") / 1000000)


@query("src11_consolidation", f"""WITH {RUNS}, c AS (SELECT arm, metric, avg(value) AS value, count(*) AS rows FROM runs GROUP BY 1, 2), n AS (SELECT arm, metric, avg(n_test) AS n_test FROM runs GROUP BY 1, 2) SELECT * FROM c LEFT JOIN n USING (arm, metric)""", floats="value n_test", ints="rows")
def _(t):
    folder = new_folder(t.spark, "consolidate")
    table = runs(t)
    table.withColumn("year", F.col("dataset")).write.partitionBy("year").option("header", True).csv(folder)
    schema = "dataset int, split_id int, n_test long, oracle_name string, arm string, metric string, value double"
    years = t.spark.read.schema(schema + ", year int").option("header", True).csv(folder).select("year").distinct().collect()
    frames = [t.spark.read.schema(schema).option("header", True).csv(f"{folder}/year={r['year']}") for r in years]
    means = RS.consolidate(frames, ["arm", "metric"], ["value"])
    return RS.master_table(means, {"n": table.groupBy("arm", "metric").agg(F.avg("n_test").alias("n_test"))}, ["arm", "metric"])


@query("src12_fingerprint")
def _(t):
    a = RS.fingerprint(t.orders, t.orders.columns).withColumn("what", F.lit("orders"))
    b = RS.fingerprint(t.orders.repartition(5, "o_custkey"), t.orders.columns).withColumn("what", F.lit("orders_repartitioned"))
    return unions([a, b])
