"""Registered ontology queries: region > nation > supplier as a taxonomy, part names matched to entity labels."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rulelens.functions.shapes import unions
from rulelens.operators import derived as D
from rulelens.operators import ontology as ON
from rulelens.operators import prep as P
from rulelens.plans.bases import FEATURES, OBSERVED, RUNS, observed, runs
from rulelens.plans.registry import query


# ---------------------------------------------------------------- tables

def edges(t):
    e = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("relation"))
    n, r, s, p = t.nation, t.region, t.supplier, t.part
    twin = n.select(F.col("n_name").alias("other"), (F.col("n_nationkey") - 20).alias("n_nationkey"))
    return unions([
        e(n.join(r, n.n_regionkey == r.r_regionkey), F.col("n_name"), F.col("r_name"), "subsumption"), e(r, F.col("r_name"), F.lit("WORLD"), "subsumption"),
        e(r.limit(1), F.lit("WORLD"), F.lit("THING"), "subsumption"), e(s.join(n, s.s_nationkey == n.n_nationkey), F.col("s_name"), F.col("n_name"), "domain"),
        e(n.join(twin, "n_nationkey"), F.col("n_name"), F.col("other"), "equivalent"), e(p.select("p_brand", "p_type").distinct(), F.col("p_brand"), F.col("p_type"), "subsumption"),
        e(p.select("p_type").distinct(), F.col("p_type"), F.lit("WORLD"), "subsumption")])


EDGES = """edges AS (SELECT n_name AS src, r_name AS dst, 'subsumption' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD', 'subsumption' FROM region UNION ALL SELECT 'WORLD', 'THING', 'subsumption'
 UNION ALL SELECT s_name, n_name, 'domain' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT a.n_name, b.n_name, 'equivalent' FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 20
 UNION ALL SELECT DISTINCT p_brand, p_type, 'subsumption' FROM part UNION ALL SELECT DISTINCT p_type, 'WORLD', 'subsumption' FROM part)"""


def graph_entities(t):
    k = lambda df, c, kind: df.select(c.alias("name"), F.lit(kind).alias("kind"), c.alias("label"))
    return unions([k(t.region, F.col("r_name"), "class"), k(t.nation, F.col("n_name"), "class"), k(t.supplier, F.col("s_name"), "individual"), k(t.part.select("p_brand").distinct(), F.col("p_brand"), "datatype_property"),
                   k(t.part.select("p_type").distinct(), F.col("p_type"), "class")])


GRAPH_ENTITIES = """gent AS (SELECT r_name AS name, 'class' AS kind FROM region UNION ALL SELECT n_name, 'class' FROM nation UNION ALL SELECT s_name, 'individual' FROM supplier UNION ALL SELECT DISTINCT p_brand, 'datatype_property' FROM part UNION ALL SELECT DISTINCT p_type, 'class' FROM part)"""


def part_features(t):
    return t.part.select(F.col("p_name").alias("feature")).distinct()


def part_entities(t):
    w = F.split("p_name", " ")
    words = t.part.select(w[0].alias("first"), w[1].alias("second")).distinct()
    props = words.filter(F.col("first").isin("small", "blue", "red")).select(F.concat(F.lit("has_"), F.col("second"), F.lit("_"), F.col("first")).alias("name"), F.lit("datatype_property").alias("kind"), F.concat_ws("_", "second", "first").alias("label"))
    nouns = words.select(F.concat(F.lit("C_"), F.col("second")).alias("name"), F.lit("class").alias("kind"), F.col("second").alias("label")).distinct()
    kinds = t.part.select(F.concat(F.lit("T_"), F.col("p_type")).alias("name"), F.lit("class").alias("kind"), F.col("p_type").alias("label")).distinct()
    near = words.filter("first = 'red'").select(F.concat(F.lit("near_"), F.col("second")).alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("Redd "), F.col("second")).alias("label"))
    return unions([props, nouns, kinds, near])


MATCH = """feat AS (SELECT DISTINCT p_name AS feature FROM part), words AS (SELECT DISTINCT split_part(p_name,' ',1) AS first, split_part(p_name,' ',2) AS second FROM part),
ent AS (SELECT 'has_' || second || '_' || first AS entity, 'datatype_property' AS kind, second || '_' || first AS label FROM words WHERE first IN ('small','blue','red') UNION ALL SELECT DISTINCT 'C_' || second, 'class', second FROM words UNION ALL SELECT DISTINCT 'T_' || p_type, 'class', p_type FROM part
 UNION ALL SELECT 'near_' || second, 'class', 'Redd ' || second FROM words WHERE first = 'red'),
nf AS (SELECT feature, regexp_replace(lower(feature),'[^a-z0-9]+','','g') AS a, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(feature),'[^a-z0-9]+'), lambda x: x <> ''))) AS ta FROM feat),
ne AS (SELECT entity, kind, regexp_replace(lower(label),'[^a-z0-9]+','','g') AS b, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(label),'[^a-z0-9]+'), lambda x: x <> ''))) AS tb FROM ent),
sc AS (SELECT feature, entity, kind, max(round(CASE WHEN a=b THEN 1.0 WHEN ta=tb THEN 0.97 WHEN least(length(a),length(b)) >= 4 AND (contains(a,b) OR contains(b,a)) THEN 0.86
 ELSE greatest((1-levenshtein(a,b)::DOUBLE/greatest(length(a),length(b)))*0.90, len(list_intersect(ta,tb))::DOUBLE/len(list_distinct(list_concat(ta,tb)))*0.92) END, 9)) AS score FROM nf, ne GROUP BY 1, 2, 3),
cand AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, CASE kind WHEN 'class' THEN 0 ELSE 1 END, entity) AS pl, max(score) OVER (PARTITION BY feature) AS best FROM sc WHERE score >= 0.62),
per AS (SELECT feature, max(entity) FILTER (pl=1) AS e1, max(kind) FILTER (pl=1) AS k1, max(score) FILTER (pl=1) AS s1, max(entity) FILTER (pl=2) AS e2, max(kind) FILTER (pl=2) AS k2, max(score) FILTER (pl=2) AS s2, count_if(score >= best-1e-9) AS nt,
 count_if(score >= best-1e-9 AND kind='datatype_property') AS np, count_if(score >= best-1e-9 AND kind='class') AS nc, min(entity) FILTER (score >= best-1e-9 AND kind='datatype_property') AS prop, max(score) FILTER (kind <> 'class' AND NOT (score >= best-1e-9 AND kind='datatype_property')) AS rival FROM cand GROUP BY 1),
f1 AS (SELECT *, nt > 1 AND s1 >= 0.72 AS several FROM per), f2 AS (SELECT *, several AND np=1 AND np+nc=nt AS bytype, NOT several AND e2 IS NOT NULL AND s1-s2 < 0.08 AND k1='class' AND k2='datatype_property' AS swap FROM f1),
f3 AS (SELECT feature, CASE WHEN bytype THEN prop WHEN swap THEN e2 ELSE e1 END AS entity, CASE WHEN bytype THEN 'datatype_property' WHEN swap THEN k2 ELSE k1 END AS kind, CASE WHEN swap THEN s2 ELSE s1 END AS score,
 CASE WHEN bytype THEN s1-coalesce(rival,0) >= 0.08 WHEN several THEN false ELSE (CASE WHEN swap THEN s2 ELSE s1 END) >= 0.98 OR s1-coalesce(s2,0) >= 0.08 OR swap END AS ok FROM f2),
dec AS (SELECT feat.feature, entity, kind, score, CASE WHEN score IS NULL OR score < 0.72 THEN 'REJECTED_LOW_SCORE' WHEN ok THEN 'ACCEPTED' ELSE 'REJECTED_AMBIGUOUS' END AS status FROM feat LEFT JOIN f3 USING (feature)),
col AS (SELECT *, max(score) OVER w AS top, count(*) OVER w AS members FROM dec WINDOW w AS (PARTITION BY entity, status = 'ACCEPTED')), col2 AS (SELECT *, sum((score = top)::INT) OVER (PARTITION BY entity, status = 'ACCEPTED') AS winners FROM col),
res AS (SELECT feature, entity, kind, score, CASE WHEN status = 'ACCEPTED' AND members > 1 AND (score < top OR winners > 1) THEN 'REJECTED_ENTITY_COLLISION' ELSE status END AS status FROM col2)"""


def resolved(t):
    return ON.resolve_collisions(ON.match_features(part_features(t), part_entities(t)))


@query("on01_feature_matching", f"WITH {MATCH} SELECT * FROM dec", floats="score")
def _(t):
    return ON.match_features(part_features(t), part_entities(t))


@query("on02_collisions", f"WITH {MATCH} SELECT * FROM res", floats="score")
def _(t):
    return resolved(t)


@query("on03_quality_gate", f"""WITH {MATCH}, c AS (SELECT entity, count(*)::DOUBLE AS c FROM res WHERE status='ACCEPTED' GROUP BY 1), n AS (SELECT sum(c) AS n FROM c),
m AS (SELECT count(*) AS features, count_if(status='ACCEPTED') AS mapped, count(DISTINCT entity) FILTER (status='ACCEPTED') AS unique_entities, count_if(status='REJECTED_AMBIGUOUS') AS ambiguous, count_if(status='REJECTED_ENTITY_COLLISION') AS collisions FROM res)
SELECT *, mapped/features AS coverage, (SELECT -sum(c/n*ln(c/n))/ln(max(n)) FROM c, n) AS mapping_entropy, CASE WHEN mapped/features < 0.35 OR unique_entities < 2 THEN 'INSUFFICIENT_SCHEMA_COVERAGE' ELSE 'VALID_DOMAIN_ONTOLOGY' END AS status FROM m""",
       floats="coverage mapping_entropy", ints="features mapped unique_entities ambiguous collisions")
def _(t):
    return ON.quality_gate(resolved(t), part_entities(t)).select("features", "mapped", "unique_entities", "ambiguous", "collisions", "coverage", "mapping_entropy", "status")


@query("on03_richness", f"WITH {GRAPH_ENTITIES} SELECT count(DISTINCT name) AS entities, 1 AS sources, 'limited' AS level FROM gent", ints="entities sources")
def _(t):
    notes = t.nation.select(F.col("n_name").alias("entity"), F.lit("max").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return ON.richness(graph_entities(t), notes, edges(t))


@query("on04_taxonomy_depth", f"""WITH RECURSIVE {EDGES}, up AS (SELECT DISTINCT src, dst FROM edges WHERE relation <> 'equivalent'), nd AS (SELECT src AS node FROM up UNION SELECT dst FROM up),
w(node, d) AS (SELECT node, 0 FROM nd WHERE node NOT IN (SELECT src FROM up) UNION SELECT up.src, w.d+1 FROM up JOIN w ON up.dst = w.node),
g AS (SELECT node, max(d) AS longest, min(d) AS shortest FROM w GROUP BY 1) SELECT node, longest, shortest, shortest/(SELECT max(shortest) FROM g) AS relative FROM g""", floats="relative", ints="longest shortest")
def _(t):
    return ON.taxonomy_depth(edges(t).filter("relation <> 'equivalent'"))


CLOSURE = EDGES + """, nm AS (SELECT n.n_name AS node, coalesce(a.n_name, n.n_name) AS o FROM nation n LEFT JOIN nation a ON a.n_nationkey = n.n_nationkey - 20), nn AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
pr AS (SELECT n.n_name AS node, least(n.n_name, coalesce(x.n_name, y.n_name, n.n_name)) AS comp FROM nation n LEFT JOIN nation x ON x.n_nationkey = n.n_nationkey + 20 LEFT JOIN nation y ON y.n_nationkey = n.n_nationkey - 20),
mem AS (SELECT nn.node, coalesce(pr.comp, nn.node) AS comp FROM nn LEFT JOIN pr USING (node)), st AS (SELECT DISTINCT a.comp AS f, b.comp AS g FROM edges JOIN mem a ON a.node = src JOIN mem b ON b.node = dst WHERE relation <> 'equivalent' AND a.comp <> b.comp),
cl(f, g, hops) AS (SELECT DISTINCT comp, comp, 0 FROM mem UNION SELECT cl.f, st.g, hops+1 FROM cl JOIN st ON st.f = cl.g), cm AS (SELECT f, g, min(hops) AS hops FROM cl GROUP BY 1, 2),
up AS (SELECT a.node, b.node AS ancestor, hops FROM cm JOIN mem a ON a.comp = cm.f JOIN mem b ON b.comp = cm.g WHERE a.node <> b.node)"""


@query("on05_closure", f"WITH RECURSIVE {CLOSURE} SELECT * FROM up", ints="hops")
def _(t):
    return ON.closure(edges(t))


UND = EDGES + """, un AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, CASE relation WHEN 'equivalent' THEN 1.0 WHEN 'subsumption' THEN 0.88 WHEN 'domain' THEN 0.68 END::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, CASE relation WHEN 'equivalent' THEN 1.0 WHEN 'subsumption' THEN 0.88 WHEN 'domain' THEN 0.68 END::DOUBLE FROM edges) GROUP BY 1, 2)"""
REL = UND + ", r1 AS (SELECT src AS start, dst AS node, w AS strength FROM un WHERE src IN (SELECT n_name FROM nation))" + "".join(
    f", r{k} AS (SELECT start, node, max(strength) AS strength FROM (SELECT * FROM r{k - 1} UNION ALL SELECT start, dst, strength*w*0.92::DOUBLE FROM r{k - 1} JOIN un ON src = node) GROUP BY 1, 2)" for k in range(2, 7))


@query("on06_relatedness", f"WITH {REL} SELECT start, node, strength FROM r6 WHERE start <> node", floats="strength")
def _(t):
    return ON.relatedness(edges(t), t.nation.select(F.col("n_name").alias("node")))


@query("on07_path_length", f"""WITH RECURSIVE {UND}, w(start, node, length) AS (SELECT r_name, r_name, 0 FROM region UNION SELECT start, dst, length+1 FROM w JOIN un ON src = node WHERE length < 6) SELECT start, node, min(length) AS length FROM w GROUP BY 1, 2""", ints="length")
def _(t):
    return ON.path_length(edges(t), t.region.select(F.col("r_name").alias("node")))


def mapping(t):
    """Suppliers play the columns: each maps to the class of its nation."""
    return t.supplier.join(t.nation, t.supplier.s_nationkey == t.nation.n_nationkey).select(F.col("s_name").alias("feature"), F.col("n_name").alias("entity"),
                                                                                          (0.7 + (F.col("s_suppkey") % 4) * 0.1).alias("score"), (F.col("s_suppkey") % 10 == 0).alias("derived"))


MAPPING = "mp AS (SELECT s_name AS feature, n_name AS entity, 0.7 + (s_suppkey % 4)*0.1 AS score, s_suppkey % 10 = 0 AS derived FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("on08_feature_groups", f"""WITH {EDGES}, {MAPPING}, nb AS (SELECT src AS entity, dst AS o FROM edges WHERE relation IN ('subsumption','domain','equivalent') UNION ALL SELECT dst, src FROM edges WHERE relation IN ('subsumption','domain','equivalent')),
g AS (SELECT entity, min(o) AS grp FROM nb WHERE o NOT IN ('THING','WORLD') GROUP BY 1) SELECT feature, coalesce(grp, entity) AS grp FROM mp LEFT JOIN g USING (entity)""")
def _(t):
    return ON.feature_groups(mapping(t), edges(t), ["THING", "WORLD"])


@query("on09_graph_summary", f"""WITH {EDGES}, {GRAPH_ENTITIES}, rr AS (SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b, relation FROM edges) SELECT kind AS name, count(*) AS n, 'kind' AS part FROM (SELECT DISTINCT name, kind FROM gent) GROUP BY 1 UNION ALL SELECT relation, count(*), 'relation' FROM rr GROUP BY 1""", ints="n")
def _(t):
    return ON.graph_summary(graph_entities(t), edges(t))


IC = CLOSURE + ", " + MAPPING + """, rch AS (SELECT feature, entity AS concept FROM mp UNION SELECT feature, ancestor FROM mp JOIN up ON up.node = mp.entity), icc AS (SELECT concept, count(*) AS n, -ln(count(*)/(SELECT count(DISTINCT feature) FROM mp)) AS ic FROM rch GROUP BY 1)"""


@query("on10_concept_relatedness", f"""WITH RECURSIVE {IC}, dw(node, d) AS (SELECT 'THING', 0 UNION SELECT edges.src, dw.d+1 FROM edges JOIN dw ON edges.dst = dw.node WHERE relation <> 'equivalent'), dd AS (SELECT node, max(d) AS d FROM dw GROUP BY 1),
re AS (SELECT n_name AS node, n_name AS anc FROM nation UNION ALL SELECT n_name, ancestor FROM nation JOIN up ON up.node = n_name), tg AS (SELECT re.node, anc, dd.d, coalesce(ic, 0) AS ic FROM re JOIN dd ON dd.node = re.anc LEFT JOIN icc ON icc.concept = re.anc),
cp AS (SELECT a.node AS left_node, b.node AS right_node, max(a.d) AS d, max(a.ic) AS sic FROM tg a JOIN re b ON b.anc = a.anc AND a.node < b.node GROUP BY 1, 2),
ow AS (SELECT n_name AS node, dd.d AS od, coalesce(ic, 0) AS oic FROM nation JOIN dd ON dd.node = n_name LEFT JOIN icc ON icc.concept = n_name)
SELECT left_node, right_node, CASE WHEN l.od+r.od <> 0 THEN 2.0::DOUBLE*cp.d/(l.od+r.od) ELSE 0 END AS wu_palmer, CASE WHEN l.oic+r.oic > 1e-12 THEN least(1.0::DOUBLE, 2*sic/(l.oic+r.oic)) ELSE 0 END AS lin FROM cp JOIN ow l ON l.node = left_node JOIN ow r ON r.node = right_node""", floats="wu_palmer lin")
def _(t):
    e = edges(t)
    up = ON.closure(e)
    depth = ON.taxonomy_depth(e.filter("relation <> 'equivalent'"))
    return ON.concept_pairs(t.nation.select(F.col("n_name").alias("node")), up, depth, ON.information_content(mapping(t), up))


@query("on11_semantic_units", f"""WITH RECURSIVE {IC}, ext AS (SELECT concept, list_sort(list(feature)) AS fs, count(*) AS size FROM rch GROUP BY 1) SELECT max(concept) AS concept, size, -ln(size/(SELECT count(DISTINCT feature) FROM mp)) AS ic FROM ext
WHERE size >= 2 AND size < (SELECT count(DISTINCT feature) FROM mp) GROUP BY fs, size""", floats="ic", ints="size")
def _(t):
    return ON.semantic_units(mapping(t), ON.closure(edges(t)))


def metadata(t):
    """Nations play the columns: entity = name, family = last digit of the key, superclass = region."""
    n = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey)
    return n.select(F.concat(F.lit("f_"), F.col("n_name")).alias("feature"), F.col("n_name").alias("entity"), F.when(F.col("n_nationkey") < 20, F.concat(F.lit("fam"), F.col("n_nationkey") % 10)).alias("family"), F.col("r_name").alias("superclass"),
                    (F.col("n_nationkey") >= 22).alias("derived"), (F.col("n_nationkey") / 30).alias("score"))


def sources(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.col("a.n_nationkey") - 20 == F.col("b.n_nationkey")).filter("a.n_nationkey >= 22").select(F.concat(F.lit("f_"), F.col("a.n_name")).alias("feature"), F.concat(F.lit("f_"), F.col("b.n_name")).alias("source"))


META = """md AS (SELECT 'f_' || n_name AS feature, n_name AS entity, CASE WHEN n_nationkey < 20 THEN 'fam' || (n_nationkey % 10) END AS family, r_name AS superclass, n_nationkey >= 22 AS derived, n_nationkey/30 AS score, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
so AS (SELECT a.feature, b.feature AS source FROM md a JOIN md b ON b.k = a.k - 20 WHERE a.k >= 22)"""


@query("on12_metadata_relatedness", f"""WITH {REL}, {META}, pp AS (SELECT a.feature AS left_feature, b.feature AS right_feature, CASE WHEN a.entity = b.entity THEN 0.9 END AS e, CASE WHEN a.family = b.family THEN 0.7 END AS f, CASE WHEN a.superclass = b.superclass THEN 0.5 END AS s,
 CASE WHEN EXISTS (SELECT 1 FROM so WHERE (so.feature = a.feature AND so.source = b.feature) OR (so.feature = b.feature AND so.source = a.feature)) THEN 0.8 END AS l, least(0.45*r6.strength, 0.5*0.99) AS g FROM md a JOIN md b ON a.feature < b.feature LEFT JOIN r6 ON r6.start = a.entity AND r6.node = b.entity)
SELECT left_feature, right_feature, coalesce(greatest(e, f, s, l), g) AS value FROM pp WHERE coalesce(e, f, s, l, g) IS NOT NULL""", floats="value")
def _(t):
    graph = ON.relatedness(edges(t), t.nation.select(F.col("n_name").alias("node")))
    return ON.metadata_relatedness(metadata(t), sources(t), graph)


@query("on13_split_weights", f"""WITH {META}, o AS (SELECT feature, CASE WHEN derived THEN NULL ELSE 1+0.35*score END AS own, derived FROM md), c AS (SELECT so.feature, max(own) AS ceiling FROM so JOIN o ON o.feature = so.source GROUP BY 1)
SELECT o.feature, derived, coalesce(own, ceiling, 1) AS weight, ceiling FROM o LEFT JOIN c USING (feature)""", floats="weight ceiling")
def _(t):
    return ON.split_weights(metadata(t), sources(t))


@query("on13_double_counting", f"""WITH {META}, o AS (SELECT feature, 1+0.35*score AS own, derived FROM md), c AS (SELECT so.feature, max(own) AS ceiling FROM so JOIN o ON o.feature = so.source GROUP BY 1) SELECT o.feature, derived, own + 1 AS weight, ceiling FROM o JOIN c USING (feature) WHERE derived""", floats="weight ceiling")
def _(t):
    w = ON.split_weights(metadata(t), sources(t))
    raised = metadata(t).select("feature", (2 + 0.35 * F.col("score")).alias("raised"))
    return ON.double_counting(w.join(raised, "feature").withColumn("weight", F.when(F.col("derived"), F.col("raised")).otherwise(F.col("weight"))).drop("raised"))


# ---------------------------------------------------------------- derived columns

SPECS = D.hierarchy_specs({"qty": "amount", "price": "amount", "disc": "rate", "tax": "rate"})
STATS = f"st AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM observed)"


@query("on14_hierarchy_means", f"WITH {OBSERVED}, {STATS} SELECT y, avg(((qty-a_qty)/s_qty+(price-a_price)/s_price)/2) AS amount_mean, stddev_pop(((disc-a_disc)/s_disc+(tax-a_tax)/s_tax)/2) AS rate_spread FROM observed, st GROUP BY y", floats="amount_mean rate_spread")
def _(t):
    rows = observed(t)
    out = D.apply_specs(rows, SPECS, P.fit_scales(rows, FEATURES))
    return out.groupBy("y").agg(F.avg("amount_mean").alias("amount_mean"), F.stddev_pop("rate_mean").alias("rate_spread"))


ROLES = {"cost": {"mean": "mean_price", "worst": "worst_price", "error": "sd_price"}}


def supplier_stats(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("skey")).agg(F.avg("l_extendedprice").alias("mean_price"), F.max("l_extendedprice").alias("worst_price"), F.stddev_samp("l_extendedprice").alias("sd_price"))


SUPPLIER_STATS = "ss AS (SELECT l_suppkey AS skey, avg(l_extendedprice) AS mean_price, max(l_extendedprice) AS worst_price, stddev_samp(l_extendedprice) AS sd_price FROM lineitem GROUP BY 1)"


@query("on15_family_relations", f"""WITH {SUPPLIER_STATS} SELECT skey, worst_price-mean_price AS cost_worst_minus_mean, (worst_price-mean_price)/greatest(abs(mean_price),1e-12) AS cost_relative_worst_delta, (worst_price-mean_price)/greatest(abs(worst_price)+abs(mean_price),1e-12) AS cost_family_contrast,
 abs(sd_price)/greatest(abs(mean_price)+abs(worst_price),1e-12) AS cost_normalized_error, sd_price/greatest(abs(mean_price),1e-12) AS cost_error_ratio FROM ss""", floats="cost_worst_minus_mean cost_relative_worst_delta cost_family_contrast cost_normalized_error cost_error_ratio", ints="skey")
def _(t):
    return D.apply_specs(supplier_stats(t), D.family_specs(ROLES)).drop("mean_price", "worst_price", "sd_price")


DECLARED = [("Price", "ratio:Qty"), ("Price", "ratio:Qty:2:1"), ("Disc", "sum:Tax"), ("Disc", "power:Tax"), ("Disc", "ratio:Unknown"), ("Tax", "product:Qty:a:1"), ("Tax", "product:Qty:0:1"), ("Tax", "difference:Disc")]
COLUMN_OF = {"Price": "price", "Qty": "qty", "Disc": "disc", "Tax": "tax"}


@query("on16_declared_relations", f"""WITH {OBSERVED} SELECT y, avg(price/qty) AS price_per_qty, avg(price*price/qty)/1000000 AS square_ratio, avg(disc+tax) AS rate_sum, avg(tax-disc) AS rate_gap, 4 AS rejected FROM observed GROUP BY y""", floats="price_per_qty square_ratio rate_sum rate_gap", ints="rejected")
def _(t):
    good, bad = D.declared_specs(t.spark.createDataFrame(DECLARED, "entity string, value string"), COLUMN_OF)
    specs = [dict(s, name=f"d{i}") for i, s in enumerate(sorted(good, key=lambda s: (s["kind"], s["p"])))]  # difference, ratio, ratio of squares, sum
    out = D.apply_specs(observed(t), specs).groupBy("y").agg(F.avg("d1").alias("price_per_qty"), (F.avg("d2") / 1000000).alias("square_ratio"), F.avg("d3").alias("rate_sum"), F.avg("d0").alias("rate_gap"))
    return out.withColumn("rejected", F.lit(bad.count()))


@query("on17_bound_flags", f"""WITH {OBSERVED}, q AS (SELECT quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM observed) SELECT y, sum((qty >= 5)::INT) AS qty_min, sum((disc <= 0.08)::INT) AS disc_max, sum((price >= lo)::INT) AS price_min, sum((price <= hi)::INT) AS price_max FROM observed, q GROUP BY y""", ints="qty_min disc_max price_min price_max")
def _(t):
    rows = observed(t)
    specs = D.bound_specs({"qty": (5.0, None), "disc": (None, 0.08)}, rows, ["price"])
    out = D.apply_specs(rows, specs)
    return out.groupBy("y").agg(F.sum("qty_within_min").alias("qty_min"), F.sum("disc_within_max").alias("disc_max"), F.sum("price_within_min").alias("price_min"), F.sum("price_within_max").alias("price_max"))


@query("on18_category_codes", "SELECT n_name AS value, r_name AS grp, r_regionkey + 1 AS code, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3", ints="code suppliers")
def _(t):
    groups = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey).select(F.col("n_name").alias("value"), F.col("r_name").alias("grp"))
    codes = D.category_codes(t.nation.select(F.col("n_name").alias("value")), groups)
    count = t.nation.join(t.supplier, t.supplier.s_nationkey == t.nation.n_nationkey, "left").groupBy(F.col("n_name").alias("value")).agg(F.count("s_suppkey").alias("suppliers"))
    return codes.join(count, "value")


@query("on19_apply_specs", f"WITH {OBSERVED}, tr AS (SELECT * FROM observed WHERE status = 'F'), {STATS.replace('FROM observed', 'FROM tr')} SELECT lno, count(*) AS n, avg(((qty-a_qty)/s_qty+(price-a_price)/s_price)/2) AS amount_mean FROM observed, st WHERE status = 'O' GROUP BY lno", floats="amount_mean", ints="lno n")
def _(t):
    rows = observed(t)
    out = D.apply_specs(rows.filter("status = 'O'"), SPECS, P.fit_scales(rows.filter("status = 'F'"), FEATURES))
    return out.groupBy("lno").agg(F.count(F.lit(1)).alias("n"), F.avg("amount_mean").alias("amount_mean"))


@query("on20_fold_recalibration", f"""WITH {OBSERVED}, l AS ({' UNION ALL '.join(f"SELECT okey % 5 AS fold, '{c}' AS feature, {c} AS v FROM observed" for c in FEATURES)}), f AS (SELECT unnest(range(5)) AS fold) SELECT f.fold, feature, avg(v) AS centre, stddev_pop(v) AS scale FROM f JOIN l ON l.fold <> f.fold GROUP BY 1, 2""", floats="centre scale", ints="fold")
def _(t):
    return D.refit_by_fold(observed(t).withColumn("fold", F.col("okey") % 5), "fold", FEATURES).select("fold", "feature", "centre", "scale")


NEW = [dict(name="per_unit", kind="declared_ratio", sources=["price", "qty"], p=1.0, q=1.0), dict(name="price", kind="difference", sources=["price", "tax"]), dict(name="always", kind="ge", sources=["qty"], limit=0.0), dict(name="rare", kind="ge", sources=["qty"], limit=50.0),
       dict(name="copy", kind="declared_sum", sources=["tax", "tax"], p=1.0, q=1.0), dict(name="nearly", kind="difference", sources=["price", "tax"]), dict(name="gap", kind="difference", sources=["disc", "tax"])]


@query("on21_novelty_filter", f"""WITH {OBSERVED} SELECT v.feature, v.accepted, v.reason, v.duplicate_of, count(*) AS rows FROM observed, (VALUES ('per_unit', true, NULL, NULL), ('price', false, 'name_collision', NULL), ('always', false, 'constant', NULL), ('rare', false, 'low_variance', NULL),
 ('copy', false, 'near_duplicate', 'tax'), ('nearly', false, 'near_duplicate', 'price'), ('gap', true, NULL, NULL)) v(feature, accepted, reason, duplicate_of) GROUP BY ALL""", ints="rows")
def _(t):
    rows = observed(t)
    made = D.apply_specs(rows, [s for s in NEW if s["name"] != "price"])
    _, audit = D.novelty(made, NEW, FEATURES, low_variance=0.97)
    n = rows.groupBy().agg(F.count(F.lit(1)).alias("rows"))
    table = t.spark.createDataFrame([(a["feature"], a["accepted"], a["reason"], a["duplicate_of"]) for a in audit], "feature string, accepted boolean, reason string, duplicate_of string")
    return table.withColumn("rows", n.scalar())


@query("on22_linear_redundancy", f"WITH {OBSERVED} SELECT 'gap_on_disc' AS what, regr_r2(disc-tax, disc) AS r2 FROM observed UNION ALL SELECT 'gap_on_both', 1.0 UNION ALL SELECT 'per_unit_on_price', regr_r2(price/qty, price) FROM observed", floats="r2")
def _(t):
    rows = observed(t).withColumns({"gap": F.col("disc") - F.col("tax"), "per_unit": F.col("price") / F.col("qty")})
    m = D.gram(rows, ["price", "disc", "tax", "gap", "per_unit"])
    found = [("gap_on_disc", D.r_squared(m, 4, [2])), ("gap_on_both", D.r_squared(m, 4, [2, 3])), ("per_unit_on_price", D.r_squared(m, 5, [1]))]
    return t.spark.createDataFrame(found, "what string, r2 double")


@query("on23_union_columns", f"""WITH {OBSERVED} SELECT y, sum(greatest((qty > 40)::INT, (qty < 5)::INT)) AS any_extreme, sum(greatest((disc > 0.08)::INT, (tax > 0.06)::INT)) AS any_rated FROM observed GROUP BY y""", ints="any_extreme any_rated")
def _(t):
    rows = observed(t).withColumns({"q_big": (F.col("qty") > 40).cast("int"), "q_small": (F.col("qty") < 5).cast("int"), "q_all": (F.col("qty") > 0).cast("int"), "r_disc": (F.col("disc") > 0.08).cast("int"), "r_tax": (F.col("tax") > 0.06).cast("int")})
    family = {"q_big": "q", "q_small": "q", "q_all": "q", "r_disc": "r", "r_tax": "r"}
    made, _ = D.union_columns(rows, {"extreme": ["q_big", "q_small"], "again": ["q_small", "q_big", "q_all"], "rated": ["r_disc", "r_tax"], "mixed": ["q_big", "r_tax"]}, family)
    return made.groupBy("y").agg(F.sum("any_extreme").alias("any_extreme"), F.sum("any_rated").alias("any_rated"))


BOUNDS = {"qty": (1.0, 45.0, True), "price": (0.0, None, False), "disc": (0.0, 0.1, False)}


@query("on24_applicable_bounds", f"""WITH {OBSERVED}, b AS (SELECT 'qty' AS feature, avg((qty BETWEEN 1 AND 45)::INT) AS in_range, avg((abs(qty-round(qty)) <= 1e-9)::INT) AS whole, true AS i FROM observed UNION ALL SELECT 'price', avg((price >= 0)::INT), avg((abs(price-round(price)) <= 1e-9)::INT), false FROM observed
UNION ALL SELECT 'disc', avg((disc BETWEEN 0 AND 0.1::DOUBLE)::INT), avg((abs(disc-round(disc)) <= 1e-9)::INT), false FROM observed) SELECT feature, in_range, whole, in_range >= 0.99 AS range_applies, i AND whole >= 0.99 AS integer_applies FROM b""", floats="in_range whole")
def _(t):
    return D.applicable_bounds(observed(t), BOUNDS).select("feature", "in_range", "whole", "range_applies", "integer_applies")


@query("on25_domain_projection", f"""WITH {OBSERVED}, k AS (SELECT y, qty*1.13::DOUBLE AS qty, price-20000 AS price FROM observed) SELECT y, sum((qty BETWEEN 1 AND 45 AND abs(qty-round(qty)) <= 1e-9 AND price >= 0)::INT) AS valid_before, avg(least(45, greatest(1, round(qty)))) AS qty, avg(greatest(0, price)) AS price FROM k GROUP BY y""", floats="qty price", ints="valid_before")
def _(t):
    rows = observed(t).select("y", (F.col("qty") * 1.13).alias("qty"), (F.col("price") - 20000).alias("price"))
    lim = {"qty": (1.0, 45.0, True), "price": (0.0, None, False)}
    fixed = D.project_to_domain(rows.withColumn("ok", D.validity(rows, lim).cast("int")), lim)
    return fixed.groupBy("y").agg(F.sum("ok").alias("valid_before"), F.avg("qty").alias("qty"), F.avg("price").alias("price"))


@query("on26_shuffled_control")
def _(t):
    s = ON.shuffled_mapping(metadata(t).select("feature", "entity"), 5)
    return s.agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("entity") == F.col("control_entity")).alias("kept"), F.count_distinct("control_entity").alias("entities"))


@query("on27_destructive_permutation")
def _(t):
    g = metadata(t).select("feature", F.col("superclass").alias("grp"), F.ntile(2).over(Window.partitionBy(F.lit(0)).orderBy("score")).alias("stratum"))
    return ON.destructive_permutations(g, 7)


@query("on28_control_validity", f"WITH {OBSERVED} SELECT greatest(stddev_pop(price/qty), stddev_pop(disc-tax)) AS real, greatest(stddev_pop(price/greatest(disc, 0.01)), stddev_pop(qty-tax)) AS control, 0 AS not_finite, true AS same_width, greatest(stddev_pop(price/greatest(disc, 0.01)), stddev_pop(qty-tax)) <= 100*greatest(stddev_pop(price/qty), stddev_pop(disc-tax)) AS valid FROM observed", floats="real control", ints="not_finite")
def _(t):
    rows = observed(t)
    real = rows.select((F.col("price") / F.col("qty")).alias("a"), (F.col("disc") - F.col("tax")).alias("b"))
    control = rows.select((F.col("price") / F.greatest("disc", F.lit(0.01))).alias("a"), (F.col("qty") - F.col("tax")).alias("b"))
    return D.control_validity(real, control, ["a", "b"], ["a", "b"])


@query("on29_coherence", f"""WITH {OBSERVED}, k AS (SELECT okey, price/qty + CASE WHEN okey % 50 = 0 THEN 100 ELSE 0 END AS per_unit, price/qty AS again, disc-tax AS gap FROM observed), s AS (SELECT stddev_pop(per_unit) AS su FROM k),
g AS (SELECT round(abs(per_unit-again)/su, 9) AS worst, (abs(per_unit-again)/su)/2 AS m FROM k, s) SELECT avg((worst > 1e-8)::INT) AS violation_rate, avg(m) AS mean_gap, quantile_cont(worst, 0.9) AS p90 FROM g""", floats="violation_rate mean_gap p90")
def _(t):
    specs = [NEW[0], NEW[6]]
    rows = D.apply_specs(observed(t), specs).withColumn("per_unit", F.col("per_unit") + F.when(F.col("okey") % 50 == 0, 100.0).otherwise(0.0))
    return D.coherence(rows, specs)


@query("on30_domain_report", f"""WITH {OBSERVED}, tr AS (SELECT min(qty) AS ql, max(qty) AS qh, stddev_pop(qty) AS qs, min(price) AS pl, max(price) AS ph, stddev_pop(price) AS ps FROM observed WHERE status='F'), k AS (SELECT qty+0.5*(lno-4) AS qty, price*1.1::DOUBLE AS price, y FROM observed WHERE status='O'),
e AS (SELECT (greatest(ql-qty,0)+greatest(qty-qh,0))/qs AS a, (greatest(pl-price,0)+greatest(price-ph,0))/ps AS b, abs(qty-round(qty)) > 1e-9 AS br FROM k, tr) SELECT count(*) AS rows, avg((a > 0 OR b > 0)::INT) AS out_of_range, avg((a+b)/2) AS mean_excess, max(greatest(a, b)) AS max_excess, avg(br::INT) AS broken_integers, 0.0 AS unseen_categories FROM e""",
       floats="out_of_range mean_excess max_excess broken_integers unseen_categories", ints="rows")
def _(t):
    rows = observed(t)
    moved = rows.filter("status = 'O'").withColumns({"qty": F.col("qty") + 0.5 * (F.col("lno") - 4), "price": F.col("price") * 1.1})
    return D.domain_report(moved, rows.filter("status = 'F'"), ["qty", "price"], ["y"])


GATED = RUNS + """, gr AS (SELECT dataset, split_id, arm, max(value) FILTER (metric='fidelity') AS fid, max(value) FILTER (metric='accuracy') AS acc, max(n_test) AS n FROM runs GROUP BY 1, 2, 3)"""


def arm_rows(t):
    cell = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return runs(t).groupBy("dataset", "split_id", "arm").agg(cell("fidelity").alias("fid"), cell("accuracy").alias("acc"), F.max("n_test").alias("n"))


@query("on31_usage_category", f"""WITH {GATED}, u AS (SELECT dataset, split_id, arm, CASE WHEN fid > 0.79 THEN 2 ELSE 0 END AS sp, CASE WHEN acc > 0.34 THEN 1 ELSE 0 END AS uf, n < 650 AS mirrored, arm <> 'plain' AS valid, arm = 'shuffled' AS control FROM gr WHERE arm <> 'teacher')
SELECT dataset, split_id, arm, CASE WHEN (sp > 0 OR uf > 0) AND NOT mirrored AND valid AND NOT control THEN 'ontology_effectively_used' WHEN NOT valid THEN 'ontology_invalid_or_unmapped' ELSE 'ontology_available_but_not_effective' END AS category FROM u""", ints="dataset split_id")
def _(t):
    rows = arm_rows(t).filter("arm <> 'teacher'").withColumns({"semantic_splits": F.when(F.col("fid") > 0.79, 2).otherwise(0), "semantic_features_used": F.when(F.col("acc") > 0.34, 1).otherwise(0), "mirrored": F.col("n") < 650,
                                                              "valid": F.col("arm") != "plain", "control": F.col("arm") == "shuffled", "mapped": F.lit(3), "generated": F.lit(2)})
    return ON.usage_category(rows).select("dataset", "split_id", "arm", "category")


@query("on32_allowed_space", f"""WITH {META}, g AS (SELECT feature, CASE WHEN k = 24 THEN NULL ELSE superclass END AS grp, k FROM md), al AS (SELECT a.feature AS x, b.feature AS y FROM g a JOIN g b ON a.feature < b.feature WHERE a.grp IS NULL OR b.grp IS NULL OR a.grp = b.grp OR (abs(a.k-b.k) = 10))
SELECT (SELECT count(*) FROM al)/(25*24/2) AS pair_share, (SELECT count(*) FROM al p JOIN al q ON q.x = p.y JOIN al r ON r.x = p.x AND r.y = q.y)/(25*24*23/6) AS triple_share, (SELECT count(*) FROM g) AS features""", floats="pair_share triple_share", ints="features")
def _(t):
    g = metadata(t).select("feature", F.when(F.col("entity") == "NATION_24", "general").otherwise(F.col("superclass")).alias("grp"))
    a, b = t.nation.alias("a"), t.nation.alias("b")
    near = a.join(b, F.col("a.n_nationkey") + 10 == F.col("b.n_nationkey")).select(F.concat(F.lit("f_"), F.col("a.n_name")).alias("left_feature"), F.concat(F.lit("f_"), F.col("b.n_name")).alias("right_feature"), F.lit(0.6).alias("value"))
    return ON.allowed_space(g, near)


@query("on33_centrality", f"""WITH {EDGES}, {MAPPING}, k AS (SELECT dst AS entity, count(DISTINCT src) AS kids FROM edges WHERE relation='subsumption' GROUP BY 1), m2 AS (SELECT feature, CASE WHEN derived THEN r_name ELSE entity END AS entity, score, derived FROM mp JOIN nation ON n_name = entity JOIN region ON r_regionkey = n_regionkey)
SELECT feature, least(1.0::DOUBLE, 0.42*score + 0.38*coalesce(kids/greatest((SELECT max(kids) FROM k), 1), 0) + CASE WHEN derived THEN 0.12 ELSE 0 END + 0.08) AS centrality FROM m2 LEFT JOIN k USING (entity)""", floats="centrality")
def _(t):
    up = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey).select(F.col("n_name").alias("entity"), "r_name")
    m = mapping(t).join(up, "entity").withColumn("entity", F.when(F.col("derived"), F.col("r_name")).otherwise(F.col("entity"))).drop("r_name")
    return ON.centrality(m, edges(t))


@query("on34_dependencies", f"""WITH {EDGES}, m AS (SELECT 'f_' || n_name AS feature, n_name AS entity FROM nation UNION ALL SELECT 'f_' || r_name, r_name FROM region UNION ALL SELECT 'f_' || s_name, s_name FROM supplier)
SELECT a.feature AS dependent, b.feature AS base, max(CASE relation WHEN 'subsumption' THEN 0.55 ELSE 0.65 END) AS strength FROM edges JOIN m a ON a.entity = src JOIN m b ON b.entity = dst WHERE relation IN ('subsumption','domain') AND a.feature <> b.feature GROUP BY 1, 2""", floats="strength")
def _(t):
    f = lambda df, c: df.select(F.concat(F.lit("f_"), F.col(c)).alias("feature"), F.col(c).alias("entity"))
    return ON.dependencies(unions([f(t.nation, "n_name"), f(t.region, "r_name"), f(t.supplier, "s_name")]), edges(t))


@query("on34_name_dependencies", """WITH m AS (SELECT DISTINCT p_name AS feature, 'T_' || split_part(p_name,' ',1) AS entity FROM part), pr AS (SELECT DISTINCT split_part(p_name,' ',2) AS property, 'T_small' AS domain FROM part)
SELECT DISTINCT m.feature AS dependent, b.feature AS base, 0.5 AS strength FROM m JOIN pr ON contains(lower(m.feature), lower(property)) OR contains(lower(property), lower(m.feature)) JOIN m b ON b.entity = domain WHERE m.feature <> b.feature""", floats="strength")
def _(t):
    w = F.split("p_name", " ")
    m = t.part.select(F.col("p_name").alias("feature"), F.concat(F.lit("T_"), w[0]).alias("entity")).distinct()
    return ON.name_dependencies(m, t.part.select(w[1].alias("property"), F.lit("T_small").alias("domain")).distinct())


@query("on35_information_audit")
def _(t):
    specs = [NEW[0], NEW[6], SPECS[1]]
    rows = observed(t)
    made = D.apply_specs(rows, specs, P.fit_scales(rows, FEATURES))
    audit = D.information_audit(made, specs, FEATURES, by_name=[["price", "qty"]])
    return t.spark.createDataFrame([(a["feature"], a["kind"], round(a["r2_sources"], 6), round(a["r2_all"], 6), a["classification"]) for a in audit], "feature string, kind string, r2_sources double, r2_all double, classification string")


GATE = GATED + """, gw AS (SELECT f.dataset, avg(f.fid-c.fid) AS gain, avg(f.fid-c.fid)-1.96*stddev_samp(f.fid-c.fid)/sqrt(count(*)) AS lo, avg(f.fid-c.fid)+1.96*stddev_samp(f.fid-c.fid)/sqrt(count(*)) AS hi, avg(f.acc-c.acc) AS db, avg((f.fid > c.fid)::INT) AS usage, avg((f.acc > c.acc)::INT) AS impact
 FROM gr f JOIN gr c ON c.dataset = f.dataset AND c.split_id = f.split_id AND c.arm = 'core' WHERE f.arm = 'full' GROUP BY 1)"""


def gate_rows(t):
    rows = arm_rows(t)
    c = rows.filter("arm = 'core'").select("dataset", "split_id", F.col("fid").alias("cf"), F.col("acc").alias("ca"))
    both = rows.filter("arm = 'full'").join(c, ["dataset", "split_id"])
    d = F.col("fid") - F.col("cf")
    half = 1.96 * F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))
    return both.groupBy("dataset").agg(F.avg(d).alias("gain"), (F.avg(d) - half).alias("ci_low"), (F.avg(d) + half).alias("ci_high"), F.avg(F.col("acc") - F.col("ca")).alias("d_balanced"),
                                       F.avg((F.col("fid") > F.col("cf")).cast("double")).alias("usage"), F.avg((F.col("acc") > F.col("ca")).cast("double")).alias("impact"))


@query("on36_enrichment_decision", f"""WITH {GATE} SELECT dataset, CASE WHEN hi < 0 OR gain < -0.01 THEN 'REJECT_DEGRADATION' WHEN lo > 0 THEN 'ACCEPT_PARTIAL_FEATURE_SET' WHEN lo >= -0.01 AND db >= -0.01 AND greatest(gain, db) >= 0.01 THEN 'ACCEPT_PARTIAL_FEATURE_SET' ELSE 'REJECT_NO_INFORMATIONAL_GAIN' END AS decision FROM gw""", ints="dataset")
def _(t):
    rows = gate_rows(t).withColumns({"stable": F.lit(2), "pool": F.lit(4), "d_minority": F.col("gain"), "d_f1": F.col("d_balanced")})
    return ON.enrichment_decision(rows).select("dataset", "decision")


@query("on36_contribution_gate", f"""WITH {GATE}, r AS (SELECT *, concat_ws(',', CASE WHEN usage >= 0.7 THEN NULL ELSE 'ontology_usage_below_threshold' END, CASE WHEN impact >= 0.5 THEN NULL ELSE 'semantic_decision_impact_below_threshold' END, CASE WHEN gain >= 0.004 THEN NULL ELSE 'fidelity_gain_below_threshold' END,
 CASE WHEN db >= -0.01 THEN NULL ELSE 'balanced_accuracy_loss_exceeded' END) AS reasons FROM gw) SELECT dataset, reasons, CASE WHEN reasons = '' THEN 'SEMANTIC_CONTRIBUTION_SUPPORTED' WHEN gain < 0.004 THEN 'SEMANTIC_EFFECT_WITHOUT_FIDELITY_GAIN' ELSE 'SEMANTIC_CONTRIBUTION_NOT_SUPPORTED' END AS status FROM r""", ints="dataset")
def _(t):
    rows = gate_rows(t).withColumns({"d_fidelity": F.col("gain"), "d_f1": F.lit(0.0), "growth": F.lit(0.2)})
    return ON.contribution_gate(rows, min_usage=0.7, min_impact=0.5, min_fidelity=0.004).select("dataset", "reasons", "status")


@query("on37_match_statistics", f"WITH {MATCH} SELECT coalesce(kind, 'none') AS kind, count(*) AS features, count_if(status='ACCEPTED') AS mapped, count_if(status<>'ACCEPTED') AS unmapped, avg(score) FILTER (status='ACCEPTED') AS mean_score, avg((status='ACCEPTED')::INT) AS rate FROM res GROUP BY 1", floats="mean_score rate", ints="features mapped unmapped")
def _(t):
    return ON.match_statistics(resolved(t))


@query("on37_match_digest")
def _(t):
    return ON.match_digest(resolved(t))
