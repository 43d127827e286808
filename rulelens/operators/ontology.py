"""Ontology tables: matching columns to entities, walking the graph, and semantic measures.

Tables: entity(name, kind, label), edge(src, dst, relation) with src below dst, annotation(entity, key, value).
Walks are repeated joins of (start, reached) with the edge table plus a loop at every node, so each round reads the
previous one once; starts are schema columns or classes, never all pairs of nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.lineage import cut
from rulelens.functions.shapes import failed_names, hits, ratio, share, unions

# fixed values: strength per relation and the decay of every hop after the first
RELATION_WEIGHTS = {"equivalent": 1.00, "subsumption": 0.88, "inferred_subsumption": 0.78, "inverse": 0.82, "domain": 0.68, "range": 0.68}
OTHER_RELATION, HOP_DECAY, MAX_HOPS = 0.50, 0.92, 6
# fixed values: scores and limits of name matching
EXACT, SAME_TOKENS, CONTAINED, EDIT_SHARE, TOKEN_SHARE = 1.0, 0.97, 0.86, 0.90, 0.92
MIN_SCORE, MIN_MARGIN, SURE_SCORE, TRACKED = 0.72, 0.08, 0.98, 0.62
# fixed values: kinds of entity in order of preference
KIND_ORDER = {"class": 0, "datatype_property": 1, "object_property": 2}
# fixed values: accented letters and their plain forms
ACCENTS, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


# ---------------------------------------------------------------- names

def normalised(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTS, PLAIN), "[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(spaced), ACCENTS, PLAIN), "[^a-z0-9]+"), lambda t: t != ""))


def grams(c: Column) -> Column:
    """Letter pairs of a normalised name, the whole name when it has one letter."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(pairs)


def name_score(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Exact, same tokens, containment, else the better of edit similarity and token overlap."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    overlap = ratio(F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb)), 0.0)
    inside = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (F.when(a == b, EXACT).when((F.size(ta) > 0) & (F.array_sort(ta) == F.array_sort(tb)), SAME_TOKENS).when(inside, CONTAINED)
            .otherwise(F.greatest(edit * EDIT_SHARE, overlap * TOKEN_SHARE)))


def match_candidates(features: DataFrame, entities: DataFrame) -> DataFrame:
    """(feature, entity, kind, score) for scores of at least 0.62.

    Two names scoring that high share a letter pair or a token, so an equi-join on those finds every candidate
    without comparing all names with all labels.
    """
    f = features.select("feature", normalised(F.col("feature")).alias("a"), tokens(F.col("feature")).alias("ta"))
    e = entities.select(F.col("name").alias("entity"), "kind", normalised(F.col("label")).alias("b"), tokens(F.col("label")).alias("tb")).filter("b <> ''")
    fk = f.select("*", F.explode(F.array_union(grams(F.col("a")), F.col("ta"))).alias("k"))
    ek = e.select("*", F.explode(F.array_union(grams(F.col("b")), F.col("tb"))).alias("k"))
    pairs = fk.join(ek, "k").drop("k").dropDuplicates(["feature", "entity", "kind", "a", "b"])
    return pairs.withColumn("score", F.round(name_score(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")), 9)).filter(F.col("score") >= TRACKED).groupBy(
        "feature", "entity", "kind").agg(F.max("score").alias("score"))


def match_features(features: DataFrame, entities: DataFrame) -> DataFrame:
    """One decision per feature: best entity, score, status.  Ties are rejected; one data property beats classes."""
    cands = match_candidates(features, entities)
    kind_place = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[F.col("kind")]
    w = Window.partitionBy("feature")  # candidates of one schema column
    c = cands.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), kind_place, "entity"))).withColumn("best", F.max("score").over(w))
    tied, is_prop, is_class = F.col("score") >= F.col("best") - 1e-9, F.col("kind") == "datatype_property", F.col("kind") == "class"
    nth = lambda i: F.max(F.when(F.col("place") == i, F.struct("entity", "kind", "score")))
    per = c.groupBy("feature").agg(nth(1).alias("one"), nth(2).alias("two"), hits(tied).alias("n_tied"), hits(tied & is_prop).alias("n_prop"), hits(tied & is_class).alias("n_class"),
                                   F.min(F.when(tied & is_prop, F.col("entity"))).alias("prop"), F.max(F.when(~is_class & ~(tied & is_prop), F.col("score"))).alias("rival"))
    best, second = F.col("one.score"), F.coalesce(F.col("two.score"), F.lit(0.0))
    several = (F.col("n_tied") > 1) & (best >= MIN_SCORE)
    by_type = several & (F.col("n_prop") == 1) & (F.col("n_prop") + F.col("n_class") == F.col("n_tied"))
    swap = ~several & F.col("two").isNotNull() & (best - second < MIN_MARGIN) & (F.col("one.kind") == "class") & (F.col("two.kind") == "datatype_property")
    score = F.when(swap, second).otherwise(best)
    margin = F.when(by_type, best - F.coalesce("rival", F.lit(0.0))).when(several, 0.0).when(swap, second - best).otherwise(best - second)
    ok = (score >= MIN_SCORE) & F.when(by_type, margin >= MIN_MARGIN).when(several, False).otherwise((score >= SURE_SCORE) | (margin >= MIN_MARGIN) | swap)
    decided = per.select("feature", F.when(by_type, F.col("prop")).when(swap, F.col("two.entity")).otherwise(F.col("one.entity")).alias("entity"),
                         F.when(by_type, "datatype_property").when(swap, F.col("two.kind")).otherwise(F.col("one.kind")).alias("kind"), score.alias("score"),
                         F.when(score < MIN_SCORE, "REJECTED_LOW_SCORE").when(ok, "ACCEPTED").otherwise("REJECTED_AMBIGUOUS").alias("status"))
    return features.select("feature").join(decided, "feature", "left").withColumn("status", F.coalesce("status", F.lit("REJECTED_LOW_SCORE")))


def resolve_collisions(decisions: DataFrame) -> DataFrame:
    """Several columns on one entity: only a single top score keeps it."""
    w = Window.partitionBy("entity", "accepted")  # columns of one entity
    tagged = decisions.withColumn("accepted", F.col("status") == "ACCEPTED").withColumn("top", F.max("score").over(w)).withColumn("members", F.count(F.lit(1)).over(w))
    tagged = tagged.withColumn("winners", F.sum((F.col("score") == F.col("top")).cast("int")).over(w))
    lost = F.col("accepted") & (F.col("members") > 1) & ((F.col("score") < F.col("top")) | (F.col("winners") > 1))
    return tagged.withColumn("status", F.when(lost, "REJECTED_ENTITY_COLLISION").otherwise(F.col("status"))).select("feature", "entity", "kind", "score", "status")


def match_statistics(decisions: DataFrame) -> DataFrame:
    """Rates per entity kind and an order-free digest of the accepted matches."""
    ok = F.col("status") == "ACCEPTED"
    return decisions.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("features"), hits(ok).alias("mapped"), hits(~ok).alias("unmapped"),
                                                                                  F.avg(F.when(ok, F.col("score"))).alias("mean_score"), share(ok).alias("rate"))


def match_digest(decisions: DataFrame) -> DataFrame:
    ok = decisions.filter("status = 'ACCEPTED'")
    return ok.agg(F.count(F.lit(1)).alias("matches"), F.bit_xor(F.xxhash64("feature", "entity")).alias("digest"))


def quality_gate(decisions: DataFrame, entities: DataFrame, records: Column | int = 0, reasoner_ran: bool = True, consistent: bool = True, generic: Sequence[str] = ("thing", "entity", "class", "value"),
                 min_coverage: float = 0.35, min_entities: int = 2, max_generic: float = 0.45) -> DataFrame:
    """Coverage, distinct entities, generic share, mapping entropy, and a status by fixed precedence."""
    ok = F.col("status") == "ACCEPTED"
    m = decisions.agg(F.count(F.lit(1)).alias("features"), hits(ok).alias("mapped"), F.count_distinct(F.when(ok, F.col("entity"))).alias("unique_entities"),
                      hits(F.col("status") == "REJECTED_AMBIGUOUS").alias("ambiguous"), hits(F.col("status") == "REJECTED_ENTITY_COLLISION").alias("collisions"), F.avg(F.when(ok, F.col("score"))).alias("mean_score"))
    name = normalised(F.col("name"))
    vague = name.isin(*generic) | name.rlike(r"^(feature|feat|attr|attribute|column|col|x|f)[0-9]+$")
    g = entities.filter(F.col("kind").isin(*KIND_ORDER)).select("name").distinct().agg(share(vague).alias("generic_ratio"))
    counts = decisions.filter(ok).groupBy("entity").agg(F.count(F.lit(1)).alias("c"))
    total = decisions.filter(ok).agg(F.count(F.lit(1))).scalar()
    entropy = counts.agg(F.when(F.max(total) <= 1, F.max(total).cast("double")).otherwise(-F.sum(F.col("c") / total * F.ln(F.col("c") / total)) / F.ln(F.max(total)))).scalar()
    out = m.withColumns({"generic_ratio": g.select("generic_ratio").scalar(), "mapping_entropy": F.coalesce(entropy, F.lit(0.0)), "coverage": F.col("mapped") / F.greatest(F.col("features"), F.lit(1)),
                         "records": F.lit(records) if isinstance(records, int) else records})
    thin = (F.col("coverage") < min_coverage) | (F.col("unique_entities") < F.least(F.lit(min_entities), F.greatest(F.lit(1), F.col("features"))))
    status = (F.when(F.col("records") > 0, "CONTAMINATED_ONTOLOGY").when(F.lit(not consistent), "LOGICALLY_INCONSISTENT").when(F.lit(not reasoner_ran), "REASONER_NOT_VALIDATED")
              .when(thin, "INSUFFICIENT_SCHEMA_COVERAGE").when(F.col("generic_ratio") > max_generic, "GENERIC_ONTOLOGY").otherwise("VALID_DOMAIN_ONTOLOGY"))
    return out.withColumn("status", status)


def richness(entities: DataFrame, annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """Knowledge beyond the taxonomy: object properties, restrictions, bounds, roles within families."""
    has = lambda df, cond: df.agg(F.coalesce(F.max(cond.cast("int")), F.lit(0))).scalar()
    obj, rest = has(entities, F.col("kind") == "object_property"), has(edges, F.col("relation") == "restriction")
    bound = has(annotations, F.col("key").isin("min", "max"))
    role = has(annotations, F.col("key") == "role") * has(annotations, F.col("key") == "family")
    out = entities.agg(F.count_distinct("name").alias("entities")).withColumn("sources", obj + rest + bound + role)
    return out.withColumn("level", F.when(F.col("sources") == 0, "poor").when(F.col("sources") == 1, "limited").otherwise("rich"))


# ---------------------------------------------------------------- graph walks

def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


HOPS = 4  # steps that a pointer takes in a written round


def _to_anchors(single: DataFrame, n: int) -> DataFrame:
    """(node, anchor, steps): where each node of one parent ends up going up until a node with none or several, as a written table.

    Pointers are followed ``HOPS`` at a time and only those that have not arrived are written again, so a chain of n nodes takes
    as many rounds as n has digits to that base. Pointers that have not arrived by then run in a cycle.
    """
    pointers = cut(single.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps")))
    done, rounds = None, 0
    while True:
        further = pointers.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        jumped = pointers
        for _ in range(HOPS - 1):
            jumped = jumped.join(further, "at", "left").select("node", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if done is not None:  # a pointer may meet one that has arrived
            arrived = done.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
            jumped = jumped.join(arrived, "at", "left").select("node", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        open_ = jumped.join(single.select(F.col("node").alias("at")), "at", "left_semi").withColumn("open", F.lit(True))
        there = jumped.join(single.select(F.col("node").alias("at")), "at", "left_anti").withColumn("open", F.lit(False))
        both = cut(open_.select("node", "at", "steps", "open").unionByName(there.select("node", "at", "steps", "open")))
        new = both.filter("NOT open").drop("open")
        done, pointers, rounds = new if done is None else done.unionByName(new), both.filter("open").drop("open"), rounds + 1
        if pointers.isEmpty():
            return done.select("node", F.col("at").alias("anchor"), "steps")
        if HOPS ** (rounds - 1) > n:
            raise ValueError("the hierarchy has a cycle")


def taxonomy_depth(edges: DataFrame) -> DataFrame:
    """(node, longest, shortest, relative): chain lengths to a root; a cycle is an error.

    Paths are contracted first: nodes of one parent point to the next node with none or several. Between those, layers are solved
    from the roots: a node is solved once all its parents are, with its longest and shortest chain together. What is left when a
    layer is empty lies on or below a cycle. Rows written grow with the edges, not with the pairs of ancestors.
    """
    up = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")).distinct())
    nodes = up.select("node").unionByName(up.select(F.col("parent").alias("node"))).distinct()
    parents = up.groupBy("node").agg(F.count(F.lit(1)).alias("need"), F.min("parent").alias("parent"))
    single, several = cut(parents.filter("need = 1").select("node", "parent")), cut(parents.filter("need > 1").select("node"))
    roots = nodes.join(up.select("node").distinct(), "node", "left_anti")
    anchored = _to_anchors(single, nodes.count()) if not single.isEmpty() else up.sparkSession.createDataFrame([], up.select("node", F.col("node").alias("anchor"), F.lit(0).cast("long").alias("steps")).schema)
    hops = up.join(several, "node").join(anchored.withColumnRenamed("node", "parent"), "parent", "left")
    between = cut(hops.select("node", F.coalesce("anchor", "parent").alias("anchor"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    need = between.groupBy("node").agg(F.count(F.lit(1)).alias("need"))
    solved = layer = cut(roots.select("node", F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("shortest")))
    waiting, left = None, several.count()
    while left:
        met = between.join(layer.withColumnRenamed("node", "anchor"), "anchor").select("node", F.lit(1).cast("long").alias("got"), (F.col("longest") + F.col("steps")).alias("longest"), (F.col("shortest") + F.col("steps")).alias("shortest"))
        met = (met if waiting is None else met.unionByName(waiting)).groupBy("node").agg(F.sum("got").alias("got"), F.max("longest").alias("longest"), F.min("shortest").alias("shortest"))
        state = cut(met.join(need, "node").withColumn("whole", F.col("got") == F.col("need")).drop("need"))
        layer, waiting = state.filter("whole").select("node", "longest", "shortest"), state.filter("NOT whole").drop("whole")
        n = layer.count()
        if not n:
            raise ValueError("the hierarchy has a cycle")
        solved, left = solved.unionByName(layer), left - n
    below = anchored.join(solved.withColumnRenamed("node", "anchor"), "anchor").select("node", (F.col("longest") + F.col("steps")).alias("longest"), (F.col("shortest") + F.col("steps")).alias("shortest"))
    state = cut(solved.unionByName(below))
    deepest = state.agg(F.max("shortest")).scalar()
    return state.withColumn("relative", ratio(F.col("shortest"), deepest, 0.0))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable name over the given (symmetric) edges.

    Each round every component points to its smallest neighbour and pointers are followed to their ends by doubling, so a
    chain needs few rounds however long it is.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    state = _nodes(edges).withColumn("component", F.col("node"))
    while True:
        left = state.select(F.col("node").alias("src"), F.col("component").alias("at"))
        right = state.select(F.col("node").alias("dst"), F.col("component").alias("to"))
        met = both.join(left, "src").join(right, "dst")
        points = cut(met.groupBy("at").agg(F.least("at", F.min("to")).alias("to")))
        if points.filter("at <> to").isEmpty():
            return state
        moved = True
        while moved:
            ends = points.select(F.col("at").alias("to"), F.col("to").alias("end"))
            points = cut(points.join(ends, "to").select("at", "to", "end"))
            moved = not points.filter("to <> end").isEmpty()
            points = points.select("at", F.col("end").alias("to"))
        state = cut(state.join(points.withColumnRenamed("at", "component"), "component").select("node", F.col("to").alias("component")))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, hops): upward closure with equivalent classes merged; hops count subsumption steps."""
    same = edges.filter("relation = 'equivalent'")
    group = components(same)
    up = edges.filter("relation <> 'equivalent'").select("src", "dst").distinct()
    lift = lambda df, c: df.join(group.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    merged = lift(lift(up, "src"), "dst").filter("src <> dst").distinct()
    nodes = _nodes(edges).join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = nodes.select(F.col("component").alias("start"), F.col("component").alias("at"), F.lit(0).alias("hops")).unionByName(
        merged.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.lit(1).alias("hops"))).groupBy("start", "at").agg(F.min("hops").alias("hops"))
    state, last = cut(state), None
    while (mark := state.agg(F.count(F.lit(1)).alias("n"), F.sum("hops").alias("s")).first()) != last:  # chains double each round
        last = mark
        on = state.select(F.col("start").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        state = cut(state.join(on, "at").groupBy("start", F.col("to").alias("at")).agg(F.min(F.col("hops") + F.col("more")).alias("hops")))
    members = nodes.select(F.col("component").alias("at"), F.col("node").alias("ancestor"))
    starts = nodes.select(F.col("component").alias("start"), "node")
    return state.join(starts, "start").join(members, "at").filter("node <> ancestor").select("node", "ancestor", "hops")


def _undirected(edges: DataFrame) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv])[F.col("relation")], F.lit(OTHER_RELATION))
    both = edges.select("src", "dst", weight.alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight.alias("w")))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def relatedness(edges: DataFrame, starts: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(start, node, strength): best product of edge weights within ``hops``, 0.92 per hop after the first."""
    e = _undirected(edges)
    loops = _nodes(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("f"))
    first = e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("w").alias("strength")).join(starts.select(F.col("node").alias("start")), "start", "left_semi")
    onward = e.select("src", "dst", (F.col("w") * HOP_DECAY).alias("f")).unionByName(loops)
    state = first
    for i in range(hops - 1):
        state = state.withColumnRenamed("node", "src").join(onward, "src").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("strength") * F.col("f")).alias("strength"))
        if i % 2 == 1:
            state = cut(state)
    return state.filter("start <> node")


def path_length(edges: DataFrame, starts: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(start, node, length): fewest edges, up to ``hops``."""
    e = _undirected(edges).select("src", "dst", F.lit(1).alias("c"))
    loops = _nodes(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("c"))
    state = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("length"))
    for i in range(hops):
        state = state.withColumnRenamed("node", "src").join(e.unionByName(loops), "src").groupBy("start", F.col("dst").alias("node")).agg(F.min(F.col("length") + F.col("c")).alias("length"))
        if i % 2 == 1:
            state = cut(state)
    return state


def feature_groups(mapping: DataFrame, edges: DataFrame, builtin: Sequence[str] = ()) -> DataFrame:
    """(feature, grp): first neighbour by subsumption, domain or equivalence that is not built in, else the entity itself."""
    near = edges.filter(F.col("relation").isin("subsumption", "domain", "equivalent"))
    both = near.select(F.col("src").alias("entity"), F.col("dst").alias("other")).unionByName(near.select(F.col("dst").alias("entity"), F.col("src").alias("other")))
    kept = both.filter(~F.col("other").isin(*builtin)) if builtin else both
    first = kept.groupBy("entity").agg(F.min("other").alias("grp"))
    return mapping.join(first, "entity", "left").select("feature", F.coalesce("grp", "entity").alias("grp"))


def graph_summary(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, n): nodes per kind, undirected edges per relation."""
    kinds = entities.select("name", "kind").distinct().groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("kind"))
    flat = relation_records(edges).groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("relation"))
    return kinds.unionByName(flat)


def relation_records(edges: DataFrame) -> DataFrame:
    """Relations without mirrored duplicates, with their weight."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv])[F.col("relation")], F.lit(OTHER_RELATION))
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").distinct().withColumn("weight", weight)


# ---------------------------------------------------------------- measures over the closure

def information_content(mapping: DataFrame, up: DataFrame) -> DataFrame:
    """(concept, n, ic): how many features sit at or below a concept, and -ln of that share."""
    own = mapping.select("feature", F.col("entity").alias("concept"))
    above = mapping.join(up.select(F.col("node").alias("entity"), F.col("ancestor").alias("concept")), "entity").select("feature", "concept")
    total = mapping.agg(F.count_distinct("feature")).scalar()
    per = own.unionByName(above).distinct().groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("ic", -F.ln(F.col("n") / total))


def concept_pairs(concepts: DataFrame, up: DataFrame, depth: DataFrame, ic: DataFrame) -> DataFrame:
    """Wu-Palmer and Lin relatedness of concept pairs that share an ancestor.

    ``concepts``: the classes the schema columns map to, a few per table; pairs meet on the shared ancestor.
    """
    reach = concepts.select(F.col("node").alias("node"), F.col("node").alias("anc")).unionByName(concepts.join(up, "node").select("node", F.col("ancestor").alias("anc")))
    tagged = reach.join(depth.select(F.col("node").alias("anc"), F.col("longest").alias("d")), "anc").join(ic.select(F.col("concept").alias("anc"), "ic"), "anc", "left")
    a = tagged.select("anc", F.col("node").alias("left_node"), "d", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    b = tagged.select("anc", F.col("node").alias("right_node"))
    common = a.join(b, "anc").filter("left_node < right_node").groupBy("left_node", "right_node").agg(F.max("d").alias("d"), F.max("ic").alias("shared_ic"))
    own = concepts.join(depth.select("node", F.col("longest").alias("own_d")), "node").join(ic.select(F.col("concept").alias("node"), F.col("ic").alias("own_ic")), "node", "left")
    l = own.select(F.col("node").alias("left_node"), F.col("own_d").alias("dl"), F.coalesce("own_ic", F.lit(0.0)).alias("il"))
    r = own.select(F.col("node").alias("right_node"), F.col("own_d").alias("dr"), F.coalesce("own_ic", F.lit(0.0)).alias("ir"))
    both = common.join(l, "left_node").join(r, "right_node")
    lin = F.when(F.col("il") + F.col("ir") > 1e-12, F.least(F.lit(1.0), 2 * F.col("shared_ic") / (F.col("il") + F.col("ir")))).otherwise(0.0)
    return both.select("left_node", "right_node", ratio(2.0 * F.col("d"), F.col("dl") + F.col("dr"), 0.0).alias("wu_palmer"), lin.alias("lin"))


def semantic_units(mapping: DataFrame, up: DataFrame, min_size: int = 2) -> DataFrame:
    """(concept, size, ic): informative concepts by extension; equal extensions collapse to one name.

    Extensions are compared by count and two order-free digests, so no concept collects its members.
    """
    total = mapping.agg(F.count_distinct("feature")).scalar()
    reach = mapping.select("feature", F.col("entity").alias("concept")).unionByName(
        mapping.join(up.select(F.col("node").alias("entity"), F.col("ancestor").alias("concept")), "entity").select("feature", "concept")).distinct()
    per = reach.groupBy("concept").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("feature")).alias("h1"), F.sum(F.pmod(F.xxhash64("feature", F.lit("second")), F.lit(1 << 31))).alias("h2"))
    kept = per.filter((F.col("size") >= min_size) & (F.col("size") < total)).groupBy("size", "h1", "h2").agg(F.max("concept").alias("concept"))
    return kept.select("concept", "size", (-F.ln(F.col("size") / total)).alias("ic"))


def metadata_relatedness(meta: DataFrame, sources: DataFrame, graph: DataFrame, same_entity: float = 0.9, derived: float = 0.8, family: float = 0.7, superclass: float = 0.5, graph_scale: float = 0.45) -> DataFrame:
    """(left_feature, right_feature, value): the strongest reason two columns are related.

    Each reason is an equi-join on what the columns share; unrelated pairs never appear.  ``graph`` holds entity
    strengths and only counts where no other reason does.
    """

    def shared(key: str, value: float) -> DataFrame:
        a = meta.filter(F.col(key).isNotNull()).select(F.col("feature").alias("left_feature"), key)
        b = meta.filter(F.col(key).isNotNull()).select(F.col("feature").alias("right_feature"), key)
        return a.join(b, key).filter("left_feature < right_feature").select("left_feature", "right_feature", F.lit(value).alias("value"), F.lit(1).alias("direct"))

    lineage = sources.select(F.least("feature", "source").alias("left_feature"), F.greatest("feature", "source").alias("right_feature"), F.lit(derived).alias("value"), F.lit(1).alias("direct"))
    a = meta.select(F.col("feature").alias("left_feature"), F.col("entity").alias("start"))
    b = meta.select(F.col("feature").alias("right_feature"), F.col("entity").alias("node"))
    near = graph.join(a, "start").join(b, "node").filter("left_feature < right_feature").select(
        "left_feature", "right_feature", F.least(graph_scale * F.col("strength"), F.lit(superclass * 0.99)).alias("value"), F.lit(0).alias("direct"))
    every = unions([shared("entity", same_entity), shared("family", family), shared("superclass", superclass), lineage, near])
    best = every.groupBy("left_feature", "right_feature").agg(F.max(F.when(F.col("direct") == 1, F.col("value"))).alias("d"), F.max(F.when(F.col("direct") == 0, F.col("value"))).alias("g"))
    return best.select("left_feature", "right_feature", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("d", "g"))).alias("value"))


def split_weights(meta: DataFrame, sources: DataFrame, per_score: float = 0.35) -> DataFrame:
    """Originals 1 + k x match score; a derived column at most its heaviest source."""
    own = meta.withColumn("own", F.when(F.col("derived"), None).otherwise(1 + per_score * F.coalesce("score", F.lit(0.0))))
    parent = sources.join(own.select(F.col("feature").alias("source"), "own"), "source").groupBy("feature").agg(F.max("own").alias("ceiling"))
    return own.join(parent, "feature", "left").select("feature", "derived", F.coalesce("own", "ceiling", F.lit(1.0)).alias("weight"), "ceiling")


def double_counting(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Derived columns that outweigh their sources."""
    return weights.filter(F.col("derived") & (F.col("weight") > F.coalesce("ceiling", F.lit(1.0)) + tolerance))


def centrality(mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """min(1, .42 score + .38 child share + .12 if derived + .08)."""
    kids = edges.filter("relation = 'subsumption'").groupBy(F.col("dst").alias("entity")).agg(F.count_distinct("src").alias("kids"))
    top = kids.agg(F.max("kids")).scalar()
    joined = mapping.join(kids, "entity", "left")
    value = 0.42 * F.col("score") + 0.38 * F.coalesce(F.col("kids") / F.greatest(top, F.lit(1)), F.lit(0.0)) + F.when(F.col("derived"), 0.12).otherwise(0.0) + 0.08
    return joined.select("feature", F.least(F.lit(1.0), value).alias("centrality"))


def dependencies(mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """(dependent, base, strength): child column on parent column (.55), property on its domain (.65)."""
    strength = F.when(F.col("relation") == "subsumption", 0.55).when(F.col("relation") == "domain", 0.65)
    e = edges.withColumn("strength", strength).filter("strength IS NOT NULL").groupBy("src", "dst").agg(F.max("strength").alias("strength"))
    low = mapping.select(F.col("feature").alias("dependent"), F.col("entity").alias("src"))
    high = mapping.select(F.col("feature").alias("base"), F.col("entity").alias("dst"))
    return e.join(low, "src").join(high, "dst").filter("dependent <> base").groupBy("dependent", "base").agg(F.max("strength").alias("strength"))


def name_dependencies(mapping: DataFrame, properties: DataFrame) -> DataFrame:
    """(dependent, base, .50): a column whose name contains a property's name depends on the columns of its domain.

    ``properties``: (property, domain).  Names meet on shared letter pairs before the containment test.
    """
    cols = mapping.select("feature", F.lower("feature").alias("a")).withColumn("k", F.explode(grams(F.col("a"))))
    props = properties.select("property", "domain", F.lower("property").alias("b")).withColumn("k", F.explode(grams(F.col("b"))))
    inside = F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a"))
    hit = cols.join(props, "k").filter(inside).select("feature", "domain").distinct()
    base = mapping.select(F.col("feature").alias("base"), F.col("entity").alias("domain"))
    return hit.join(base, "domain").filter("feature <> base").select(F.col("feature").alias("dependent"), "base", F.lit(0.50).alias("strength")).distinct()


# ---------------------------------------------------------------- controls and gates

def shuffled_mapping(mapping: DataFrame, seed: int) -> DataFrame:
    """Every column gets another column's entity: hash order, shifted by one (no column keeps its own place)."""
    whole = Window.partitionBy(F.lit(0))  # one row per schema column
    order = whole.orderBy(F.md5(F.concat_ws("|", "feature", F.lit(str(seed)))), "feature")
    ranked = mapping.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole))
    target = ranked.select((F.col("place") % F.col("n") + 1).alias("place"), F.col("entity").alias("control_entity"))
    return ranked.join(target, "place").select("feature", "entity", "control_entity")


def destructive_permutations(groups: DataFrame, seed: int, candidates: int = 50) -> DataFrame:
    """(candidate, retention, chance, chosen): permutations inside a stratum; the first to keep no more same-group pairs than chance.

    ``groups``: (feature, grp, stratum).  Pairs are formed inside groups of schema columns only.
    """
    total = groups.agg(F.count(F.lit(1))).scalar()
    chance = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)) / (F.max(total) * (F.max(total) - 1))).scalar()
    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("candidate"))
    w = Window.partitionBy("candidate", "stratum")  # schema columns of one stratum
    slots = each.withColumn("i", F.row_number().over(w.orderBy("feature"))).withColumn("j", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", "feature", "candidate", F.lit(str(seed)))), "feature")))
    moved = slots.select("candidate", "stratum", F.col("j").alias("i"), F.col("grp").alias("new_grp"))
    placed = slots.join(moved, ["candidate", "stratum", "i"]).select("candidate", "feature", "grp", "new_grp")
    other = placed.select("candidate", "grp", F.col("feature").alias("f2"), F.col("new_grp").alias("g2"))
    kept = placed.join(other, ["candidate", "grp"]).filter("feature < f2").groupBy("candidate").agg(share(F.col("new_grp") == F.col("g2")).alias("retention"))
    out = kept.withColumn("chance", chance).withColumn("ok", F.col("retention") <= F.col("chance") + 1e-12)
    first = out.agg(F.min(F.when(F.col("ok"), F.col("candidate")))).scalar()
    lowest = out.agg(F.min_by("candidate", F.struct("retention", "candidate"))).scalar()
    return out.withColumn("chosen", F.col("candidate") == F.coalesce(first, lowest))


def usage_category(runs: DataFrame) -> DataFrame:
    """Was derived knowledge really used?  Control arms never count as evidence."""
    evidence = (F.col("semantic_splits") > 0) | (F.col("semantic_features_used") > 0)
    used = evidence & ~F.col("mirrored") & F.col("valid") & ~F.col("control")
    unmapped = ~F.col("valid") | ((F.col("mapped") == 0) & (F.col("generated") == 0))
    return runs.withColumn("category", F.when(used, "ontology_effectively_used").when(unmapped, "ontology_invalid_or_unmapped").otherwise("ontology_available_but_not_effective"))


def allowed_space(groups: DataFrame, relatedness_pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Shares of column pairs and triples whose members may be combined.

    Allowed pairs are counted without listing the forbidden ones; triples come from joining allowed pairs.
    """
    g = groups.withColumn("grp", F.when(F.lower("grp").isin("general", "none", ""), None).otherwise(F.col("grp")))
    n = g.count()  # schema columns
    a = g.select(F.col("feature").alias("x"), F.col("grp").alias("gx"))
    b = g.select(F.col("feature").alias("y"), F.col("grp").alias("gy"))
    same = a.filter("gx IS NOT NULL").join(b, F.col("gx") == F.col("gy")).filter("x < y").select("x", "y")
    near = relatedness_pairs.filter(F.col("value") >= threshold).select(F.least("left_feature", "right_feature").alias("x"), F.greatest("left_feature", "right_feature").alias("y"))
    free = g.filter("grp IS NULL").select(F.col("feature").alias("f"))
    names = [r["feature"] for r in g.select("feature").orderBy("feature").collect()]
    open_world = free.select("f", F.explode(F.array(*[F.lit(c) for c in names])).alias("o")).filter("f <> o").select(F.least("f", "o").alias("x"), F.greatest("f", "o").alias("y"))
    pairs = same.unionByName(near).unionByName(open_world).distinct()
    ab, bc, ac = pairs, pairs.select(F.col("x").alias("y"), F.col("y").alias("z")), pairs.select("x", F.col("y").alias("z"))
    triples = ab.join(bc, "y").join(ac, ["x", "z"])
    p2, p3 = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    counts = pairs.agg((F.count(F.lit(1)) / p2).alias("pair_share"))
    return counts.withColumn("triple_share", triples.agg(F.count(F.lit(1)) / p3).scalar()).withColumn("features", F.lit(n))


def enrichment_decision(rows: DataFrame, margin: float = 0.01, secondary: float = 0.01) -> DataFrame:
    """Accept, accept in part, or reject derived columns, with the reason."""
    partial = F.col("stable") < F.col("pool")
    good = F.col("ci_low") > 0
    second = (F.col("ci_low") >= -margin) & (F.col("d_balanced") >= -margin) & (F.greatest("d_minority", "d_f1") >= secondary)
    status = (F.when(F.col("stable") == 0, "REJECT_UNSTABLE_FEATURES").when((F.col("ci_high") < 0) | (F.col("gain") < -margin), "REJECT_DEGRADATION")
              .when(good & partial, "ACCEPT_PARTIAL_FEATURE_SET").when(good, "ACCEPT_SIGNIFICANT_GAIN").when(second & partial, "ACCEPT_PARTIAL_FEATURE_SET")
              .when(second, "ACCEPT_NON_INFERIOR_WITH_SECONDARY_GAIN").otherwise("REJECT_NO_INFORMATIONAL_GAIN"))
    return rows.withColumn("decision", status)


def contribution_gate(rows: DataFrame, min_usage: float = 0.05, min_impact: float = 0.02, min_fidelity: float = 0.0, max_loss: float = 0.01, max_growth: float = 0.5) -> DataFrame:
    """Named conditions of a semantic contribution and the ones that failed."""
    checks = {"ontology_usage_below_threshold": F.col("usage") >= min_usage, "semantic_decision_impact_below_threshold": F.col("impact") >= min_impact, "fidelity_gain_below_threshold": F.col("d_fidelity") >= min_fidelity,
              "balanced_accuracy_loss_exceeded": F.col("d_balanced") >= -max_loss, "macro_f1_loss_exceeded": F.col("d_f1") >= -max_loss, "tree_complexity_growth_exceeded": F.col("growth") <= max_growth}
    out = rows.withColumn("reasons", failed_names(checks))
    status = (F.when(F.col("reasons") == "", "SEMANTIC_CONTRIBUTION_SUPPORTED").when((F.col("usage") <= 0) & (F.col("impact") <= 0), "NO_OBSERVED_SEMANTIC_CONTRIBUTION")
              .when(F.col("d_fidelity") < min_fidelity, "SEMANTIC_EFFECT_WITHOUT_FIDELITY_GAIN").otherwise("SEMANTIC_CONTRIBUTION_NOT_SUPPORTED"))
    return out.withColumn("status", status)
