"""The named operators over a `Knowledge`: lookups, expansion, evidence, candidates, search, context, staleness.

Every operator is a function of DataFrames that returns one DataFrame; limits are part of an operator's meaning
(they are its parameters) and always cut a total order, ended by an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.vectors import cosine
from weftgraph.knowledge import Knowledge
from weftgraph.operators import graph
from weftgraph.sources import small_side


def top(df: DataFrame, order: Sequence[Column | str], n: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def rank_value(rank: Column, scores: dict[str, float] = model.SOURCE_AUTHORITY) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[rank], F.lit(scores["C"]))


# ---- lookup and resolve


def lookup(k: Knowledge, terms: DataFrame, scope: str = "") -> DataFrame:
    """terms (term) -> (term, node_id, canonical_name, layer, matched_by): the exact canonical name (with the scope as
    an id prefix) before an alias; ``not_found`` with nulls otherwise. Of several matches the least node id."""
    wanted = terms.select("term", F.lower("term").alias("folded")).distinct()
    nodes = k.node.select("node_id", "canonical_name", "layer", F.lower("canonical_name").alias("folded"))
    by_name = wanted.join(nodes.where(F.col("node_id").startswith(scope)), "folded").select("term", "node_id", F.lit(1).alias("p"))
    by_alias = wanted.join(k.alias.select("folded", F.col("canonical_node_id").alias("node_id")), "folded").select("term", "node_id", F.lit(2).alias("p"))
    best = by_name.union(by_alias).groupBy("term").agg(F.min(F.struct("p", "node_id")).alias("m"))
    found = best.select("term", F.col("m.node_id").alias("node_id"), F.when(F.col("m.p") == 1, "canonical").otherwise("alias").alias("matched_by"))
    out = wanted.select("term").join(found, "term", "left").join(nodes.drop("folded"), "node_id", "left")
    return out.select("term", "node_id", "canonical_name", "layer", F.coalesce("matched_by", F.lit("not_found")).alias("matched_by"))


def lookup_evidence(k: Knowledge, found: DataFrame, most: int = 5) -> DataFrame:
    """found (node_id) -> the best evidence of the facts each node is the subject of: (node_id, fact_id, evidence_id,
    evidence_score), at most ``most`` a node."""
    ids = found.where("node_id is not null").select("node_id").distinct()
    rows = k.fact.where("lifecycle_state = 'active'").select(F.col("subject").alias("node_id"), "fact_id").join(ids, "node_id", "left_semi").join(k.evidence.select("fact_id", "evidence_id", "evidence_score"), "fact_id")
    order = Window.partitionBy("node_id").orderBy(F.desc_nulls_last("evidence_score"), "evidence_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("node_id", "fact_id", "evidence_id", "evidence_score")


def resolve(k: Knowledge, alias: str, vendor: str | None = None) -> DataFrame:
    """All nodes an alias stands for, the most confident first: (node_id, canonical_name, alias_type, confidence,
    is_primary)."""
    rows = k.alias.where(F.col("folded") == alias.lower())
    if vendor:
        rows = rows.where(F.col("vendor") == vendor)
    order = Window.orderBy(F.desc("confidence"), "canonical_node_id", "alias_id")
    rows = rows.withColumn("n", F.row_number().over(order))
    named = rows.join(k.node.select(F.col("node_id").alias("canonical_node_id"), "canonical_name"), "canonical_node_id", "left")
    return named.select(F.col("canonical_node_id").alias("node_id"), "canonical_name", "alias_type", "confidence", (F.col("n") == 1).alias("is_primary"))


# ---- expand, filter


def expand(k: Knowledge, node_id: str, relation_types: Sequence[str] | None = None, depth: int = 1, min_confidence: float = 0.0, limit: int = 50) -> DataFrame:
    """The undirected neighbourhood up to ``depth`` (at most 3): at depth 1 every edge with its direction, beyond it
    the nodes with their hop."""
    node = k.spark.createDataFrame([(node_id,)], "node_id string")
    if depth <= 1:
        kept = k.edge.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
        kept = kept if relation_types is None else kept.where(F.col("rel_type").isin(list(relation_types)))
        out = kept.where(F.col("src") == node_id).select(F.col("dst").alias("node_id"), "rel_type", F.lit("out").alias("direction"), "confidence")
        into = kept.where(F.col("dst") == node_id).select(F.col("src").alias("node_id"), "rel_type", F.lit("in").alias("direction"), "confidence")
        return top(out.union(into).distinct(), ["node_id", "rel_type", "direction"], limit)
    walk = graph.bfs(k.edge, node, relation_types, "both", min(depth, 3), 1.0, min_confidence)
    return top(walk.where(F.col("node_id") != node_id).select("node_id", "rel_type", F.lit("both").alias("direction"), "confidence", "hop"), ["hop", "node_id"], limit)


def expand_facts(k: Knowledge, node_id: str, limit: int = 30) -> DataFrame:
    """Active facts at a node, the most confident first."""
    rows = k.fact.where((F.col("lifecycle_state") == "active") & ((F.col("subject") == node_id) | (F.col("object") == node_id)))
    return top(rows.select("fact_id", "subject", "predicate", "object", "confidence"), [F.desc_nulls_last("confidence"), "fact_id"], limit)


def expand_segments(k: Knowledge, node_id: str, limit: int = 20) -> DataFrame:
    """Active segments tagged with a node, the most confident first."""
    tagged = k.segment_tag.where(F.col("ontology_node_id") == node_id).select("segment_id")
    rows = k.segment.where("lifecycle_state = 'active'").join(tagged, "segment_id", "left_semi").select("segment_id", "confidence")
    return top(rows, [F.desc_nulls_last("confidence"), "segment_id"], limit)


def fuzzy_terms(k: Knowledge, terms: DataFrame, least: float = 0.4, n: int = 5) -> DataFrame:
    """terms (term) -> the dictionary's forms closest to each by edit distance: (term, node_id, ratio). A handful of terms
    of one question against the dictionary."""
    asked = terms.select("term", F.lower("term").alias("t")).distinct()
    forms = k.alias.select(F.col("folded").alias("form"), F.col("canonical_node_id").alias("node_id")).distinct()
    longest = F.greatest(F.length("t"), F.length("form"))
    # as many edits more than the length difference can't be within the ratio: no distance is computed for those
    near = forms.join(small_side(asked), F.abs(F.length("t") - F.length("form")) <= (1 - least) * longest)
    best = near.withColumn("ratio", F.round(1 - F.levenshtein("t", "form") / longest, 6)).where(F.col("ratio") > least).groupBy("term", "node_id").agg(F.max("ratio").alias("ratio"))
    order = Window.partitionBy("term").orderBy(F.desc("ratio"), "node_id")
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def filter_facts(facts: DataFrame, min_confidence=None, max_confidence=None, domain=None, lifecycle_state="active", after=None, order="confidence", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of facts; ``order`` is one of confidence and created_at, greatest first."""
    if order not in ("confidence", "created_at"):
        raise ValueError("facts are sorted by confidence or created_at")
    for value, condition in ((min_confidence, F.col("confidence") >= min_confidence), (max_confidence, F.col("confidence") <= max_confidence), (domain, F.col("domain") == domain), (lifecycle_state, F.col("lifecycle_state") == lifecycle_state), (after, F.col("created_at") >= F.to_timestamp_ntz(F.lit(after)))):
        facts = facts if value is None else facts.where(condition)
    return top(facts, [F.desc_nulls_last(order), "fact_id"], limit, offset)


def filter_segments(k: Knowledge, tags: Sequence[str] | None = None, source_ranks: Sequence[str] | None = None, min_confidence=None, source_doc_id=None, lifecycle_state="active", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of segments with their document's rank; tags are an existence test (a left-semi join)."""
    rows = k.segment.where(F.col("lifecycle_state") == lifecycle_state)
    rows = rows if min_confidence is None else rows.where(F.col("confidence") >= min_confidence)
    rows = rows if source_doc_id is None else rows.where(F.col("source_doc_id") == source_doc_id)
    if tags is not None:
        rows = rows.join(k.segment_tag.where(F.col("ontology_node_id").isin(list(tags))).select("segment_id"), "segment_id", "left_semi")
    documents = k.document.select("source_doc_id", "source_rank")
    documents = documents if source_ranks is None else documents.where(F.col("source_rank").isin(list(source_ranks)))
    return top(rows.join(documents, "source_doc_id"), [F.desc_nulls_last("confidence"), "segment_id"], limit, offset)


def filter_concepts(nodes: DataFrame, domain: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of active nodes whose id begins with the domain."""
    return top(nodes.where((F.col("lifecycle_state") == "active") & F.col("node_id").startswith(domain)), ["node_id"], limit, offset)


# ---- paths, dependencies, impact


def path_infer(k: Knowledge, start: str, end: str, policy: str = "all", max_hops: int = 6, min_confidence: float = 0.0) -> DataFrame:
    return graph.shortest_paths(k.edge, start, end, model.PATH_POLICIES.get(policy), min(max_hops, 8), min_confidence)


def dependency_closure(k: Knowledge, root: str, relations: Sequence[str] = ("DEPENDS_ON", "REQUIRES"), max_depth: int = 3) -> DataFrame:
    """(node_id, rel_type, children): the outgoing edges of the root and of every node visited below ``max_depth``;
    children at the limit are listed but not visited."""
    seed = k.spark.createDataFrame([(root,)], "node_id string")
    visited = graph.bfs(k.edge, seed, tuple(relations), "outbound", max(0, min(max_depth, 10) - 1)).select("node_id").union(seed)
    edges = k.edge.where(F.col("rel_type").isin(list(relations))).select(F.col("src").alias("node_id"), "rel_type", "dst")
    return edges.join(visited.distinct(), "node_id", "left_semi").groupBy("node_id", "rel_type").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("children"))


def impact_propagate(k: Knowledge, root: str, policy: str = "all", event: str = "fault", max_depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """What an event at the root reaches: (node_id, depth, confidence, via_relation, impact_type). The root is never
    part of it."""
    relations = model.IMPACT_POLICIES.get(policy, model.IMPACT_POLICIES["all"])
    walk = graph.bfs(k.edge, k.spark.createDataFrame([(root,)], "node_id string"), relations, "outbound", min(max_depth, 6), 1.0, min_confidence)
    return walk.select("node_id", F.col("hop").alias("depth"), "confidence", F.col("rel_type").alias("via_relation"), F.lit(model.IMPACT_TYPES.get(event, "affected")).alias("impact_type"))


# ---- evidence, conflicts, facts


def evidence_rank(k: Knowledge, fact_ids: DataFrame, by: str = "evidence_score", limit: int = 10) -> DataFrame:
    """fact_ids (fact_id) -> each fact's ``limit`` best pieces of evidence with their document's site."""
    if by not in ("evidence_score", "created_at", "source_rank"):
        raise ValueError("evidence is sorted by evidence_score, created_at or source_rank")
    rows = k.evidence.join(fact_ids.select("fact_id").distinct(), "fact_id", "left_semi")
    rows = rows.join(k.document.select("source_doc_id", "site_key"), "source_doc_id", "left")
    key = rank_value(F.col("source_rank")) if by == "source_rank" else F.col(by)
    order = Window.partitionBy("fact_id").orderBy(key.desc_nulls_last(), "evidence_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("fact_id", "evidence_id", "site_key", "source_rank", "extraction_method", "evidence_score", "rank")


def conflict_detect(facts: DataFrame, conflicts: DataFrame, topic: str, min_confidence: float = 0.0, predicate: str | None = None) -> DataFrame:
    """Recorded conflicts (fact_id_a, fact_id_b, conflict_type) whose first fact is about the topic."""
    side = lambda x: facts.select(F.col("fact_id").alias(f"fact_id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("subject", "predicate", "object", "confidence")])
    a = side("a").where(((F.col("subject_a") == topic) | (F.col("object_a") == topic)) & (F.col("confidence_a") >= min_confidence))
    a = a if predicate is None else a.where(F.col("predicate_a") == predicate)
    return conflicts.join(a, "fact_id_a").join(side("b"), "fact_id_b")


def fact_merge(facts: DataFrame, evidence: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clusters (cluster_id, fact_id) -> new snapshots of facts and evidence: the most confident fact of a cluster stays,
    the others are superseded, and their evidence points to it."""
    rows = clusters.join(facts.select("fact_id", "confidence"), "fact_id")
    kept = rows.groupBy("cluster_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "fact_id")).alias("best")).select("cluster_id", F.col("best.fact_id").alias("canonical_fact_id"))
    target = rows.join(kept, "cluster_id").select("fact_id", F.col("cluster_id").alias("merge_cluster_id"), "canonical_fact_id")
    merged = facts.join(target, "fact_id", "left")
    state = F.when(F.col("canonical_fact_id").isNotNull() & (F.col("canonical_fact_id") != F.col("fact_id")), "superseded").otherwise(F.col("lifecycle_state"))
    new_facts = merged.select(*[state.alias(c) if c == "lifecycle_state" else F.col(c) for c in facts.columns], "merge_cluster_id")
    moved = evidence.join(target.select("fact_id", "canonical_fact_id"), "fact_id", "left")
    return new_facts, moved.select(*[F.coalesce("canonical_fact_id", "fact_id").alias(c) if c == "fact_id" else F.col(c) for c in evidence.columns])


# ---- candidates


def candidate_discover(candidates: DataFrame, as_of: str, window_days: int = 30, min_sources: int = 1, min_frequency: int = 5, limit: int = 100) -> DataFrame:
    """Forms seen in the window with enough sources; the frequency of a form is the sum of its source counts."""
    since = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(window_days)} DAYS")
    rows = candidates.where((F.col("last_seen_at") >= since) & (F.col("source_count") >= min_sources) & F.col("normalized_form").isNotNull())
    grouped = rows.groupBy("normalized_form").agg(F.sum("source_count").cast("long").alias("frequency"), F.count("*").alias("n_candidates"))
    return top(grouped.where(F.col("frequency") >= min_frequency), [F.desc("frequency"), "normalized_form"], limit)


def attach_score(candidates: DataFrame, parents: DataFrame, limit: int = 5) -> DataFrame:
    """candidates (candidate_id, surface_forms), parents (node_id, name) -> each candidate's best parents by token
    Jaccard. Only pairs with a common token are ever joined; others score 0."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != "")
    left = candidates.select("candidate_id", F.array_distinct(F.flatten(F.transform("surface_forms", lambda s: words(s)))).alias("w"))
    left = left.select("candidate_id", F.size("w").alias("n"), F.explode("w").alias("token"))
    right = parents.select("node_id", words(F.col("name")).alias("w")).select("node_id", F.size("w").alias("m"), F.explode("w").alias("token"))
    both = left.join(right, "token").groupBy("candidate_id", "node_id", "n", "m").agg(F.count("*").alias("c"))
    scored = both.select("candidate_id", "node_id", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 4).alias("score"))
    order = Window.partitionBy("candidate_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def gate_reasons(**columns: Column | str) -> Column:
    """The gates a candidate doesn't pass, in a fixed order; a missing score blocks, except that of synonym risk."""
    checks = []
    for name, least in model.GATES.items():
        value = F.col(columns[name]) if isinstance(columns[name], str) else columns[name]
        if name == "synonym_risk":
            fails = F.coalesce(value, F.lit(0.0)) > least
        else:
            fails = F.coalesce(value.cast("double"), F.lit(0.0)) < least
        checks.append(F.when(fails, F.lit(name)))
    return F.array_compact(F.array(*checks))


# ---- search


def semantic_search(k: Knowledge, query: list[float], top_k: int = 10, min_similarity: float = 0.0, layer: str | None = None, column: str = "embedding") -> DataFrame:
    """Segments by cosine: (segment_id, similarity, preview); the similarity bound is applied after the limit."""
    vectors = k.segment_vec.select("segment_id", F.col(column).alias("v")).where("v is not null")
    if layer is not None:
        nodes = k.node.where(F.col("layer") == layer).select(F.col("node_id").alias("ontology_node_id"))
        vectors = vectors.join(k.segment_tag.join(nodes, "ontology_node_id", "left_semi").select("segment_id"), "segment_id", "left_semi")
    best = top(vectors.select("segment_id", cosine(F.col("v"), query).alias("similarity")).where("similarity is not null"), [F.desc("similarity"), "segment_id"], top_k)
    return best.where(F.col("similarity") >= min_similarity).join(k.segment.select("segment_id", F.substring("raw_text", 1, 300).alias("preview")), "segment_id")


def edu_search(k: Knowledge, query: list[float], title_weight: float = 0.3, top_k: int = 10) -> DataFrame:
    """Title and content together, content alone where there is no title vector; nulls last."""
    t, c = cosine(F.col("title_vec"), query), cosine(F.col("content_vec"), query)
    score = F.when(t.isNotNull(), title_weight * t + (1 - title_weight) * c).otherwise(c)
    return top(k.segment_vec.select("segment_id", score.alias("score")), [F.desc_nulls_last("score"), "segment_id"], top_k)


# ---- inspection


def isolated_nodes(k: Knowledge) -> DataFrame:
    typed = k.edge.where("predicate is not null")
    ends = typed.select(F.col("src").alias("node_id")).union(typed.select("dst")).distinct()
    return k.node.where("lifecycle_state = 'active'").join(ends, "node_id", "left_anti").select("node_id", "canonical_name", "layer")


def _incident(k: Knowledge) -> DataFrame:
    typed = k.edge.where("predicate is not null")
    return typed.select(F.col("src").alias("node_id"), "predicate").union(typed.where("src <> dst").select("dst", "predicate"))


def super_nodes(k: Knowledge, threshold: int = 50, n: int = 20, predicates: int = 5) -> DataFrame:
    """Nodes of a degree above the threshold with their most frequent predicates: (node_id, degree, histogram)."""
    counts = _incident(k).groupBy("node_id", "predicate").agg(F.count("*").alias("c"))
    degree = counts.groupBy("node_id").agg(F.sum("c").alias("degree"))
    best = top(degree.where(F.col("degree") > threshold), [F.desc("degree"), "node_id"], n)
    order = Window.partitionBy("node_id").orderBy(F.desc("c"), "predicate")
    rows = counts.join(best, "node_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= predicates)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "predicate", "c"))), lambda x: F.concat_ws(":", x["predicate"], x["c"])), ",")
    return rows.groupBy("node_id", "degree").agg(listed.alias("histogram"))


def degree_distribution(k: Knowledge) -> DataFrame:
    d = graph.degrees(k.node, k.edge)
    return d.agg(F.round(F.avg("degree"), 6).alias("avg_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.stddev_samp("degree"), 6).alias("stdev_degree"), F.count("*").alias("n_nodes"))


def predicate_concentration(k: Knowledge, least: int = 5, share: float = 0.8) -> DataFrame:
    counts = _incident(k).groupBy("node_id", "predicate").agg(F.count("*").alias("c"))
    one = counts.groupBy("node_id").agg(F.sum("c").alias("total"), F.min(F.struct((-F.col("c")).alias("c"), "predicate")).alias("m"))
    rate = -F.col("m.c") / F.col("total")
    return one.where((F.col("total") >= least) & (rate > share)).select("node_id", F.col("m.predicate").alias("predicate"), "total", F.round(rate, 6).alias("share"))


def cross_layer_check(k: Knowledge, gaps: bool = False) -> DataFrame:
    """For each layer pair the share of the first layer's nodes with an edge (either way) to the second; or the nodes
    without one."""
    pairs = k.spark.createDataFrame(list(model.LAYER_PAIRS), "layer_a string, layer_b string")
    layer = k.node.select("node_id", "layer").distinct()
    # every edge gets its layers once; those of a pair, whichever way, are turned to its first layer
    typed = k.edge.select("src", "dst").join(layer.select(F.col("node_id").alias("src"), F.col("layer").alias("s")), "src").join(layer.select(F.col("node_id").alias("dst"), F.col("layer").alias("d")), "dst")
    ends = F.explode(F.array(F.struct(F.col("s").alias("layer_a"), F.col("d").alias("layer_b"), F.col("src").alias("node_id")), F.struct(F.col("d").alias("layer_a"), F.col("s").alias("layer_b"), F.col("dst").alias("node_id"))))
    linked = typed.where(F.col("s") != F.col("d")).select(ends.alias("e")).select("e.*").join(F.broadcast(pairs), ["layer_a", "layer_b"]).distinct()
    every = layer.withColumnRenamed("layer", "layer_a").join(F.broadcast(pairs), "layer_a")
    if gaps:
        return every.join(linked, ["layer_a", "layer_b", "node_id"], "left_anti").select("layer_a", "layer_b", "node_id")
    marked = every.join(linked.withColumn("hit", F.lit(1)), ["layer_a", "layer_b", "node_id"], "left")
    return marked.groupBy("layer_a", "layer_b").agg(F.count("hit").alias("connected"), F.count("*").alias("total"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


def inheritance_stats(k: Knowledge) -> DataFrame:
    """Depth of the SUBCLASS_OF tree from its roots and its branching: one row."""
    e = k.edge.where("rel_type = 'SUBCLASS_OF'").select("src", "dst")
    roots = e.select(F.col("dst").alias("node_id")).distinct().join(e.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    depth = graph.bfs(k.edge, roots, ("SUBCLASS_OF",), "inbound", None).agg(F.coalesce(F.max("hop"), F.lit(0)).alias("max_depth"))
    branch = e.groupBy("dst").agg(F.count_distinct("src").alias("n"))
    stats = branch.agg(F.round(F.avg("n"), 6).alias("avg_branch"), F.max("n").alias("max_branch"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("single_child_ratio"))
    return depth.join(stats)


# ---- context


def reasoning_chain(k: Knowledge, seeds: DataFrame) -> DataFrame:
    """seeds (node_id) -> (seed, layer, node_id): mechanisms that explain a concept, methods that implement these,
    conditions the methods apply to, scenarios composed of them; each once per seed and layer."""
    e = k.edge.select("src", "rel_type", "dst")
    concept = seeds.select(F.col("node_id").alias("seed"), F.lit("concept").alias("layer"), "node_id").distinct()

    def hop(rows: DataFrame, relation: str, layer: str, back: bool = False) -> DataFrame:
        here, there = ("dst", "src") if back else ("src", "dst")
        found = rows.join(e.where(F.col("rel_type") == relation), F.col("node_id") == F.col(here))
        return found.select("seed", F.lit(layer).alias("layer"), F.col(there).alias("node_id")).distinct()

    mechanism = hop(concept, "EXPLAINS", "mechanism")
    method = hop(mechanism, "IMPLEMENTED_BY", "method")
    return concept.union(mechanism).union(method).union(hop(method, "APPLIES_TO", "condition")).union(hop(method, "COMPOSED_OF", "scenario", back=True))


def context_facts(k: Knowledge, seeds: DataFrame, per_seed: int = 30) -> DataFrame:
    """The most confident edges at each seed, each (src, predicate, dst) once."""
    typed = k.edge.where("predicate is not null").select("src", "predicate", "dst", "confidence")
    ids = seeds.select(F.col("node_id").alias("seed")).distinct()
    both = ids.join(typed, F.col("seed") == F.col("src")).union(ids.join(typed, F.col("seed") == F.col("dst"))).distinct()
    order = Window.partitionBy("seed").orderBy(F.desc("confidence"), "src", "predicate", "dst")
    kept = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_seed)
    return kept.groupBy("src", "predicate", "dst").agg(F.max("confidence").alias("confidence"))


def context_segments(k: Knowledge, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Active segments tagged with any of the nodes: (segment_id, matched, confidence, token_count)."""
    tags = k.segment_tag.join(nodes.select(F.col("node_id").alias("ontology_node_id")).distinct(), "ontology_node_id", "left_semi")
    matched = tags.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_set("ontology_node_id")), ",").alias("matched"))
    rows = k.segment.where("lifecycle_state = 'active'").join(matched, "segment_id").select("segment_id", "matched", "confidence", "token_count")
    return top(rows, [F.desc_nulls_last("confidence"), F.desc_nulls_last("token_count"), "segment_id"], limit)


def context_rst(k: Knowledge, segments: DataFrame) -> DataFrame:
    ids = segments.select("segment_id").distinct()
    return k.rst.join(ids.withColumnRenamed("segment_id", "src_edu_id"), "src_edu_id", "left_semi").join(ids.withColumnRenamed("segment_id", "dst_edu_id"), "dst_edu_id", "left_semi")


def context_evidence(k: Knowledge, nodes: DataFrame, limit: int = 30) -> DataFrame:
    ids = nodes.select(F.col("node_id").alias("subject")).distinct()
    rows = k.fact.where("lifecycle_state = 'active'").join(ids, "subject", "left_semi").select("fact_id", "subject", "predicate", "object", "confidence")
    rows = rows.join(k.evidence.select("fact_id", "source_doc_id", "source_rank"), "fact_id").join(k.document.select("source_doc_id", "site_key"), "source_doc_id")
    rows = rows.select("fact_id", "subject", "predicate", "object", "confidence", "source_rank", "site_key").distinct()
    return top(rows, [F.desc(rank_value(F.col("source_rank"))), F.desc("confidence"), "fact_id", "site_key"], limit)


# ---- staleness


def stale_facts(k: Knowledge, as_of: str, days: int = 180) -> DataFrame:
    before = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return k.evidence.groupBy("fact_id").agg(F.max("created_at").alias("latest")).where(F.col("latest") < before)


def stale_documents(k: Knowledge, as_of: str, days: int = 180) -> DataFrame:
    before = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return k.document.where((F.col("status") == "indexed") & (F.col("crawl_time") < before)).select("source_doc_id", "site_key", "crawl_time")


def weak_evidence(k: Knowledge) -> DataFrame:
    """Facts with a single piece of evidence of rank B or C."""
    one = k.evidence.groupBy("fact_id").agg(F.count("*").alias("n"), F.min("source_rank").alias("source_rank"))
    return one.where((F.col("n") == 1) & F.col("source_rank").isin("B", "C")).select("fact_id", "source_rank")
