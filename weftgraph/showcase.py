"""Compositions of the algebra and the operators: what a fault reaches, what hangs on a node, chains through the layers,
and the retrieval of a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.knowledge import Knowledge
from weftgraph.operators import graph, semantic
from weftgraph.pipeline import align
from weftgraph.plans import QueryEngine


def _segments_of(k: Knowledge, node_id: str, query: str, limit: int) -> DataFrame:
    steps = [
        {"op": "seed", "as": "$root", "by": "id", "target": "node", "value": [node_id]},
        {"op": "expand", "as": "$segs", "from": "$root", "any_of": ["tagged_in"]},
        {"op": "aggregate", "as": "$ranked", "from": "$segs", "function": "rerank", "query": query, "limit": limit},
    ]
    return QueryEngine(k).run({"steps": steps}).frame


def related_facts(k: Knowledge, prefix: str, limit: int = 15) -> DataFrame:
    """The most confident active facts of which an end begins with the prefix."""
    rows = k.fact.where((F.col("lifecycle_state") == "active") & (F.col("subject").startswith(prefix) | F.col("object").startswith(prefix)))
    return semantic.top(rows.select("fact_id", "subject", "predicate", "object", "confidence"), [F.desc_nulls_last("confidence"), "fact_id"], limit)


def fault_impact(k: Knowledge, node_id: str, query: str, relations: Sequence[str] = ("DEPENDS_ON", "CONFIGURED_BY", "CONTAINS", "EXPLAINS", "COMPOSED_OF"), depth: int = 2, segments: int = 8) -> dict[str, DataFrame]:
    """What a fault of a node may touch: ``affected`` nodes within ``depth`` hops either way, ``facts``, ``segments``."""
    walk = graph.bfs(k.edge, k.spark.createDataFrame([(node_id,)], "node_id string"), tuple(relations), "both", depth)
    affected = k.node.join(walk, "node_id").select("node_id", "canonical_name", "layer", F.col("rel_type").alias("relation"), "hop")
    return {"affected": affected, "facts": related_facts(k, node_id), "segments": _segments_of(k, node_id, query, segments)}


def dependency_report(k: Knowledge, node_id: str, query: str, relations: Sequence[str] = ("DEPENDS_ON", "REQUIRES"), depth: int = 3, segments: int = 5) -> dict[str, DataFrame]:
    """What a node rests on and what rests on it: ``nodes`` (node_id, side, hop), ``facts``, ``segments``."""
    seed = k.spark.createDataFrame([(node_id,)], "node_id string")
    side = lambda name, direction: graph.bfs(k.edge, seed, tuple(relations), direction, depth).select("node_id", F.lit(name).alias("side"), "hop")
    return {"nodes": side("dependency", "outbound").union(side("dependent", "inbound")), "facts": related_facts(k, node_id), "segments": _segments_of(k, node_id, query, segments)}


def cross_layer_chains(k: Knowledge, limit: int = 10, segments: int = 2) -> DataFrame:
    """Chains (concept, mechanism, method, condition, scenario) along edges either way, the last two where there are any;
    with the ids of the concept's ``segments`` longest segments. The first ``limit`` in the order of their nodes.

    Each layer adds only what continues the first ``limit`` chains so far: the order of the nodes decides from the left,
    so nothing further back can come in later."""
    edge = k.edge.select("src", "dst")
    both = edge.union(edge.select("dst", "src")).distinct()
    layer = lambda name: k.node.where(F.col("layer") == name).select(F.col("node_id").alias(name))

    def hop(rows: DataFrame, here: str, there: str, how: str) -> DataFrame:
        reached = both.join(layer(there), F.col("dst") == F.col(there)).select(F.col("src").alias(here), there)
        return rows.join(reached, here, how)

    active = k.node.where("layer = 'concept' and lifecycle_state = 'active'").select(F.col("node_id").alias("concept"))
    first = semantic.top(hop(hop(active, "concept", "mechanism", "inner"), "mechanism", "method", "inner").distinct(), ["concept", "mechanism", "method"], limit)
    more = hop(hop(first, "method", "condition", "left"), "condition", "scenario", "left").distinct()
    chains = semantic.top(more, ["concept", "mechanism", "method", F.asc_nulls_last("condition"), F.asc_nulls_last("scenario")], limit)
    tags = k.segment_tag.select("segment_id", F.col("ontology_node_id").alias("concept")).distinct().join(F.broadcast(chains.select("concept").distinct()), "concept")
    longest = Window.partitionBy("concept").orderBy(F.desc_nulls_last("token_count"), "segment_id")
    texts = k.segment.where("lifecycle_state = 'active'").join(tags, "segment_id").withColumn("n", F.row_number().over(longest)).where(F.col("n") <= segments)
    listed = texts.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "segment_id"))), lambda x: x["segment_id"].cast("string")), ",").alias("segments"))
    return chains.join(listed, "concept", "left").select("concept", "mechanism", "method", "condition", "scenario", F.coalesce("segments", F.lit("")).alias("segments"))


def retrieve(k: Knowledge, question: str, terms: Sequence[str], vector: list[float] | None = None, node_vectors: DataFrame | None = None, least: float = 0.4, alike: float = 0.5, n: int = 15) -> DataFrame:
    """The nodes a question is about, best first: (node_id, score, source). Aliases that stand in the question score 1,
    terms that are aliases 0.95, terms that contain an alias or are contained in one the ratio of their lengths (above
    ``least``, the best per term); the 5 nodes nearest to the question's vector from ``alike`` on where fewer than 3 are
    found. A node counts by its best."""
    asked = k.spark.createDataFrame([(0, question)], "segment_id long, text string")
    forms = k.alias.where("length(folded) > 3").select(F.col("folded").alias("form"), F.col("canonical_node_id").alias("node_id"), F.lit(1.0).alias("confidence"))
    exact = align.find_terms(asked, forms).select("node_id", F.lit(1.0).alias("score"), F.lit("alias_exact").alias("source"))
    folded = sorted({t.lower().strip() for t in terms} - {""})
    term = k.spark.createDataFrame([(t,) for t in folded], "term string")
    alias = k.alias.select("folded", F.col("canonical_node_id").alias("node_id"))
    named = alias.join(F.broadcast(term), F.col("folded") == F.col("term")).select("term", "node_id").distinct()
    # a handful of terms of one question against the dictionary
    near = alias.join(F.broadcast(term), F.contains("term", "folded") | F.contains("folded", "term")).where("folded <> ''").join(named.select("term"), "term", "left_anti")
    near = near.withColumn("score", F.round(F.least(F.length("term"), F.length("folded")) / F.greatest(F.length("term"), F.length("folded")), 2))
    best = near.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "node_id"))).where((F.col("i") == 1) & (F.col("score") > least))
    found = exact.union(named.select("node_id", F.lit(0.95), F.lit("alias_term"))).union(best.select("node_id", "score", F.lit("alias_partial")))
    if vector is not None and node_vectors is not None and found.select("node_id").distinct().limit(3).count() < 3:
        query = k.spark.createDataFrame([(0, vector)], "id long, vec array<double>")
        close = align.nearest_nodes(query, node_vectors, 5, alike).select("node_id", F.round("similarity", 3), F.lit("embedding"))
        found = found.union(close)
    one = found.groupBy("node_id").agg(F.max(F.struct("score", "source")).alias("m")).select("node_id", "m.score", "m.source")
    return semantic.top(one, [F.desc("score"), "node_id"], n)


def by_layer(k: Knowledge, nodes: DataFrame, facts: int = 15) -> dict[str, DataFrame]:
    """What an answer is written from: the ``nodes`` grouped by layer (layer, node_ids) and the most confident ``facts``
    at them."""
    listed = k.node.join(nodes.select("node_id").distinct(), "node_id", "left_semi").groupBy("layer").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("node_ids"))
    ids = nodes.select("node_id").distinct()
    at = k.fact.where("lifecycle_state = 'active'").select("fact_id", "subject", "predicate", "object", "confidence")
    rows = at.join(ids.withColumnRenamed("node_id", "subject"), "subject", "left_semi").unionByName(at.join(ids.withColumnRenamed("node_id", "object"), "object", "left_semi")).distinct()
    return {"layers": listed, "facts": semantic.top(rows, [F.desc_nulls_last("confidence"), "fact_id"], facts)}
