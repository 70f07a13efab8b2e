"""From a metric of the report to the rows behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import quality
from weftgraph.knowledge import Knowledge
from weftgraph.operators import graph, semantic

METRICS = {
    "isolated_nodes": semantic.isolated_nodes,
    "super_nodes": semantic.super_nodes,
    "degree_distribution": semantic.degree_distribution,
    "predicate_concentration": semantic.predicate_concentration,
    "cross_layer_coverage": semantic.cross_layer_check,
    "cross_layer_gaps": lambda k: semantic.cross_layer_check(k, gaps=True),
    "inheritance": semantic.inheritance_stats,
    "weak_evidence": semantic.weak_evidence,
    "stale_facts": lambda k, as_of="2024-06-30", days=180: semantic.stale_facts(k, as_of, days),
    "stale_documents": lambda k, as_of="2024-06-30", days=180: semantic.stale_documents(k, as_of, days),
    "low_confidence_facts": lambda k, limit=50: semantic.filter_facts(k.fact, max_confidence=0.6, limit=limit),
    "high_confidence_facts": lambda k, limit=50: semantic.filter_facts(k.fact, min_confidence=0.9, limit=limit),
    "conflicted_facts": lambda k, limit=50: semantic.filter_facts(k.fact, lifecycle_state="conflicted", limit=limit),
    "superseded_facts": lambda k, limit=50: semantic.filter_facts(k.fact, lifecycle_state="superseded", limit=limit),
    "segments": lambda k, limit=50: semantic.filter_segments(k, limit=limit),
    "concepts": lambda k, limit=50: semantic.filter_concepts(k.node, limit=limit),
    "documents": lambda k, limit=50: semantic.top(k.document.select("source_doc_id", "site_key", "status"), ["source_doc_id"], limit),
    "candidates": lambda k, limit=50: semantic.top(k.candidate.select("candidate_id", "normalized_form", "composite_score"), [F.desc_nulls_last("composite_score"), "candidate_id"], limit),
    "similar_nodes": quality.similar_nodes,
    "predicate_overlap": lambda k: quality.predicate_overlap(k.edge),
    "cycles": lambda k, relation="DEPENDS_ON": graph.cycles(k.edge, relation),
}


def drilldown(k: Knowledge, metric: str, **parameters) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}': one of {sorted(METRICS)}")
    return METRICS[metric](k, **parameters)
