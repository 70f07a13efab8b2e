"""From facts to the graph: gates, aggregated edges, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import model


def gated(rows: DataFrame, least: float = model.INDEX_GATE) -> DataFrame:
    return rows.where((F.col("lifecycle_state") == "active") & (F.col("confidence") >= least))


def relation_type(predicate: Column) -> Column:
    """A relation's name for the graph: upper case, anything but letters and digits as one underscore."""
    return F.upper(F.regexp_replace(F.trim(predicate), r"[^A-Za-z0-9]+", "_"))


def edges(facts: DataFrame) -> DataFrame:
    """(src, rel_type, dst, predicate, confidence, fact_count) of the gated facts: recomputed as a whole, so running it
    again changes nothing."""
    grouped = gated(facts).groupBy(F.col("subject").alias("src"), "predicate", F.col("object").alias("dst")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("fact_count"))
    return grouped.select("src", relation_type(F.col("predicate")).alias("rel_type"), "dst", "predicate", "confidence", "fact_count")


def provenance(facts: DataFrame, evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """(fact_id, evidence_id, segment_id, source_doc_id) of the gated facts."""
    rows = gated(facts).select("fact_id").join(evidence.select("fact_id", "evidence_id", "segment_id"), "fact_id")
    return rows.join(segments.select("segment_id", "source_doc_id"), "segment_id").select("fact_id", "evidence_id", "segment_id", "source_doc_id")


def layer_of(node_id: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in model.PREFIX_LAYER.items() for x in kv])[F.split(node_id, r"\.")[0]]


def run(stages, frame: DataFrame, start: str | None = None, route=None):
    """Named stages (name, function) one after the other, from ``start`` on; ``route`` (column, {value: function}) sends
    the rows of each value through their own function first and puts the branches together again."""
    if route:
        column, branches = route
        parts = [f(frame.where(F.col(column) == v)) for v, f in branches.items()]
        rest = frame.where(F.coalesce(~F.col(column).isin(list(branches)), F.lit(True)))
        for part in parts:
            rest = rest.unionByName(part, allowMissingColumns=True)
        frame = rest
    names = [n for n, _ in stages]
    for name, f in stages[names.index(start) if start else 0 :]:
        frame = f(frame)
    return frame
