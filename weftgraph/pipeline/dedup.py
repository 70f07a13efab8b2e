"""Duplicates and conflicts among segments and facts; every rule gives a new snapshot of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.functions.hashing import hamming
from weftgraph.functions.text import jaccard, token_set
from weftgraph.functions.vectors import cosine


def superseded_segments(segments: DataFrame) -> DataFrame:
    """segments (segment_id, source_doc_id, segment_index, simhash, text) -> ids of those that an earlier one of the same
    document repeats (within 3 bits and a Jaccard of 0.85). Candidates share one of four 16-bit blocks, so a long
    document is not compared all with all."""
    cut = F.array(*[F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)])
    keys = segments.where("simhash is not null").select("source_doc_id", "segment_id", "segment_index", "simhash", F.posexplode(cut).alias("block", "value"))
    a, b = keys.toDF("source_doc_id", "a", "ia", "ha", "block", "value"), keys.toDF("source_doc_id", "b", "ib", "hb", "block", "value")
    near = a.join(b, ["source_doc_id", "block", "value"]).where((F.struct("ia", "a") < F.struct("ib", "b")) & (hamming(F.col("ha"), F.col("hb")) <= model.DEDUP_HAMMING)).select("a", "b").distinct()
    tokens = segments.select("segment_id", token_set(F.coalesce("text", F.lit(""))).alias("t"))
    rows = near.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
    return rows.where(jaccard(F.col("ta"), F.col("tb")) >= model.DEDUP_JACCARD).select(F.col("b").alias("segment_id")).distinct()


def merge_same_triples(facts: DataFrame) -> DataFrame:
    """facts with merge_cluster_id and lifecycle_state: of equal (subject, predicate, object) the most confident stays.

    Two hashes stand for the triple, so that what is sorted, shuffled and joined are two numbers; the heads are partial
    minima joined back, hence a triple with very many facts is no task of its own."""
    triple = [F.xxhash64("subject", "predicate", "object").alias("_h"), F.xxhash64(F.lit(7), "object", "subject", "predicate").alias("_g")]
    best = F.min(F.struct(F.col("confidence").isNull().alias("none"), (-F.col("confidence")).alias("c"), "fact_id"))
    heads = facts.select(*triple, "confidence", "fact_id").groupBy("_h", "_g").agg(best.alias("_b")).select("_h", "_g", F.col("_b.fact_id").alias("merge_cluster_id"))
    state = F.when(F.col("merge_cluster_id") != F.col("fact_id"), "superseded").otherwise(F.col("lifecycle_state"))
    return facts.select("*", *triple).join(heads, ["_h", "_g"]).withColumn("lifecycle_state", state).select(*facts.columns, "merge_cluster_id")


def semantic_duplicates(facts: DataFrame, vectors: DataFrame, least: float = model.DEDUP_SEMANTIC) -> DataFrame:
    """facts (fact_id, subject, object, confidence), vectors (fact_id, vec) of their source texts -> ids of facts that a
    more confident one (ties: lesser id) with the same ends and an alike source stands for."""
    rows = facts.select("fact_id", "subject", "object", "confidence").join(vectors.select("fact_id", "vec"), "fact_id")
    a, b = rows.toDF("a", "subject", "object", "ca", "va"), rows.toDF("b", "subject", "object", "cb", "vb")
    before = (F.col("ca") > F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")))
    return a.join(b, ["subject", "object"]).where(before & (cosine(F.col("va"), F.col("vb")) >= least)).select(F.col("b").alias("fact_id")).distinct()


def functional_conflicts(facts: DataFrame, functional: Sequence[str]) -> DataFrame:
    """Pairs (fact_id_a, fact_id_b, outcome) with fact_id_a < fact_id_b of active facts of functional predicates, same
    subject, different objects: ``merge`` if one object's text contains the other's, else ``conflict``."""
    rows = facts.where((F.col("lifecycle_state") == "active") & F.col("predicate").isin(list(functional))).select("fact_id", "subject", "predicate", "object")
    a, b = rows.toDF("fact_id_a", "subject", "predicate", "oa"), rows.toDF("fact_id_b", "subject", "predicate", "ob")
    pairs = a.join(b, ["subject", "predicate"]).where("fact_id_a < fact_id_b and oa <> ob")
    x, y = F.lower(F.trim("oa")), F.lower(F.trim("ob"))
    return pairs.select("fact_id_a", "fact_id_b", F.when(F.contains(x, y) | F.contains(y, x), "merge").otherwise("conflict").alias("outcome"))


def conflicted_facts(facts: DataFrame, functional: Sequence[str]) -> DataFrame:
    """(fact_id) of every active fact of a functional predicate whose subject has another, unlike object: found by
    counting distinct objects, without a pair being made (use `functional_conflicts` for the records)."""
    rows = facts.where((F.col("lifecycle_state") == "active") & F.col("predicate").isin(list(functional)))
    many = rows.groupBy("subject", "predicate").agg(F.count_distinct(F.lower(F.trim("object"))).alias("n")).where("n > 1")
    return rows.join(many, ["subject", "predicate"], "left_semi").select("fact_id")
