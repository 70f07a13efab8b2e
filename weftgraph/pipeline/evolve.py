"""Scoring candidates and letting them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.scoring import clamped, mapped
from weftgraph.operators.semantic import attach_score, gate_reasons
from weftgraph.pipeline import align


def source_scores(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, source_diversity, authority): a third of the number of distinct sites, at most 1; the best rank."""
    seen = candidates.select("candidate_id", F.explode("seen_source_doc_ids").alias("source_doc_id"))
    rows = seen.join(documents.select("source_doc_id", "site_key", "source_rank"), "source_doc_id")
    found = rows.groupBy("candidate_id").agg(F.least(F.lit(1.0), F.count_distinct("site_key") / 3).alias("d"), F.max(mapped(F.col("source_rank"), model.CANDIDATE_AUTHORITY, 0.4)).alias("a"))
    return candidates.select("candidate_id").distinct().join(found, "candidate_id", "left").select("candidate_id", F.round(F.coalesce("d", F.lit(0.0)), 4).alias("source_diversity"), F.coalesce("a", F.lit(0.4)).alias("authority"))


def temporal_stability(first_seen: Column, as_of: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.datediff(as_of, first_seen), F.lit(0)) / 14)), 4)


def structural_fit(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(candidate_id, structural_fit, parent_id): the best token Jaccard with a node's name."""
    best = attach_score(candidates, nodes, 1)
    return candidates.select("candidate_id").distinct().join(best, "candidate_id", "left").select("candidate_id", F.coalesce("score", F.lit(0.0)).alias("structural_fit"), F.col("node_id").alias("parent_id"))


def synonym_risk(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, synonym_risk): the greatest ratio of lengths among forms and aliases of which one contains the
    other. Aliases are sought in the distinct forms, and forms in the aliases, by one automaton each."""
    forms = candidates.select("candidate_id", F.explode("surface_forms").alias("f")).select("candidate_id", F.lower("f").alias("form")).where("form <> ''").distinct()
    dictionary = aliases.select(F.lower("surface_form").alias("alias")).where("alias <> ''").distinct()
    asked = forms.select("form").distinct().select(F.xxhash64("form").alias("segment_id"), F.col("form").alias("text"))
    known = dictionary.select(F.xxhash64("alias").alias("segment_id"), F.col("alias").alias("text"))
    terms = lambda rows: rows.select(F.col("text").alias("form"), F.col("text").alias("node_id"), F.lit(1.0).alias("confidence"))
    within = lambda texts, found: align.find_terms(texts, terms(found), whole_words=0).join(texts, "segment_id")
    pairs = within(asked, known).select(F.col("text").alias("form"), F.col("node_id").alias("alias")).union(within(known, asked).select(F.col("node_id").alias("form"), F.col("text").alias("alias")))
    ratio = F.least(F.length("form"), F.length("alias")) / F.greatest(F.length("form"), F.length("alias"))
    best = pairs.groupBy("form").agg(F.max(ratio).alias("r"))
    risk = forms.join(best, "form").groupBy("candidate_id").agg(F.round(F.max("r"), 4).alias("synonym_risk"))
    return candidates.select("candidate_id").distinct().join(risk, "candidate_id", "left").select("candidate_id", F.coalesce("synonym_risk", F.lit(0.0)).alias("synonym_risk"))


def composite(authority: Column, diversity: Column, stability: Column, fit: Column, synonym: Column) -> Column:
    w = model.COMPOSITE_WEIGHTS
    return clamped(w["authority"] * authority + w["diversity"] * diversity + w["stability"] * stability + w["fit"] * fit + w["gain"] * 0.5 - w["synonym"] * synonym)


def scored(candidates: DataFrame, documents: DataFrame, nodes: DataFrame, aliases: DataFrame, as_of: Column) -> DataFrame:
    """All scores of every candidate, the composite and the admission decision."""
    one = candidates.dropDuplicates(["candidate_id"])
    rows = one.select("candidate_id", "source_count", "first_seen_at", "review_status", temporal_stability(F.col("first_seen_at"), as_of).alias("temporal_stability"))
    rows = rows.join(source_scores(one, documents), "candidate_id").join(structural_fit(one, nodes), "candidate_id").join(synonym_risk(one, aliases), "candidate_id")
    rows = rows.withColumn("composite", composite(F.col("authority"), F.col("source_diversity"), F.col("temporal_stability"), F.col("structural_fit"), F.col("synonym_risk")))
    reasons = gate_reasons(source_count="source_count", source_diversity="source_diversity", temporal_stability="temporal_stability", structural_fit="structural_fit", composite="composite", synonym_risk="synonym_risk")
    rows = rows.withColumn("reasons", F.array_join(reasons, ","))
    old_enough = F.coalesce(F.datediff(as_of, F.col("first_seen_at")), F.lit(0)) >= model.MIN_POOL_DAYS
    decision = F.when((F.col("reasons") != "") | ~old_enough, F.col("review_status")).when((F.col("composite") >= model.AUTO_ACCEPT) & F.col("parent_id").isNotNull(), "auto_accepted").otherwise("pending_review")
    return rows.withColumn("decision", decision)



def enrichment_requests(candidates: DataFrame, segments: DataFrame, per_document: int = 5, examples: int = 3, characters: int = 400) -> DataFrame:
    """candidates (candidate_id, normalized_form, candidate_type, composite_score, description, doc_ids, example_segments)
    and segments (segment_id, raw_text) -> what a model is asked to describe: (candidate_id, normalized_form,
    candidate_type, texts), at most ``per_document`` candidates of a document that have a score and no description, with
    the beginnings of their first examples; candidates without a text of an example are left out."""
    open_ = candidates.where("composite_score > 0 and coalesce(description, '') = ''")
    first = Window.partitionBy("doc_id").orderBy("candidate_id")
    picked = open_.select("candidate_id", F.explode("doc_ids").alias("doc_id")).distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_document).select("candidate_id").distinct()
    listed = open_.join(picked, "candidate_id", "left_semi").select("candidate_id", "normalized_form", "candidate_type", F.posexplode(F.slice("example_segments", 1, examples)).alias("place", "segment_id"))
    texts = segments.where("coalesce(raw_text, '') <> ''").select("segment_id", F.substring("raw_text", 1, characters).alias("text"))
    held = listed.join(texts, "segment_id").groupBy("candidate_id", "normalized_form", "candidate_type").agg(F.array_sort(F.collect_set(F.struct("place", "text"))).alias("t"))
    return held.select("candidate_id", "normalized_form", "candidate_type", F.transform("t", lambda x: x["text"]).alias("texts"))
