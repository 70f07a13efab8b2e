"""Governance: candidates' variants and clusters, clean-up, review, migration, backfill, checks of the ontology."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.text import normalize_term
from weftgraph.functions.vectors import cosine
from weftgraph.operators.graph import components
from weftgraph.pipeline import align


def confidence_total(authority: Column, method: Column, fit: Column, consistency: Column, temporal: Column) -> Column:
    return sum((w * c for w, c in zip(model.FACT_WEIGHTS, (authority, method, fit, consistency, temporal))), F.lit(0.0))


def semantic_conflicts(facts: DataFrame, vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs (a, b), a < b, of facts that share the subject or the object but not the predicate and whose vectors are
    alike. Two equi-joins instead of one on an OR."""
    rows = facts.select("fact_id", "subject", "predicate", "object").join(vectors, "fact_id")
    a, b = rows.toDF("a", "sa", "pa", "oa", "va"), rows.toDF("b", "sb", "pb", "ob", "vb")
    other = (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & (cosine(F.col("va"), F.col("vb")) >= least)
    return a.join(b, (F.col("sa") == F.col("sb")) & other).select("a", "b").union(a.join(b, (F.col("oa") == F.col("ob")) & other).select("a", "b")).distinct()


def variants(candidate_vectors: DataFrame, node_vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(candidate_id, node_id, similarity): the most similar node of each candidate that is alike enough to be the same.
    Hand in candidates and nodes of one layer: a candidate of another layer is no variant of a node."""
    found = align.nearest_nodes(candidate_vectors.select(F.col("candidate_id").alias("id"), "vec"), node_vectors, 1, least)
    return found.select(F.col("id").alias("candidate_id"), "node_id", "similarity")


def cluster_merge(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """candidates (candidate_id, normalized_form, surface_forms, source_count) and links (a, b) of alike ones -> one row per
    cluster: the form of the greatest source count (ties: least id), all surface forms, the sum of the counts."""
    group = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("candidate_id"), "component")
    rows = candidates.join(group, "candidate_id", "left").withColumn("cluster_id", F.coalesce("component", "candidate_id"))
    primary = F.min(F.struct((-F.coalesce("source_count", F.lit(0))).alias("n"), "candidate_id", "normalized_form"))
    forms = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("surface_forms", F.array().cast("array<string>"))))))
    return rows.groupBy("cluster_id").agg(primary.alias("p"), forms.alias("surface_forms"), F.sum("source_count").alias("source_count"), F.count("*").alias("n_merged")).select("cluster_id", F.col("p.candidate_id").alias("primary_id"), F.col("p.normalized_form").alias("normalized_form"), "surface_forms", "source_count", "n_merged")


def cosine_links(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vectors (candidate_id, vec) -> links (a, b), a < b, of candidates at least so alike, for `cluster_merge`: a product
    of matrices, block by block."""
    named = vectors.select(F.col("candidate_id").cast("string").alias("node_id"), "vec")
    found = align.nearest_nodes(vectors.select(F.col("candidate_id").alias("id"), "vec"), named, None, least)
    return found.select(F.col("id").alias("a"), F.col("node_id").cast("long").alias("b")).where("a < b")


@dataclass(frozen=True)
class CleanUp:
    """The pool after a clean-up, and what merged variants leave behind: tags (segment_id, ontology_node_id, confidence,
    tagger) and aliases (surface_form, canonical_node_id)."""

    candidates: DataFrame
    tags: DataFrame
    aliases: DataFrame


def clean_up(candidates: DataFrame, nodes: DataFrame, aliases: DataFrame, as_of: Column, days: int = 30) -> CleanUp:
    """candidates (candidate_id, surface_forms, review_status, review_note, source_count, last_seen_at, example_segments),
    nodes (node_id, canonical_name), aliases (surface_form, canonical_node_id) -> the three rules of the clean-up:

    auto-rejected noise goes; an auto-rejected variant gives its forms and example segments to the node its note names
    (by id, or by a name or alias) and is marked as merged, or goes where the note names none; discovered candidates of
    one source that were not seen for ``days`` go. Everything else stays as it is."""
    note = F.coalesce("review_note", F.lit(""))
    rejected = F.coalesce(F.col("review_status") == "auto_rejected", F.lit(False))
    noise = rejected & note.rlike("^llm: ?noise$")
    variant = rejected & note.rlike("^(llm:variant:|llm: variant|embedding_variant:|embedding: ontology variant)")
    named = F.when(note.startswith("embedding_variant:"), F.split(note, ":")[1])
    asked = F.when(note.startswith("llm:variant:"), F.lower(F.trim(F.substring(note, len("llm:variant:") + 1, 1_000_000))))
    names = nodes.select(F.lower("canonical_name").alias("_asked"), F.lit(1).alias("p"), "node_id").union(aliases.select(F.lower("surface_form"), F.lit(2), F.col("canonical_node_id")))
    names = names.where("_asked is not null and node_id is not null").groupBy("_asked").agg(F.min(F.struct("p", "node_id")).alias("m")).select("_asked", F.col("m.node_id").alias("_node"))
    rows = candidates.withColumn("_noise", noise).withColumn("_variant", variant).withColumn("_named", named).withColumn("_asked", asked).join(names, "_asked", "left")
    rows = rows.withColumn("_to", F.when(F.col("_variant"), F.coalesce(F.when(F.col("_named") != "", F.col("_named")), "_node")))
    stale = (F.col("review_status") == "discovered") & (F.col("source_count") == 1) & (F.datediff(as_of, F.col("last_seen_at")) > days)
    gone = F.col("_noise") | (F.col("_variant") & F.col("_to").isNull()) | F.coalesce(stale, F.lit(False))
    merged = rows.where("_to is not null")
    marked = {"review_status": F.when(F.col("_to").isNotNull(), "variant_merged").otherwise(F.col("review_status")), "review_note": F.when(F.col("_to").isNotNull(), F.concat(F.lit("merged_into:"), "_to")).otherwise(F.col("review_note"))}
    kept = rows.where(~gone).select(*[marked[c].alias(c) if c in marked else F.col(c) for c in candidates.columns])
    tags = merged.select(F.explode("example_segments").alias("segment_id"), F.col("_to").alias("ontology_node_id")).where("segment_id is not null").distinct()
    return CleanUp(kept, tags.withColumn("confidence", F.lit(0.75)).withColumn("tagger", F.lit("maintenance")), merged.select(F.explode("surface_forms").alias("surface_form"), F.col("_to").alias("canonical_node_id")).where("trim(surface_form) <> ''").distinct())


def review_merge(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (group_id, candidate_id, is_primary) picked by a reviewer -> the pool with one candidate a group: the primary
    (of several the least id; the least id where none is named) with its forms first, then the others' new ones, and
    the sum of the source counts. Groups of fewer than two candidates change nothing."""
    known = groups.join(candidates.select("candidate_id", "surface_forms", "source_count"), "candidate_id")
    order = F.struct((~F.coalesce("is_primary", F.lit(False))).cast("int").alias("o"), "candidate_id", F.coalesce("surface_forms", F.array().cast("array<string>")).alias("f"), F.coalesce("source_count", F.lit(0)).alias("n"))
    made = known.groupBy("group_id").agg(F.array_sort(F.collect_set(order)).alias("x")).where(F.size("x") > 1)
    made = made.select(F.col("x")[0]["candidate_id"].alias("candidate_id"), F.array_distinct(F.flatten(F.transform("x", lambda c: c["f"]))).alias("_forms"), F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("_n"), F.transform("x", lambda c: c["candidate_id"]).alias("_all"))
    lost = made.select(F.explode("_all").alias("candidate_id"), F.col("candidate_id").alias("_kept")).where("candidate_id <> _kept").select("candidate_id")
    rows = candidates.join(lost, "candidate_id", "left_anti").join(made.drop("_all"), "candidate_id", "left")
    merged = {"surface_forms": F.coalesce("_forms", "surface_forms"), "source_count": F.coalesce(F.col("_n"), F.col("source_count").cast("long"))}
    return rows.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in candidates.columns])


def retro_facts(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved relations (normalized_form, examples array<struct<subject, object, segment_id, source_doc_id>>) -> the facts
    and evidence of their examples, each at 0.65; examples without both ends are left out. Ids are digests of what
    they stand for, so a second run adds nothing."""
    rows = relations.select(F.col("normalized_form").alias("predicate"), F.explode("examples").alias("e")).select("predicate", "e.*").where("coalesce(subject, '') <> '' and coalesce(object, '') <> ''").distinct()
    rows = rows.withColumn("fact_id", F.md5(F.concat_ws("|", "subject", "predicate", "object").cast("binary")))
    facts = rows.select("fact_id", "subject", "predicate", "object", F.lit(0.65).alias("confidence"), F.lit("active").alias("lifecycle_state")).distinct()
    evidence = rows.select(F.md5(F.concat_ws("|", "fact_id", "source_doc_id", "segment_id").cast("binary")).alias("evidence_id"), "fact_id", "source_doc_id", "segment_id", F.lit("B").alias("source_rank"), F.lit("llm").alias("extraction_method"), F.lit(0.65).alias("evidence_score"))
    return facts, evidence.distinct()


def load_ontology(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An ontology in YAML files below a folder: nodes (under ``nodes``), relations (``relations``) and aliases
    (``aliases``), each id once (the least of several rows)."""
    from weftgraph.sources.readers import read_yaml

    first = lambda rows, key: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*")
    nodes = first(read_yaml(spark, folder, "nodes", "node_id string, canonical_name string, display_name_zh string, layer string, parent_id string, lifecycle_state string"), "node_id")
    relations = first(read_yaml(spark, folder, "relations", "id string, domain_hint string, range_hint string, description string"), "id")
    aliases = read_yaml(spark, folder, "aliases", "surface_form string, canonical_node_id string, alias_type string, language string").where("surface_form is not null").distinct()
    return nodes.withColumn("lifecycle_state", F.coalesce("lifecycle_state", F.lit("active"))), relations, aliases


def validate_relations(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """relations (id, domain_hint, range_hint) and edges (src, predicate, dst) -> (predicate, problem, n): predicates that
    are not defined, and ends of another layer than the hints name (``any`` or null allows all)."""
    layer = lambda c: F.create_map(*[F.lit(x) for kv in model.PREFIX_LAYER.items() for x in kv])[F.split(c, r"\.")[0]]
    used = edges.where("predicate is not null").groupBy("predicate", layer(F.col("src")).alias("a"), layer(F.col("dst")).alias("b")).agg(F.count("*").alias("n"))
    known = used.join(relations.select(F.col("id").alias("predicate"), "domain_hint", "range_hint", F.lit(True).alias("known")), "predicate", "left")
    wrong = lambda hint, found: F.col(hint).isNotNull() & (F.col(hint) != "any") & (F.col(hint) != F.coalesce(F.col(found), F.lit("")))
    problems = F.array_compact(F.array(F.when(F.col("known").isNull(), "not defined"), F.when(wrong("domain_hint", "a"), "wrong subject"), F.when(wrong("range_hint", "b"), "wrong object")))
    return known.select("predicate", F.explode(problems).alias("problem"), "n").groupBy("predicate", "problem").agg(F.sum("n").alias("n"))


def stale_candidates(candidates: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Candidates of a single source not seen for so many days."""
    return candidates.where((F.coalesce("source_count", F.lit(0)) <= 1) & (F.datediff(as_of, F.col("last_seen_at")) > days))


def too_generic(aliases: DataFrame, segments: DataFrame, share: float = 0.05) -> DataFrame:
    """(form, n_segments): forms that stand in more than ``share`` of the active segments."""
    active = segments.where("lifecycle_state = 'active'")
    hits = align.find_terms(active.select("segment_id", "text"), aliases.select(F.col("surface_form").alias("form"), F.lower("surface_form").alias("node_id"), F.lit(1.0).alias("confidence")))
    counted = hits.groupBy(F.col("node_id").alias("form")).agg(F.count("*").alias("n_segments"))
    return counted.join(active.agg(F.count("*").alias("total"))).where(F.col("n_segments") > share * F.col("total")).select("form", "n_segments")


def review_list(candidates: DataFrame, status: str, n: int = 50) -> DataFrame:
    return candidates.where(F.col("review_status") == status).orderBy(F.desc_nulls_last("composite_score"), "candidate_id").limit(n)


def synonym_verdict(vectors: DataFrame, yes: float = 0.9, no: float = 0.6) -> DataFrame:
    """vectors (group_id, id, vec) -> (group_id, least, verdict): whether all of a group's members mean the same, by their
    least pairwise cosine. For groups picked for review, which are a handful of members each."""
    a, b = vectors.toDF("group_id", "a", "va"), vectors.toDF("group_id", "b", "vb")
    pairs = a.join(b, "group_id").where("a < b").select("group_id", cosine(F.col("va"), F.col("vb")).alias("c"))
    least = pairs.groupBy("group_id").agg(F.min("c").alias("least"))
    return least.select("group_id", "least", F.when(F.col("least") >= yes, "yes").when(F.col("least") < no, "no").otherwise("unknown").alias("verdict"))


def approve(candidates: DataFrame, prefix: str = "IP") -> DataFrame:
    """The nodes made of approved candidates: (node_id, canonical_name, parent_id, aliases)."""
    name = F.upper(F.regexp_replace(F.regexp_replace(F.trim("normalized_form"), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    aliases = F.array_sort(F.array_distinct(F.concat(F.coalesce("surface_forms", F.array().cast("array<string>")), F.array("normalized_form"))))
    rows = candidates.select(F.concat(F.lit(prefix + "."), name).alias("node_id"), F.col("normalized_form").alias("canonical_name"), F.col("candidate_parent_id").alias("parent_id"), aliases.alias("aliases"), "candidate_id")
    first = Window.partitionBy("node_id").orderBy("candidate_id")
    return rows.where(F.length("node_id") > len(prefix) + 1).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "candidate_id")


def next_version(version: str) -> str:
    """The version with its last number raised by one."""
    head, _, last = version.rpartition(".")
    return f"{head}.{int(last) + 1}"


def migrate_normalized(candidates: DataFrame) -> DataFrame:
    """Candidates grouped by the recomputed form: (term, candidate_id of the greatest source count, source_count, n)."""
    rows = candidates.where("normalized_form is not null").withColumn("term", normalize_term(F.col("normalized_form"))).where("term <> ''")
    best = F.min(F.struct((-F.coalesce("source_count", F.lit(0))).alias("c"), "candidate_id"))
    return rows.groupBy("term").agg(best.alias("b"), F.sum("source_count").alias("source_count"), F.count("*").alias("n")).select("term", F.col("b.candidate_id").alias("candidate_id"), "source_count", "n")


def backfill(segments: DataFrame, tags: DataFrame, node_forms: DataFrame, per_term: int = 500) -> DataFrame:
    """New tags (segment_id, node_id, confidence 0.85) for active segments that hold a form of a node and aren't tagged
    with it, at most ``per_term`` a node in the order of ids."""
    hits = align.find_terms(segments.where("lifecycle_state = 'active'").select("segment_id", "text"), node_forms.select("form", "node_id", F.lit(0.85).alias("confidence")))
    new = hits.join(tags.select("segment_id", F.col("ontology_node_id").alias("node_id")), ["segment_id", "node_id"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("segment_id"))).where(F.col("n") <= per_term).drop("n")


def backfill_terms(segments: DataFrame, tags: DataFrame, node_forms: DataFrame, per_term: int = 500) -> DataFrame:
    """The same with ``per_term`` new tags a form of a node, as the reference counts, instead of a node."""
    forms = node_forms.select(F.lower("form").alias("term"), "node_id").distinct()
    hits = align.find_terms(segments.where("lifecycle_state = 'active'").select("segment_id", "text"), forms.select(F.col("term").alias("form"), F.col("term").alias("node_id"), F.lit(0.85).alias("confidence")))
    new = hits.withColumnRenamed("node_id", "term").join(forms, "term").join(tags.select("segment_id", F.col("ontology_node_id").alias("node_id")), ["segment_id", "node_id"], "left_anti")
    first = new.withColumn("n", F.row_number().over(Window.partitionBy("node_id", "term").orderBy("segment_id"))).where(F.col("n") <= per_term)
    return first.select("segment_id", "node_id", "confidence").distinct()


def validate_ontology(nodes: DataFrame, layers: Sequence[str] = model.LAYERS) -> DataFrame:
    """(node_id, problem): missing fields, unknown layers, unknown parents, double ids."""
    missing = [nodes.where(F.col(c).isNull() | (F.trim(c) == "")).select("node_id", F.lit(f"no {c}").alias("problem")) for c in ("node_id", "canonical_name", "layer", "lifecycle_state")]
    out = missing[0]
    for part in missing[1:]:
        out = out.union(part)
    out = out.union(nodes.where(~F.col("layer").isin(list(layers))).select("node_id", F.lit("unknown layer")))
    parents = nodes.where("parent_id is not null").select("node_id", "parent_id").join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    out = out.union(parents.select("node_id", F.lit("unknown parent")))
    return out.union(nodes.groupBy("node_id").count().where("count > 1").select("node_id", F.lit("double id")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The snapshot after an upsert: where a key is in both, the new row's values that aren't null win."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns])
