"""Governance, quality report and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftgraph import governance as G
from weftgraph import quality as Q
from weftgraph import showcase as W
from weftgraph.drilldown import METRICS, drilldown
from weftgraph.functions.vectors import mean_vector
from weftgraph.knowledge import Held
from weftgraph.pipeline import evolve
from weftgraph.queries.algebra import walk_sql
from weftgraph.queries.registry import Registry
from weftgraph.queries.semantic import _DEGREE, _TYPED
from weftgraph.queries.stages import AS_OF, EVIDENCE_VECTORS

R = Registry()
add, shared = R.add, R.shared

# ---- governance
add("confidence_total", lambda k: k.evidence.select("evidence_id", F.round(G.confidence_total(F.lit(0.8), F.lit(0.7), F.col("evidence_score"), F.lit(0.5), F.lit(1.0)), 6).alias("c")), "SELECT evidence_id, round(0.0 + cast(0.3 AS double) * 0.8 + cast(0.2 AS double) * 0.7 + cast(0.2 AS double) * evidence_score + cast(0.2 AS double) * 0.5 + cast(0.1 AS double) * 1.0, 6) AS c FROM {v_evidence}")
add(
    "conflict_semantic",
    lambda k: G.semantic_conflicts(k.fact, k.sql(EVIDENCE_VECTORS).select("fact_id", "vec"), 0.85).groupBy("a").agg(F.count("*").alias("n")),
    f"WITH v AS ({EVIDENCE_VECTORS}), r AS (SELECT f.fact_id, f.subject, f.predicate, f.object, v.vec::DOUBLE[] AS vec FROM {{v_fact}} f JOIN v ON v.fact_id = f.fact_id WHERE list_sum(list_transform(v.vec, lambda x: abs(x))) > 0), p AS (SELECT a.fact_id AS a, b.fact_id AS b FROM r a JOIN r b ON a.subject = b.subject WHERE a.fact_id < b.fact_id AND a.predicate <> b.predicate AND list_cosine_similarity(a.vec, b.vec) >= 0.85 UNION SELECT a.fact_id, b.fact_id FROM r a JOIN r b ON a.object = b.object WHERE a.fact_id < b.fact_id AND a.predicate <> b.predicate AND list_cosine_similarity(a.vec, b.vec) >= 0.85) SELECT a, count(*) AS n FROM p GROUP BY a",
)
shared("conflict_exact", "SELECT subject, predicate, count(DISTINCT object) AS n_objects FROM {v_fact} WHERE lifecycle_state = 'active' GROUP BY subject, predicate HAVING count(DISTINCT object) > 1")
# candidates have the mean of the vectors of the documents they were seen in, nodes of the segments tagged with them
_SEEN = "SELECT DISTINCT c.candidate_id, v.segment_id, v.content_vec AS vec FROM (SELECT candidate_id, explode(seen_source_doc_ids) AS doc_id FROM {v_candidate}) c JOIN {v_segment} s ON s.source_doc_id = c.doc_id JOIN {v_segment_vec} v ON v.segment_id = s.segment_id WHERE v.content_vec IS NOT NULL"
_TAGGED = "SELECT DISTINCT g.ontology_node_id AS node_id, v.segment_id, v.content_vec AS vec FROM {v_segment_tag} g JOIN {v_segment_vec} v ON v.segment_id = g.segment_id WHERE v.content_vec IS NOT NULL"
_mean = lambda rows, key: f"SELECT {key}, list(x ORDER BY place) AS vec FROM (SELECT {key}, place, avg(x) AS x FROM (SELECT {key}, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS place FROM ({rows}) r) u GROUP BY 1, 2) m GROUP BY 1"
_CV, _NV = _mean(_SEEN.replace("explode(", "unnest("), "candidate_id"), _mean(_TAGGED, "node_id")
_VARIANTS = f"WITH c AS ({_CV}), n AS ({_NV}), s AS (SELECT c.candidate_id, n.node_id, list_cosine_similarity(c.vec, n.vec) AS s FROM c, n WHERE list_sum(list_transform(c.vec, lambda x: abs(x))) > 0 AND list_sum(list_transform(n.vec, lambda x: abs(x))) > 0"
add(
    "maint_variant_detect",
    lambda k: G.variants(mean_vector(k.sql(_SEEN), "candidate_id").join(k.candidate.where("candidate_type = 'concept' and review_status <> 'accepted'").select("candidate_id"), "candidate_id", "left_semi"), mean_vector(k.sql(_TAGGED), "node_id").join(k.node.where("layer = 'concept'").select("node_id"), "node_id", "left_semi")).select("candidate_id", "node_id"),
    _VARIANTS + " AND c.candidate_id IN (SELECT candidate_id FROM {v_candidate} WHERE candidate_type = 'concept' AND review_status <> 'accepted') AND n.node_id IN (SELECT node_id FROM {v_node} WHERE layer = 'concept')), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, node_id) AS k FROM s) SELECT candidate_id, node_id FROM r WHERE k = 1 AND s >= 0.9",
)
_LINKS = "SELECT DISTINCT x.candidate_id AS a, y.candidate_id AS b FROM {v_candidate} x JOIN {v_candidate} y ON lower(trim(x.normalized_form)) = lower(trim(y.normalized_form)) AND x.candidate_id < y.candidate_id"
add(
    "maint_cluster_merge",
    lambda k: G.cluster_merge(k.candidate.where("normalized_form is not null").select("candidate_id", "normalized_form", "surface_forms", "source_count").dropDuplicates(["candidate_id"]), k.sql(_LINKS)).select("cluster_id", "primary_id", F.array_join("surface_forms", "|").alias("forms"), "source_count", "n_merged"),
    """WITH c AS (SELECT DISTINCT candidate_id, normalized_form, surface_forms, source_count FROM {v_candidate} WHERE normalized_form IS NOT NULL), g AS (SELECT *, min(candidate_id) OVER (PARTITION BY lower(trim(normalized_form))) AS cluster_id FROM c)
       SELECT cluster_id, arg_min(candidate_id, (-coalesce(source_count, 0), candidate_id)) AS primary_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(surface_forms, []))))), '|') AS forms, cast(sum(source_count) AS bigint) AS source_count, count(*) AS n_merged FROM g GROUP BY cluster_id""",
)
add("maint_cleanup", lambda k: G.stale_candidates(k.candidate, F.lit(AS_OF).cast("date")).select("candidate_id"), f"SELECT candidate_id FROM {{v_candidate}} WHERE coalesce(source_count, 0) <= 1 AND date_diff('day', cast(last_seen_at AS date), date '{AS_OF}') > 30")
# notes as a maintenance run leaves them behind: by a parent's id, by a name, or without a node
_NOTED = """SELECT candidate_id, surface_forms, CASE WHEN review_status = 'rejected' THEN 'auto_rejected' ELSE review_status END AS review_status,
    CASE WHEN review_status <> 'rejected' THEN NULL WHEN candidate_type = 'relation' THEN 'llm:noise' WHEN candidate_parent_id IS NOT NULL THEN concat('embedding_variant:', candidate_parent_id, ':0.934') WHEN source_count > 3 THEN concat('llm:variant:', normalized_form) ELSE 'llm: variant' END AS review_note,
    source_count, last_seen_at, seen_source_doc_ids AS example_segments FROM {v_candidate}"""
_CLEANED = f"""WITH c AS ({_NOTED}), a AS (SELECT name, p, node FROM (SELECT lower(canonical_name) AS name, 1 AS p, node_id AS node FROM {{v_node}} UNION ALL SELECT folded, 2, canonical_node_id FROM {{v_alias}}) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY p, node) = 1),
    t AS (SELECT c.*, coalesce(CASE WHEN starts_with(review_note, 'embedding_variant:') THEN split_part(review_note, ':', 2) END, CASE WHEN starts_with(review_note, 'llm:variant:') THEN a.node END) AS node FROM c LEFT JOIN a ON a.name = lower(trim(substr(review_note, 13), ' ')) AND starts_with(review_note, 'llm:variant:'))"""
add(
    "maint_clean_up",
    lambda k: G.clean_up(k.sql(_NOTED), k.node, k.alias, F.lit(AS_OF).cast("date")).candidates.select("candidate_id", "review_status", "review_note"),
    _CLEANED + f" SELECT candidate_id, CASE WHEN node IS NOT NULL THEN 'variant_merged' ELSE review_status END AS review_status, CASE WHEN node IS NOT NULL THEN concat('merged_into:', node) ELSE review_note END AS review_note FROM t WHERE NOT coalesce(review_note = 'llm:noise', false) AND NOT (review_note IS NOT NULL AND review_note <> 'llm:noise' AND node IS NULL) AND NOT coalesce(review_status = 'discovered' AND source_count = 1 AND date_diff('day', cast(last_seen_at AS date), date '{AS_OF}') > 30, false)",
)
add(
    "maint_clean_up_aliases",
    lambda k: G.clean_up(k.sql(_NOTED), k.node, k.alias, F.lit(AS_OF).cast("date")).aliases,
    _CLEANED + " SELECT DISTINCT surface_form, node AS canonical_node_id FROM (SELECT unnest(surface_forms) AS surface_form, node FROM t WHERE node IS NOT NULL) x WHERE trim(surface_form, ' ') <> ''",
)
# a reviewer merges candidates whose forms are equal but for case and blanks, the newest being the primary
_PICKED = "SELECT lower(trim(normalized_form)) AS group_id, candidate_id, candidate_id = max(candidate_id) OVER (PARTITION BY lower(trim(normalized_form))) AS is_primary FROM {v_candidate} WHERE normalized_form IS NOT NULL"
add(
    "review_merge",
    lambda k: G.review_merge(k.candidate.select("candidate_id", "surface_forms", "source_count"), k.sql(_PICKED)).select("candidate_id", F.array_join(F.array_sort("surface_forms"), "|").alias("forms"), F.col("source_count").cast("long").alias("source_count")),
    f"""WITH g AS ({_PICKED}), m AS (SELECT g.group_id, max(CASE WHEN g.is_primary THEN g.candidate_id END) AS candidate_id, list_sort(list_distinct(flatten(list(coalesce(c.surface_forms, []))))) AS f, cast(sum(coalesce(c.source_count, 0)) AS bigint) AS n FROM g JOIN {{v_candidate}} c ON c.candidate_id = g.candidate_id GROUP BY 1 HAVING count(*) > 1)
        SELECT candidate_id, array_to_string(f, '|') AS forms, n AS source_count FROM m UNION ALL SELECT candidate_id, array_to_string(list_sort(surface_forms), '|'), cast(source_count AS bigint) FROM {{v_candidate}} WHERE candidate_id NOT IN (SELECT g.candidate_id FROM g JOIN m ON m.group_id = g.group_id)""",
)
_EXAMPLES = "SELECT predicate AS normalized_form, {0} AS examples FROM (SELECT predicate, subject, object, cast(l_orderkey AS string) AS segment_id, cast(l_linenumber AS string) AS source_doc_id FROM {v_fact} WHERE lifecycle_state = 'conflicted') x GROUP BY predicate"
add(
    "review_retro_facts",
    lambda k: G.retro_facts(k.sql(_EXAMPLES.replace("{0}", "collect_list(named_struct('subject', subject, 'object', object, 'segment_id', segment_id, 'source_doc_id', source_doc_id))")))[0],
    "SELECT DISTINCT md5(concat_ws('|', subject, predicate, object)) AS fact_id, subject, predicate, object, cast(0.65 AS double) AS confidence, 'active' AS lifecycle_state FROM {v_fact} WHERE lifecycle_state = 'conflicted'",
)
add(
    "maint_cosine_links",
    lambda k: G.cosine_links(mean_vector(k.sql(_SEEN), "candidate_id")),
    f"WITH c AS ({_CV}) SELECT x.candidate_id AS a, y.candidate_id AS b FROM c x JOIN c y ON x.candidate_id < y.candidate_id WHERE list_sum(list_transform(x.vec, lambda v: abs(v))) > 0 AND list_sum(list_transform(y.vec, lambda v: abs(v))) > 0 AND list_cosine_similarity(x.vec, y.vec) >= 0.9",
)
add(
    "maint_too_generic",
    lambda k: G.too_generic(k.alias.where("length(surface_form) > 3"), k.segment),
    "WITH a AS (SELECT DISTINCT folded FROM {v_alias} WHERE length(surface_form) > 3), s AS (SELECT segment_id, lower(text) AS t FROM {v_segment} WHERE lifecycle_state = 'active') SELECT folded AS form, count(*) AS n_segments FROM a JOIN s ON contains(s.t, a.folded) GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM s)",
)
add("review_list", lambda k: G.review_list(k.candidate, "pending_review").select("candidate_id", "composite_score"), "SELECT candidate_id, composite_score FROM {v_candidate} WHERE review_status = 'pending_review' ORDER BY composite_score DESC NULLS LAST, candidate_id LIMIT 50")
_GROUPS = "SELECT cast(floor(segment_id / 1000) AS bigint) AS group_id, segment_id AS id, content_vec AS vec FROM {v_segment_vec} WHERE content_vec IS NOT NULL"
add(
    "review_synonyms",
    lambda k: G.synonym_verdict(k.sql(_GROUPS)).select("group_id", F.round("least", 5).alias("least"), "verdict"),
    "WITH g AS (" + _GROUPS + "), p AS (SELECT a.group_id, CASE WHEN list_sum(list_transform(a.vec, lambda x: abs(x))) = 0 OR list_sum(list_transform(b.vec, lambda x: abs(x))) = 0 THEN NULL ELSE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) END AS c FROM g a JOIN g b ON a.group_id = b.group_id AND a.id < b.id) SELECT group_id, round(min(c), 5) AS least, CASE WHEN min(c) >= 0.9 THEN 'yes' WHEN min(c) < 0.6 THEN 'no' ELSE 'unknown' END AS verdict FROM p GROUP BY group_id",
)
add(
    "review_approve",
    lambda k: G.approve(k.candidate.where("composite_score > 0.5 and normalized_form is not null")).select("node_id", "parent_id"),
    "WITH r AS (SELECT concat('IP.', upper(regexp_replace(regexp_replace(trim(normalized_form, ' '), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))) AS node_id, candidate_parent_id AS parent_id, candidate_id FROM {v_candidate} WHERE composite_score > 0.5 AND normalized_form IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY candidate_id) AS n FROM r WHERE length(node_id) > 3) SELECT node_id, parent_id FROM n WHERE n = 1",
)
add("migrate_normalized", lambda k: G.migrate_normalized(k.candidate))
_FORMS = "SELECT DISTINCT surface_form AS form, canonical_node_id AS node_id FROM {v_alias} WHERE length(surface_form) > 3"
add(
    "backfill",
    lambda k: G.backfill_terms(k.segment, k.segment_tag, k.sql(_FORMS)).select("segment_id", "node_id"),
    f"WITH f AS (SELECT DISTINCT lower(form) AS term, node_id FROM ({_FORMS}) x), h AS (SELECT DISTINCT s.segment_id, f.term, f.node_id FROM {{v_segment}} s JOIN f ON contains(lower(s.text), f.term) WHERE s.lifecycle_state = 'active'), n AS (SELECT h.*, row_number() OVER (PARTITION BY node_id, term ORDER BY segment_id) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM {{v_segment_tag}} g WHERE g.segment_id = h.segment_id AND g.ontology_node_id = h.node_id)) SELECT DISTINCT segment_id, node_id FROM n WHERE n <= 500",
)
_BROKEN = "SELECT CASE WHEN node_id LIKE '%LABEL%' THEN concat(node_id, 'X') ELSE node_id END AS node_id, CASE WHEN node_id LIKE '%FLOW%' THEN '' ELSE canonical_name END AS canonical_name, CASE WHEN node_id LIKE '%CACHE%' THEN 'other' ELSE layer END AS layer, lifecycle_state, parent_id FROM {v_node}"
add(
    "ontology_validate",
    lambda k: G.validate_ontology(k.sql(_BROKEN)),
    f"WITH n AS ({_BROKEN}) SELECT node_id, 'no canonical_name' AS problem FROM n WHERE trim(canonical_name, ' ') = '' UNION ALL SELECT node_id, 'unknown layer' FROM n WHERE layer = 'other' UNION ALL SELECT node_id, 'unknown parent' FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM n) UNION ALL SELECT node_id, 'double id' FROM n GROUP BY node_id HAVING count(*) > 1",
)
# tasks that were fetched are done after ingestion, and each document without a task gets one
_TASKS = "SELECT DISTINCT task_id, status, retry_count FROM {v_task}"
_DONE = "SELECT DISTINCT task_id, 'done' AS status, cast(NULL AS smallint) AS retry_count FROM {v_task} WHERE status = 'fetched' UNION ALL SELECT -1 - doc_id, 'done', cast(0 AS smallint) FROM {documents} WHERE crawl_task_id IS NULL OR crawl_task_id NOT IN (SELECT task_id FROM {v_task})"
add("upsert", lambda k: G.upsert(k.sql(_TASKS), k.sql(_DONE), "task_id"), f"SELECT coalesce(n.task_id, o.task_id) AS task_id, coalesce(n.status, o.status) AS status, coalesce(n.retry_count, o.retry_count) AS retry_count FROM ({_TASKS}) o FULL JOIN ({_DONE}) n ON n.task_id = o.task_id")

# ---- quality report
add(
    "quality_granularity",
    lambda k: Q.granularity(k),
    f"""WITH d AS {_DEGREE}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM d), b AS (SELECT avg(degree) + 3 * stddev_pop(degree) AS bound FROM d)
        SELECT (SELECT round(CASE WHEN sum(degree) > 0 THEN sum((2 * i - n - 1) * degree) / (max(n) * sum(degree)) ELSE 1 END, 6) FROM r) AS gini, (SELECT round(avg(CASE WHEN degree > bound THEN 1.0 ELSE 0.0 END), 6) FROM d, b) AS super_ratio, (SELECT round(avg(CASE WHEN degree = 0 THEN 1.0 ELSE 0.0 END), 6) FROM d) AS isolation,
        (SELECT round(avg(n), 6) FROM (SELECT count(DISTINCT ontology_node_id) AS n FROM {{v_segment_tag}} WHERE tag_type = 'canonical' GROUP BY segment_id) x) AS tags_per_segment""",
)
shared("quality_ubiquitous", "SELECT ontology_node_id, count(DISTINCT segment_id) AS n FROM {v_segment_tag} GROUP BY ontology_node_id HAVING count(DISTINCT segment_id) > 0.05 * (SELECT count(DISTINCT segment_id) FROM {v_segment_tag})")
add(
    "predicate_jaccard",
    lambda k: Q.predicate_overlap(k.edge, 0.0),
    "WITH r AS (SELECT DISTINCT src, dst, predicate FROM {v_edge} WHERE predicate IS NOT NULL), s AS (SELECT predicate, count(*) AS n FROM r GROUP BY 1), b AS (SELECT x.predicate AS a, y.predicate AS b, count(*) AS c FROM r x JOIN r y ON x.src = y.src AND x.dst = y.dst AND x.predicate < y.predicate GROUP BY 1, 2) SELECT b.a, b.b, round(c / (p.n + q.n - c), 6) AS jaccard FROM b JOIN s p ON p.predicate = b.a JOIN s q ON q.predicate = b.b",
)
shared("quality_top3_share", "SELECT round(sum(CASE WHEN r <= 3 THEN n ELSE 0 END) / sum(n), 6) AS share, count(*) AS n_predicates FROM (SELECT predicate, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, predicate) AS r FROM {v_edge} WHERE predicate IS NOT NULL GROUP BY predicate) x")
shared("quality_predicate_distribution", "SELECT predicate, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM {v_edge} WHERE predicate IS NOT NULL GROUP BY predicate")
shared("quality_concentrated_subjects", "SELECT src AS node_id, sum_n AS total, round(top_n / sum_n, 6) AS share FROM (SELECT src, cast(sum(n) AS bigint) AS sum_n, max(n) AS top_n FROM (SELECT src, predicate, count(*) AS n FROM {v_edge} WHERE predicate IS NOT NULL GROUP BY src, predicate) x GROUP BY src) y WHERE sum_n >= 5 AND top_n / sum_n > 0.8")
add(
    "quality_similar_nodes",
    lambda k: Q.similar_nodes(k),
    """WITH e AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM {v_edge} WHERE predicate IS NOT NULL UNION ALL SELECT dst, src FROM {v_edge} WHERE predicate IS NOT NULL) x WHERE a <> b), t AS (SELECT DISTINCT ontology_node_id AS a, concat('#', segment_id) AS b FROM {v_segment_tag}),
       i AS (SELECT * FROM e UNION ALL SELECT * FROM t), p AS (SELECT x.a, y.a AS b, sum(CASE WHEN starts_with(x.b, '#') THEN 0 ELSE 1 END) AS cn, sum(CASE WHEN starts_with(x.b, '#') THEN 1 ELSE 0 END) AS ct FROM i x JOIN i y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2),
       dn AS (SELECT a, count(*) AS n FROM e GROUP BY 1), dt AS (SELECT a, count(*) AS n FROM t GROUP BY 1),
       s AS (SELECT p.*, coalesce(n1.n, 0) - CASE WHEN l.a IS NULL THEN 0 ELSE 1 END AS na, coalesce(n2.n, 0) - CASE WHEN l.a IS NULL THEN 0 ELSE 1 END AS nb, coalesce(t1.n, 0) AS ta, coalesce(t2.n, 0) AS tb FROM p LEFT JOIN dn n1 ON n1.a = p.a LEFT JOIN dn n2 ON n2.a = p.b LEFT JOIN dt t1 ON t1.a = p.a LEFT JOIN dt t2 ON t2.a = p.b LEFT JOIN e l ON l.a = p.a AND l.b = p.b)
       SELECT a, b, score FROM (SELECT a, b, round(0.5 * CASE WHEN na + nb - cn > 0 THEN cn / (na + nb - cn) ELSE 0 END + 0.5 * CASE WHEN ta + tb - ct > 0 THEN ct / (ta + tb - ct) ELSE 0 END, 6) AS score FROM s) x WHERE score >= 0.3 ORDER BY score DESC, a, b LIMIT 50""",
)
shared("quality_direct_concept_scenario", "SELECT count(*) AS n FROM {v_edge} e JOIN {v_node} a ON a.node_id = e.src JOIN {v_node} b ON b.node_id = e.dst WHERE (a.layer = 'concept' AND b.layer = 'scenario') OR (a.layer = 'scenario' AND b.layer = 'concept')")
add("quality_complete_concepts", lambda k: Q.complete_concepts(k), "SELECT count(DISTINCT a.src) AS complete_concepts FROM {v_edge} a JOIN {v_edge} b ON b.src = a.dst AND b.rel_type = 'IMPLEMENTED_BY' WHERE a.rel_type = 'EXPLAINS' AND b.dst IN (SELECT src FROM {v_edge} WHERE rel_type = 'APPLIES_TO') AND b.dst IN (SELECT dst FROM {v_edge} WHERE rel_type = 'COMPOSED_OF')")
shared(
    "quality_dictionary",
    "SELECT round((SELECT count(DISTINCT canonical_node_id) FROM {v_alias}) / (SELECT count(*) FROM {v_node} WHERE lifecycle_state = 'active'), 6) AS alias_coverage, round((SELECT count(DISTINCT predicate) FROM {v_edge}) / (SELECT count(DISTINCT rel_type) FROM {v_edge}), 6) AS relation_utilization, round((SELECT count(DISTINCT segment_id) FROM {v_segment_tag}) / (SELECT count(*) FROM {v_segment}), 6) AS tag_hit_rate",
)
_MECH = "SELECT node_id FROM {v_node} WHERE layer IN ('method', 'condition', 'scenario')"
add(
    "quality_connectivity",
    lambda k: Q.connectivity(k.sql(_MECH), k.edge),
    f"""WITH RECURSIVE n AS (SELECT DISTINCT node_id FROM ({_MECH}) x), e AS (SELECT DISTINCT src, dst FROM {{v_edge}} WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)), w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT node_id, node_id AS c FROM n UNION SELECT w.dst, r.c FROM r JOIN w ON w.src = r.node_id), m AS (SELECT node_id, min(c) AS c FROM r GROUP BY 1), s AS (SELECT c, count(*) AS s FROM m GROUP BY 1)
        SELECT cast(sum(s) AS bigint) AS n_nodes, count(*) AS n_components, round(max(s) / sum(s), 6) AS largest_share, round(sum(s * (s - 1)) / (sum(s) * (sum(s) - 1)), 6) AS reachability, round((SELECT count(*) FROM e WHERE src <> dst) / (sum(s) * (sum(s) - 1)), 8) AS density FROM s""",
)
add("quality_fiedler", lambda k: k.spark.createDataFrame([(Q.fiedler_value(k.sql(_MECH), k.edge),)], "fiedler double").select(F.round("fiedler", 6).alias("fiedler")))
shared("quality_top_degree", f"SELECT node_id, count(*) AS degree FROM {_TYPED} t GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 15")

# ---- statistics
shared("stats_knowledge", "SELECT (SELECT count(*) FROM {v_document}) AS documents, (SELECT count(*) FROM {v_segment}) AS segments, (SELECT count(*) FROM {v_segment_tag}) AS tags, (SELECT count(*) FROM {v_fact}) AS facts, (SELECT count(*) FROM {v_fact} WHERE lifecycle_state = 'active') AS active_facts, (SELECT count(*) FROM {v_alias}) AS aliases, (SELECT count(*) FROM {v_node}) AS nodes")
shared("stats_fact_states", "SELECT lifecycle_state, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM {v_fact} GROUP BY lifecycle_state")
shared("stats_quality", "SELECT round(avg(CASE WHEN n = 1 AND r >= 'B' AND r <= 'C' THEN cast(1 AS double) ELSE cast(0 AS double) END), 6) AS weak_share, count(*) AS facts_with_evidence FROM (SELECT fact_id, count(*) AS n, min(source_rank) AS r FROM {v_evidence} GROUP BY fact_id) x")
shared("stats_sources", "SELECT d.site_key, count(DISTINCT d.source_doc_id) AS documents, count(s.segment_id) AS segments, round(avg(s.confidence), 6) AS avg_confidence FROM {v_document} d LEFT JOIN {v_segment} s ON s.source_doc_id = d.source_doc_id GROUP BY d.site_key")
shared("stats_evolution", "SELECT review_status, count(*) AS n, cast(sum(source_count) AS bigint) AS sources, round(avg(composite_score), 6) AS avg_score FROM {v_candidate} GROUP BY review_status")
shared("stats_pipeline", "SELECT status, count(*) AS n, sum(CASE WHEN finished_at >= timestamp '2024-03-01 00:00:00' THEN 1 ELSE 0 END) AS recent, max(retry_count) AS most_retries FROM {v_task} GROUP BY status".replace("sum(CASE WHEN finished_at >= timestamp '2024-03-01 00:00:00' THEN 1 ELSE 0 END)", "count(CASE WHEN finished_at >= timestamp '2024-03-01 00:00:00' THEN 1 END)"))
shared("stats_graph_health", f"SELECT layer, count(*) AS nodes, count(CASE WHEN degree = 0 THEN 1 END) AS isolated, max(degree) AS max_degree FROM {{v_node}} n JOIN {_DEGREE} d ON d.node_id = n.node_id GROUP BY layer")
_LAYER = lambda c: f"CASE WHEN {c} LIKE 'IP.%' THEN 'concept' WHEN {c} LIKE 'MECH.%' THEN 'mechanism' WHEN {c} LIKE 'METHOD.%' THEN 'method' WHEN {c} LIKE 'COND.%' THEN 'condition' WHEN {c} LIKE 'SCENE.%' THEN 'scenario' ELSE 'other' END"
shared("layer_matrix", f"SELECT {_LAYER('src')} AS subject_layer, {_LAYER('dst')} AS object_layer, count(*) AS n, cast(sum(fact_count) AS bigint) AS facts FROM {{v_edge}} GROUP BY 1, 2")
shared("stats_layer_nodes", f"SELECT {_LAYER('id')} AS layer, count(DISTINCT id) AS n FROM (SELECT src AS id FROM {{v_edge}} UNION ALL SELECT dst FROM {{v_edge}}) x GROUP BY 1")
shared("stats_top_predicates", "SELECT predicate, count(*) AS n FROM {v_fact} GROUP BY predicate ORDER BY n DESC, predicate LIMIT 10")
shared("stats_history", "SELECT event_id, ts, value FROM {events} WHERE ts >= timestamp '2024-01-30 12:00:00' AND ts < timestamp '2024-01-31 12:00:00'")
shared("stats_retention", "SELECT count(*) AS kept FROM {events} WHERE ts >= timestamp '2024-01-31 00:00:00' - INTERVAL '7' DAY")
shared("stats_snapshots", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")
shared("pipeline_flow", "SELECT (SELECT count(*) FROM {v_task} WHERE status IN ('done', 'fetched')) AS fetched, count(*) AS documents, count(CASE WHEN status IN ('segmented', 'indexed') THEN 1 END) AS segmented, count(CASE WHEN status = 'indexed' THEN 1 END) AS indexed, count(CASE WHEN status = 'low_quality' THEN 1 END) AS low_quality FROM {v_document}")
shared("recent_activity", "SELECT source_doc_id, site_key, status, crawl_time FROM {v_document} WHERE crawl_time IS NOT NULL ORDER BY crawl_time DESC, source_doc_id LIMIT 20")
shared("candidate_distribution", "SELECT bucket, count(*) AS n, min(source_count) AS least FROM (SELECT source_count, CASE WHEN source_count <= 1 THEN '1' WHEN source_count <= 3 THEN '2-3' WHEN source_count <= 10 THEN '4-10' ELSE '11+' END AS bucket FROM {v_candidate} WHERE source_count IS NOT NULL) x GROUP BY bucket")
shared("showcase_multi_source", "SELECT fact_id, n, CASE WHEN n >= 2 AND s >= 1 THEN 'confirmed' WHEN n >= 2 THEN 'supported' ELSE 'single' END AS verdict FROM (SELECT fact_id, count(*) AS n, count(CASE WHEN source_rank IN ('S', 'A') THEN 1 END) AS s FROM {v_evidence} GROUP BY fact_id) x")
shared("showcase_knowledge_gap", "SELECT n.layer, count(*) AS nodes, count(t.id) AS tagged, count(a.id) AS with_alias FROM {v_node} n LEFT JOIN (SELECT DISTINCT ontology_node_id AS id FROM {v_segment_tag}) t ON t.id = n.node_id LEFT JOIN (SELECT DISTINCT canonical_node_id AS id FROM {v_alias}) a ON a.id = n.node_id GROUP BY n.layer")
shared("copilot_alias_scan", "SELECT d.source_doc_id, a.canonical_node_id AS node_id, max(a.confidence) AS confidence FROM {v_document} d JOIN {v_alias} a ON length(a.folded) > 3 AND contains(lower(d.title), a.folded) GROUP BY 1, 2")
shared("ontology_summary", "SELECT layer, count(*) AS n, FIRST_EIGHT(node_id) AS first_ids FROM {v_node} GROUP BY layer UNION ALL SELECT 'relations', count(DISTINCT lower(rel_type)), SORTED_LIST(lower(rel_type)) FROM {v_edge}")

# ---- the report, compositions, retrieval
_ENRICH = "SELECT candidate_id, normalized_form, candidate_type, composite_score, cast(NULL AS string) AS description, seen_source_doc_ids AS doc_ids, seen_source_doc_ids AS example_segments FROM {v_candidate}"
_FIRST_OF = "SELECT source_doc_id AS segment_id, min(raw_text) AS raw_text FROM {v_segment} GROUP BY source_doc_id"
add(
    "candidate_enrichment",
    lambda k: evolve.enrichment_requests(k.sql(_ENRICH), k.sql(_FIRST_OF)).select("candidate_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|").cast("binary")).alias("digest")),
    f"""WITH c AS ({_ENRICH}), o AS (SELECT * FROM c WHERE composite_score > 0), p AS (SELECT DISTINCT candidate_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY doc ORDER BY candidate_id) AS n FROM (SELECT DISTINCT candidate_id, unnest(doc_ids) AS doc FROM o) x) y WHERE n <= 5),
        e AS (SELECT candidate_id, unnest(example_segments[1:3]) AS segment_id, generate_subscripts(example_segments[1:3], 1) AS i FROM o WHERE candidate_id IN (SELECT candidate_id FROM p)), s AS ({_FIRST_OF}),
        t AS (SELECT e.candidate_id, e.i, substr(s.raw_text, 1, 400) AS t FROM e JOIN s ON s.segment_id = e.segment_id WHERE coalesce(s.raw_text, '') <> '')
        SELECT candidate_id, cast(count(*) AS int) AS n, md5(string_agg(t, '|' ORDER BY i)) AS digest FROM t GROUP BY candidate_id""",
)
add("quality_layer_connectivity", lambda k: Q.layer_connectivity(k))
add("quality_report", lambda k: Q.report(k, k.edge.select("rel_type").distinct().count()))
_FAULT_RELATIONS = ("DEPENDS_ON", "IMPLEMENTED_BY")
add(
    "showcase_fault_impact",
    lambda k: W.fault_impact(k, "MECH.5", "policy timer", _FAULT_RELATIONS)["affected"].select("node_id", "layer", F.col("hop").cast("int").alias("hop")),
    f"""WITH RECURSIVE {walk_sql("SELECT 'MECH.5' AS node_id", _FAULT_RELATIONS, 2, "both")} SELECT n.node_id, n.layer, cast(r.hop AS int) AS hop FROM reached r JOIN {{v_node}} n ON n.node_id = r.node_id""",
)
_SIDE = lambda name, direction: f"SELECT node_id, '{name}' AS side, cast(hop AS int) AS hop FROM (WITH RECURSIVE {walk_sql(chr(39).join(['SELECT ', 'MECH.9', ' AS node_id']), ('DEPENDS_ON', 'REQUIRES'), 3, direction)} SELECT * FROM reached) x"
add(
    "showcase_dependency_closure",
    lambda k: W.dependency_report(k, "MECH.9", "policy timer")["nodes"].select("node_id", "side", F.col("hop").cast("int").alias("hop")),
    _SIDE("dependency", "outbound") + " UNION ALL " + _SIDE("dependent", "inbound"),
)
add("showcase_related_facts", lambda k: W.related_facts(k, "METHOD.1"), "SELECT fact_id, subject, predicate, object, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND (starts_with(subject, 'METHOD.1') OR starts_with(object, 'METHOD.1')) ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 15")
add(
    "showcase_cross_layer",
    lambda k: W.cross_layer_chains(k),
    """WITH b AS (SELECT DISTINCT * FROM (SELECT src, dst FROM {v_edge} UNION ALL SELECT dst, src FROM {v_edge}) x), l AS (SELECT b.src, b.dst, n.layer FROM b JOIN {v_node} n ON n.node_id = b.dst),
       f AS (SELECT DISTINCT c.node_id AS concept, m.dst AS mechanism, t.dst AS method FROM {v_node} c JOIN l m ON m.src = c.node_id AND m.layer = 'mechanism' JOIN l t ON t.src = m.dst AND t.layer = 'method' WHERE c.layer = 'concept' AND c.lifecycle_state = 'active' ORDER BY 1, 2, 3 LIMIT 10),
       g AS (SELECT DISTINCT f.*, o.dst AS condition, s.dst AS scenario FROM f LEFT JOIN l o ON o.src = f.method AND o.layer = 'condition' LEFT JOIN l s ON s.src = o.dst AND s.layer = 'scenario' ORDER BY 1, 2, 3, 4 NULLS LAST, 5 NULLS LAST LIMIT 10),
       p AS (SELECT g.concept, s.segment_id, row_number() OVER (PARTITION BY g.concept ORDER BY s.token_count DESC NULLS LAST, s.segment_id) AS n FROM (SELECT DISTINCT concept FROM g) g JOIN (SELECT DISTINCT segment_id, ontology_node_id FROM {v_segment_tag}) t ON t.ontology_node_id = g.concept JOIN {v_segment} s ON s.segment_id = t.segment_id WHERE s.lifecycle_state = 'active'),
       q AS (SELECT concept, string_agg(cast(segment_id AS string), ',' ORDER BY n) AS segments FROM p WHERE n <= 2 GROUP BY 1)
       SELECT g.*, coalesce(q.segments, '') AS segments FROM g LEFT JOIN q ON q.concept = g.concept""",
)
_QUESTION, _ASKED = "why does the kixwick session guard drop what drismar sends", ["Drismar", "Morbex Prefix", "fault"]
_QUESTION_TERMS = str([t.lower() for t in _ASKED])
add(
    "copilot_retrieve",
    lambda k: W.retrieve(k, _QUESTION, _ASKED),
    f"""WITH e AS (SELECT DISTINCT canonical_node_id AS node_id FROM {{v_alias}} WHERE length(folded) > 3 AND contains('{_QUESTION}', folded)), t AS (SELECT unnest({_QUESTION_TERMS}) AS term), n AS (SELECT DISTINCT t.term, a.canonical_node_id AS node_id FROM t JOIN {{v_alias}} a ON a.folded = t.term),
        p AS (SELECT t.term, a.canonical_node_id AS node_id, round(least(length(t.term), length(a.folded)) / greatest(length(t.term), length(a.folded)), 2) AS score FROM t JOIN {{v_alias}} a ON contains(t.term, a.folded) OR contains(a.folded, t.term) WHERE a.folded <> '' AND t.term NOT IN (SELECT term FROM n)),
        q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, node_id) = 1),
        u AS (SELECT node_id, cast(1 AS double) AS score, 'alias_exact' AS source FROM e UNION ALL SELECT node_id, 0.95, 'alias_term' FROM n UNION ALL SELECT node_id, score, 'alias_partial' FROM q WHERE score > 0.4)
        SELECT node_id, score, source FROM u QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score DESC, source DESC) = 1 ORDER BY score DESC, node_id LIMIT 15""",
)
add(
    "drilldown_all",
    lambda k: (lambda held: reduce(lambda a, b: a.union(b), [drilldown(held, m).agg(F.lit(m).alias("metric"), F.count("*").alias("n")) for m in sorted(METRICS)]))(Held(k)),
)
