"""The named operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.operators import graph
from weftgraph.operators import semantic as S
from weftgraph.queries.algebra import NEAR, VECTOR, cosine_sql, walk_sql
from weftgraph.queries.registry import Registry

R = Registry()
add = R.add


def one(*ids: str):
    return lambda k: k.spark.createDataFrame([(i,) for i in ids], "node_id string")


TERMS = ["Kixwick Session Guard", "drismar", "ASIA", "no such term"]
add(
    "lookup",
    lambda k: S.lookup(k, k.spark.createDataFrame([(t,) for t in TERMS], "term string")),
    """WITH terms AS (SELECT unnest(['Kixwick Session Guard', 'drismar', 'ASIA', 'no such term']) AS term),
       c AS (SELECT t.term, n.node_id, 1 AS p FROM terms t JOIN {v_node} n ON lower(n.canonical_name) = lower(t.term) UNION ALL SELECT t.term, a.canonical_node_id, 2 FROM terms t JOIN {v_alias} a ON a.folded = lower(t.term)),
       f AS (SELECT term, node_id, p FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p, node_id) AS n FROM c) x WHERE n = 1)
       SELECT t.term, f.node_id, n.canonical_name, n.layer, CASE f.p WHEN 1 THEN 'canonical' WHEN 2 THEN 'alias' ELSE 'not_found' END AS matched_by FROM terms t LEFT JOIN f ON f.term = t.term LEFT JOIN {v_node} n ON n.node_id = f.node_id""",
)
add(
    "resolve",
    lambda k: S.resolve(k, "Kixwick Session Guard"),
    """SELECT a.canonical_node_id AS node_id, n.canonical_name, a.alias_type, a.confidence, row_number() OVER (ORDER BY a.confidence DESC, a.canonical_node_id, a.alias_id) = 1 AS is_primary
       FROM {v_alias} a LEFT JOIN {v_node} n ON n.node_id = a.canonical_node_id WHERE a.folded = 'kixwick session guard'""",
)
add(
    "expand",
    lambda k: S.expand(k, "MECH.5", ["DEPENDS_ON", "REQUIRES", "IMPLEMENTED_BY"], 1, 0.5),
    """SELECT * FROM (SELECT DISTINCT * FROM (SELECT dst AS node_id, rel_type, 'out' AS direction, confidence FROM {v_edge} WHERE src = 'MECH.5' AND coalesce(confidence, 1) >= 0.5
       UNION ALL SELECT src, rel_type, 'in', confidence FROM {v_edge} WHERE dst = 'MECH.5' AND coalesce(confidence, 1) >= 0.5) x WHERE rel_type IN ('DEPENDS_ON', 'REQUIRES', 'IMPLEMENTED_BY')) y ORDER BY node_id, rel_type, direction LIMIT 50""",
)
add(
    "filter_fact",
    lambda k: S.filter_facts(k.fact, min_confidence=0.6, max_confidence=0.95, domain="ip_network", after="1997-01-01", limit=50, offset=10).select("fact_id", "subject", "predicate", "object", "confidence"),
    "SELECT fact_id, subject, predicate, object, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND confidence >= 0.6 AND confidence <= 0.95 AND domain = 'ip_network' AND created_at >= timestamp '1997-01-01' ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 50 OFFSET 10",
)
_TAGS = ["METHOD.PISFEN_BACKUP_ELECTION", "IP.KELDOCK_PEER_DISCOVERY", "MECH.VEBVANE_PREFIX_RELAY", "IP.BRELGORY_QUEUE_SHAPING"]
add(
    "filter_segment",
    lambda k: S.filter_segments(k, _TAGS, ["S", "A", "B"], 0.5, limit=100).select("segment_id", "source_doc_id", "source_rank", "confidence"),
    f"SELECT s.segment_id, s.source_doc_id, d.source_rank, s.confidence FROM {{v_segment}} s JOIN {{v_document}} d ON d.source_doc_id = s.source_doc_id WHERE s.lifecycle_state = 'active' AND s.confidence >= 0.5 AND d.source_rank IN ('S', 'A', 'B') AND s.segment_id IN (SELECT segment_id FROM {{v_segment_tag}} WHERE ontology_node_id IN {tuple(_TAGS)}) ORDER BY s.confidence DESC NULLS LAST, s.segment_id LIMIT 100",
)
add("filter_concept", lambda k: S.filter_concepts(k.node, "IP.", 40, 5).select("node_id", "canonical_name"), "SELECT node_id, canonical_name FROM {v_node} WHERE lifecycle_state = 'active' AND starts_with(node_id, 'IP.') ORDER BY node_id LIMIT 40 OFFSET 5")
add(
    "path",
    lambda k: S.path_infer(k, "MECH.1", "MECH.49", "dependency").select("hops", F.array_join("node_ids", ">").alias("nodes"), F.array_join("rel_types", ">").alias("rels"), F.round("min_confidence", 6).alias("min_confidence")),
    """WITH RECURSIVE hops AS (SELECT src AS here, dst AS there, rel_type, coalesce(confidence, 1.0) AS c FROM {v_edge} WHERE rel_type IN ('DEPENDS_ON', 'REQUIRES') UNION ALL SELECT dst, src, rel_type, coalesce(confidence, 1.0) FROM {v_edge} WHERE rel_type IN ('DEPENDS_ON', 'REQUIRES')),
       p AS (SELECT 0 AS hops, 'MECH.1' AS place, ['MECH.1'] AS ids, cast([] AS string[]) AS rels, cast(1.0 AS double) AS c UNION ALL
             SELECT p.hops + 1, h.there, list_append(p.ids, h.there), list_append(p.rels, h.rel_type), least(p.c, h.c) FROM p JOIN hops h ON h.here = p.place WHERE p.hops < 4 AND p.place <> 'MECH.49' AND NOT list_contains(p.ids, h.there)),
       f AS (SELECT * FROM p WHERE place = 'MECH.49'), s AS (SELECT * FROM f WHERE hops = (SELECT min(hops) FROM f) ORDER BY ids, rels LIMIT 5)
       SELECT hops, array_to_string(ids, '>') AS nodes, array_to_string(rels, '>') AS rels, round(c, 6) AS min_confidence FROM s""",
)
add(
    "dependency_closure",
    lambda k: S.dependency_closure(k, "MECH.3", max_depth=3),
    f"""WITH RECURSIVE {walk_sql("SELECT 'MECH.3' AS node_id", ("DEPENDS_ON", "REQUIRES"), 2)}
        SELECT e.src AS node_id, e.rel_type, string_agg(DISTINCT e.dst, ',' ORDER BY e.dst) AS children FROM {{v_edge}} e WHERE e.rel_type IN ('DEPENDS_ON', 'REQUIRES') AND (e.src = 'MECH.3' OR e.src IN (SELECT node_id FROM reached)) GROUP BY e.src, e.rel_type""",
)
add(
    "impact_propagate",
    lambda k: S.impact_propagate(k, "MECH.7", "service", "fault", 3).select("node_id", "depth", F.round("confidence", 6).alias("confidence"), "impact_type"),
    f"""WITH RECURSIVE {walk_sql("SELECT 'MECH.7' AS node_id", model.IMPACT_POLICIES["service"], 3)} SELECT node_id, hop AS depth, round(confidence, 6) AS confidence, 'disrupted' AS impact_type FROM reached WHERE node_id <> 'MECH.7'""",
)
add(
    "evidence_rank",
    lambda k: S.evidence_rank(k, k.fact.where("subject IN ('METHOD.1', 'METHOD.2')").select("fact_id"), "evidence_score", 2),
    """SELECT fact_id, evidence_id, site_key, source_rank, extraction_method, evidence_score, cast(rank AS int) AS rank FROM (SELECT e.fact_id, e.evidence_id, d.site_key, e.source_rank, e.extraction_method, e.evidence_score, row_number() OVER (PARTITION BY e.fact_id ORDER BY e.evidence_score DESC NULLS LAST, e.evidence_id) AS rank
       FROM {v_evidence} e LEFT JOIN {v_document} d ON d.source_doc_id = e.source_doc_id WHERE e.fact_id IN (SELECT fact_id FROM {v_fact} WHERE subject IN ('METHOD.1', 'METHOD.2'))) x WHERE rank <= 2""",
)


def conflicts(k):
    f = k.fact.select("fact_id", "subject", "predicate", "object").where("predicate = 'depends_on'")
    b = f.toDF("fact_id_b", "subject", "predicate", "object_b")
    return f.withColumnRenamed("fact_id", "fact_id_a").join(b, ["subject", "predicate"]).where("object <> object_b and fact_id_a < fact_id_b").select("fact_id_a", "fact_id_b", F.lit("functional").alias("conflict_type"))


add(
    "conflict_detect",
    lambda k: S.conflict_detect(k.fact, conflicts(k), "METHOD.1", 0.6).select("fact_id_a", "fact_id_b", "object_a", "object_b", "confidence_a", "confidence_b"),
    "SELECT a.fact_id AS fact_id_a, b.fact_id AS fact_id_b, a.object AS object_a, b.object AS object_b, a.confidence AS confidence_a, b.confidence AS confidence_b FROM {v_fact} a JOIN {v_fact} b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object AND a.fact_id < b.fact_id WHERE a.predicate = 'depends_on' AND a.subject = 'METHOD.1' AND a.confidence >= 0.6",
)
_CLUSTERS = "SELECT concat_ws('|', subject, predicate, object) AS cluster_id, fact_id, confidence FROM {v_fact}"
add(
    "fact_merge",
    lambda k: S.fact_merge(k.fact, k.evidence, k.sql(_CLUSTERS).select("cluster_id", "fact_id"))[0].select("fact_id", "lifecycle_state", "merge_cluster_id"),
    f"WITH c AS ({_CLUSTERS}), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, fact_id) AS n FROM c) SELECT f.fact_id, CASE WHEN r.n > 1 THEN 'superseded' ELSE f.lifecycle_state END AS lifecycle_state, r.cluster_id AS merge_cluster_id FROM {{v_fact}} f JOIN r ON r.fact_id = f.fact_id",
)
add(
    "fact_merge_evidence",
    lambda k: S.fact_merge(k.fact, k.evidence, k.sql(_CLUSTERS).select("cluster_id", "fact_id"))[1].groupBy("fact_id").agg(F.count("*").alias("n")),
    f"WITH c AS ({_CLUSTERS}), r AS (SELECT fact_id, first_value(fact_id) OVER (PARTITION BY cluster_id ORDER BY confidence DESC, fact_id) AS head FROM c) SELECT coalesce(r.head, e.fact_id) AS fact_id, count(*) AS n FROM {{v_evidence}} e LEFT JOIN r ON r.fact_id = e.fact_id GROUP BY 1",
)
AS_OF = "2024-06-30"
add(
    "candidate_discover",
    lambda k: S.candidate_discover(k.candidate, AS_OF, 2000, 2, 5),
    f"SELECT normalized_form, cast(sum(source_count) AS bigint) AS frequency, count(*) AS n_candidates FROM {{v_candidate}} WHERE last_seen_at >= timestamp '{AS_OF}' - INTERVAL 2000 DAY AND source_count >= 2 AND normalized_form IS NOT NULL GROUP BY normalized_form HAVING sum(source_count) >= 5 ORDER BY frequency DESC, normalized_form LIMIT 100",
)
add(
    "attach_score",
    lambda k: S.attach_score(k.candidate.select("candidate_id", "surface_forms").where("surface_forms is not null"), k.table("ontology_nodes").select("node_id", F.col("canonical_name").alias("name"))),
    """WITH c AS (SELECT DISTINCT candidate_id, unnest(regexp_split_to_array(lower(f), '\\s+')) AS token FROM (SELECT candidate_id, unnest(surface_forms) AS f FROM {v_candidate}) x), cc AS (SELECT * FROM c WHERE token <> ''), cn AS (SELECT candidate_id, count(*) AS n FROM cc GROUP BY 1),
       p AS (SELECT DISTINCT node_id, unnest(regexp_split_to_array(lower(canonical_name), '\\s+')) AS token FROM {ontology_nodes}), pn AS (SELECT node_id, count(*) AS m FROM p GROUP BY 1),
       b AS (SELECT cc.candidate_id, p.node_id, count(*) AS c FROM cc JOIN p ON p.token = cc.token GROUP BY 1, 2), s AS (SELECT b.candidate_id, b.node_id, round(c / (n + m - c), 4) AS score FROM b JOIN cn ON cn.candidate_id = b.candidate_id JOIN pn ON pn.node_id = b.node_id)
       SELECT candidate_id, node_id, score, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, node_id) AS rank FROM s) x WHERE rank <= 5""",
)
add(
    "semantic_search",
    lambda k: S.semantic_search(k, VECTOR, 25, 0.1).select("segment_id", F.round("similarity", 6).alias("similarity"), "preview"),
    f"WITH n AS (SELECT segment_id, {cosine_sql('embedding')} AS similarity FROM {{v_segment_vec}}), t AS (SELECT * FROM n WHERE similarity IS NOT NULL ORDER BY similarity DESC, segment_id LIMIT 25) SELECT t.segment_id, round(t.similarity, 6) AS similarity, substr(s.raw_text, 1, 300) AS preview FROM t JOIN {{v_segment}} s ON s.segment_id = t.segment_id WHERE t.similarity >= 0.1",
)
add(
    "semantic_search_layer",
    lambda k: S.semantic_search(k, VECTOR, 25, 0.0, "method", "content_vec").select("segment_id", F.round("similarity", 6).alias("similarity")),
    f"WITH n AS (SELECT segment_id, {cosine_sql('content_vec')} AS similarity FROM {{v_segment_vec}} WHERE segment_id IN (SELECT g.segment_id FROM {{v_segment_tag}} g JOIN {{v_node}} n ON n.node_id = g.ontology_node_id WHERE n.layer = 'method')), t AS (SELECT * FROM n WHERE similarity IS NOT NULL ORDER BY similarity DESC, segment_id LIMIT 25) SELECT segment_id, round(similarity, 6) AS similarity FROM t WHERE similarity >= 0 AND segment_id IN (SELECT segment_id FROM {{v_segment}})",
)
add(
    "edu_search",
    lambda k: S.edu_search(k, VECTOR, 0.3, 25).select("segment_id", F.round("score", 6).alias("score")),
    f"WITH n AS (SELECT segment_id, {cosine_sql('title_vec')} AS t, {cosine_sql('content_vec')} AS c FROM {{v_segment_vec}}) SELECT segment_id, round(CASE WHEN t IS NOT NULL THEN 0.3 * t + 0.7 * c ELSE c END, 6) AS score FROM n ORDER BY CASE WHEN t IS NOT NULL THEN 0.3 * t + 0.7 * c ELSE c END DESC NULLS LAST, segment_id LIMIT 25",
)
_TYPED = "(SELECT src AS node_id, predicate FROM {v_edge} WHERE predicate IS NOT NULL UNION ALL SELECT dst, predicate FROM {v_edge} WHERE predicate IS NOT NULL AND src <> dst)"
add("graph_isolated", lambda k: S.isolated_nodes(k), f"SELECT node_id, canonical_name, layer FROM {{v_node}} WHERE lifecycle_state = 'active' AND node_id NOT IN (SELECT node_id FROM {_TYPED} t)")
add(
    "graph_super_nodes",
    lambda k: S.super_nodes(k, 30, 20),
    f"""WITH c AS (SELECT node_id, predicate, count(*) AS c FROM {_TYPED} t GROUP BY 1, 2), d AS (SELECT node_id, cast(sum(c) AS bigint) AS degree FROM c GROUP BY 1 HAVING sum(c) > 30 ORDER BY 2 DESC, 1 LIMIT 20),
        r AS (SELECT c.node_id, d.degree, c.predicate, c.c, row_number() OVER (PARTITION BY c.node_id ORDER BY c.c DESC, c.predicate) AS r FROM c JOIN d ON d.node_id = c.node_id)
        SELECT node_id, degree, string_agg(concat(predicate, ':', c), ',' ORDER BY r) AS histogram FROM r WHERE r <= 5 GROUP BY 1, 2""",
)
_DEGREE = f"(SELECT n.node_id, count(t.node_id) AS degree FROM {{v_node}} n LEFT JOIN {_TYPED} t ON t.node_id = n.node_id GROUP BY n.node_id)"
add("degree_distribution", lambda k: S.degree_distribution(k), f"SELECT round(avg(degree), 6) AS avg_degree, quantile_cont(degree, 0.5) AS median_degree, max(degree) AS max_degree, min(degree) AS min_degree, round(stddev_samp(degree), 6) AS stdev_degree, count(*) AS n_nodes FROM {_DEGREE} d")
add(
    "predicate_concentration",
    lambda k: S.predicate_concentration(k, 5, 0.5),
    f"WITH c AS (SELECT node_id, predicate, count(*) AS c FROM {_TYPED} t GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY node_id) AS total, row_number() OVER (PARTITION BY node_id ORDER BY c DESC, predicate) AS n FROM c) SELECT node_id, predicate, cast(total AS bigint) AS total, round(c / total, 6) AS share FROM r WHERE n = 1 AND total >= 5 AND c / total > 0.5",
)
_DEFINED = [(p,) for p in ("depends_on", "requires", "impacts", "causes", "implemented_by", "explains", "applies_to", "composed_of", "constrained_by", "is_a", "part_of")]
add(
    "unused_predicates",
    lambda k: k.spark.createDataFrame(_DEFINED, "predicate string").join(k.edge.where("predicate is not null").select("predicate").distinct(), "predicate", "left_anti"),
    f"SELECT predicate FROM (SELECT unnest({[p for p, in _DEFINED]}) AS predicate) d WHERE predicate NOT IN (SELECT predicate FROM {{v_edge}} WHERE predicate IS NOT NULL)",
)
_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in model.LAYER_PAIRS) + ") p(layer_a, layer_b)"
_LINKED = "(SELECT DISTINCT a.layer AS layer_a, b.layer AS layer_b, a.node_id FROM (SELECT src, dst FROM {v_edge} UNION ALL SELECT dst, src FROM {v_edge}) e JOIN {v_node} a ON a.node_id = e.src JOIN {v_node} b ON b.node_id = e.dst)"
add(
    "cross_layer_coverage",
    lambda k: S.cross_layer_check(k),
    f"SELECT p.layer_a, p.layer_b, count(l.node_id) AS connected, count(*) AS total, round(count(l.node_id) / count(*), 6) AS coverage FROM {_PAIRS} JOIN {{v_node}} n ON n.layer = p.layer_a LEFT JOIN {_LINKED} l ON l.layer_a = p.layer_a AND l.layer_b = p.layer_b AND l.node_id = n.node_id GROUP BY 1, 2",
)
add(
    "cross_layer_gaps",
    lambda k: S.cross_layer_check(k, gaps=True),
    f"SELECT p.layer_a, p.layer_b, n.node_id FROM {_PAIRS} JOIN {{v_node}} n ON n.layer = p.layer_a WHERE NOT EXISTS (SELECT 1 FROM {_LINKED} l WHERE l.layer_a = p.layer_a AND l.layer_b = p.layer_b AND l.node_id = n.node_id)",
)
add(
    "inheritance_stats",
    lambda k: S.inheritance_stats(k),
    """WITH RECURSIVE e AS (SELECT src, dst FROM {v_edge} WHERE rel_type = 'SUBCLASS_OF'), t AS (SELECT DISTINCT dst AS n, 0 AS d FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, t.d + 1 FROM t JOIN e ON e.dst = t.n),
       b AS (SELECT dst, count(DISTINCT src) AS n FROM e GROUP BY dst), m AS (SELECT n, min(d) AS d FROM t GROUP BY n)
       SELECT (SELECT cast(max(d) AS int) FROM m) AS max_depth, round(avg(n), 6) AS avg_branch, max(n) AS max_branch, round(avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 6) AS single_child_ratio FROM b""",
)
R.shared("single_child", "SELECT dst AS parent_id, min(src) AS child_id FROM {v_edge} WHERE rel_type = 'SUBCLASS_OF' GROUP BY dst HAVING count(DISTINCT src) = 1")
add(
    "no_alias",
    lambda k: k.node.where("lifecycle_state = 'active'").join(k.alias.select(F.col("canonical_node_id").alias("node_id")), "node_id", "left_anti").select("node_id", "layer"),
    "SELECT node_id, layer FROM {v_node} WHERE lifecycle_state = 'active' AND NOT EXISTS (SELECT 1 FROM {v_alias} a WHERE a.canonical_node_id = {v_node}.node_id)",
)
# forms of the business tables repeat, so that conflicts exist
_FORMS = "SELECT lower(p_name) AS form, concat('MECH.', p_partkey) AS node_id FROM {part} UNION ALL SELECT folded, canonical_node_id FROM {v_alias}"
R.shared("alias_conflicts", f"SELECT form, SORTED_LIST(node_id) AS targets, count(DISTINCT node_id) AS n FROM ({_FORMS}) f GROUP BY form HAVING count(DISTINCT node_id) > 1")
add(
    "relation_candidates",
    lambda k: S.top(k.candidate.where("candidate_type = 'relation'"), [F.desc_nulls_last("source_count"), "candidate_id"], 30).select("candidate_id", "normalized_form", "source_count"),
    "SELECT candidate_id, normalized_form, source_count FROM {v_candidate} WHERE candidate_type = 'relation' ORDER BY source_count DESC NULLS LAST, candidate_id LIMIT 30",
)
add("stale_facts", lambda k: S.stale_facts(k, "2001-08-01", 365), "SELECT fact_id, max(created_at) AS latest FROM {v_evidence} GROUP BY fact_id HAVING max(created_at) < timestamp '2001-08-01' - INTERVAL 365 DAY")
add("stale_docs", lambda k: S.stale_documents(k, AS_OF, 60), f"SELECT source_doc_id, site_key, crawl_time FROM {{v_document}} WHERE status = 'indexed' AND crawl_time < timestamp '{AS_OF}' - INTERVAL 60 DAY")
add("weak_evidence", lambda k: S.weak_evidence(k), "SELECT fact_id, min(source_rank) AS source_rank FROM {v_evidence} GROUP BY fact_id HAVING count(*) = 1 AND min(source_rank) IN ('B', 'C')")
_KEYWORDS = ["drismar", "Morbex", "Pumtis Burst Absorption"]
add(
    "context_keywords",
    lambda k: S.lookup(k, k.spark.createDataFrame([(t,) for t in _KEYWORDS], "term string")).where("node_id is not null").select("node_id").distinct(),
    "SELECT DISTINCT node_id FROM (SELECT node_id, folded FROM (SELECT node_id, lower(canonical_name) AS folded FROM {v_node}) n UNION ALL SELECT canonical_node_id, folded FROM {v_alias}) x WHERE folded IN ('drismar', 'morbex', 'pumtis burst absorption')",
)
_CONCEPTS = ("IP.1", "IP.7", "IP.10")
add(
    "context_reasoning_chain",
    lambda k: S.reasoning_chain(k, one(*_CONCEPTS)(k)),
    f"""WITH c AS (SELECT unnest({list(_CONCEPTS)}) AS seed), m AS (SELECT DISTINCT c.seed, e.dst AS n FROM c JOIN {{v_edge}} e ON e.src = c.seed AND e.rel_type = 'EXPLAINS'), t AS (SELECT DISTINCT m.seed, e.dst AS n FROM m JOIN {{v_edge}} e ON e.src = m.n AND e.rel_type = 'IMPLEMENTED_BY')
        SELECT seed, 'concept' AS layer, seed AS node_id FROM c UNION SELECT seed, 'mechanism', n FROM m UNION SELECT seed, 'method', n FROM t UNION SELECT t.seed, 'condition', e.dst FROM t JOIN {{v_edge}} e ON e.src = t.n AND e.rel_type = 'APPLIES_TO' UNION SELECT t.seed, 'scenario', e.src FROM t JOIN {{v_edge}} e ON e.dst = t.n AND e.rel_type = 'COMPOSED_OF'""",
)
add(
    "context_facts",
    lambda k: S.context_facts(k, one("MECH.1", "MECH.2", "METHOD.1")(k), 30),
    """WITH b AS (SELECT DISTINCT s.seed, e.src, e.predicate, e.dst, e.confidence FROM (SELECT unnest(['MECH.1', 'MECH.2', 'METHOD.1']) AS seed) s JOIN {v_edge} e ON (e.src = s.seed OR e.dst = s.seed) AND e.predicate IS NOT NULL),
       r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, src, predicate, dst) AS n FROM b) SELECT src, predicate, dst, max(confidence) AS confidence FROM r WHERE n <= 30 GROUP BY 1, 2, 3""",
)
_TAGGED = "SELECT segment_id, string_agg(DISTINCT ontology_node_id, ',' ORDER BY ontology_node_id) AS matched FROM {v_segment_tag} WHERE ontology_node_id IN " + str(tuple(_TAGS)) + " GROUP BY segment_id"
add(
    "context_segments",
    lambda k: S.context_segments(k, one(*_TAGS)(k), 50),
    f"SELECT s.segment_id, m.matched, s.confidence, s.token_count FROM {{v_segment}} s JOIN ({_TAGGED}) m ON m.segment_id = s.segment_id WHERE s.lifecycle_state = 'active' ORDER BY s.confidence DESC NULLS LAST, s.token_count DESC NULLS LAST, s.segment_id LIMIT 50",
)
add(
    "context_rst_chains",
    lambda k: S.context_rst(k, k.segment.where("segment_type in ('fault', 'procedure', 'unknown')").select("segment_id")).select("src_edu_id", "dst_edu_id", "relation_type"),
    "SELECT src_edu_id, dst_edu_id, relation_type FROM {v_rst} WHERE src_edu_id IN (SELECT segment_id FROM {v_segment} WHERE segment_type IN ('fault', 'procedure', 'unknown')) AND dst_edu_id IN (SELECT segment_id FROM {v_segment} WHERE segment_type IN ('fault', 'procedure', 'unknown'))",
)
add(
    "context_evidence",
    lambda k: S.context_evidence(k, one("METHOD.1", "METHOD.2", "METHOD.3")(k), 30),
    """SELECT * FROM (SELECT DISTINCT f.fact_id, f.subject, f.predicate, f.object, f.confidence, e.source_rank, d.site_key FROM {v_fact} f JOIN {v_evidence} e ON e.fact_id = f.fact_id JOIN {v_document} d ON d.source_doc_id = e.source_doc_id
       WHERE f.lifecycle_state = 'active' AND f.subject IN ('METHOD.1', 'METHOD.2', 'METHOD.3')) x ORDER BY CASE source_rank WHEN 'S' THEN 1.0 WHEN 'A' THEN 0.85 WHEN 'B' THEN 0.65 ELSE 0.4 END DESC, confidence DESC, fact_id, site_key LIMIT 30""",
)
add(
    "lookup_evidence",
    lambda k: S.lookup_evidence(k, one("METHOD.1", "METHOD.2")(k), 5),
    """SELECT node_id, fact_id, evidence_id, evidence_score FROM (SELECT f.subject AS node_id, f.fact_id, e.evidence_id, e.evidence_score, row_number() OVER (PARTITION BY f.subject ORDER BY e.evidence_score DESC NULLS LAST, e.evidence_id) AS n
       FROM {v_fact} f JOIN {v_evidence} e ON e.fact_id = f.fact_id WHERE f.lifecycle_state = 'active' AND f.subject IN ('METHOD.1', 'METHOD.2')) x WHERE n <= 5""",
)
add("expand_facts", lambda k: S.expand_facts(k, "MECH.11"), "SELECT fact_id, subject, predicate, object, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND (subject = 'MECH.11' OR object = 'MECH.11') ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 30")
add("expand_segments", lambda k: S.expand_segments(k, _TAGS[0]), f"SELECT segment_id, confidence FROM {{v_segment}} WHERE lifecycle_state = 'active' AND segment_id IN (SELECT segment_id FROM {{v_segment_tag}} WHERE ontology_node_id = '{_TAGS[0]}') ORDER BY confidence DESC NULLS LAST, segment_id LIMIT 20")
_ASKED = ["kixwik sesion guard", "morbx", "fault echo", "drismar map"]
add(
    "copilot_fuzzy",
    lambda k: S.fuzzy_terms(k, k.spark.createDataFrame([(t,) for t in _ASKED], "term string")),
    f"""WITH r AS (SELECT t.term, a.canonical_node_id AS node_id, max(round(1 - levenshtein(t.term, a.folded) / greatest(length(t.term), length(a.folded)), 6)) AS ratio FROM (SELECT unnest({_ASKED}) AS term) t, {{v_alias}} a GROUP BY 1, 2)
        SELECT term, node_id, ratio FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ratio DESC, node_id) AS n FROM r WHERE ratio > 0.4) x WHERE n <= 5""",
)
# ---- graph kernel as queries of their own
add(
    "graph_components",
    lambda k: graph.components(k.edge.where("rel_type = 'REQUIRES'").select("src", "dst")).groupBy("component").agg(F.count("*").alias("n")),
    "WITH RECURSIVE e AS (SELECT src, dst FROM {v_edge} WHERE rel_type = 'REQUIRES' UNION ALL SELECT dst, src FROM {v_edge} WHERE rel_type = 'REQUIRES'), r AS (SELECT DISTINCT src AS n, src AS c FROM e UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.n), m AS (SELECT n, min(c) AS component FROM r GROUP BY n) SELECT component, count(*) AS n FROM m GROUP BY component",
)
_LOOP = "(SELECT src, dst FROM {v_edge} WHERE rel_type IN ('DEPENDS_ON', 'CAUSES'))"
add(
    "graph_cycles",
    lambda k: graph.cycles(k.sql(f"SELECT src, 'DEPENDS_ON' AS rel_type, dst FROM {_LOOP} x"), "DEPENDS_ON", 5).groupBy("length").agg(F.count("*").alias("n")),
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_LOOP} x WHERE src <> dst), p AS (SELECT src AS root, dst AS at, [src, dst] AS ids FROM e WHERE src < dst UNION ALL SELECT p.root, e.dst, list_append(p.ids, e.dst) FROM p JOIN e ON e.src = p.at WHERE len(p.ids) < 5 AND e.dst > p.root AND NOT list_contains(p.ids, e.dst))
        SELECT cast(len(p.ids) AS int) AS length, count(*) AS n FROM p JOIN e ON e.src = p.at AND e.dst = p.root GROUP BY 1""",
)
