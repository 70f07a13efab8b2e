"""The read-only graph cookbook: label and relation counts, trees, neighbourhoods, chains, funnels.

The source of these is query text, so each is one SQL text here, run by Catalyst as it is by any other engine.
"""

from __future__ import annotations

from weftgraph.queries.registry import Registry

R = Registry()
q = R.shared

q("cb_label_counts", "SELECT layer AS label, count(*) AS n FROM {v_node} GROUP BY layer UNION ALL SELECT 'Segment', count(*) FROM {v_segment} UNION ALL SELECT 'Fact', count(*) FROM {v_fact} UNION ALL SELECT 'Alias', count(*) FROM {v_alias}")
q("cb_relation_counts", "SELECT rel_type, count(*) AS n FROM {v_edge} GROUP BY rel_type")
q("cb_totals", "SELECT a.n AS nodes, b.n AS relations FROM (SELECT count(*) AS n FROM {v_node}) a CROSS JOIN (SELECT count(*) AS n FROM {v_edge}) b")
q("cb_triples", "SELECT a.canonical_name AS src_name, e.rel_type, b.canonical_name AS dst_name, e.src, e.dst FROM {v_edge} e JOIN {v_node} a ON a.node_id = e.src JOIN {v_node} b ON b.node_id = e.dst ORDER BY e.src, e.rel_type, e.dst LIMIT 50")
q("cb_layer_names", "SELECT layer, count(*) AS n, FIRST_FIVE(canonical_name) AS names FROM {v_node} GROUP BY layer")
q("cb_node_tree", "SELECT n.node_id, x.rel_type, x.other FROM {v_node} n LEFT JOIN (SELECT src AS node_id, rel_type, dst AS other FROM {v_edge} UNION ALL SELECT canonical_node_id, 'ALIAS', surface_form FROM {v_alias} UNION ALL SELECT ontology_node_id, 'SEGMENT', cast(segment_id AS string) FROM {v_segment_tag} UNION ALL SELECT subject, 'FACT', fact_id FROM {v_fact}) x ON x.node_id = n.node_id WHERE n.node_id IN ('METHOD.1', 'METHOD.PISFEN_BACKUP_ELECTION', 'IP.1')")
q("cb_alias_contains", "SELECT n.node_id, a.surface_form, a.alias_type FROM {v_alias} a JOIN {v_node} n ON n.node_id = a.canonical_node_id WHERE contains(lower(n.canonical_name), 'guard')")
q("cb_alias_of", "SELECT canonical_node_id AS node_id, surface_form, vendor FROM {v_alias} WHERE canonical_node_id IN ('IP.KIXWICK_SESSION_GUARD', 'METHOD.DRISMAR_MAP_SERVER', 'COND.GATHMAR_ADDRESS_LEASE')")
q("cb_direct_dependencies", "SELECT a.node_id, b.node_id AS depends_on, e.confidence FROM {v_edge} e JOIN {v_node} a ON a.node_id = e.src JOIN {v_node} b ON b.node_id = e.dst WHERE e.rel_type = 'DEPENDS_ON' AND e.src IN ('MECH.1', 'MECH.2', 'MECH.3')")
_E = "(SELECT src, dst, rel_type FROM {v_edge} WHERE rel_type IN ('DEPENDS_ON', 'REQUIRES'))"
q("cb_paths_1_3", f"SELECT concat(a.src, '>', a.dst) AS path, 1 AS hops FROM {_E} a WHERE a.src = 'MECH.1' UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst), 2 FROM {_E} a JOIN {_E} b ON b.src = a.dst WHERE a.src = 'MECH.1' UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst, '>', c.dst), 3 FROM {_E} a JOIN {_E} b ON b.src = a.dst JOIN {_E} c ON c.src = b.dst WHERE a.src = 'MECH.1'")
_W = "(SELECT src AS x, dst AS y, concat(src, rel_type, dst) AS id FROM {v_edge} UNION ALL SELECT dst, src, concat(src, rel_type, dst) FROM {v_edge})"
q("cb_neighbourhood_2", f"SELECT a.y AS first, b.y AS second, count(*) AS n FROM {_W} a JOIN {_W} b ON b.x = a.y AND b.id <> a.id WHERE a.x = 'COND.3' GROUP BY a.y, b.y")
q("cb_children", "SELECT dst AS parent_id, count(*) AS n, SORTED_LIST(src) AS children FROM {v_edge} WHERE rel_type = 'SUBCLASS_OF' GROUP BY dst")
q("cb_incident", "SELECT 'out' AS direction, e.rel_type, e.dst AS other, n.layer FROM {v_edge} e JOIN {v_node} n ON n.node_id = e.dst WHERE e.src IN ('METHOD.1', 'METHOD.2') UNION ALL SELECT 'in', e.rel_type, e.src, n.layer FROM {v_edge} e JOIN {v_node} n ON n.node_id = e.src WHERE e.dst IN ('METHOD.1', 'METHOD.2')")
q("cb_incident_layer", "SELECT e.src, e.rel_type, e.dst FROM {v_edge} e JOIN {v_node} n ON n.node_id = e.src WHERE e.dst = 'METHOD.3' AND n.layer = 'scenario' UNION ALL SELECT e.src, e.rel_type, e.dst FROM {v_edge} e JOIN {v_node} n ON n.node_id = e.dst WHERE e.src = 'METHOD.3' AND n.layer = 'condition'")
q("cb_chain_from_node", "SELECT c.node_id, SORTED_LIST(m.dst) AS mechanisms, SORTED_LIST(t.dst) AS methods, SORTED_LIST(k.dst) AS conditions FROM {v_node} c LEFT JOIN {v_edge} m ON m.src = c.node_id AND m.rel_type = 'EXPLAINS' LEFT JOIN {v_edge} t ON t.src = m.dst AND t.rel_type = 'IMPLEMENTED_BY' LEFT JOIN {v_edge} k ON k.src = t.dst AND k.rel_type = 'APPLIES_TO' WHERE c.node_id IN ('IP.1', 'IP.2', 'IP.3') GROUP BY c.node_id")
q("cb_facts_containing", "SELECT fact_id, subject, predicate, object FROM {v_fact} WHERE contains(subject, '.7') AND contains(object, '11')")
q("cb_facts_confident", "SELECT fact_id, subject, predicate, object, confidence FROM {v_fact} WHERE confidence >= 0.9 AND lifecycle_state = 'active' ORDER BY confidence DESC, fact_id LIMIT 100")
q("cb_segment_document", "SELECT s.segment_id, d.source_doc_id, d.site_key, d.source_rank FROM {v_segment} s JOIN {v_document} d ON d.source_doc_id = s.source_doc_id WHERE s.segment_type = 'fault'")
q("cb_evidence_chain", "SELECT f.fact_id, e.evidence_id, s.segment_id, d.site_key FROM {v_fact} f JOIN {v_evidence} e ON e.fact_id = f.fact_id JOIN {v_segment} s ON s.segment_id = e.segment_id JOIN {v_document} d ON d.source_doc_id = s.source_doc_id WHERE f.subject IN ('METHOD.1', 'METHOD.2')")
_H = "(SELECT src, dst FROM {v_edge} WHERE rel_type = 'REQUIRES')"
q("cb_upstream", f"SELECT node_id, min(depth) AS depth FROM (SELECT a.src AS node_id, 1 AS depth FROM {_H} a WHERE a.dst = 'MECH.63' UNION ALL SELECT b.src, 2 FROM {_H} a JOIN {_H} b ON b.dst = a.src WHERE a.dst = 'MECH.63' UNION ALL SELECT c.src, 3 FROM {_H} a JOIN {_H} b ON b.dst = a.src JOIN {_H} c ON c.dst = b.src WHERE a.dst = 'MECH.63') x GROUP BY node_id")
q("cb_dependencies_both", "SELECT n.node_id, (SELECT count(DISTINCT dst) FROM {v_edge} e WHERE e.src = n.node_id AND e.rel_type = 'DEPENDS_ON') AS needs, (SELECT count(DISTINCT src) FROM {v_edge} e WHERE e.dst = n.node_id AND e.rel_type = 'DEPENDS_ON') AS needed_by FROM {v_node} n WHERE n.layer = 'mechanism'")
q("cb_edges_of_predicate", "SELECT src, dst, fact_count, confidence FROM {v_edge} WHERE predicate = 'implemented_by' ORDER BY fact_count DESC, src, dst LIMIT 50")
q("cb_candidates_top", "SELECT candidate_id, normalized_form, source_count, composite_score FROM {v_candidate} ORDER BY composite_score DESC NULLS LAST, candidate_id LIMIT 20")
q("cb_candidates_by_status", "SELECT review_status, count(*) AS n, round(avg(composite_score), 6) AS avg_score FROM {v_candidate} GROUP BY review_status")
q("cb_candidates_ready", "SELECT candidate_id, composite_score FROM {v_candidate} WHERE composite_score >= 0.65")
q("cb_versions", "SELECT ontology_version, count(DISTINCT tag_id) AS tags, min(created_at) AS first_at, max(created_at) AS last_at FROM {segment_tags} GROUP BY ontology_version")
q("cb_implemented_nodes", "SELECT n.node_id FROM {v_node} n WHERE n.layer = 'concept' AND n.node_id IN (SELECT e.src FROM {v_edge} e WHERE e.rel_type = 'EXPLAINS') AND n.node_id IN (SELECT e.src FROM {v_edge} e WHERE e.dst IN (SELECT f.src FROM {v_edge} f WHERE f.rel_type = 'IMPLEMENTED_BY'))")
q("cb_isolated_by_relation", "SELECT n.node_id, n.layer FROM {v_node} n WHERE NOT EXISTS (SELECT 1 FROM {v_edge} e WHERE e.src = n.node_id AND e.rel_type IN ('DEPENDS_ON', 'REQUIRES', 'SUBCLASS_OF')) AND NOT EXISTS (SELECT 1 FROM {v_edge} e WHERE e.dst = n.node_id AND e.rel_type IN ('DEPENDS_ON', 'REQUIRES', 'SUBCLASS_OF'))")
q("cb_layer_pair_edges", "SELECT a.layer AS layer_a, e.rel_type, b.layer AS layer_b, count(*) AS n FROM {v_edge} e JOIN {v_node} a ON a.node_id = e.src JOIN {v_node} b ON b.node_id = e.dst GROUP BY 1, 2, 3")
q("cb_five_layer_paths", "SELECT a.src AS concept, a.dst AS mechanism, b.dst AS method, c.dst AS cond, d.src AS scenario FROM {v_edge} a JOIN {v_edge} b ON b.src = a.dst AND b.rel_type = 'IMPLEMENTED_BY' JOIN {v_edge} c ON c.src = b.dst AND c.rel_type = 'APPLIES_TO' JOIN {v_edge} d ON d.dst = b.dst AND d.rel_type = 'COMPOSED_OF' WHERE a.rel_type = 'EXPLAINS' ORDER BY 1, 2, 3, 4, 5 LIMIT 100")
q("cb_documents_by_status", "SELECT status, count(*) AS n, FIRST_THREE(title) AS titles FROM {v_document} GROUP BY status")
q("cb_facts_per_document", "SELECT e.source_doc_id, count(DISTINCT e.fact_id) AS facts, round(avg(e.evidence_score) + 1e-9, 5) AS avg_score FROM {v_evidence} e GROUP BY e.source_doc_id")
q("cb_document_funnel", "SELECT d.source_doc_id, count(DISTINCT s.segment_id) AS segments, count(DISTINCT g.tag_id) AS tags FROM {v_document} d LEFT JOIN {v_segment} s ON s.source_doc_id = d.source_doc_id LEFT JOIN {v_segment_tag} g ON g.segment_id = s.segment_id GROUP BY d.source_doc_id")
q("cb_confidence_buckets", "SELECT CASE WHEN confidence >= 0.9 THEN 'very high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM {v_fact} GROUP BY 1")
q("cb_alias_heat", "SELECT canonical_node_id AS node_id, count(*) AS n, FIRST_FIVE(vendor) AS vendors FROM {v_alias} WHERE vendor IS NOT NULL GROUP BY canonical_node_id")
q("cb_evolved_nodes", "SELECT node_id, canonical_name, parent_id FROM {v_node} WHERE lifecycle_state <> 'active'")
q("cb_evolved_parents", "SELECT n.node_id, p.node_id AS parent_id, p.canonical_name FROM {v_node} n JOIN {v_node} p ON p.node_id = n.parent_id WHERE n.lifecycle_state <> 'active'")
q("cb_evolved_edges", "SELECT e.src, e.rel_type, e.dst FROM {v_edge} e JOIN {v_node} n ON n.node_id = e.src WHERE n.lifecycle_state <> 'active'")
q("cb_priority_tasks", "SELECT site_key, status, count(*) AS n, max(priority) AS priority FROM {v_task} GROUP BY site_key, status")
q("cb_source_overview", "SELECT r.site_key, r.source_rank, count(d.source_doc_id) AS documents FROM {source_registry} r LEFT JOIN {v_document} d ON d.site_key = r.site_key GROUP BY r.site_key, r.source_rank")
