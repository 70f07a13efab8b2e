"""The primitives of the plan algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.plans import NO_LIMITS, QueryEngine
from weftgraph.queries.registry import Registry

R = Registry()

SEG = "cast(s.segment_id AS string) AS node_id"
#: A query vector that every engine can write down.
VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
VECTOR_SQL = "[" + ", ".join(repr(x) for x in VECTOR) + "]"
RECURSIVE_STEP = "w.hop < {depth} AND e.rel_type IN ({relations})"


def cosine_sql(column: str) -> str:
    """The cosine with VECTOR for the other engine, in doubles."""
    dot = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: ({a})[i]::DOUBLE * ({b})[i]::DOUBLE))"
    v = f"{VECTOR_SQL}::DOUBLE[]"
    return f"(CASE WHEN {column} IS NULL OR {dot(column, column)} = 0 THEN NULL ELSE {dot(column, v)} / (sqrt({dot(column, column)}) * sqrt({dot(v, v)})) END)"


def walk_sql(seed: str, relations: tuple[str, ...], depth: int, direction: str = "outbound", decay: float = 1.0) -> str:
    """Recursive CTEs ``walk`` (node_id, hop, confidence) and ``best``: the least hop and the greatest confidence."""
    kept = "" if relations is None else "WHERE rel_type IN (" + ", ".join(f"'{r}'" for r in relations) + ")"
    out, into = f"SELECT src AS here, dst AS there, coalesce(confidence, 1.0) AS c FROM {{v_edge}} {kept}", f"SELECT dst, src, coalesce(confidence, 1.0) FROM {{v_edge}} {kept}"
    hops = {"outbound": out, "inbound": into.replace("SELECT dst, src, coalesce(confidence, 1.0)", "SELECT dst AS here, src AS there, coalesce(confidence, 1.0) AS c")}.get(direction, f"{out} UNION ALL {into}")
    return f"""hops AS ({hops}),
        walk AS (SELECT node_id, 0 AS hop, cast(1.0 AS double) AS confidence FROM ({seed}) s
                 UNION SELECT h.there, w.hop + 1, w.confidence * h.c * {decay} FROM walk w JOIN hops h ON h.here = w.node_id WHERE w.hop < {depth}),
        best AS (SELECT node_id, hop, max(confidence) AS confidence FROM walk GROUP BY node_id, hop),
        reached AS (SELECT b.node_id, b.hop, b.confidence FROM best b JOIN (SELECT node_id, min(hop) AS hop FROM best GROUP BY node_id) m ON b.node_id = m.node_id AND b.hop = m.hop WHERE b.hop > 0)"""


def plan(*steps: dict, intent: str | None = None):
    return lambda k: QueryEngine(k).run({"steps": list(steps), **({"intent": intent} if intent else {})}).frame


NODES = {"op": "seed", "as": "$n", "by": "id", "target": "node", "value": ["MECH.1", "MECH.2", "MECH.3", "IP.4", "IP.KELDOCK_PEER_DISCOVERY", "absent"]}
_IDS = "('MECH.1', 'MECH.2', 'MECH.3', 'IP.4', 'IP.KELDOCK_PEER_DISCOVERY', 'absent')"
fields = lambda source, *names: {"op": "project", "as": "$p", "from": source, "fields": list(names)}


def without_order(run):
    return lambda k: (lambda df: df.drop("_ord"))(run(k))


def add(name, steps, sql, intent=None):
    R.add(name, without_order(plan(*steps, intent=intent)), sql)


add("seed_id_node", [NODES, fields("$n", "node_id", "canonical_name", "layer")], f"SELECT node_id, canonical_name, layer FROM {{v_node}} WHERE node_id IN {_IDS}")
add(
    "seed_id_segment",
    [{"op": "seed", "as": "$s", "by": "id", "target": "segment", "value": [2000, 2001, 12000, 26001, -5]}, fields("$s", "segment_id", "segment_type", "confidence")],
    "SELECT cast(segment_id AS string) AS segment_id, segment_type, confidence FROM {v_segment} WHERE segment_id IN (2000, 2001, 12000, 26001, -5) AND lifecycle_state = 'active'",
)
R.add(
    "seed_id_fact",
    lambda k: (lambda ids: QueryEngine(k).run({"steps": [{"op": "seed", "as": "$f", "by": "id", "target": "fact", "value": ids}, fields("$f", "fact_id", "subject", "predicate", "object", "confidence")]}).frame.drop("_ord"))([r[0] for r in k.fact.where("subject = 'METHOD.1'").select("fact_id").orderBy("fact_id").limit(40).collect()]),
    "SELECT fact_id, subject, predicate, object, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND fact_id IN (SELECT fact_id FROM {v_fact} WHERE subject = 'METHOD.1' ORDER BY fact_id LIMIT 40)",
)
ALIASES = ["drismar", "MORBEX", "Kixwick Session Guard", "nothing of the kind"]
add(
    "seed_alias",
    [{"op": "seed", "as": "$a", "by": "alias", "target": "node", "value": ALIASES}, fields("$a", "node_id", "canonical_name", "layer")],
    "SELECT node_id, canonical_name, layer FROM {v_node} WHERE node_id IN (SELECT canonical_node_id FROM {v_alias} WHERE folded IN ('drismar', 'morbex', 'kixwick session guard')) OR lower(canonical_name) IN ('drismar', 'morbex', 'kixwick session guard')",
)
add("seed_layer", [{"op": "seed", "as": "$l", "by": "layer", "target": "node", "value": "condition"}, fields("$l", "node_id", "canonical_name")], "SELECT node_id, canonical_name FROM {v_node} WHERE layer = 'condition'")
NEAR = f"near AS (SELECT segment_id, {cosine_sql('content_vec')} AS similarity FROM {{v_segment_vec}} WHERE content_vec IS NOT NULL), topk AS (SELECT * FROM near WHERE similarity IS NOT NULL ORDER BY similarity DESC, segment_id LIMIT 100)"
R.add(
    "seed_embedding_segment",
    lambda k: QueryEngine(k).run({"steps": [{"op": "seed", "as": "$e", "by": "embedding", "target": "segment", "value": VECTOR, "top_k": 100, "threshold": 0.2}, fields("$e", "segment_id", "similarity")]}).frame.select("segment_id", F.round("similarity", 6).alias("similarity")),
    f"WITH {NEAR} SELECT cast(t.segment_id AS string) AS segment_id, round(t.similarity, 6) AS similarity FROM topk t WHERE t.similarity >= 0.2 AND t.segment_id IN (SELECT segment_id FROM {{v_segment}} WHERE lifecycle_state = 'active')",
)
R.add(
    "seed_embedding_node",
    lambda k: QueryEngine(k).run({"steps": [{"op": "seed", "as": "$e", "by": "embedding", "target": "node", "value": VECTOR, "top_k": 100, "threshold": 0.2}, fields("$e", "node_id", "similarity")]}).frame.select("node_id", F.round("similarity", 6).alias("similarity")),
    f"""WITH {NEAR}, tagged AS (SELECT t.segment_id, t.similarity, g.ontology_node_id AS node_id FROM topk t JOIN {{v_segment_tag}} g ON g.segment_id = t.segment_id ORDER BY t.similarity DESC, t.segment_id, g.ontology_node_id LIMIT 100)
        SELECT node_id, round(max(similarity), 6) AS similarity FROM tagged WHERE node_id IN (SELECT node_id FROM {{v_node}}) GROUP BY node_id HAVING max(similarity) >= 0.2""",
)
add(
    "seed_attribute",
    [{"op": "seed", "as": "$s", "by": "attribute", "target": "segment", "value": {"segment_type": "fault", "segment_index": 3}}, fields("$s", "segment_id", "source_doc_id")],
    "SELECT cast(segment_id AS string) AS segment_id, source_doc_id FROM {v_segment} WHERE lifecycle_state = 'active' AND segment_type = 'fault' AND segment_index = 3 ORDER BY cast(segment_id AS string) LIMIT 5000",
)
add(
    "seed_dedup_truncate",
    [{"op": "seed", "as": "$s", "by": "attribute", "target": "segment", "value": {"lifecycle_state": "active"}}, fields("$s", "segment_id")],
    f"SELECT cast(segment_id AS string) AS segment_id FROM {{v_segment}} WHERE lifecycle_state = 'active' ORDER BY 1 LIMIT {model.MAX_RESULT}",
)

MECH = {"op": "seed", "as": "$m", "by": "id", "target": "node", "value": ["MECH.1", "MECH.5", "MECH.40"]}
_MECH = "SELECT node_id FROM {v_node} WHERE node_id IN ('MECH.1', 'MECH.5', 'MECH.40')"


def expand_query(name: str, relations: tuple[str, ...], depth, direction: str = "outbound", decay: float | None = None, sql_depth: int | None = None) -> None:
    step = {"op": "expand", "as": "$x", "from": "$m", "any_of": [r.lower() for r in relations], "depth": depth, "direction": direction, **({"confidence_decay": decay} if decay else {})}
    run = lambda k: QueryEngine(k).run({"steps": [MECH, step]}).frame.select("node_id", F.col("_hop").cast("int").alias("hop"), F.round("_confidence", 6).alias("confidence"))
    sql = f"WITH RECURSIVE {walk_sql(_MECH, relations, sql_depth or depth, direction, decay or 1.0)} SELECT node_id, cast(hop AS int) AS hop, round(confidence, 6) AS confidence FROM reached" if sql_depth or depth != "unlimited" else None
    R.add(name, run, sql)


expand_query("expand_any_of_graph", ("DEPENDS_ON", "REQUIRES"), 3)
expand_query("expand_any_of_inbound", ("DEPENDS_ON", "REQUIRES"), 2, "inbound")
expand_query("expand_any_of_both", ("IMPACTS", "CAUSES"), 2, "both")
expand_query("expand_confidence", ("DEPENDS_ON", "IMPACTS"), 3, "outbound", 0.9)
R.add(
    "expand_unlimited",
    lambda k: QueryEngine(k).run({"steps": [MECH, {"op": "expand", "as": "$x", "from": "$m", "any_of": ["requires"], "depth": "unlimited"}]}).frame.select("node_id"),
    f"WITH RECURSIVE reach AS (SELECT node_id FROM ({_MECH}) s UNION SELECT e.dst FROM reach r JOIN {{v_edge}} e ON e.src = r.node_id AND e.rel_type = 'REQUIRES') SELECT node_id FROM reach WHERE node_id NOT IN (SELECT node_id FROM ({_MECH}) t)",
)
add(
    "expand_sequence",
    [MECH, {"op": "expand", "as": "$x", "from": "$m", "sequence": ["implemented_by", "applies_to"]}, fields("$x", "node_id", "layer")],
    f"SELECT DISTINCT n.node_id, n.layer FROM ({_MECH}) m JOIN {{v_edge}} a ON a.src = m.node_id AND a.rel_type = 'IMPLEMENTED_BY' JOIN {{v_edge}} b ON b.src = a.dst AND b.rel_type = 'APPLIES_TO' JOIN {{v_node}} n ON n.node_id = b.dst",
)
LAYER = {"op": "seed", "as": "$l", "by": "layer", "target": "node", "value": ["method", "scenario"]}
add(
    "expand_tagged_in",
    [LAYER, {"op": "expand", "as": "$x", "from": "$l", "any_of": ["tagged_in"]}, fields("$x", "segment_id", "matched_node", "confidence")],
    """SELECT cast(s.segment_id AS string) AS segment_id, min(g.ontology_node_id) AS matched_node, s.confidence FROM {v_segment} s JOIN {v_segment_tag} g ON g.segment_id = s.segment_id JOIN {v_node} n ON n.node_id = g.ontology_node_id
       WHERE s.lifecycle_state = 'active' AND n.layer IN ('method', 'scenario') GROUP BY s.segment_id, s.confidence ORDER BY cast(s.segment_id AS string) LIMIT 5000""",
)
FAULTS = {"op": "seed", "as": "$s", "by": "attribute", "target": "segment", "value": {"segment_type": "fault", "segment_index": 2}}
_FAULTS = "(SELECT segment_id FROM {v_segment} WHERE lifecycle_state = 'active' AND segment_type = 'fault' AND segment_index = 2 ORDER BY cast(segment_id AS string) LIMIT 5000)"
add(
    "expand_rst_adjacent",
    [FAULTS, {"op": "expand", "as": "$x", "from": "$s", "any_of": ["rst_adjacent"]}, fields("$x", "segment_id", "relation_type")],
    f"""WITH f AS {_FAULTS}, both_ways AS (SELECT src_edu_id AS a, dst_edu_id AS b, relation_type FROM {{v_rst}} UNION ALL SELECT dst_edu_id, src_edu_id, relation_type FROM {{v_rst}})
        SELECT cast(b AS string) AS segment_id, min(relation_type) AS relation_type FROM both_ways WHERE a IN (SELECT segment_id FROM f) AND b NOT IN (SELECT segment_id FROM f) GROUP BY b ORDER BY cast(b AS string) LIMIT 5000""",
)
add(
    "expand_evidenced_by",
    [{"op": "seed", "as": "$f", "by": "attribute", "target": "fact", "value": {"subject": "METHOD.3"}}, {"op": "expand", "as": "$x", "from": "$f", "any_of": ["evidenced_by"]}, fields("$x", "segment_id", "evidence_score")],
    """SELECT cast(s.segment_id AS string) AS segment_id, max(e.evidence_score) AS evidence_score FROM {v_fact} f JOIN {v_evidence} e ON e.fact_id = f.fact_id JOIN {v_segment} s ON s.segment_id = e.segment_id
       WHERE f.lifecycle_state = 'active' AND f.subject = 'METHOD.3' AND s.lifecycle_state = 'active' GROUP BY s.segment_id""",
)

A = {"op": "seed", "as": "$a", "by": "attribute", "target": "segment", "value": {"segment_type": "fault"}}
B = {"op": "seed", "as": "$b", "by": "attribute", "target": "segment", "value": {"segment_index": 1}}
_A = "(SELECT cast(segment_id AS string) AS segment_id FROM {v_segment} WHERE lifecycle_state = 'active' AND segment_type = 'fault' ORDER BY 1 LIMIT 5000)"
_B = "(SELECT cast(segment_id AS string) AS segment_id FROM {v_segment} WHERE lifecycle_state = 'active' AND segment_index = 1 ORDER BY 1 LIMIT 5000)"
for method, sql in (
    ("union", f"SELECT segment_id FROM (SELECT segment_id, min(o) AS o FROM (SELECT segment_id, 0 AS o FROM {_A} x UNION ALL SELECT segment_id, 1 FROM {_B} y) z GROUP BY segment_id) u ORDER BY o, segment_id LIMIT 5000"),
    ("intersect", f"SELECT segment_id FROM {_A} x WHERE segment_id IN (SELECT segment_id FROM {_B} y)"),
    ("subtract", f"SELECT segment_id FROM {_A} x WHERE segment_id NOT IN (SELECT segment_id FROM {_B} y)"),
):
    add(f"combine_{method}", [A, B, {"op": "combine", "as": "$c", "method": method, "sets": ["$a", "$b"]}, fields("$c", "segment_id")], sql)

add("agg_count", [A, {"op": "aggregate", "as": "$c", "from": "$a", "function": "count"}], f"SELECT count(*) AS value FROM {_A} x")
FACTS = {"op": "seed", "as": "$f", "by": "attribute", "target": "fact", "value": {"subject": "METHOD.2"}}
_FACTS = "(SELECT fact_id, predicate, object, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND subject = 'METHOD.2' ORDER BY fact_id LIMIT 5000)"
add("agg_rank", [FACTS, {"op": "aggregate", "as": "$r", "from": "$f", "function": "rank", "by": ["confidence"], "limit": 25}, fields("$r", "fact_id", "confidence")], f"SELECT fact_id, confidence FROM {_FACTS} x ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 25")
add("agg_group", [FACTS, {"op": "aggregate", "as": "$g", "from": "$f", "function": "group", "by": ["predicate", "absent"]}], f"SELECT coalesce(predicate, '') AS predicate, '' AS absent, count(*) AS count FROM {_FACTS} x GROUP BY 1, 2")
add("agg_score", [FACTS, {"op": "aggregate", "as": "$g", "from": "$f", "function": "score", "signals": ["confidence", "absent"], "limit": 20}, fields("$g", "fact_id", "_score")], f"SELECT fact_id, (0.0 + coalesce(confidence, 0) + 0) / 2 AS _score FROM {_FACTS} x ORDER BY _score DESC, fact_id LIMIT 20")
INTENT = "cookie buffer queue policy"
_FEATURE = "round(cast(0.0 AS double) + 0.15 * 0.4 + 0.15 * coalesce(confidence, 0) + 0.15 * 0 + 0.10 * 0 + 0.10 * 0 + 0.35 * least(({hits}) / 4, 1.0), 4)".replace("{hits}", " + ".join(f"cast(contains(lower(coalesce(raw_text, '')), '{t}') AS int)" for t in INTENT.split()))
add(
    "agg_rerank_4a",
    [A, {"op": "aggregate", "as": "$r", "from": "$a", "function": "rerank", "limit": 40}, fields("$r", "segment_id", "_feature_score")],
    f"SELECT segment_id, {_FEATURE} AS _feature_score FROM (SELECT cast(segment_id AS string) AS segment_id, confidence, raw_text FROM {{v_segment}} WHERE lifecycle_state = 'active' AND segment_type = 'fault' ORDER BY 1 LIMIT 5000) x ORDER BY _feature_score DESC, segment_id LIMIT 40",
    INTENT,
)
# a stand-in for a cross-encoder: what matters here is that it sees at most 50 rows and how scores combine
R.add(
    "agg_rerank_4b",
    lambda k: QueryEngine(k, scorer=lambda query, texts: [float(len(t) % 11) for t in texts]).run({"intent": INTENT, "steps": [A, {"op": "aggregate", "as": "$r", "from": "$a", "function": "rerank", "cross_encoder": True, "limit": 10}, fields("$r", "segment_id", "_final_score")]}).frame.select("segment_id", F.round("_final_score", 6).alias("final_score")),
    f"""WITH f AS (SELECT segment_id, raw_text, {_FEATURE} AS s FROM (SELECT cast(segment_id AS string) AS segment_id, confidence, raw_text FROM {{v_segment}} WHERE lifecycle_state = 'active' AND segment_type = 'fault' ORDER BY 1 LIMIT 5000) x ORDER BY s DESC, segment_id LIMIT 50)
        SELECT segment_id, round(0.4 * s + 0.6 * (length(raw_text) % 11) / 10, 6) AS final_score FROM f ORDER BY 0.4 * s + 0.6 * (length(raw_text) % 11) / 10 DESC, segment_id LIMIT 10""",
)
add(
    "agg_rerank_4c",
    [A, {"op": "aggregate", "as": "$r", "from": "$a", "function": "rerank", "budget": 1500, "limit": 30}, fields("$r", "segment_id", "token_count")],
    f"""WITH RECURSIVE f AS (SELECT segment_id, token_count, CASE WHEN coalesce(token_count, 0) > 0 THEN token_count ELSE greatest(1, length(coalesce(raw_text, '')) // 4) END AS t, row_number() OVER (ORDER BY {_FEATURE} DESC, segment_id) AS i
          FROM (SELECT cast(segment_id AS string) AS segment_id, confidence, raw_text, token_count FROM {{v_segment}} WHERE lifecycle_state = 'active' AND segment_type = 'fault' ORDER BY 1 LIMIT 5000) x), o AS (SELECT * FROM f WHERE i <= 500),
        g AS (SELECT cast(0 AS bigint) AS i, cast(0 AS bigint) AS total, 0 AS n, false AS taken, cast('' AS string) AS segment_id, cast(NULL AS int) AS token_count UNION ALL
              SELECT o.i, CASE WHEN g.total + o.t <= 1500 AND g.n < 30 THEN g.total + o.t ELSE g.total END, CASE WHEN g.total + o.t <= 1500 AND g.n < 30 THEN g.n + 1 ELSE g.n END, g.total + o.t <= 1500 AND g.n < 30, o.segment_id, o.token_count FROM g JOIN o ON o.i = g.i + 1)
        SELECT segment_id, token_count FROM g WHERE taken""",
    INTENT,
)
# the whole set, whatever its size
R.add("agg_count_whole", lambda k: QueryEngine(k, limits=NO_LIMITS).run({"steps": [A, {"op": "aggregate", "as": "$c", "from": "$a", "function": "count"}]}).frame, "SELECT count(*) AS value FROM {v_segment} WHERE lifecycle_state = 'active' AND segment_type = 'fault'")
R.add(
    "combine_union_whole",
    lambda k: QueryEngine(k, limits=NO_LIMITS).run({"steps": [A, B, {"op": "combine", "as": "$c", "method": "union", "sets": ["$a", "$b"]}, fields("$c", "segment_id")]}).frame.drop("_ord"),
    "SELECT cast(segment_id AS string) AS segment_id FROM {v_segment} WHERE lifecycle_state = 'active' AND (segment_type = 'fault' OR segment_index = 1)",
)
add(
    "project",
    [FACTS, fields("$f", "fact_id", "object", "absent")],
    f"SELECT fact_id, object FROM {_FACTS} x",
)
R.add(
    "plan_rerank",
    lambda k: QueryEngine(k).run(
        {
            "intent": "policy timer session",
            "steps": [
                {"op": "seed", "as": "$t", "by": "alias", "target": "node", "value": ALIASES},
                {"op": "expand", "as": "$d", "from": "$t", "any_of": ["subclass_of", "depends_on"], "depth": 2, "direction": "both"},
                {"op": "combine", "as": "$all", "method": "union", "sets": ["$t", "$d"]},
                {"op": "expand", "as": "$s", "from": "$all", "any_of": ["tagged_in"]},
                {"op": "aggregate", "as": "$r", "from": "$s", "function": "rerank", "limit": 20},
                {"op": "project", "as": "$p", "from": "$r", "fields": ["segment_id", "source_doc_id", "segment_type", "_feature_score"]},
            ],
        }
    ).frame.drop("_ord"),
    f"""WITH RECURSIVE seeds AS (SELECT node_id FROM {{v_node}} WHERE node_id IN (SELECT canonical_node_id FROM {{v_alias}} WHERE folded IN ('drismar', 'morbex', 'kixwick session guard')) OR lower(canonical_name) IN ('drismar', 'morbex', 'kixwick session guard')),
        {walk_sql("SELECT node_id FROM seeds", ("SUBCLASS_OF", "DEPENDS_ON"), 2, "both")},
        ids AS (SELECT node_id FROM seeds UNION SELECT node_id FROM reached),
        found AS (SELECT DISTINCT s.segment_id, s.source_doc_id, s.segment_type, s.confidence, s.raw_text FROM {{v_segment}} s JOIN {{v_segment_tag}} g ON g.segment_id = s.segment_id JOIN ids ON ids.node_id = g.ontology_node_id WHERE s.lifecycle_state = 'active'),
        scored AS (SELECT cast(segment_id AS string) AS segment_id, source_doc_id, segment_type, round(cast(0.0 AS double) + 0.15 * 0.4 + 0.15 * coalesce(confidence, 0) + 0.35 * least((cast(contains(lower(raw_text), 'policy') AS int) + cast(contains(lower(raw_text), 'timer') AS int) + cast(contains(lower(raw_text), 'session') AS int)) / 3, 1.0), 4) AS _feature_score FROM found)
        SELECT segment_id, source_doc_id, segment_type, _feature_score FROM scored ORDER BY _feature_score DESC, segment_id LIMIT 20""",
)
