"""The knowledge graph's tables as lazily evaluated DataFrames, and portable SQL over them.

A *view* is SQL text in which every table or other view it reads stands in braces.  `frame` builds the DataFrame of
a view (or of any such SQL), `portable` the same as one standalone statement with common table expressions, which
another engine can run on the same Parquet tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources import read_table, stage

_NAME = re.compile(r"\{([a-z_][a-z_0-9]*)\}")

VIEWS = {
    # documents, segments and what hangs on them: double deliveries count once
    "v_document": """
        SELECT doc_id AS source_doc_id, site_key, title, doc_type, lang AS language, source_rank, status, crawl_time, publish_time, ingest_batch,
               content_hash, normalized_hash, text, source_url FROM {documents}""",
    "v_segment": """
        SELECT DISTINCT segment_id, source_doc_id, site_key, section_title, cast(segment_index AS int) AS segment_index, segment_type, raw_text,
               coalesce(normalized_text, raw_text) AS text, token_count, confidence, simhash_value, lifecycle_state, created_at FROM {segments}""",
    "v_segment_vec": "SELECT DISTINCT segment_id, embedding, title_vec, content_vec FROM {segments} WHERE lifecycle_state = 'active'",
    "v_segment_tag": """
        SELECT DISTINCT tag_id, segment_id, tag_type, tag_value, ontology_node_id, confidence, tagger FROM {segment_tags} WHERE ontology_node_id IS NOT NULL""",
    "v_page": """
        SELECT doc_id AS page_id, coalesce(source_url, 'https://example.org/x.txt') AS url,
               concat('<html><head><title> ', coalesce(title, ''), ' </title><style>p</style><script>var x = 1;</script></head><body><h1>', coalesce(title, ''), '</h1><p>',
                      replace(replace(coalesce(text, ''), '<', ' '), chr(10), '</p><p>'), '</p><br/><a href="/a/', cast(doc_id AS string), '.html">a</a><a href="/b.png">b</a></body></html>') AS html
        FROM {documents}""",
    "v_rst": """
        SELECT src_edu_id, dst_edu_id,
               CASE segment_index % 5 WHEN 0 THEN 'Elaboration' WHEN 1 THEN 'Causation' WHEN 2 THEN 'Prerequisite' WHEN 3 THEN 'Contrast' ELSE 'Constraint' END AS relation_type,
               CASE segment_index % 3 WHEN 0 THEN 'NS' WHEN 1 THEN 'SN' ELSE 'NN' END AS nuclearity
        FROM (SELECT segment_id AS src_edu_id, lead(segment_id) OVER (PARTITION BY source_doc_id ORDER BY segment_index, segment_id) AS dst_edu_id, segment_index FROM {v_segment}) x
        WHERE dst_edu_id IS NOT NULL""",
    "v_alias": """
        SELECT alias_id, surface_form, lower(surface_form) AS folded, canonical_node_id, alias_type, vendor, language, confidence FROM {lexicon_aliases}
        WHERE canonical_node_id IS NOT NULL""",
    "v_candidate": """
        SELECT DISTINCT candidate_id, surface_forms, normalized_form, candidate_parent_id, candidate_type, source_count, composite_score, review_status,
               seen_source_doc_ids, first_seen_at, last_seen_at FROM {evolution_candidates}""",
    "v_task": """
        SELECT DISTINCT task_id, site_key, url, task_type, priority, status, scheduled_at, started_at, finished_at, retry_count, http_status, content_hash FROM {crawl_tasks}""",
    # the graph: the ontology, and a large synthetic one on the business tables
    "v_node": """
        SELECT node_id, canonical_name, layer, lifecycle_state, parent_id FROM {ontology_nodes}
        UNION ALL SELECT concat('SCENE.', r_regionkey), r_name, 'scenario', 'active', cast(NULL AS string) FROM {region}
        UNION ALL SELECT concat('COND.', n_nationkey), n_name, 'condition', 'active', concat('SCENE.', n_regionkey) FROM {nation}
        UNION ALL SELECT concat('METHOD.', s_suppkey), s_name, 'method', CASE WHEN s_acctbal < 0 THEN 'deprecated' ELSE 'active' END, concat('COND.', s_nationkey) FROM {supplier}
        UNION ALL SELECT concat('MECH.', p_partkey), p_name, 'mechanism', 'active', cast(NULL AS string) FROM {part}
        UNION ALL SELECT concat('IP.', c_custkey), c_name, 'concept', CASE WHEN c_acctbal < 0 THEN 'deprecated' ELSE 'active' END, concat('COND.', c_nationkey) FROM {customer}""",
    "v_edge": """
        SELECT concat('MECH.', a.p_partkey) AS src, 'DEPENDS_ON' AS rel_type, concat('MECH.', b.p_partkey) AS dst, 'depends_on' AS predicate, 0.5 + cast(a.p_size AS double) / 100 AS confidence, cast(1 AS bigint) AS fact_count FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + a.p_size
        UNION ALL SELECT concat('MECH.', a.p_partkey), 'REQUIRES', concat('MECH.', b.p_partkey), 'requires', 0.5 + cast(a.p_size AS double) / 100, cast(1 AS bigint) FROM {part} a JOIN {part} b ON b.p_partkey = 2 * a.p_partkey + 1
        UNION ALL SELECT concat('MECH.', a.p_partkey), 'IMPACTS', concat('MECH.', b.p_partkey), 'impacts', 0.5 + cast(a.p_size AS double) / 100, cast(1 AS bigint) FROM {part} a JOIN {part} b ON b.p_partkey = 3 * a.p_partkey + 1
        UNION ALL SELECT concat('MECH.', a.p_partkey), 'CAUSES', concat('MECH.', b.p_partkey), 'causes', 0.5 + cast(a.p_size AS double) / 100, cast(1 AS bigint) FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey - a.p_size
        UNION ALL SELECT concat('MECH.', l_partkey), 'IMPLEMENTED_BY', concat('METHOD.', l_suppkey), 'implemented_by', max(round(1 - 5 * l_discount, 3)), count(*) FROM {lineitem} GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT concat('IP.', o_custkey), 'EXPLAINS', concat('MECH.', l_partkey), 'explains', max(round(1 - 5 * l_discount, 3)), count(*) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY o_custkey, l_partkey
        UNION ALL SELECT concat('METHOD.', s_suppkey), 'APPLIES_TO', concat('COND.', s_nationkey), 'applies_to', cast(1 AS double), cast(1 AS bigint) FROM {supplier}
        UNION ALL SELECT concat('SCENE.', n_regionkey), 'COMPOSED_OF', concat('METHOD.', s_suppkey), 'composed_of', cast(1 AS double), cast(1 AS bigint) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT concat('COND.', n_nationkey), 'SUBCLASS_OF', concat('SCENE.', n_regionkey), cast(NULL AS string), cast(1 AS double), cast(0 AS bigint) FROM {nation}
        UNION ALL SELECT concat('IP.', c_custkey), 'SUBCLASS_OF', concat('COND.', c_nationkey), cast(NULL AS string), cast(1 AS double), cast(0 AS bigint) FROM {customer}
        UNION ALL SELECT node_id, 'SUBCLASS_OF', parent_id, cast(NULL AS string), cast(1 AS double), cast(0 AS bigint) FROM {ontology_nodes} WHERE parent_id IS NOT NULL""",
    # a fact's id is a digest of what identifies it, so that no global order is needed to make it
    "v_fact": """
        SELECT md5(concat_ws('|', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string), cast(cast(l_shipdate AS date) AS string))) AS fact_id,
               concat('METHOD.', l_suppkey) AS subject,
               CASE l_returnflag WHEN 'A' THEN 'depends_on' WHEN 'N' THEN 'uses_protocol' ELSE 'impacts' END AS predicate,
               concat('MECH.', l_partkey) AS object, round(1 - 5 * l_discount, 3) AS confidence,
               CASE WHEN l_linestatus = 'O' THEN 'active' WHEN l_linenumber = 1 THEN 'conflicted' ELSE 'superseded' END AS lifecycle_state,
               'ip_network' AS domain, l_orderkey, l_linenumber, l_shipdate AS created_at
        FROM {lineitem}""",
    # no, one or two pieces of evidence a fact
    "v_evidence": """
        SELECT concat(f.fact_id, '-', k.k) AS evidence_id, f.fact_id, o.o_orderkey % 1000 AS source_doc_id, (o.o_orderkey % 1000) * 1000 AS segment_id,
               CASE o.o_orderpriority WHEN '1-URGENT' THEN 'S' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'B' ELSE 'C' END AS source_rank,
               CASE f.predicate WHEN 'depends_on' THEN 'rule' WHEN 'uses_protocol' THEN 'llm' ELSE 'manual' END AS extraction_method,
               round(f.confidence * k.share, 4) AS evidence_score, f.created_at
        FROM {v_fact} f JOIN {orders} o ON f.l_orderkey = o.o_orderkey
        JOIN (SELECT 1 AS k, 1.0 AS share UNION ALL SELECT 2, 0.5) k ON (f.l_orderkey + f.l_linenumber) % 4 <> 2 AND (k.k = 1 OR (f.l_orderkey + f.l_linenumber) % 4 = 1)""",
}


def frame(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The DataFrame of SQL over tables and views in braces; nothing is registered in the session."""
    names = sorted(set(_NAME.findall(sql)))
    return spark.sql(sql, **{n: frame(spark, folder, VIEWS[n]) if n in VIEWS else read_table(spark, folder, n) for n in names})


@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for other in _NAME.findall(VIEWS[name]):
        if other in VIEWS:
            out += [x for x in (*_needs(other), other) if x not in out]
    return tuple(out)


def portable(sql: str) -> str:
    """The same as one statement that reads the tables by their names."""
    used: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS:
            used += [x for x in (*_needs(name), name) if x not in used]
    bare = lambda s: _NAME.sub(r"\1", s).strip()
    # of the views only: RECURSIVE is harmless and lets a statement add recursive parts of its own
    ctes = [f"{n} AS ({bare(VIEWS[n])})" for n in used]
    body = bare(sql)
    if body.upper().startswith("WITH "):
        rest = body[5:].removeprefix("RECURSIVE ")
        return "WITH RECURSIVE " + ", ".join([*ctes, rest])
    return ("WITH RECURSIVE " + ", ".join(ctes) + " " + body) if ctes else body


class Knowledge:
    """The tables of one folder by name, e.g. ``k.node``, ``k.edge``, ``k.segment``: lazily built views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if name.startswith("_") or view not in VIEWS:
            raise AttributeError(name)
        return frame(self.spark, self.folder, VIEWS[view])

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def sql(self, text: str) -> DataFrame:
        return frame(self.spark, self.folder, text)


class Held:
    """A `Knowledge` whose nodes and edges are written once, for what reads them many times: each reading of the views
    would join and group the tables below them again, and plans would grow with every use."""

    def __init__(self, k: Knowledge):
        self._k, self.node, self.edge = k, stage(k.node), stage(k.edge)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self._k, name)
