"""Queries over whole tables, against plain Python."""

import os
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from weftgraph import catalog
from weftgraph.functions.vectors import mean_vector
from weftgraph.governance import backfill_terms, variants
from weftgraph.knowledge import Knowledge
from weftgraph.pipeline.dedup import semantic_duplicates
from weftgraph.queries.analytics import _SEEN, _TAGGED
from weftgraph.queries.stages import EVIDENCE_VECTORS

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def k(spark):
    return Knowledge(spark, FOLDER)


def rows(spark, name):
    return {tuple(r) for r in catalog.QUERIES[name](spark, FOLDER).collect()}


def cosine(a, b):
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / length) if length else None


@pytest.fixture(scope="module")
def vectors(k):
    return {r.segment_id: np.array(r.content_vec, float) for r in k.segment_vec.where("content_vec is not null").select("segment_id", "content_vec").collect()}


@pytest.fixture(scope="module")
def sources(k, vectors):
    """The vectors of each fact's pieces of evidence."""
    out = defaultdict(dict)
    for r in k.evidence.select("fact_id", "segment_id").collect():
        if r.segment_id in vectors:
            out[r.fact_id][r.segment_id] = vectors[r.segment_id]
    return out


def alike(sources, a, b, least):
    return any((c := cosine(x, y)) is not None and c >= least for x in sources[a].values() for y in sources[b].values())


def test_functional_conflicts_of_all_facts(spark, k):
    by = defaultdict(list)
    for f in k.fact.where("lifecycle_state = 'active' and predicate = 'depends_on'").collect():
        by[f.subject].append(f)
    want = set()
    for facts in by.values():
        for a, b in combinations(sorted(facts, key=lambda f: f.fact_id), 2):
            if a.object != b.object:
                x, y = a.object.lower(), b.object.lower()
                want.add((a.fact_id, b.fact_id, "merge" if x in y or y in x else "conflict"))
    assert len(by) == 10 and rows(spark, "conflicts_functional") == want


def test_semantic_duplicates_and_conflicts_of_all_facts(spark, k, sources):
    facts = [f for f in k.fact.select("fact_id", "subject", "predicate", "object", "confidence").collect() if f.fact_id in sources]
    ends, doubles, pairs = defaultdict(list), set(), set()
    for f in facts:
        ends[f.subject].append(f)
        ends[f.object].append(f)
    for group in ends.values():
        for a, b in combinations(sorted(group, key=lambda f: f.fact_id), 2):
            if a.subject == b.subject and a.object == b.object and alike(sources, a.fact_id, b.fact_id, 0.5):
                doubles.add((a if a.confidence < b.confidence else b).fact_id)
            if a.predicate != b.predicate and alike(sources, a.fact_id, b.fact_id, 0.85):
                pairs.add((a.fact_id, b.fact_id))
    assert {r.fact_id for r in semantic_duplicates(k.fact, k.sql(EVIDENCE_VECTORS), 0.5).collect()} == doubles
    counted = defaultdict(int)
    for a, _ in pairs:
        counted[a] += 1
    assert len({f.subject for f in facts}) == 10 and pairs and rows(spark, "conflict_semantic") == set(counted.items())


def test_backfill_reaches_more_than_twenty_segments_of_a_node(spark):
    segments = spark.createDataFrame([(i, "a text about drismar", "active" if i else "draft") for i in range(600)], "segment_id long, text string, lifecycle_state string")
    tags = spark.createDataFrame([(1, "IP.1")], "segment_id long, ontology_node_id string")
    more = spark.createDataFrame([(i, "of the morbex", "active") for i in range(1_000, 1_600)], "segment_id long, text string, lifecycle_state string")
    forms = spark.createDataFrame([("Drismar", "IP.1"), ("Morbex", "IP.1"), ("morbex", "IP.1")], "form string, node_id string")
    found = backfill_terms(segments.union(more), tags, forms)
    assert [r.segment_id for r in found.orderBy("segment_id").collect()] == [*range(2, 502), *range(1_000, 1_500)]


def test_backfill_of_all_terms(spark, k):
    forms = {(r.surface_form.lower(), r.canonical_node_id) for r in k.alias.select("surface_form", "canonical_node_id").collect() if len(r.surface_form) > 3}
    have = {(r.segment_id, r.ontology_node_id) for r in k.segment_tag.select("segment_id", "ontology_node_id").collect()}
    hits = defaultdict(set)
    for s in k.segment.where("lifecycle_state = 'active'").select("segment_id", "text").collect():
        text = (s.text or "").lower()
        for form, node in forms:
            if form in text and (s.segment_id, node) not in have:
                hits[form, node].add(s.segment_id)
    assert rows(spark, "backfill") == {(s, n) for (_, n), ids in hits.items() for s in sorted(ids)[:500]}


def test_variants_of_all_candidates(spark, k, vectors):
    texts, seen, tagged = defaultdict(set), defaultdict(set), defaultdict(set)
    for s in k.segment.select("segment_id", "source_doc_id").collect():
        if s.segment_id in vectors:
            texts[s.source_doc_id].add(s.segment_id)
    for c in k.candidate.select("candidate_id", "seen_source_doc_ids").collect():
        for d in c.seen_source_doc_ids or ():
            seen[c.candidate_id] |= texts[d]
    for t in k.segment_tag.select("segment_id", "ontology_node_id").collect():
        if t.segment_id in vectors:
            tagged[t.ontology_node_id].add(t.segment_id)
    mean = lambda ids: np.mean([vectors[i] for i in sorted(ids)], axis=0)
    nodes = {n: mean(ids) for n, ids in tagged.items()}
    want = set()
    for c, ids in seen.items():
        if ids:
            best = sorted((-x, n) for n, v in nodes.items() if (x := cosine(mean(ids), v)) is not None)
            if best and -best[0][0] >= 0.3:
                want.add((c, best[0][1]))
    found = variants(mean_vector(k.sql(_SEEN), "candidate_id"), mean_vector(k.sql(_TAGGED), "node_id"), 0.3)
    assert len(want) > 5 and {(r.candidate_id, r.node_id) for r in found.collect()} == want


def test_merge_of_all_facts_and_their_evidence(spark, k):
    clusters, state = defaultdict(list), {}
    for f in k.fact.select("fact_id", "subject", "predicate", "object", "confidence", "lifecycle_state").collect():
        clusters[f"{f.subject}|{f.predicate}|{f.object}"].append((-f.confidence, f.fact_id))
        state[f.fact_id] = f.lifecycle_state
    head = {f: (c, min(facts)[1]) for c, facts in clusters.items() for _, f in facts}
    assert rows(spark, "fact_merge") == {(f, state[f] if h == f else "superseded", c) for f, (c, h) in head.items()}
    n = defaultdict(int)
    for e in k.evidence.select("fact_id").collect():
        n[head[e.fact_id][1]] += 1
    assert any(h != f for f, (_, h) in head.items()) and rows(spark, "fact_merge_evidence") == set(n.items())


def test_cycles_of_all_edges_up_to_five(spark, k):
    out = defaultdict(set)
    for e in k.edge.where("rel_type in ('DEPENDS_ON', 'CAUSES') and src <> dst").select("src", "dst").collect():
        out[e.src].add(e.dst)
    n = defaultdict(int)

    def walk(path):
        if len(path) > 1 and path[0] in out[path[-1]]:
            n[len(path)] += 1
        if len(path) < 5:
            for x in list(out[path[-1]]):
                if x > path[0] and x not in path:
                    walk([*path, x])

    for root in list(out):
        walk([root])
    assert n[5] and rows(spark, "graph_cycles") == set(n.items())
