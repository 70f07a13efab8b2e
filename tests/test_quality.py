"""The quality report's heavy parts, against plain Python."""

import random
from collections import defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest

from weftgraph import quality


def graph_of(spark, edges, tags):
    edge = spark.createDataFrame([(a, b, "requires") for a, b in edges], "src string, dst string, predicate string")
    return SimpleNamespace(edge=edge, segment_tag=spark.createDataFrame(tags, "ontology_node_id string, segment_id long"))


@pytest.fixture(scope="module")
def made():
    """Two linked nodes that are alike, hubs, nodes of one kind of items, nodes nearly alike; and what each has."""
    draw = random.Random(3)
    edges = [(f"n{i}", f"x{draw.randrange(60)}") for i in range(40) for _ in range(draw.randrange(1, 9))]
    edges += [(f"n{i}", "hub") for i in range(40)] + [("n1", "n2"), ("n2", "n1"), ("n3", "n3"), ("n4", "n5")]
    edges += [(b, a) for a, b in edges if draw.random() < 0.2] + [(n, f"y{i}") for i in range(60) for n in ("p", "q") if i % 9 or n == "p"]
    tags = [(f"n{i}", draw.randrange(25)) for i in range(0, 40, 2) for _ in range(draw.randrange(1, 12))]
    near, tagged = defaultdict(set), defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for a, s in tags:
        tagged[a].add(s)
    return edges, tags, near, tagged


def wanted(near, tagged, least, vectors=None):
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    weight, out = 0.5 if vectors is None else 0.35, []
    for a, b in combinations(sorted({*near, *tagged}), 2):
        if not (near[a] & near[b] or tagged[a] & tagged[b]):
            continue
        score = weight * jaccard(near[a] - {b}, near[b] - {a}) + weight * jaccard(tagged[a], tagged[b])
        if vectors and a in vectors and b in vectors:
            x, y = np.array(vectors[a]), np.array(vectors[b])
            score += 0.3 * float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        if round(score, 6) >= least:
            out.append((a, b, pytest.approx(score, abs=2e-6)))
    return {(a, b): s for a, b, s in out}


@pytest.mark.parametrize("least", [0.1, 0.3, 0.45])
def test_similar_nodes_are_those_of_all_pairs(spark, made, least):
    edges, tags, near, tagged = made
    found = quality.similar_nodes(graph_of(spark, edges, tags), least=least, n=10_000).collect()
    assert {(r.a, r.b): r.score for r in found} == wanted(near, tagged, least)


def test_similar_nodes_with_vectors_keep_pairs_that_share_little(spark, made):
    edges, tags, near, tagged = made
    draw = random.Random(5)
    vectors = {f"n{i}": [1.0, draw.random(), 0.1 * draw.random()] for i in range(30)}
    found = quality.similar_nodes(graph_of(spark, edges, tags), spark.createDataFrame(list(vectors.items()), "node_id string, vec array<double>"), n=10_000).collect()
    assert {(r.a, r.b): r.score for r in found} == wanted(near, tagged, 0.3, vectors)


def test_similar_nodes_gather_no_sets_and_chance_meetings_make_no_pairs(spark, monkeypatch):
    draw = random.Random(7)
    edges = [(f"n{i}", f"x{j}") for i in range(200) for j in draw.sample(range(1500), 60)]
    edges += [("m0", f"x{j}") for j in range(50)] + [("m1", f"x{j}") for j in range(2, 52)]
    staged, stage = [], quality.stage
    monkeypatch.setattr(quality, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    found = quality.similar_nodes(graph_of(spark, edges, []))
    assert "collect_set" not in found._jdf.queryExecution().toString()
    assert ("m0", "m1") in {(r.a, r.b) for r in found.collect()}
    pairs = next(t for t in staged if t.columns == ["a", "b"]).where("a like 'n%' and b like 'n%'")
    assert pairs.count() < 2_000  # of 19 900, nine in ten of which share items


def test_layers_are_connected_as_each_by_itself_in_one_search(spark, monkeypatch):
    draw, layers = random.Random(11), ("one", "two", "three", "none")
    nodes = [(f"n{i}", layers[i % 3], "active" if i % 7 else "deprecated") for i in range(60)] + [(None, "one", "active"), ("n4", "one", "active"), ("n4", "two", "active"), ("z", "other", "active"), ("y", None, "active")]
    edges = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}", "requires" if draw.random() < 0.9 else None) for _ in range(90)] + [("n4", "n4", "requires"), ("n1", None, "requires"), ("z", "n1", "requires")]
    node = spark.createDataFrame(nodes, "node_id string, layer string, lifecycle_state string")
    k = SimpleNamespace(spark=spark, node=node, edge=spark.createDataFrame(edges, "src string, dst string, predicate string"))
    searches, components = [], quality.graph.components
    active, typed = node.where("lifecycle_state = 'active'"), k.edge.where("predicate is not null")
    of = {name: active.where(active.layer.isin([name] if name in layers else list(layers))) for name in (*layers, "global")}
    want = {name: tuple(quality.connectivity(own, typed).first()) for name, own in of.items()}
    monkeypatch.setattr(quality.graph, "components", lambda e: searches.append(e) or components(e))
    assert {r.layer: tuple(r)[1:] for r in quality.layer_connectivity(k, layers).collect()} == want
    assert len(searches) == 1


def test_cycles_beside_a_long_chain_take_few_rounds(spark, monkeypatch):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("c020", "a"), ("a", "b"), ("b", "a"), ("b", "d"), ("d", "c018"), ("x", "y"), ("y", "z"), ("z", "x")]
    edge = spark.createDataFrame([(a, "DEPENDS_ON", b) for a, b in edges], "src string, rel_type string, dst string")
    staged, stage = [], quality.graph.stage
    monkeypatch.setattr(quality.graph, "stage", lambda df: staged.append(df) or stage(df))
    found = {tuple(r.node_ids) for r in quality.graph.cycles(edge, "DEPENDS_ON").collect()}
    assert found == {("a", "b"), ("x", "y", "z")}  # the one through c018 has six edges
    assert len(staged) < 10
