"""The graph kernel on small graphs, against plain Python."""

import itertools
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.quality import connectivity, fiedler_value, gini

EDGE = "src string, rel_type string, dst string, predicate string, confidence double"


def edges(spark, rows):
    return spark.createDataFrame([(a, r, b, r.lower(), c) for a, r, b, c in rows], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


@pytest.fixture(scope="module")
def web():
    pick = random.Random(11)
    return [(f"n{pick.randrange(25)}", pick.choice("AB"), f"n{pick.randrange(25)}", pick.randint(5, 10) / 10) for _ in range(70)]


def search(rows, start, relations, hops):
    best, frontier = {start: (0, 1.0)}, {start: 1.0}
    for h in range(1, hops + 1):
        step = defaultdict(float)
        for a, r, b, c in rows:
            if r in relations and a in frontier and b not in best:
                step[b] = max(step[b], frontier[a] * c)
        frontier = dict(step)
        best.update({b: (h, c) for b, c in frontier.items()})
    del best[start]
    return best


@pytest.mark.parametrize("hops", [1, 2, 4])
def test_bfs(spark, web, hops):
    got = {r.node_id: (r.hop, round(r.confidence, 9)) for r in graph.bfs(edges(spark, web), seeds(spark, "n0"), ("A", "B"), "outbound", hops).collect()}
    assert got == {k: (h, round(c, 9)) for k, (h, c) in search(web, "n0", "AB", hops).items()}


def test_bfs_depth_only_adds_and_closure_is_idempotent(spark, web):
    e = edges(spark, web)
    reach = [{r.node_id for r in graph.bfs(e, seeds(spark, "n1"), ("A",), "outbound", d).collect()} for d in (1, 2, 3, None)]
    assert reach[0] <= reach[1] <= reach[2] <= reach[3]
    again = {r.node_id for r in graph.bfs(e, seeds(spark, "n1", *reach[3]), ("A",), "outbound", None).collect()}
    assert again <= reach[3] | {"n1"}


def test_bfs_decays_prunes_and_never_reports_seeds(spark):
    rows = [("a", "R", "b", 0.9), ("b", "R", "c", 0.9), ("c", "R", "a", 1.0), ("a", "R", "d", 0.2), ("b", "R", "d", 0.9)]
    got = {r.node_id: (r.hop, round(r.confidence, 6)) for r in graph.bfs(edges(spark, rows), seeds(spark, "a"), None, "outbound", 5, 0.5, 0.15).collect()}
    # d is below the least confidence at hop 1 and is reached at hop 2 instead
    assert got == {"b": (1, 0.45), "c": (2, 0.2025), "d": (2, 0.2025)}


def test_bfs_cap_cuts_in_order(spark):
    rows = [("a", "R", f"x{i:02d}", 1.0) for i in range(30)]
    got = [r.node_id for r in graph.bfs(edges(spark, rows), seeds(spark, "a"), None, "outbound", 3, cap=10).orderBy("node_id").collect()]
    assert got == [f"x{i:02d}" for i in range(10)]


def test_shortest_paths(spark):
    rows = [("a", "R", "b", 0.9), ("b", "R", "d", 0.8), ("a", "R", "c", 0.7), ("c", "Q", "d", 0.6), ("a", "R", "d", 0.1), ("d", "R", "e", 1.0)]
    e = edges(spark, rows)
    got = [(r.hops, r.node_ids, round(r.min_confidence, 3)) for r in graph.shortest_paths(e, "a", "d", None, 5, 0.5).collect()]
    assert got == [(2, ["a", "b", "d"], 0.8), (2, ["a", "c", "d"], 0.6)]
    assert [r.hops for r in graph.shortest_paths(e, "a", "d").collect()] == [1]
    assert graph.shortest_paths(e, "a", "nowhere").count() == graph.shortest_paths(e, "a", "a").count() == graph.shortest_paths(e, "a", "e", ("Q",)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    rows = [(f"v{pick.randrange(40)}", f"v{pick.randrange(40)}") for _ in range(26)] + [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("z", "z")]
    parent = {x: x for r in rows for x in r}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in rows:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*rows, ("x", None)], "src string, dst string")
    assert {r.node: r.component for r in graph.components(df).collect()} == {x: find(x) for x in parent}


def test_cycles(spark, web):
    links = {(a, b) for a, r, b, _ in web if r == "A" and a != b}
    want = set()
    for length in range(2, 5):
        for path in itertools.permutations(sorted({x for l in links for x in l}), length) if length < 4 else []:
            if path[0] == min(path) and all((path[i], path[(i + 1) % length]) in links for i in range(length)):
                want.add(path)
    got = {tuple(r.node_ids) for r in graph.cycles(edges(spark, web), "A", 3).collect()}
    assert got == want


def test_degrees_count_a_loop_once(spark):
    nodes = seeds(spark, "a", "b", "c")
    e = spark.createDataFrame([("a", "R", "b", "r", 1.0), ("a", "R", "a", "r", 1.0), ("b", "S", "c", None, 1.0)], EDGE)
    assert {r.node_id: r.degree for r in graph.degrees(nodes, e).collect()} == {"a": 2, "b": 1, "c": 0}


def test_connectivity_and_gini(spark):
    nodes = seeds(spark, "a", "b", "c", "d")
    one = connectivity(nodes, edges(spark, [("a", "R", "b", 1.0), ("b", "R", "c", 1.0), ("x", "R", "a", 1.0)])).first()
    assert (one.n_nodes, one.n_components, one.largest_share, one.reachability) == (4, 2, 0.75, 0.5)
    values = [0, 0, 3, 5, 5, 9]
    n, ordered = len(values), sorted(values)
    want = sum((2 * i - n - 1) * x for i, x in enumerate(ordered, 1)) / (n * sum(values))
    assert gini(spark.createDataFrame([(v,) for v in values], "v int"), "v").first().gini == pytest.approx(want)
    assert gini(spark.createDataFrame([(0,)], "v int"), "v").first().gini == 1.0


@pytest.mark.parametrize("apart", [False, True])
def test_fiedler_value_of_more_than_the_dense_bound(spark, apart):
    pick = random.Random(3)
    links = [(i, pick.randrange(i)) for i in range(1, 700)] + [(pick.randrange(700), pick.randrange(700)) for _ in range(300)]
    n = 701 if apart else 700
    a = np.zeros((n, n))
    for x, y in links:
        if x != y:
            a[x, y] = a[y, x] = 1
    want = 0.0 if apart else np.sort(np.linalg.eigvalsh(np.diag(a.sum(1)) - a))[1]
    e = edges(spark, [(f"v{x:03d}", "R", f"v{y:03d}", 1.0) for x, y in [*links, *links[:50]]] + [("v000", "R", "outside", 1.0)])
    nodes = seeds(spark, *[f"v{i:03d}" for i in range(n)])
    assert fiedler_value(nodes, e) == pytest.approx(want, abs=1e-6)
    assert fiedler_value(nodes, e, dense=800) == pytest.approx(want, abs=1e-6)
    assert fiedler_value(nodes.limit(1), e) is None


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    assert {tuple(r) for r in graph.keep_first(df, ["k"], [F.col("o")]).collect()} == {("a", 1), ("b", 3)}


def test_bfs_of_nothing(spark):
    assert graph.bfs(edges(spark, []), seeds(spark), None, "both", None).count() == 0
    assert deque() == deque(graph.components(edges(spark, []).select("src", "dst")).collect())
