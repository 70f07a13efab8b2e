"""The iterative graph kernel: everything here is a loop of equi-joins over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.sources import small_side, stage

#: Levels of a walk after which its visited nodes are written into one table.
COMPACT = 16


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst): (node, component = smallest node).

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the number of
    nodes, and no component is ever gathered in one task. Self-loops keep their node as a component of its own;
    null endpoints are ignored.
    """
    raw = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    current = stage(raw)
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's least neighbour (itself included)
        both = current.union(current.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: a node's smaller neighbours and the node itself are linked to the least of them
        low = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        head = low.groupBy("src").agg(F.min("dst").alias("m"))
        joined = low.join(head, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(head.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        current = stage(small)
        sign = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    nodes = raw.select(F.col("src").alias("node")).union(raw.select("dst")).distinct()
    return nodes.join(current.select(F.col("src").alias("node"), "dst"), "node", "left").select("node", F.coalesce("dst", "node").alias("component"))


def directed(edges: DataFrame, relations: list[str] | tuple[str, ...] | None, direction: str) -> DataFrame:
    """(here, there, rel_type, confidence) of the edges (src, rel_type, dst, confidence) that may be walked; a null
    confidence counts as 1. A filter on the relation comes first, so it reaches the scan."""
    kept = edges if relations is None else edges.where(F.col("rel_type").isin(list(relations)))
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence")
    out = kept.select(F.col("src").alias("here"), F.col("dst").alias("there"), "rel_type", confidence)
    inward = kept.select(F.col("dst").alias("here"), F.col("src").alias("there"), "rel_type", confidence)
    return {"outbound": out, "inbound": inward}.get(direction) or out.union(inward)


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    relations: list[str] | tuple[str, ...] | None = None,
    direction: str = "outbound",
    max_hops: int | None = 1,
    decay: float = 1.0,
    min_confidence: float = 0.0,
    cap: int | None = None,
) -> DataFrame:
    """Level-synchronous search from ``seeds`` (node_id): (node_id, hop, confidence, rel_type).

    The hop is the least; the confidence the greatest product of edge confidences times decay**hop over the paths of
    that length (a node reached below ``min_confidence`` is not visited at that hop); the relation is that of the best
    last edge, the least among equals. Seeds are not part of the result. ``max_hops`` None walks to the fixpoint.
    Beyond ``cap`` visited nodes the walk ends after the hop, cut in the order of node_id.
    """
    # the frontier is joined with the (pruned) scan of the edges; only a walk over all edges to the fixpoint keeps a copy
    walk = directed(edges, relations, direction)
    if relations is None and max_hops is None:
        walk = stage(walk)
    frontier = seeds.select("node_id").where("node_id is not null").distinct().select("node_id", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("rel_type"))
    if max_hops is None or max_hops > 1:
        frontier = stage(frontier)
    levels, hop, total = [frontier], 0, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.select(F.col("node_id").alias("here"), F.col("confidence").alias("so_far")).join(walk, "here")
        step = step.select(F.col("there").alias("node_id"), (F.col("so_far") * F.col("confidence") * decay).alias("confidence"), "rel_type")
        visited = _all(levels).select("node_id")
        step = step.where(F.col("node_id").isNotNull() & (F.col("confidence") >= min_confidence)).join(visited, "node_id", "left_anti")
        # the best pair of (confidence, relation) with the least relation among equals: one hash aggregate, no list
        best = step.groupBy("node_id").agg(F.max("confidence").alias("confidence"), F.min(F.struct((-F.col("confidence")).alias("c"), F.col("rel_type").alias("r"))).alias("way"))
        frontier = best.select("node_id", F.lit(hop).alias("hop"), "confidence", F.col("way.r").alias("rel_type"))
        if hop == max_hops:  # nothing follows: the last hop is written by nobody
            levels.append(frontier)
            break
        frontier = stage(frontier)
        levels.append(frontier)
        found = frontier.count()
        total += found
        if not found or (cap is not None and total >= cap):
            break
        if len(levels) > COMPACT:  # long walks: few tables, each written a bounded number of times
            levels = [stage(_all(levels))]
    out = _all(levels).where("hop > 0")
    return out if cap is None else out.orderBy("hop", "node_id").limit(cap)


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def shortest_paths(edges: DataFrame, start: str, end: str, relations=None, max_hops: int = 8, min_confidence: float = 0.0, keep: int = 5) -> DataFrame:
    """The shortest undirected paths between two nodes over edges of at least ``min_confidence``: up to ``keep`` rows
    (hops, node_ids, rel_types, min_confidence) in the order of their nodes.

    Hops are found level by level with one row per node; paths are then read off backwards over the levels between
    the two nodes, so nothing is enumerated that isn't part of a shortest path.
    """
    spark = edges.sparkSession
    solid = edges.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= min_confidence)
    walk = directed(solid, relations, "both").where("here <> there")
    if relations is None:  # every level and every step back reads all edges
        walk = stage(walk)
    seed = spark.createDataFrame([(start,)], "node_id string")
    level, levels = seed, []
    empty = spark.createDataFrame([], "hops int, node_ids array<string>, rel_types array<string>, min_confidence double")
    if start == end:
        return empty
    for _ in range(max_hops):
        visited = _all([seed, *levels])
        level = stage(walk.join(small_side(level), walk.here == level.node_id).select(F.col("there").alias("node_id")).distinct().join(visited, "node_id", "left_anti"))
        levels.append(level)
        met = level.agg(F.count("*").alias("n"), F.max((F.col("node_id") == end).cast("int")).alias("there")).first()
        if not met.n:
            return empty
        if met.there:
            break
    else:
        return empty
    paths = spark.createDataFrame([(end, [end], [], 1.0)], "node_id string, node_ids array<string>, rel_types array<string>, min_confidence double")
    for back in [*reversed(levels[:-1]), seed]:
        hops = walk.join(small_side(back.withColumnRenamed("node_id", "back")), F.col("here") == F.col("back")).select("here", F.col("there").alias("node_id"), "rel_type", "confidence")
        paths = paths.join(hops, "node_id").select(F.col("here").alias("node_id"), F.concat(F.array("here"), "node_ids").alias("node_ids"), F.concat(F.array("rel_type"), "rel_types").alias("rel_types"), F.least("min_confidence", "confidence").alias("min_confidence"))
        # more than `keep` ways into one node can't all be among the first: the rest of the path is theirs in common
        order = Window.partitionBy("node_id").orderBy("node_ids", "rel_types")
        paths = stage(paths.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n"))
    return paths.select(F.size("rel_types").alias("hops"), "node_ids", "rel_types", "min_confidence").orderBy("node_ids", "rel_types").limit(keep)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) of every node, 0 included: edges with a predicate, at either end; a self-loop counts once."""
    typed = edges.where("predicate is not null")
    ends = typed.select(F.col("src").alias("node_id")).union(typed.where("src <> dst").select("dst"))
    counted = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def cycles(edges: DataFrame, relation: str, longest: int = 5) -> DataFrame:
    """Simple cycles of 2..``longest`` edges of one relation, each once, from its least node: (length, node_ids).

    Before paths are walked, nodes that have no edge both in and out are stripped, as long as that takes a tenth of the
    edges away: what is left of long chains, which lose an end a round, is walked like the rest and closes no cycle.
    """
    e = stage(edges.where((F.col("rel_type") == relation) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    left = e.count()
    while left:
        inner = e.select("src").intersect(e.select(F.col("dst").alias("src"))).withColumnRenamed("src", "n")
        e = stage(e.join(inner.withColumnRenamed("n", "src"), "src", "left_semi").join(inner.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
        before, left = left, e.count()
        if left > 0.9 * before:
            break
    path = e.where("src < dst").select(F.col("src").alias("root"), F.col("dst").alias("at"), F.array("src", "dst").alias("node_ids"))
    out = None
    for length in range(2, longest + 1):
        closed = path.join(e.select(F.col("src").alias("at"), F.col("dst").alias("root")), ["at", "root"]).select(F.lit(length).alias("length"), "node_ids")
        out = closed if out is None else out.union(closed)
        if length < longest:
            step = path.join(e.withColumnRenamed("src", "at"), "at").where((F.col("dst") > F.col("root")) & ~F.array_contains("node_ids", F.col("dst")))
            path = stage(step.select("root", F.col("dst").alias("at"), F.concat("node_ids", F.array("dst")).alias("node_ids")))
    return out


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
