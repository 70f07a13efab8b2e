"""The quality report: granularity, overlap, layers, dictionary, structure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.vectors import cosine
from weftgraph.knowledge import Held, Knowledge
from weftgraph.operators import graph, semantic
from weftgraph.sources import small_side, stage


def gini(values: DataFrame, column: str) -> DataFrame:
    """The Gini coefficient, 1 where all is 0. Equal values are counted first, so the ranking runs over the distinct
    values (for degrees: few, however many nodes there are)."""
    c = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").cast("double").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = c.withColumn("b", before)
    # ranks b+1 .. b+m of one value: the sum of 2i - n - 1 is m * (2b + m - n)
    n, total = F.sum("m").over(Window.partitionBy()), F.sum(F.col("x") * F.col("m")).over(Window.partitionBy())
    return rows.withColumn("n", n).withColumn("t", total).agg(F.when(F.max("t") > 0, F.sum(F.col("x") * F.col("m") * (2 * F.col("b") + F.col("m") - F.col("n"))) / F.max(F.col("n") * F.col("t"))).otherwise(1.0).alias("gini"))


def granularity(k: Knowledge) -> DataFrame:
    """One row: gini of degrees, share of super nodes (above mean + 3 deviations) and of isolated nodes, tags a segment."""
    d = graph.degrees(k.node, k.edge)
    bound = d.agg((F.avg("degree") + 3 * F.stddev_pop("degree")).alias("bound"))
    shares = d.join(bound).agg(F.round(F.avg((F.col("degree") > F.col("bound")).cast("double")), 6).alias("super_ratio"), F.round(F.avg((F.col("degree") == 0).cast("double")), 6).alias("isolation"))
    per = k.segment_tag.where("tag_type = 'canonical'").groupBy("segment_id").agg(F.count_distinct("ontology_node_id").alias("n")).agg(F.round(F.avg("n"), 6).alias("tags_per_segment"))
    return gini(d, "degree").select(F.round("gini", 6).alias("gini")).join(shares).join(per)


def predicate_overlap(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, jaccard) of predicates over the (subject, object) pairs they connect: an inverted index, so only predicates
    that meet on a pair are counted."""
    rows = edges.where("predicate is not null").select("src", "dst", "predicate").distinct()
    size = rows.groupBy("predicate").agg(F.count("*").alias("n"))
    both = rows.withColumnRenamed("predicate", "a").join(rows.withColumnRenamed("predicate", "b"), ["src", "dst"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    scored = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").withColumn("jaccard", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6))
    return scored.where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def similar_nodes(k: Knowledge, vectors: DataFrame | None = None, least: float = 0.3, n: int = 50) -> DataFrame:
    """(a, b, score): the most similar pairs of nodes by neighbours (excluding each other) and tagged segments, and by
    vectors where given.

    Without vectors a score of ``least`` needs a Jaccard of ``least`` in neighbours or in segments, and of twice that
    where one of the two has one kind only; vectors may make up for 0.3 of the score, but not for a missing item in
    common. `_meeting` finds what can reach that, and only those pairs have their items counted, one row an item.
    """
    typed = k.edge.where("predicate is not null")
    near = typed.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").where("src <> dst").toDF("node_id", "item")
    tagged = k.segment_tag.select(F.col("ontology_node_id").alias("node_id"), F.concat(F.lit("#"), F.col("segment_id")).alias("item")).where("item is not null")
    items = stage(near.union(tagged).repartition("item").distinct().withColumn("uses", F.count("*").over(Window.partitionBy("item"))))
    weight, rest = (0.5, 0.0) if vectors is None else (0.35, 0.3)
    short = least - rest - 1e-6  # scores are rounded
    pairs = stage(_meeting(items, both=max(0.0, short / (2 * weight)), alone=min(1.0, max(0.0, short / weight))))
    ends = stage(pairs.select(F.col("a").alias("node_id")).union(pairs.select("b")).distinct())
    tag = F.col("item").startswith("#").cast("long")
    mine = items.join(small_side(ends), "node_id", "left_semi").select("node_id", "item")
    size = mine.groupBy("node_id").agg(F.sum(1 - tag).alias("n"), F.sum(tag).alias("t"))
    rows = pairs.join(size.toDF("a", "na", "ta"), "a").join(size.toDF("b", "nb", "tb"), "b")
    rows = rows.join(mine.toDF("a", "b").withColumn("linked", F.lit(1)), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    # the items of the smaller one are looked up in the larger
    fewer = F.col("na") + F.col("ta") <= F.col("nb") + F.col("tb")
    looked = rows.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"))
    common = looked.join(mine.toDF("few", "item"), "few").join(mine.toDF("many", "item"), ["many", "item"]).groupBy("a", "b").agg(F.sum(1 - tag).alias("cn"), F.sum(tag).alias("ct"))
    rows = rows.join(common, ["a", "b"]).withColumn("un", F.col("na") + F.col("nb") - 2 * F.col("linked") - F.col("cn")).withColumn("ut", F.col("ta") + F.col("tb") - F.col("ct"))
    j = lambda c, u: F.when(F.col(u) > 0, F.col(c) / F.col(u)).otherwise(0.0)
    score = weight * j("cn", "un") + weight * j("ct", "ut")
    if vectors is not None:
        rows = rows.join(vectors.toDF("a", "va"), "a", "left").join(vectors.toDF("b", "vb"), "b", "left")
        score = score + rest * F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0))
    return rows.select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "a", "b").limit(n)


def _meeting(items: DataFrame, both: float, alone: float) -> DataFrame:
    """(a, b): all pairs of nodes that may have a Jaccard of ``both`` in items (node_id, item, uses) of one kind (an item
    of the other kind begins with #), or of ``alone`` where one of them has a single kind, and a few others.

    Sets of ma and mb items with a Jaccard of t overlap by o >= t / (1 + t) * (ma + mb). Ordered by how rare items are,
    the first x that they share stand among the first m - o + x of each; a pair must share x = sqrt(o) / 2 of those. So
    hubs, which come last, hardly ever meet, a few chance meetings are not enough for large sets, and no pair is lost. Two linked
    nodes don't count each other, hence the 2 below.
    """
    enough = lambda o: F.ceil(F.sqrt(o) / 2)
    overlap = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-9))
    of = Window.partitionBy("node_id", "tag")
    rows = items.select("node_id", F.xxhash64("item").alias("item"), F.col("item").startswith("#").alias("tag"), "uses").repartition("node_id")
    rows = rows.withColumn("room", -F.row_number().over(of.orderBy("uses", "item"))).withColumn("m", F.count("*").over(of))
    rows = rows.withColumn("need", F.when(F.min("tag").over(Window.partitionBy("node_id")) != F.max("tag").over(Window.partitionBy("node_id")), both).otherwise(alone))
    # room: the items that follow; an item of one node meets nobody
    rows = rows.withColumn("room", F.col("room") + F.col("m")).withColumn("o", overlap(F.col("need") * (F.col("m") - 1)))
    rows = rows.where((F.col("uses") > 1) & (F.col("room") >= F.col("o") - enough(F.col("o")))).select("item", "tag", "node_id", "m", "room", "need")
    need = F.greatest("wa", "wb")
    met = rows.toDF("item", "tag", "a", "ma", "ra", "wa").join(rows.toDF("item", "tag", "b", "mb", "rb", "wb"), ["item", "tag"])
    met = met.where((F.col("a") < F.col("b")) & (F.least("ma", "mb") >= need * (F.greatest("ma", "mb") - 1) - 1e-9))
    o = overlap(need / (1 + need) * (F.col("ma") + F.col("mb") - 2))
    met = met.where(F.least("ra", "rb") >= o - enough(o)).select("a", "b", "tag", enough(o).alias("x"))
    return met.groupBy("a", "b", "tag", "x").agg(F.count("*").alias("n")).where("n >= x").select("a", "b").distinct()


def complete_concepts(k: Knowledge) -> DataFrame:
    """One row: the number of concepts with a path through all five layers, by semi-joins from the far end (no path is
    ever enumerated)."""
    e = k.edge.select("src", "rel_type", "dst")
    part = lambda r: e.where(F.col("rel_type") == r)
    method = part("APPLIES_TO").select(F.col("src").alias("n")).distinct().join(part("COMPOSED_OF").select(F.col("dst").alias("n")), "n", "left_semi")
    mechanism = part("IMPLEMENTED_BY").join(method.withColumnRenamed("n", "dst"), "dst", "left_semi").select(F.col("src").alias("n")).distinct()
    concept = part("EXPLAINS").join(mechanism.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src").distinct()
    return concept.agg(F.count("*").alias("complete_concepts"))


def _sizes() -> list[Column]:
    """The figures of a graph from the sizes s of its components."""
    n = F.sum("s")
    return [F.sum("s").cast("long").alias("n_nodes"), F.count("*").alias("n_components"), F.round(F.max("s") / n, 6).alias("largest_share"), F.round(F.when(n > 1, F.sum(F.col("s") * (F.col("s") - 1)) / (n * (n - 1))).otherwise(0.0), 6).alias("reachability")]


def _density() -> Column:
    """Of m edges over n_nodes."""
    return F.round(F.when(F.col("n_nodes") > 1, F.col("m") / (F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1))).otherwise(0.0), 8).alias("density")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, components, share of the largest one, average reachability (exact: the sum of s(s-1) over the
    components by n(n-1)), directed density."""
    ids = nodes.select("node_id").distinct()
    pairs = edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").distinct()
    component = graph.components(pairs)
    size = ids.join(component.toDF("node_id", "component"), "node_id", "left").groupBy(F.coalesce("component", "node_id")).agg(F.count("*").cast("double").alias("s"))
    m = pairs.where("src <> dst").agg(F.count("*").alias("m"))
    return size.agg(*_sizes()).join(m).select("n_nodes", "n_components", "largest_share", "reachability", _density())


def fiedler_value(nodes: DataFrame, edges: DataFrame, dense: int = 600) -> float | None:
    """The second eigenvalue of the Laplacian of a graph, None below 2 nodes: from the whole matrix up to ``dense`` nodes,
    above by `_second_eigenvalue` over its edges. A graph that is not connected has 0 without either. Nodes are numbered
    and edges held on the driver (an ontology: 8 bytes a node and vector, 16 an edge)."""
    ids = nodes.select("node_id").where("node_id is not null").distinct()
    pairs = edges.select("src", "dst").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = stage(pairs.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").distinct())
    listed = ids.orderBy("node_id").toArrow().column(0).to_pylist()
    if len(listed) < 2:
        return None
    at = {x: i for i, x in enumerate(listed)}
    held = pairs.toArrow()
    ends = np.array([[at[x] for x in held.column(c).to_pylist()] for c in ("src", "dst")], np.int64).reshape(2, -1)
    if len(listed) > dense:
        return _second_eigenvalue(len(listed), ends)
    a = np.zeros((len(listed), len(listed)))
    a[ends[0], ends[1]] = a[ends[1], ends[0]] = 1
    return float(np.sort(np.linalg.eigvalsh(np.diag(a.sum(1)) - a))[1])


def _connected(n: int, ends: np.ndarray) -> bool:
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, ends[0], before[ends[1]])
        np.minimum.at(least, ends[1], before[ends[0]])
        least = least[least]
        if (least == before).all():
            return not least.any()


def _second_eigenvalue(n: int, ends: np.ndarray, close: float = 1e-9, block: int = 200) -> float:
    """The least eigenvalue of the Laplacian on what is orthogonal to the constant vector, by Lanczos steps that are
    kept orthogonal and begun again from the best vector every ``block`` steps, until the residual is below ``close`` of
    the largest degree."""
    if not _connected(n, ends):
        return 0.0
    degree = np.bincount(ends.ravel(), minlength=n).astype(float)
    apply = lambda x: degree * x - np.bincount(ends[0], x[ends[1]], n) - np.bincount(ends[1], x[ends[0]], n)
    x = np.random.default_rng(0).standard_normal(n)
    for _ in range(2_000):
        basis, steps = np.zeros((min(block, n - 1), n)), min(block, n - 1)
        diagonal, beside = np.zeros(steps), np.zeros(steps)
        x -= x.mean()
        basis[0] = x / np.linalg.norm(x)
        for j in range(steps):
            y = apply(basis[j])
            diagonal[j] = basis[j] @ y
            for _ in range(2):
                y -= basis[: j + 1].T @ (basis[: j + 1] @ y)
                y -= y.mean()
            beside[j] = np.linalg.norm(y)
            if beside[j] <= 1e-12 * degree.max() or j + 1 == steps:
                steps = j + 1
                break
            basis[j + 1] = y / beside[j]
        small = np.diag(diagonal[:steps]) + np.diag(beside[: steps - 1], 1) + np.diag(beside[: steps - 1], -1)
        values, vectors = np.linalg.eigh(small)
        x = basis[:steps].T @ vectors[:, 0]
        if np.linalg.norm(apply(x) - values[0] * x) <= close * degree.max():
            return float(values[0])
    raise ValueError("the second eigenvalue was not reached")


def layer_connectivity(k: Knowledge, layers: Sequence[str] = model.LAYERS) -> DataFrame:
    """`connectivity` of the active nodes of each layer over the typed edges within it, and of all layers together as
    ``global``: one row each, with the layer first. The graphs have no node in common once it is named with its layer,
    so the components of all of them are found in one go."""
    named = k.spark.createDataFrame([(i, name) for i, name in enumerate([*layers, "global"])], "graph int, layer string")
    active = k.node.where("lifecycle_state = 'active'").where(F.col("layer").isin(list(layers)))
    own = active.join(F.broadcast(named), "layer").select("graph", "node_id")
    ids = stage(own.union(active.select(F.lit(len(layers)), "node_id")).distinct())
    typed = k.edge.where("predicate is not null").select("src", "dst").distinct()
    pairs = typed.join(ids.withColumnRenamed("node_id", "src"), "src").join(ids.withColumnRenamed("node_id", "dst"), ["graph", "dst"])
    within = lambda c: F.concat_ws("|", "graph", c)
    pairs = stage(pairs.select("graph", within("src").alias("src"), within("dst").alias("dst")))
    component = graph.components(pairs).withColumnRenamed("node", "node_id")
    size = ids.withColumn("node_id", F.when(F.col("node_id").isNotNull(), within("node_id"))).join(component, "node_id", "left").groupBy("graph", F.coalesce("component", "node_id")).agg(F.count("*").cast("double").alias("s"))
    m = pairs.where("src <> dst").groupBy("graph").agg(F.count("*").alias("m"))
    one = named.join(size.groupBy("graph").agg(*_sizes()), "graph", "left").join(m, "graph", "left").fillna(0, ["n_components", "m"]).fillna(0.0, ["reachability"])
    return one.select("layer", "n_nodes", "n_components", "largest_share", "reachability", _density())


@dataclass(frozen=True)
class Measured:
    """The figures a report is made from."""

    gini: float
    super_ratio: float
    isolation: float
    tags_per_segment: float
    ubiquitous: int
    overlaps: list[tuple[str, str, float]]
    top3_share: float
    concentrated: int
    used_in_facts: int
    used: int
    defined: int
    similar: int
    coverage: dict[str, float]
    alias_coverage: float
    tag_rate: float
    largest_share: dict[str, float]
    fiedler: dict[str, float | None]
    cycles: int


def measure(k: Knowledge, defined: int, similar_least: float = 0.3) -> Measured:
    """The figures over a whole graph; ``defined`` is the number of relations the ontology defines. All of them are
    aggregates; only what a report names by itself (predicates, layers) comes to the driver."""
    k = Held(k)
    g = granularity(k).first()
    tagged = k.segment_tag.where("tag_type = 'canonical'")
    segments = k.segment_tag.select("segment_id").distinct().count()
    everywhere = tagged.groupBy("ontology_node_id").agg(F.count_distinct("segment_id").alias("n")).where(F.col("n") > 0.8 * segments).count()
    facts = k.fact.where("lifecycle_state = 'active'")
    uses = sorted((r["n"] for r in facts.groupBy("predicate").agg(F.count("*").alias("n")).collect()), reverse=True)
    overlaps = predicate_overlap(facts.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate"), 0.5).where("jaccard > 0.5").orderBy(F.desc("jaccard"), "a", "b").limit(5).collect()
    per = facts.groupBy("subject", "predicate").agg(F.count("*").alias("n")).groupBy("subject").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    concentrated = per.where("n >= 5 and top / n > 0.9").count()
    active = k.node.where("lifecycle_state = 'active'").select("node_id").distinct()
    n_active = max(active.count(), 1)
    aliased = active.join(k.alias.select(F.col("canonical_node_id").alias("node_id")), "node_id", "left_semi").count()
    # the report asks for active nodes and typed edges
    covered = semantic.cross_layer_check(_Sound(k)).collect()
    connected = {r.layer: r for r in layer_connectivity(k).collect()}
    typed, fiedler = k.edge.where("predicate is not null"), {}
    for name, r in connected.items():
        nodes = k.node.where("lifecycle_state = 'active'")
        nodes = nodes if name == "global" else nodes.where(F.col("layer") == name)
        # a graph that isn't connected has 0, whatever its size
        fiedler[name] = None if r.n_nodes < 2 else 0.0 if r.n_components > 1 else fiedler_value(nodes, typed)
    return Measured(
        gini=g.gini, super_ratio=g.super_ratio, isolation=g.isolation, tags_per_segment=float(g.tags_per_segment or 0), ubiquitous=everywhere,
        overlaps=[(r.a, r.b, r.jaccard) for r in overlaps], top3_share=sum(uses[:3]) / max(sum(uses), 1), concentrated=concentrated,
        used_in_facts=len(uses), used=k.fact.select("predicate").distinct().count(), defined=defined, similar=similar_nodes(k, least=similar_least).count(),
        coverage={f"{r.layer_a}-{r.layer_b}": r.coverage for r in covered}, alias_coverage=aliased / n_active, tag_rate=tagged.select("ontology_node_id").distinct().count() / n_active,
        largest_share={n: r.largest_share for n, r in connected.items()}, fiedler=fiedler, cycles=graph.cycles(k.edge, "DEPENDS_ON").count(),
    )


class _Sound:
    """A view of a `Knowledge` with active nodes and typed edges only."""

    def __init__(self, k: Knowledge):
        self.spark, self.node, self.edge = k.spark, k.node.where("lifecycle_state = 'active'"), k.edge.where("predicate is not null")


def issues(m: Measured) -> list[tuple[str, str, float]]:
    """What is wrong, as (dimension, issue, value), in a fixed order."""
    out: list[tuple[str, str, float]] = []
    found = lambda dimension, wrong, name, value: out.append((dimension, name, float(value))) if wrong else None
    used = m.used_in_facts / max(m.defined, 1)
    found("granularity", m.gini > 0.8, "high_gini", m.gini)
    found("granularity", m.super_ratio > 0.1, "super_node_ratio", m.super_ratio)
    found("granularity", m.isolation > 0.4, "high_isolation", m.isolation)
    found("granularity", m.tags_per_segment > 8, "tag_overload", m.tags_per_segment)
    found("granularity", m.ubiquitous > 5, "ubiquitous_nodes", m.ubiquitous)
    for a, b, jaccard in m.overlaps:
        found("orthogonality", True, f"predicate_overlap:{a}/{b}", jaccard)
    found("orthogonality", m.top3_share > 0.8, "predicate_skew", m.top3_share)
    found("orthogonality", m.concentrated > 5, "predicate_concentration", m.concentrated)
    found("orthogonality", used < 0.3, "low_utilization", used)
    found("orthogonality", m.similar > 3, "similar_nodes", m.similar)
    for pair in sorted(m.coverage):
        found("cross_layer", m.coverage[pair] < 0.1, f"layer_gap:{pair}", m.coverage[pair])
    found("discoverability", m.alias_coverage < 0.5, "low_alias_coverage", m.alias_coverage)
    found("discoverability", m.used / max(m.defined, 1) < 0.3, "low_relation_utilization", m.used / max(m.defined, 1))
    found("discoverability", m.tag_rate < 0.3, "low_tag_rate", m.tag_rate)
    for layer, share in m.largest_share.items():
        found("structural", share < 0.5, f"fragmented_layer:{layer}", share)
        value = m.fiedler.get(layer)
        found("structural", value is not None and value < 0.01 and share > 0.5, f"low_algebraic_connectivity:{layer}", value or 0)
    found("structural", m.cycles > 0, "dependency_cycle", m.cycles)
    return out


def scores(m: Measured) -> dict[str, float]:
    """The score of each dimension (0..1, higher is healthier) and of all, ``overall``."""
    listed = [d for d, _, _ in issues(m)]
    penalty = lambda d: min(0.15 * listed.count(d), 0.6)
    out = {
        "granularity": max(0.0, 1 - penalty("granularity") - 0.1 * (m.gini > 0.7) - 0.1 * (m.isolation > 0.3)),
        "orthogonality": max(0.0, 1 - penalty("orthogonality") - 0.2 * (m.top3_share > 0.7)),
        "cross_layer": min(1.0, 2 * sum(m.coverage.values()) / max(len(m.coverage), 1)),
        "discoverability": 0.4 * m.alias_coverage + 0.3 * m.used / max(m.defined, 1) + 0.3 * m.tag_rate,
        "structural": max(0.0, 0.8 - 0.3 * (m.cycles > 0) - 0.2 * (m.largest_share.get("global", 0.0) < 0.5)),
    }
    out = {d: round(v, 4) for d, v in out.items()}
    return {**out, "overall": round(sum(out.values()) / len(out), 4)}


def report(k: Knowledge, defined: int) -> DataFrame:
    """The report as rows (dimension, entry, value): a ``score`` for each dimension and ``overall``, then the issues."""
    m = measure(k, defined)
    rows = [(d, "score", float(v)) for d, v in scores(m).items()] + issues(m)
    return k.spark.createDataFrame(rows, "dimension string, entry string, value double")
