"""Linking segments to the ontology, and pooling new terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.scoring import mapped, rounded
from weftgraph.functions.vectors import cosine

#: Forms of the dictionary sent to every task at once.
DICTIONARY_ROWS = 200_000

# The tag type of each layer, the role of each segment type, and the signs of each context.
LAYER_TAG = {"concept": "canonical", "mechanism": "mechanism_tag", "method": "method_tag", "condition": "condition_tag", "scenario": "scenario_tag"}
ROLES = {
    "definition": "定义", "mechanism": "机制", "constraint": "约束", "config": "配置", "fault": "故障", "troubleshooting": "排障",
    "best_practice": "最佳实践", "performance": "性能", "comparison": "对比", "table": "表格", "code": "配置",
}
CONTEXTS = {
    "数据中心": r"\bdata center\b|\bdc fabric\b",
    "园区网": r"\bcampus\b|\benterprise\b",
    "承载网": r"\bcarrier\b|\bservice provider\b|\bsp network\b",
    "接入网": r"\baccess network\b|\bpon\b|\bolt\b",
    "5GC": r"\b5gc\b|\b5g core\b|\bamf\b|\bsmf\b",
    "多厂商组网": r"\bmulti.vendor\b|\binterop\b",
}


def find_terms(segments: DataFrame, dictionary: DataFrame, whole_words: int = 3) -> DataFrame:
    """segments (segment_id, text), dictionary (form, node_id, confidence) -> the best confidence per segment and node.

    Forms of up to ``whole_words`` characters match whole words only, longer ones anywhere. All forms are sought in one pass over
    each text with an automaton; a dictionary of more than DICTIONARY_ROWS forms goes to the tasks in blocks, a pass each.
    """
    listed = dictionary.where("form is not null and form <> ''").groupBy(F.lower("form").alias("form")).agg(F.collect_set(F.struct("node_id", F.col("confidence").cast("double").alias("confidence"))).alias("meant"))
    out, block = None, {}
    for row in [*listed.orderBy("form").toLocalIterator(), None]:
        if row is not None:
            block[row.form] = [(m.node_id, m.confidence) for m in row.meant]
        if (row is None and (block or out is None)) or len(block) == DICTIONARY_ROWS:
            part = _block_terms(segments, block, whole_words)
            out, block = part if out is None else out.union(part), {}
    return out.groupBy("segment_id", "node_id").agg(F.max("confidence").alias("confidence"))


def _block_terms(segments: DataFrame, meanings: dict[str, list[tuple[str, float]]], whole_words: int) -> DataFrame:
    shape = pa.schema([("segment_id", pa.int64()), ("node_id", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(list(meanings), whole_words)
        for batch in batches:
            best: dict[tuple[int, str], float] = {}
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for form in find((text or "").lower()):
                    for node, c in meanings[form]:
                        best[s, node] = max(best.get((s, node), 0.0), c)
            keys = list(best)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([best[k] for k in keys], pa.float64())], schema=shape)

    return segments.select(F.col("segment_id").cast("long"), "text").mapInArrow(run, "segment_id long, node_id string, confidence double")


def _finder(forms: list[str], whole_words: int = 3):
    """A function text -> the set of forms that occur in it."""
    import ahocorasick  # there is no other way that reads a text once for all forms

    word = lambda c: c.isalnum() or c == "_"

    def whole(text: str, a: int, b: int) -> bool:
        return not (a and word(text[a - 1]) and word(text[a])) and not (b < len(text) and word(text[b]) and word(text[b - 1]))

    machine = ahocorasick.Automaton()
    for f in forms:
        machine.add_word(f, f)
    if not forms:
        return lambda text: set()
    machine.make_automaton()
    return lambda text: {f for end, f in machine.iter(text) if len(f) > whole_words or whole(text, end + 1 - len(f), end + 1)}


def verify_short(matches: DataFrame, segment_vectors: DataFrame, node_vectors: DataFrame, longest: int = 5, least: float = 0.3) -> DataFrame:
    """matches (segment_id, node_id, form, …) without those of a short form whose vectors are less alike than ``least``;
    a match without vectors stays."""
    rows = matches.join(segment_vectors.select("segment_id", F.col("vec").alias("_s")), "segment_id", "left").join(node_vectors.select("node_id", F.col("vec").alias("_n")), "node_id", "left")
    alike = cosine(F.col("_s"), F.col("_n"))
    return rows.where((F.length("form") > longest) | alike.isNull() | (alike >= least)).drop("_s", "_n")


#: Node vectors of one block; further blocks are further passes over the segments, merged by their best.
BLOCK_NODES = 20_000
#: The similarity from which a segment is about a node, how confident that is there, the gain, the most.
MATCH_LEAST, MATCH_BASE, MATCH_GAIN, MATCH_MOST = 0.6, 0.55, 1.8, 0.8


def nearest_nodes(vectors: DataFrame, nodes: DataFrame, first: int | None, least: float) -> DataFrame:
    """vectors (id, vec), nodes (node_id, vec) -> (id, node_id, similarity, place): the ``first`` most similar nodes of each
    vector (None: all of them, without a place), ties by the lesser id, as far as they reach ``least``. Null and zero
    vectors take no part.

    The nodes go to the tasks as matrices of BLOCK_NODES rows, one block after the other, so what is sent at once is
    bounded however many there are; every block gives a vector's ``first`` best, and the best of these are the result."""
    shape = pa.schema([("id", pa.int64()), ("node_id", pa.string()), ("similarity", pa.float64())])
    size, out, block = nodes.where("vec is not null").agg(F.max(F.size("vec"))).first()[0], None, []
    for row in [*nodes.where("node_id is not null and vec is not null").select("node_id", "vec").orderBy("node_id").toLocalIterator(), None]:
        if row is not None and len(row.vec) == size:
            block.append(row)
        if (row is None and block) or len(block) == BLOCK_NODES:
            part = _block_matches(vectors, block, first, least, shape)
            out, block = part if out is None else out.union(part), []
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "id long, node_id string, similarity double")
    if first is None:
        return out
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "node_id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)


def _block_matches(vectors: DataFrame, block: list, first: int | None, least: float, shape: pa.Schema) -> DataFrame:
    matrix = np.array([n.vec for n in block], float)
    length = np.linalg.norm(matrix, axis=1)
    ids, matrix = [n.node_id for n, x in zip(block, length) if x > 0], matrix[length > 0] / length[length > 0][:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, float]] = []
            for at in range(0, batch.num_rows if ids else 0, 512):
                part = batch.slice(at, 512)
                x = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                n = np.linalg.norm(x, axis=1)
                s = (x @ matrix.T) / np.where(n > 0, n, 1)[:, None]
                for i, one in enumerate(part.column(0).to_pylist()):
                    if n[i] > 0:
                        order = np.argsort(-s[i], kind="stable")[:first]
                        rows += [(one, ids[j], float(s[i, j])) for j in order if s[i, j] >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)

    known = vectors.where("id is not null and vec is not null").where(F.size("vec") == matrix.shape[1])
    return known.select(F.col("id").cast("long"), "vec").mapInArrow(run, "id long, node_id string, similarity double")


def embedding_match(segment_vectors: DataFrame, node_vectors: DataFrame, layers: Sequence[str] | None = None, least: float = MATCH_LEAST, most: int = 5) -> DataFrame:
    """segment_vectors (segment_id, vec), node_vectors (node_id, vec, layer) -> (segment_id, node_id, similarity,
    confidence): of each segment's ``3 * most`` most similar nodes those that are alike enough and of one of the
    ``layers`` (all where none are named), ``most`` at the most. The confidence is rounded to 2 places."""
    near = nearest_nodes(segment_vectors.withColumnRenamed("segment_id", "id"), node_vectors, 3 * most, least)
    if layers is not None:
        near = near.join(node_vectors.where(F.col("layer").isin(list(layers))).select("node_id").distinct(), "node_id", "left_semi")
    kept = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("n") <= most)
    confidence = F.least(F.lit(MATCH_MOST), F.round(MATCH_BASE + (F.col("similarity") - least) * MATCH_GAIN, 2))
    return kept.select(F.col("id").alias("segment_id"), "node_id", "similarity", confidence.alias("confidence"))


def new_concepts(terms: DataFrame, aliases: DataFrame, stopwords: DataFrame, term_vectors: DataFrame | None = None, node_vectors: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """What a classifier of terms found, (term, classification, layer, doc_id, segment_id), cut down to what may enter
    the pool: new concepts (the default) that are no alias and no stopword (word), and whose vector (term, vec) is not
    as close as ``least`` to that of a node (node_id, vec). An unknown layer becomes concept. Without vectors nothing
    is dropped for likeness. Null and blank terms are left out."""
    rows = terms.withColumn("term", F.trim("term")).where("term is not null and term <> ''").where(F.coalesce("classification", F.lit("new_concept")) == "new_concept")
    rows = rows.withColumn("layer", F.when(F.col("layer").isin(*model.LAYERS), F.col("layer")).otherwise("concept")).withColumn("folded", F.lower("term"))
    rows = rows.join(aliases.select(F.lower("surface_form").alias("folded")), "folded", "left_anti").join(stopwords.select(F.lower(F.trim("word")).alias("folded")), "folded", "left_anti")
    if term_vectors is not None and node_vectors is not None:
        ids = term_vectors.select(F.xxhash64("term").alias("id"), "term", "vec")
        same = nearest_nodes(ids.select("id", "vec"), node_vectors, 1, least).select("id").join(ids.select("id", "term"), "id").select("term").distinct()
        rows = rows.join(same, "term", "left_anti")
    return rows.select("term", "layer", "doc_id", "segment_id")


def role_tag(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[kind]


def context_tags(text: Column) -> Column:
    """The contexts whose signs stand in the first 1 000 characters, in a fixed order."""
    head = F.lower(F.substring(text, 1, 1000))
    return F.array_compact(F.array(*[F.when(head.rlike(pattern), F.lit(label)) for label, pattern in CONTEXTS.items()]))


def pending(segments: DataFrame, tags: DataFrame) -> DataFrame:
    """Segments without a canonical tag."""
    return segments.join(tags.where("tag_type = 'canonical'").select("segment_id"), "segment_id", "left_anti")


def propagate(waiting: DataFrame, tags: DataFrame, rst: DataFrame) -> DataFrame:
    """waiting (segment_id), canonical tags (segment_id, ontology_node_id, confidence) and discourse edges -> borrowed tags
    (segment_id, ontology_node_id, confidence): a neighbour's confidence times the relation's weight, a bonus if the
    neighbour is the nucleus, kept from 0.5 on. Recomputed rather than added to, so a second run changes nothing."""
    ids = waiting.select("segment_id").distinct()
    ends = rst.select(F.col("src_edu_id").alias("segment_id"), F.col("dst_edu_id").alias("other"), "relation_type", (F.col("nuclearity") == "SN").alias("nucleus"))
    ends = ends.union(rst.select(F.col("dst_edu_id"), F.col("src_edu_id"), "relation_type", F.col("nuclearity") == "NS"))
    near = ends.join(ids, "segment_id", "left_semi").join(ids.withColumnRenamed("segment_id", "other"), "other", "left_anti")
    weight = F.least(F.lit(1.0), mapped(F.col("relation_type"), model.RST_PROPAGATION, model.RST_OTHER) + F.when(F.col("nucleus"), model.RST_NUCLEUS_BONUS).otherwise(0.0))
    near = near.withColumn("weight", F.round(weight, 4)).where(F.col("weight") >= model.RST_KEEP)
    rows = near.join(tags.select(F.col("segment_id").alias("other"), "ontology_node_id", F.col("confidence").alias("c")), "other")
    rows = rows.select("segment_id", "ontology_node_id", rounded(F.col("c") * F.col("weight"), 3).alias("confidence")).where(F.col("confidence") >= model.RST_KEEP)
    return rows.groupBy("segment_id", "ontology_node_id").agg(F.max("confidence").alias("confidence"))


def pool_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """The pool after a batch: one row per normalized_form with all surface forms and documents, the number of documents,
    and the first and last time seen. Both sides: (normalized_form, surface_forms, doc_ids, first_seen_at, last_seen_at)."""
    both = old.unionByName(new).where("normalized_form is not null and trim(normalized_form) <> ''")
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(both.schema[c].dataType))))))
    grouped = both.groupBy("normalized_form").agg(together("surface_forms").alias("surface_forms"), together("doc_ids").alias("doc_ids"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return grouped.withColumn("source_count", F.size("doc_ids"))


def best_per_node(matches: DataFrame) -> DataFrame:
    return matches.groupBy("segment_id", "node_id").agg(F.max("confidence").alias("confidence"))

