"""The queries of this subpackage over the tables of TESTDATA.md; each reads its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import boilerplate, canonical, history, leaks, near_duplicates, nearest_vectors, packing, shared_spans, site_lines, splitting
from weftgraph.llm.oracles import ORACLES
from weftgraph.sources import read_table, scratch_folder

#: TESTDATA.md's similarity: three consecutive tokens, 0.6; segments of at least 40 tokens.
ALIKE_SEGMENTS = near_duplicates.Similarity(threshold=0.6, words=3, min_tokens=40)


def _alike_segments(spark: SparkSession, folder: str) -> near_duplicates.Found:
    segments = read_table(spark, folder, "segments").select("segment_id", "normalized_text", "raw_text")
    return near_duplicates.near_duplicates(segments, "segment_id", F.coalesce("normalized_text", "raw_text"), ALIKE_SEGMENTS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of segments of at least 40 tokens with similarity >= 0.6."""
    return near_duplicates.all_pairs(_alike_segments(spark, folder)).toDF("segment_id_a", "segment_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment of at least 40 tokens with its class of copies, its group and its number of links."""
    return near_duplicates.groups(_alike_segments(spark, folder)).withColumnRenamed("id", "segment_id")


#: TESTDATA.md's similarity for documents.
ALIKE_DOCUMENTS = near_duplicates.Similarity(threshold=0.6, words=3)


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return documents.select(F.col("doc_id").alias("id"), F.col("ingest_batch").alias("batch"), "text", "content_hash", "normalized_hash")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """For every document and every fetched task the accepted documents of older batches that it repeats."""
    documents = _accepted(spark, folder)
    tasks = read_table(spark, folder, "crawl_tasks").where("status = 'fetched'").select(F.col("task_id").alias("id"), "content_hash")
    found, fetched = history.duplicates(history.HistoryIndex(spark, scratch_folder(spark), ALIKE_DOCUMENTS), documents, tasks)
    named = lambda rows, kind: rows.select(F.lit(kind).alias("new_kind"), F.col("accepted_id").alias("accepted_doc_id"), "new_id")
    return named(found.where("accepted_id < new_id"), "document").union(named(fetched, "task"))


#: TESTDATA.md's problem 3: lines of at least 20 letters in at least 6 documents of a site.
LEAST_DOCUMENTS, LEAST_LETTERS = 6, 20


def _segment_lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "segments").select("segment_id", F.col("source_doc_id").alias("doc_id"), "site_key", "raw_text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of segments that stand in at least 6 documents of their site."""
    return site_lines.repeated_lines(_segment_lines(spark, folder), LEAST_DOCUMENTS, LEAST_LETTERS)


def p3_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of each site's lines with the documents, wordings and lines they cover."""
    return site_lines.templates(_segment_lines(spark, folder), LEAST_DOCUMENTS, LEAST_LETTERS)


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment without its site's repeated lines."""
    segments = _segment_lines(spark, folder)
    return site_lines.without_lines(segments, site_lines.repeated_lines(segments, LEAST_DOCUMENTS, LEAST_LETTERS))


#: TESTDATA.md's problem 4: the 5 most similar of a cosine of at least 0.85, in each field.
VECTOR_FIELDS, NEIGHBOURS, LEAST_COSINE = ("embedding", "title_vec", "content_vec"), 5, 0.85


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar other segments of each segment and field, as far as their cosine is at least 0.85."""
    segments = read_table(spark, folder, "segments").select("segment_id", *VECTOR_FIELDS)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("vec")) for f in VECTOR_FIELDS])
    vectors = segments.select(F.col("segment_id").alias("id"), F.explode(entries).alias("v")).select("v.field", "id", "v.vec")
    members, pairs = nearest_vectors.nearest_pairs(vectors, LEAST_COSINE, NEIGHBOURS)
    best = nearest_vectors.most_similar(members, pairs, NEIGHBOURS)
    return best.select(F.col("field").alias("vec_field"), F.col("id").alias("segment_id"), F.col("neighbour").alias("neighbour_id"))


#: TESTDATA.md's problem 5.
PIECE_TOKENS, PIECE_OVERLAP = 1024, 64


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of more than 1 024 tokens, found by cutting them."""
    return splitting.oversized(read_table(spark, folder, "segments").select("segment_id", "raw_text"), PIECE_TOKENS, PIECE_OVERLAP)


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment as pieces of at most 1 024 tokens, numbered within its document."""
    segments = read_table(spark, folder, "segments").select("segment_id", F.col("source_doc_id").alias("doc_id"), "segment_index", "raw_text")
    return splitting.pieces(segments, PIECE_TOKENS, PIECE_OVERLAP)


def _typed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The records with a typed form, and the entries of the reference list."""
    aliases = read_table(spark, folder, "lexicon_aliases").select("alias_id", "surface_form", "canonical_node_id")
    nodes = read_table(spark, folder, "ontology_nodes").select("node_id", F.explode(F.array("canonical_name", "display_name_zh")).alias("entry"))
    entries = nodes.select("entry", "node_id").union(aliases.where("canonical_node_id is not null").select("surface_form", "canonical_node_id"))
    candidates = read_table(spark, folder, "evolution_candidates").select(F.lit("candidate").alias("record_kind"), F.col("candidate_id").alias("record_id"), F.col("normalized_form").alias("form"))
    pending = aliases.where("canonical_node_id is null").select(F.lit("alias").alias("record_kind"), F.col("alias_id").alias("record_id"), F.col("surface_form").alias("form"))
    return candidates.union(pending).distinct(), entries


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The node meant by each typed form, or UNMATCHED."""
    records, entries = _typed(spark, folder)
    mapped = canonical.map_to_canonical(records.select("form"), entries)
    return records.join(mapped, "form").select("record_kind", "record_id", F.col("node_id").alias("canonical_node_id")).distinct()


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    segments = read_table(spark, folder, "segments").select("segment_id", F.col("source_doc_id").alias("doc_id"), "segment_index", "site_key", "raw_text")
    return segments, read_table(spark, folder, "cleaned_bodies").select("doc_id", "body")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of segments that are page furniture."""
    return boilerplate.furniture_lines(*_pages(spark, folder))


def p7_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each document: of its segments, or of its text where it has none."""
    segments, bodies = _pages(spark, folder)
    documents = read_table(spark, folder, "documents").select("doc_id", "site_key", "text")
    others = boilerplate.text_parts(documents.join(segments.select("doc_id").distinct(), "doc_id", "left_anti"))
    return boilerplate.main_bodies(segments.unionByName(others), boilerplate.furniture_lines(segments, bodies, others=others))


#: TESTDATA.md's problem 8: capacity, and the tokenizer file that sizes the documents (base64 tokens and ranks).
CAPACITY = 2048
TOKENIZER = os.environ.get("WEFTGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return packing.pack(packing.token_sizes(documents, TOKENIZER), CAPACITY)


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of a document above 2 048 tokens."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of space unused."""
    bins = _packed(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    used = F.sum("n")
    return bins.agg(F.count("*").alias("n_containers"), used.alias("n_tokens"), F.max("n").alias("fullest"), (1 - used / (F.count("*") * CAPACITY)).alias("unused_share"))


#: TESTDATA.md's problem 9: words in a row.
LEAK_WORDS = 13


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read_table(spark, folder, "eval_items").select("item_id", "item_text")
    names = read_table(spark, folder, "ontology_nodes").select(F.split("canonical_name", " ")[0].alias("text")).distinct()
    return leaks.leaks(documents, items, LEAK_WORDS, names)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that contain at least 13 consecutive words of an item."""
    return _leaks(spark, folder).where("kind = 'verbatim'").select(F.col("id").alias("doc_id"), "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every leak, verbatim or with other parameters, with the longest stretch of words."""
    return _leaks(spark, folder).withColumnRenamed("id", "doc_id")


#: TESTDATA.md's span length in characters.
SPAN = 300


def _spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shared_spans.span_pairs(read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), SPAN)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a verbatim common span of at least 300 characters."""
    return shared_spans.expanded_pairs(*_spans(spark, folder), SPAN).toDF("doc_id_a", "doc_id_b")


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, how much of it stands elsewhere too."""
    return shared_spans.shared_share(*_spans(spark, folder), SPAN).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_templates": p3_templates,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_bodies": p7_bodies,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_shared": p10_shared,
}

__all__ = ["ORACLES", "QUERIES"]
