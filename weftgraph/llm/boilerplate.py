"""Separating a page's main body from the furniture of its site: consensus host paths.

The pages here are text, so a page's containers are its lines (`page_lines`).  A line's *path* is its generalised
container, shape and head of wording with site name and numbers replaced; its *place* the coarser path of part of the
page, nearness to top and end, shapes of the line and its neighbours.  Three steps:

1. every container of every page is scored by a small linear model over generalised wording, shape and place,
   fitted on a bounded sample of hand-cleaned pages;
2. the scores vote per host and path, and per host and place, as sums merged over all partitions: a verdict rests on
   all of the host's pages;
3. the pages are read again.  Where the line's path stands on enough of the host's pages its verdict alone decides,
   whatever the single line's score; elsewhere the line's score and the verdict of its place decide together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.llm.page_lines import BITS, read
from weftgraph.llm.shingles import chunks
from weftgraph.sources import small_side, stage


@dataclass(frozen=True)
class Cleaning:
    """``sample_pages`` bounds the labelled pages a model is fitted on; a path's verdict counts from ``least_pages``
    pages of the host; that of a place weighs ``weight`` times as much as a line's own score."""

    sample_pages: int = 2_000
    epochs: int = 120
    least_pages: int = 3
    weight: float = 0.5


class Model:
    """A logistic model over hashed features; positive scores are furniture."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    @staticmethod
    def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int) -> Model:
        """Examples as (line, slot) pairs and each line's label. Full-batch Adagrad with a small L2 penalty; the same for
        any order of the examples up to rounding."""
        weights = np.zeros(1 << BITS)
        if sum(len(y) for _, _, y in examples):
            offset = np.cumsum([0, *[len(y) for _, _, y in examples]])
            owner = np.concatenate([line + o for (line, _, _), o in zip(examples, offset)])
            index, target = np.concatenate([slot for _, slot, _ in examples]), np.concatenate([y for _, _, y in examples]).astype(float)
            history = np.full(1 << BITS, 1e-6)
            for _ in range(epochs):
                score = np.bincount(owner, weights[index], len(target))
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
                slope = np.bincount(index, error[owner], 1 << BITS) + 0.01 * weights
                history += slope**2
                weights -= 0.5 * slope / np.sqrt(history)
        return Model(weights)


def labelled(segments: DataFrame, bodies: DataFrame, how: Cleaning) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Examples from at most ``sample_pages`` pages of bodies (doc_id, body), chosen by a hash of their id: a line of a
    page's segments is furniture unless it stands in the page's body."""
    sample = bodies.where("doc_id is not null and body is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample_pages).select("doc_id", "body")
    kept = {row.doc_id: {x.strip() for x in row.body.split("\n")} for row in sample.collect()}
    ids = segments.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    rows = segments.join(F.broadcast(ids), "doc_id").select("doc_id", "segment_id", "site_key", "first", "raw_text").dropDuplicates(["segment_id"]).orderBy("segment_id").collect()
    texts, out = [r.raw_text or "" for r in rows], []
    for a, b in chunks(texts):
        lines = read(texts[a:b], [r.site_key for r in rows[a:b]], [r.first for r in rows[a:b]])
        parts = [t.split("\n") for t in texts[a:b]]
        label = [parts[t][k].strip() not in kept[rows[a + t].doc_id] for t, k in zip(lines.text.tolist(), lines.line_no.tolist())]
        out.append((lines.feature_line, lines.feature_slot, np.array(label, bool)))
    return out


def _prepared(segments: DataFrame) -> DataFrame:
    rows = segments.where("segment_id is not null").select("segment_id", "doc_id", "site_key", (F.coalesce("segment_index", F.lit(-1)) == 0).alias("first"), "raw_text")
    return rows


def text_parts(documents: DataFrame) -> DataFrame:
    """documents (doc_id, site_key, text) -> their parts between heading lines in the shape of segments, with negative ids;
    headings are left out, and a document without text is one part without text."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?m)^##? .*$\n?", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = documents.where("doc_id is not null").select("doc_id", "site_key", F.posexplode_outer(parts).alias("i", "raw_text")).withColumn("segment_index", F.coalesce("i", F.lit(0)))
    return rows.select((-F.col("doc_id") * 1_000_000 - F.col("segment_index") - 1).alias("segment_id"), "doc_id", "segment_index", "site_key", "raw_text")


def furniture_lines(segments: DataFrame, bodies: DataFrame, how: Cleaning = Cleaning(), others: DataFrame | None = None) -> DataFrame:
    """segments (segment_id, doc_id, segment_index, site_key, raw_text), bodies (doc_id, body) -> the lines that are
    furniture (segment_id, line_no), counted from 0 at line feeds; blank lines are neither.

    Segments delivered twice count once. Null texts have no lines; a null site is a host of its own. Without bodies
    every score is 0 and nothing is furniture. ``others``, of the shape of segments, are judged by the same model and
    verdicts without a vote in them.
    """
    rows = _prepared(segments)
    model = Model.fit(labelled(rows, bodies, how), how.epochs)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, out = array(batch, "segment_id"), []
        texts, sites, first = (column(batch, c) for c in ("raw_text", "site_key", "first"))
        for a, b in chunks(texts):
            lines = read(texts[a:b], sites[a:b], first[a:b])
            out.append((a + lines.text, lines.line_no, lines.path, lines.place, lines.scores(model.weights).astype(np.float32)))
        at, line_no, path, place, scores = (np.concatenate(x) for x in zip(*out))
        taken = lambda c: batch.column(batch.schema.get_field_index(c)).take(pa.array(at))
        return record(segment_id=ids[at], doc_id=taken("doc_id"), site_key=taken("site_key"), line_no=line_no, path=path, place=place, score=scores)

    shape_ = "segment_id long, doc_id long, site_key string, line_no int, path long, place long, score float"
    scored_ = lambda x: stage(map_batches(x.where("raw_text is not null"), score, shape_))
    scored = scored_(rows)
    # a score counts within bounds, so that no single page outvotes the others
    bounded = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("score").cast("double")))

    def verdicts(way: str) -> DataFrame:
        pages = scored.groupBy("site_key", way, "doc_id").agg(F.avg(bounded).alias("score"))
        voted = pages.groupBy("site_key", way).agg(F.avg("score").alias("verdict"), F.count("*").alias("n_pages")).where(F.col("n_pages") >= how.least_pages)
        return small_side(stage(voted.select(F.col("site_key").alias(f"{way}_host"), F.col(way).alias(f"{way}_way"), F.col("verdict").alias(f"{way}_verdict"))))

    judged = scored if others is None else scored.union(scored_(_prepared(others)))
    for way in ("path", "place"):
        judged = judged.join(verdicts(way), F.col("site_key").eqNullSafe(F.col(f"{way}_host")) & (F.col(way) == F.col(f"{way}_way")), "left")
    alone = bounded + how.weight * F.coalesce("place_verdict", F.lit(0.0))
    return judged.where(F.coalesce("path_verdict", alone) > 0).select("segment_id", "line_no").distinct()


def main_bodies(segments: DataFrame, furniture: DataFrame) -> DataFrame:
    """segments (segment_id, doc_id, segment_index, raw_text) and furniture (segment_id, line_no) -> (doc_id, body): the
    rest of each document's segments in order, joined by a blank line."""
    drop = furniture.groupBy("segment_id").agg(F.collect_set("line_no").alias("drop"))
    one = segments.where("segment_id is not null and doc_id is not null").groupBy("segment_id").agg(F.max("doc_id").alias("doc_id"), F.max("segment_index").alias("segment_index"), F.max("raw_text").alias("raw_text"))
    lines = F.split(F.coalesce("raw_text", F.lit("")), "\n", -1)
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    parts = one.join(drop, "segment_id", "left").select("doc_id", F.struct("segment_index", "segment_id", text.alias("text")).alias("part"))
    ordered = F.array_sort(F.collect_list("part"))
    return parts.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("body"))
