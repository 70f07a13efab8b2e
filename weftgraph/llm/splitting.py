"""Splitting oversized texts at natural boundaries: token offsets, sorted boundaries, binary search.

The token count is that of `weftgraph.functions.text.token_count`: each ideograph is one, what remains is split at
white space.  A text's token offsets are the prefix sums; paragraph, line and sentence ends are sorted arrays of
token numbers.  A piece ends at the last boundary under the limit (the strongest kind that leaves the piece at
least half full, else the last of any kind, else a hard cut), and the next one steps back by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import token_count
from weftgraph.llm.arrow import array, column, map_batches, record

_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\s㐀-䶿一-鿿]+")
#: The ends of paragraphs, of lines and of sentences, strongest first.
_ENDS = (re.compile(r"\n[^\S\n]*\n"), re.compile(r"\n"), re.compile(r"[.!?]+[\"')\]]*(?=\s)|[。！？；]+[”’」』）]*"))


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (first token, end token, first character, end character) of at most ``limit`` tokens; consecutive ones
    share ``overlap`` tokens. The characters from one piece's first beyond the previous piece's end, put together,
    are the text."""
    starts, ends = [], []
    for m in _TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    if n <= limit:
        return [(0, n, 0, len(text))]
    # a boundary at character c stands after as many tokens as end at or before c
    kinds = [sorted({bisect_right(ends, m.end()) for m in pattern.finditer(text)}) for pattern in _ENDS]
    every = sorted(set().union(*kinds))
    pieces, at = [], 0
    while True:
        if n - at <= limit:
            end = n
        else:
            end = _last(kinds, every, at + overlap, at + limit, at + limit // 2)
        pieces.append((at, end, starts[at] if at else 0, starts[end] if end < n else len(text)))
        if end == n:
            return pieces
        at = end - overlap


def _last(kinds: list[list[int]], every: list[int], above: int, most: int, good: int) -> int:
    for boundaries in kinds:
        i = bisect_right(boundaries, most)
        if i and boundaries[i - 1] >= max(good, above + 1):
            return boundaries[i - 1]
    i = bisect_right(every, most)
    return every[i - 1] if i and every[i - 1] > above else most


def pieces(segments: DataFrame, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """segments (segment_id, doc_id, segment_index, raw_text) -> one row per piece: (segment_id, doc_id, segment_index,
    piece_no, n_pieces, n_tokens, first_token, text, chunk_no). chunk_no numbers a document's pieces in the order of
    segment_index.

    Only texts over the limit go through Python. Segments delivered twice count once; null ids are left out; a null
    or empty text is one piece of no tokens. A segment with a null document is numbered by itself.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and below half the limit")
    rows = segments.where("segment_id is not null").select("segment_id", "doc_id", "segment_index", F.coalesce("raw_text", F.lit("")).alias("raw_text")).dropDuplicates(["segment_id"])
    # no text has more tokens than characters, so most are never counted here
    rows = rows.withColumn("n_tokens", F.when(F.length("raw_text") > limit, token_count(F.col("raw_text"))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for s, text in zip(array(batch, "segment_id"), column(batch, "raw_text")):
            cut = split_points(text, limit, overlap)
            out += [(int(s), i, len(cut), b - a, a, text[x:y]) for i, (a, b, x, y) in enumerate(cut)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return record(**{k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(("segment_id", "piece_no", "n_pieces", "n_tokens", "first_token", "text"), kinds))})

    shape = "segment_id long, piece_no int, n_pieces int, n_tokens int, first_token int, text string"
    over = F.coalesce(F.col("n_tokens") > limit, F.lit(False))
    large = rows.where(over)
    cut = map_batches(large.select("segment_id", "raw_text"), work, shape).join(large.select("segment_id", "doc_id", "segment_index"), "segment_id")
    small = rows.where(~over).select("segment_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.coalesce("n_tokens", token_count(F.col("raw_text"))).alias("n_tokens"), F.lit(0).alias("first_token"), F.col("raw_text").alias("text"), "doc_id", "segment_index")
    # however many segments have no document, they make no common window
    alone = F.when(F.col("doc_id").isNull(), F.col("segment_id"))
    order = Window.partitionBy("doc_id", alone).orderBy(F.col("segment_index").asc_nulls_last(), "segment_id", "piece_no")
    every = cut.unionByName(small).withColumn("chunk_no", F.row_number().over(order) - 1)
    return every.select("segment_id", "doc_id", "segment_index", "piece_no", "n_pieces", "n_tokens", "first_token", "text", "chunk_no")


def oversized(segments: DataFrame, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """The ids of the segments that `pieces` cuts, found by cutting them."""
    rows = segments.where("segment_id is not null and raw_text is not null").where(F.length("raw_text") > limit).where(token_count(F.col("raw_text")) > limit)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(segment_id=array(batch, "segment_id"), n_pieces=pa.array([len(split_points(t, limit, overlap)) for t in column(batch, "raw_text")], pa.int32()))

    return map_batches(rows.select("segment_id", "raw_text"), work, "segment_id long, n_pieces int").where("n_pieces > 1").select("segment_id").distinct()
