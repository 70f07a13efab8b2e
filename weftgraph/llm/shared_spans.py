"""Long exact spans shared between texts: compact windows of several min-hashes, interval joins, exact comparison.

The units are overlapping grams of ``gram`` characters (a common span may begin and end inside a word).  A span
of ``span`` characters holds ``span - gram + 1`` grams; for each of ``hashes`` hash functions the Cartesian tree over
the grams' hashes splits a text into compact windows (first, smallest, last), each standing for all subsequences
whose smallest hash is the node's.  Only nodes at least as wide as a span count, about
``2 * length / (span - gram + 1)`` of them.  Windows of two texts with the same hash are joined as intervals: laid over
each other at their smallest gram they must overlap in a whole span.  A common span passes this under every hash
function, so a pair must be met by all of them, and no recall is lost.  The texts of the remaining pairs are compared
character by character within the windows that met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.llm.shingles import CHUNK_CHARS, chunks, code_points, mix, powers
from weftgraph.sources import small_side, stage

_U = np.uint64
#: Characters of a gram: two texts that share so much elsewhere than in a common span are joined in vain.
GRAM = 150
#: Hash functions that must agree on a pair.
HASHES = 2


def _totals(chars: np.ndarray) -> np.ndarray:
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * powers(len(chars) + 1)[0][:-1], out=total[1:])
    return total


def _grams(total: np.ndarray, size: int) -> np.ndarray:
    n = len(total) - size
    return mix((total[size:] - total[:-size]) * powers(len(total))[1][:n]) if n > 0 else np.zeros(0, _U)


def compact_windows(hashes: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The nodes (first, smallest, last) of the Cartesian tree over ``hashes`` whose range has at least ``width``
    entries. Of equal hashes the first is the root; where that makes a deep tree (a text of one repeated gram), the
    middle one."""
    for middle in (False, True):
        nodes, todo, most = [], [(0, len(hashes) - 1)], 64 + 8 * len(hashes) // max(width, 1)
        while todo and (middle or len(nodes) < most):
            a, b = todo.pop()
            if b - a + 1 < width:
                continue
            part = hashes[a : b + 1]
            c = a + int(part.argmin())
            if middle:
                at = np.flatnonzero(part == hashes[c])
                c = a + int(at[len(at) // 2])
            nodes.append((a, c, b))
            todo += [(a, c - 1), (c + 1, b)]
        if not todo:
            break
    return nodes


def window_rows(texts: DataFrame, span: int, gram: int, hashes: int = HASHES) -> DataFrame:
    """(class_id, text) -> (key, class_id, fn, first, at, last): the compact windows of texts of at least ``span``
    characters under each hash function ``fn``. A hash that stands at several places of one text (a text that repeats
    itself) is one row with a null ``at``: it says nothing about where the texts would lie on each other."""
    width = span - gram + 1

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts_, out = array(batch, "class_id"), column(batch, "text"), []
        for a, b in chunks(texts_):
            chars, starts = code_points([t or "" for t in texts_[a:b]])
            grams = _grams(_totals(chars), gram)
            for fn in range(hashes):
                values = mix(grams + _U(fn)) if fn else grams
                for i in range(b - a):
                    n = starts[i + 1] - starts[i] - 1
                    if n >= span:
                        own = values[starts[i] : starts[i] + n - gram + 1]
                        rows, ordered = np.array(compact_windows(own, width), np.int32).reshape(-1, 3), np.sort(own)
                        unique, at = np.unique(own[rows[:, 1]], return_index=True)
                        several = np.searchsorted(ordered, unique, "right") - np.searchsorted(ordered, unique) > 1
                        rows = np.where(several[:, None], -1, rows[at])
                        out.append((unique, np.full(len(unique), ids[a + i]), np.full(len(unique), fn, np.int8), rows))
        if not out:
            return None
        key, owner, fn, rows = (np.concatenate(x) for x in zip(*out))
        place = lambda k: pa.array(rows[:, k], mask=rows[:, 1] < 0)
        return record(key=key.view(np.int64), class_id=owner, fn=fn, first=place(0), at=place(1), last=place(2))

    return map_batches(texts, work, "key long, class_id long, fn byte, first int, at int, last int")


def interval_pairs(windows: DataFrame, span: int, gram: int, hashes: int = HASHES) -> DataFrame:
    """Windows of `window_rows` -> (a, b, whole, places): the pairs, a < b, that every hash function meets in windows
    which overlap in a span when laid over each other. ``places`` (shift, first, end) are the stretches of b's
    characters, and how far b's lie behind a's, where the first function met; ``whole`` marks pairs that also met
    in a window without a place and are compared as a whole."""
    side = lambda x: windows.select("key", "fn", *[F.col(c).alias(f"{c}_{x}") for c in ("class_id", "first", "at", "last")])
    before = F.least(F.col("at_a") - F.col("first_a"), F.col("at_b") - F.col("first_b"))
    after = F.least(F.col("last_a") - F.col("at_a"), F.col("last_b") - F.col("at_b"))
    met = side("a").join(side("b").hint("merge"), ["key", "fn"]).where("class_id_a < class_id_b")
    placed = F.col("at_a").isNotNull() & F.col("at_b").isNotNull()
    met = met.where(~placed | (before + after >= span - gram))
    place = F.struct((F.col("at_b") - F.col("at_a")).alias("shift"), (F.col("at_b") - before).alias("first"), (F.col("at_b") + after + gram).alias("end"))
    first = F.col("fn") == 0
    rows = met.groupBy(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).agg(
        F.bit_or(F.expr("shiftleft(1, fn)")).alias("fns"), F.max(first & ~placed).alias("whole"), F.collect_set(F.when(first & placed, place)).alias("places")
    )
    return rows.where(F.col("fns") == (1 << hashes) - 1).select("a", "b", "whole", "places")


def _runs(here: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], here.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def common_spans(a: str, b: str, span: int) -> tuple[list, list]:
    """The stretches [first, end) of a and of b that lie in a common span of at least ``span`` characters, wherever."""
    if len(a) < span or len(b) < span:
        return [], []
    chars, starts = code_points([a, b])
    hashes = _grams(_totals(chars), span)
    ha, hb = hashes[: len(a) - span + 1], hashes[starts[1] : starts[1] + len(b) - span + 1]
    common = np.intersect1d(ha, hb)
    if not len(common):
        return [], []
    out = []
    for h in (ha, hb):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        runs = _runs(common[at] == h)
        out.append([(int(x), int(y) + span - 1) for x, y in runs])
    return out[0], out[1]


def placed_spans(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int, int]], span: int) -> tuple[list, list]:
    """The same of code points a and b where b lies ``shift`` behind a, within the stretches [first, end) of b."""
    found_a, found_b = [], []
    for shift, first, end in places:
        runs = _runs(a[first - shift : end - shift] == b[first:end])
        for x, y in runs[runs[:, 1] - runs[:, 0] >= span] + first:
            found_a.append((int(x) - shift, int(y) - shift))
            found_b.append((int(x), int(y)))
    return _united(found_a), _united(found_b)


def span_pairs(documents: DataFrame, span: int = 300, gram: int = GRAM, hashes: int = HASHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (id, text) -> members (class_id, id), pairs (a, b, spans_a, spans_b) of classes that share a span of
    at least ``span`` characters, and classes (class_id, n, copies).

    Documents with the same text are one class, named by the smallest id. Null ids are left out; null texts count as
    empty; texts shorter than ``span`` are members of their class but have no pair.
    """
    if not 0 < gram <= span or not 0 < hashes < 32:
        raise ValueError("gram must be within 1..span, hashes within 1..31")
    plain = documents.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id is not null")
    prints = plain.select("id", F.xxhash64("text").alias("p"), F.xxhash64(F.lit(7), F.reverse("text")).alias("q"), F.length("text").cast("long").alias("n")).distinct()
    prints = stage(prints)
    heads = prints.groupBy("p", "q", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    members = stage(prints.join(heads, ["p", "q", "n"]).select("class_id", "id", "n", "copies"))
    copies = stage(members.where("id <> class_id").select("id"))
    unique = plain.join(small_side(copies), "id", "left_anti").select(F.col("id").alias("class_id"), "text")
    pairs = stage(interval_pairs(window_rows(unique, span, gram, hashes), span, gram, hashes))
    needed = stage(pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct())
    used = unique.join(small_side(needed), "class_id", "left_semi")
    side = lambda x: used.select(F.col("class_id").alias(x), F.col("text").alias(f"t_{x}"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = (array(batch, "a"), array(batch, "b")), []
        for i, (x, y, whole, places) in enumerate(zip(*(column(batch, c) for c in ("t_a", "t_b", "whole", "places")))):
            if whole:
                sa, sb = common_spans(x, y, span)
            else:
                points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y)]
                sa, sb = placed_spans(*points, [(p["shift"], p["first"], p["end"]) for p in places], span)
            if sa:
                rows.append((int(ids[0][i]), int(ids[1][i]), sa, sb))
        spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        as_structs = lambda k: pa.array([[{"first": f, "end": e} for f, e in r[k]] for r in rows], spans)
        return record(a=pa.array([r[0] for r in rows], pa.int64()), b=pa.array([r[1] for r in rows], pa.int64()), spans_a=as_structs(2), spans_b=as_structs(3))

    kind = "array<struct<first:int,end:int>>"
    found = stage(map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), work, f"a long, b long, spans_a {kind}, spans_b {kind}"))
    return members.select("class_id", "id"), found, members.where("id = class_id").select("class_id", "n", "copies")


def expanded_pairs(members: DataFrame, pairs: DataFrame, classes: DataFrame, span: int = 300) -> DataFrame:
    """Every pair (id_a, id_b), id_a < id_b, of documents with a common span, copies included."""
    left = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    between = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    long_ = classes.where((F.col("n") >= span) & (F.col("copies") > 1)).select(F.col("class_id").alias("a"))
    inside = left.join(long_, "a", "left_semi").join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return between.union(inside)


def shared_share(members: DataFrame, pairs: DataFrame, classes: DataFrame, span: int = 300) -> DataFrame:
    """One row per document: (id, n_chars, shared_chars, share, n_partners). A document of at least ``span`` characters
    that has a copy is shared as a whole; otherwise the union of its common spans counts. n_partners is the number
    of other texts (classes) it shares a span with."""
    one = lambda x, s: pairs.select(F.col(x).alias("class_id"), F.explode(s).alias("s"))
    spans = one("a", "spans_a").union(one("b", "spans_b")).select("class_id", F.col("s.first").alias("first"), F.col("s.end").alias("end")).distinct()
    merged = spans.groupBy("class_id").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"))
    length = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc.sum + F.greatest(F.lit(0), x.end - F.greatest(x.first, acc.upto))).alias("sum"), F.greatest(acc.upto, x.end).alias("upto")),
        lambda acc: acc.sum,
    )
    partners = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_partners")).withColumnRenamed("a", "class_id")
    whole = (F.col("copies") > 1) & (F.col("n") >= span)
    shared = F.when(whole, F.col("n")).otherwise(F.coalesce("shared", F.lit(0)).cast("long"))
    return (
        members.join(classes, "class_id")
        .join(merged.select("class_id", length.alias("shared")), "class_id", "left")
        .join(partners, "class_id", "left")
        .select("id", F.col("n").alias("n_chars"), shared.alias("shared_chars"), F.when(F.col("n") > 0, F.round(shared / F.col("n"), 4)).otherwise(0.0).alias("share"), F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"))
    )
