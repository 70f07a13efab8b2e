"""The most similar vectors of every vector: all of them by blocks, or most of them by multiprobe p-stable hashing.

`nearest_pairs` compares every vector of a field with every other, block by block: products of matrices in single
precision with an allowance for their rounding, then exact cosines of what may be near enough. Nothing is left out; the
time grows with the square of the number of vectors. `similar_pairs` is the way whose time grows with the number of
vectors, and which leaves out what its tables do not bring together:

Vectors are scaled to unit length, so that the cosine is a function of the Euclidean distance.  Each of ``tables``
tables hashes a vector to the cells of ``functions`` random projections of width ``width``; a vector is stored in
its own bucket of each table and visits, besides it, the ``probes`` buckets next to it that hold a neighbour with
the greatest estimated probability: the perturbations of the expected-score sequence over the projections sorted by
their distance from a cell border.  The pairs that meet in some bucket, each once, are thinned by 128 random signs
(as far as these can tell them to be below the least cosine) and the rest is ranked by exact cosine.  A vector's best
are then joined with their own best, which finds most of what no table brought together: near vectors nearly always
have a near one in common.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.llm.shingles import mix
from weftgraph.sources import small_side, stage

_U = np.uint64
#: Random signs of a vector's sketch.
SIGNS = 128
#: Bits of a bucket key that are kept (they are what the shuffle is made of).
KEY_BITS = 48
#: Bytes of the vectors of one block, and of all blocks that a task has begun.
BLOCK_BYTES, BEGUN_BYTES = 2 << 20, 64 << 20
#: Rows and columns of one product of matrices, and pairs whose exact cosines are computed at a time.
PRODUCT, EXACT_PAIRS = (512, 4096), 50_000


@dataclass(frozen=True)
class Probing:
    """Parameters of the index (`planned` derives the number of projections from that of vectors), and of its refinement:
    ``rounds`` times the ``listed`` best of every vector are joined with their own best."""

    tables: int = 18
    functions: int = 24
    width: float = 2.3
    probes: int = 6
    sign_slack: float = 4.5
    rounds: int = 1
    listed: int = 8
    seed: int = 71

    def most_signs(self, least_cosine: float) -> int:
        """Signs, of SIGNS, in which a pair of that cosine may differ: the mean and ``sign_slack`` deviations."""
        share = float(np.arccos(np.clip(least_cosine, -1, 1)) / np.pi)
        return int(np.ceil(SIGNS * share + self.sign_slack * (SIGNS * share * (1 - share)) ** 0.5))


def planned(vectors: int) -> Probing:
    """Projections grow with the logarithm of the number of vectors, so that a vector meets about as many unlike ones
    whatever the number. What that takes from a table's recall the refinement gives back (see `similar_pairs`); more
    tables would be paid for by every vector in the shuffle."""
    return Probing(functions=max(8, round(24 * np.log(max(vectors, 2)) / np.log(300_000))))


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of ranks (0 .. 2*functions-1) in ascending order of expected score, without sets that
    move one projection both ways (rank j and rank 2*functions-1-j are the two borders of one projection)."""
    m = functions
    score = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    heap, out = [(score[0], (0,))], []
    while heap and len(out) < probes:
        s, a = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in a}) == len(a):
            out.append(a)
        last = a[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], a[:-1] + (last + 1,)))
            heapq.heappush(heap, (s + score[last + 1], a + (last + 1,)))
    return out


def bucket_keys(unit: np.ndarray, how: Probing) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (rows x tables) and probed keys (rows x tables x probes) of unit vectors, as int64."""
    rows, size = unit.shape
    order = np.random.default_rng(how.seed)
    sets = perturbations(how.functions, how.probes)
    own = np.empty((rows, how.tables), np.int64)
    probed = np.empty((rows, how.tables, len(sets)), np.int64)
    at = np.arange(rows)[:, None]
    for t in range(how.tables):
        lines, shift = order.standard_normal((size, how.functions)), order.uniform(0, how.width, how.functions)
        weights = order.integers(1, np.iinfo(np.int64).max, how.functions, dtype=np.int64).view(_U) | _U(1)
        place = (unit @ lines + shift) / how.width
        cell = np.floor(place)
        gap = place - cell
        terms = cell.astype(np.int64).view(_U) * weights
        base = terms.sum(axis=1, dtype=_U) + _U(t)
        own[:, t] = mix(base).view(np.int64)
        borders = np.concatenate([gap, 1 - gap], axis=1)
        ranked = np.argsort(borders, axis=1)
        # moving projection i down subtracts its weight, moving it up adds it
        step = np.concatenate([_U(0) - weights, weights])[ranked]
        for p, ranks in enumerate(sets):
            moved = step[at, np.array(ranks)[None, :]].sum(axis=1, dtype=_U)
            probed[:, t, p] = mix(base + moved).view(np.int64)
    drop = _U(64 - KEY_BITS)
    return (own.view(_U) >> drop).view(np.int64), (probed.view(_U) >> drop).view(np.int64)


def signs(unit: np.ndarray, how: Probing) -> np.ndarray:
    """SIGNS random signs of each vector as two int64."""
    lines = np.random.default_rng(how.seed + 1).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ lines > 0, axis=1).view(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lengths(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.diff(_column(batch, name).offsets.to_numpy())


def _unit(batch: pa.RecordBatch, name: str) -> np.ndarray:
    x = _column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(batch: pa.RecordBatch, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length with their vectors scaled to unit length."""
    sizes, out = _lengths(batch, name), []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, _unit(batch if len(rows) == batch.num_rows else batch.take(pa.array(rows)), name)))
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(field, id, vec) without null ids, null, empty and all-zero vectors, and vectors with a null or not finite
    entry; each (field, id) once."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where("id is not null and vec is not null").where(~bad & F.exists("vec", lambda x: x != 0)).dropDuplicates(["field", "id"])


def _plain(vectors: DataFrame) -> DataFrame:
    return unit_vectors(vectors).select("field", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows with vec -> the same, staged, with the two hashes p and q that equal vectors share."""
    return stage(rows.withColumn("p", F.xxhash64("vec")).withColumn("q", F.xxhash64(F.lit(3), F.reverse("vec"))))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows told apart -> members (field, head, id), equal vectors under their smallest id; and the rows of the heads."""
    # copies by a partial minimum and a join of narrow rows: a vector with very many copies is no task of its own
    ids = rows.select("field", "p", "q", "id")
    members = stage(ids.join(ids.groupBy("field", "p", "q").agg(F.min("id").alias("head")), ["field", "p", "q"]).select("field", "head", "id"))
    copies = stage(members.where("id <> head").select("field", "id"))
    return members, rows.join(small_side(copies), ["field", "id"], "left_anti")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, id, vec) -> blocks (field, size, first, ids, vecs) of vectors of one field and length."""
    begun: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(key: tuple[str, int]) -> pa.RecordBatch:
        ids, vecs = (np.concatenate(x) for x in zip(*begun.pop(key)))
        return record(field=[key[0]], size=pa.array([key[1]], pa.int32()), first=pa.array([ids[0]], pa.int64()), ids=[ids.astype("<i8").tobytes()], vecs=[vecs.astype("<f4").tobytes()])

    for batch in batches:
        fields, ids, sizes = np.array(column(batch, "field"), object), array(batch, "id"), _lengths(batch, "vec")
        for key in dict.fromkeys(zip(fields.tolist(), sizes.tolist())):
            rows, most = np.flatnonzero((fields == key[0]) & (sizes == key[1])), max(1, BLOCK_BYTES // (4 * key[1]))
            while len(rows):
                own = begun.setdefault(key, [])
                now, rows = np.split(rows, [most - sum(len(x) for x, _ in own)])
                own.append((ids[now], _column(batch.take(pa.array(now)), "vec").flatten().to_numpy(zero_copy_only=False).reshape(len(now), -1)))
                if sum(len(x) for x, _ in own) == most:
                    yield block(key)
        if sum(x.nbytes for own in begun.values() for _, x in own) > BEGUN_BYTES:
            yield from [block(key) for key in list(begun)]
    yield from [block(key) for key in list(begun)]


def _unit_rows(block: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(block, "<f4").reshape(-1, size).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_rows(a: np.ndarray, b: np.ndarray | None, least_cosine: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of ``a``, j of ``b`` (without it: rows i < j of ``a``), unit vectors, and their exact cosine where it is at
    least ``least_cosine``. Of a product with very many of them only what may be among the k best of its row or column."""
    same = b is None
    b = a if same else b
    left, right = a.astype(np.float32), b.astype(np.float32)
    # a sum of ``size`` products in single precision is off by less than that, in whatever order it is taken
    slack = np.float32((a.shape[1] + 4) * np.finfo(np.float32).eps)
    least, parts, room = np.float32(least_cosine) - slack, [], np.empty(PRODUCT[0] * PRODUCT[1], np.float32)
    for r in range(0, len(a), PRODUCT[0]):
        for c in range(r if same else 0, len(b), PRODUCT[1]):
            x, y = left[r : r + PRODUCT[0]], right[c : c + PRODUCT[1]]
            cosine = np.matmul(x, y.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
            if same and c < r + len(x):
                cosine[np.arange(r, r + len(x))[:, None] >= np.arange(c, c + len(y))] = -2
            rows = np.flatnonzero(cosine.max(axis=1) >= least)
            if not len(rows):
                continue
            cosine = cosine[rows]
            near = cosine >= least
            if np.count_nonzero(near) > EXACT_PAIRS:
                of_row, of_column = (np.partition(cosine, max(0, cosine.shape[x] - k), axis=x).take([max(0, cosine.shape[x] - k)], axis=x) for x in (1, 0))
                near &= (cosine >= of_row - 2 * slack) | (cosine >= of_column - 2 * slack)
            i, j = np.nonzero(near)
            for at in range(0, len(i), EXACT_PAIRS):
                x, y = rows[i[at : at + EXACT_PAIRS]] + r, j[at : at + EXACT_PAIRS] + c
                exact = (a[x] * b[y]).sum(axis=1)
                kept = exact >= least_cosine
                parts.append((x[kept], y[kept], exact[kept]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def nearest_pairs(vectors: DataFrame, least_cosine: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(field, id, vec) -> members as in `similar_pairs`; and pairs (field, a, b, cosine) of heads with a cosine of at
    least ``least_cosine``, among them all that are one of the ``k`` best of either head. No such pair is left out.

    Every block of a field meets every other once, in a Cartesian product that reads the staged blocks and shuffles
    nothing; of the products with very many near pairs only each vector's best are kept.
    """
    members, heads = _classes(_told_apart(_plain(vectors)))
    blocks = stage(heads.select("field", "id", "vec").mapInArrow(_packed, "field string, size int, first long, ids binary, vecs binary"))
    side = lambda x: blocks.toDF(*[f"{c}_{x}" for c in blocks.columns])
    # said as inequalities: as equalities they would shuffle every block to the few keys there are
    like = [F.col(f"{c}_a") <= F.col(f"{c}_b") for c in ("field", "size", "first")] + [F.col(f"{c}_a") >= F.col(f"{c}_b") for c in ("field", "size")]
    met = side("a").hint("shuffle_replicate_nl").join(side("b"), reduce(and_, like))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for row in range(batch.num_rows):
            field, size, first_a, first_b, *packed = (_column(batch, c)[row].as_py() for c in ("field_a", "size_a", "first_a", "first_b", "ids_a", "ids_b", "vecs_a", "vecs_b"))
            ids_a, ids_b = (np.frombuffer(x, "<i8") for x in packed[:2])
            i, j, cosine = near_rows(_unit_rows(packed[2], size), None if first_a == first_b else _unit_rows(packed[3], size), least_cosine, k)
            parts.append((np.full(len(i), field, object), ids_a[i], ids_b[j], cosine))
        field, x, y, cosine = (np.concatenate(p) for p in zip(*parts))
        return record(field=pa.array(field, pa.string()), a=np.minimum(x, y), b=np.maximum(x, y), cosine=np.minimum(cosine, 1.0))

    return members, stage(map_batches(met, compare, "field string, a long, b long, cosine double"))


def similar_pairs(vectors: DataFrame, least_cosine: float, how: Probing | None = None) -> tuple[DataFrame, DataFrame]:
    """(field, id, vec) -> members (field, head, id): equal vectors under their smallest id; and pairs (field, a, b,
    cosine) of heads with a cosine of at least ``least_cosine``.

    Vectors of different lengths within a field never meet. Vectors that are multiples of each other have different
    heads and a cosine of 1. Without parameters the index is planned for the largest field.
    """
    signed = how or Probing()
    shape = "field string, id long, vec array<float>, sign_a long, sign_b long"

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, 2), np.int64)
        for rows, unit in _by_length(batch, "vec"):
            out[rows] = signs(unit, signed)
        return record(field=_column(batch, "field"), id=array(batch, "id"), vec=_column(batch, "vec"), sign_a=out[:, 0], sign_b=out[:, 1])

    rows = _told_apart(map_batches(_plain(vectors), sketch, shape))
    members, heads = _classes(rows)
    if how is None:
        largest = members.where("id = head").groupBy("field").count().agg(F.max("count")).first()[0]
        how = planned(largest or 1)
    heads = heads.select("field", "id", "vec", "sign_a", "sign_b")

    def work(probing: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = array(batch, "id"), []
            for rows, unit in _by_length(batch, "vec"):
                own, probed = bucket_keys(unit, how)
                keys = probed.reshape(len(rows), -1) if probing else own
                out.append((np.repeat(rows, keys.shape[1]), keys.ravel()))
            at, keys = (np.concatenate(x) for x in zip(*out))
            return record(field=_column(batch, "field").take(pa.array(at)), key=keys, id=ids[at])

        return run

    of_heads = heads.select("field", "id", "vec")
    own, probed = (map_batches(of_heads, work(x), "field string, key long, id long") for x in (False, True))
    met = own.toDF("field", "key", "x").join(own.union(probed).toDF("field", "key", "y").hint("merge"), ["field", "key"]).where("x <> y")
    met = met.select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    def rank(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, lengths_b = [], _lengths(batch, "v_b")
        for rows, unit in _by_length(batch, "v_a"):
            like = lengths_b[rows] == unit.shape[1]
            rows, unit = rows[like], unit[like]
            if len(rows):
                other = _unit(batch.take(pa.array(rows)), "v_b")
                cosine = (unit * other).sum(axis=1)
                parts.append((rows[cosine >= least_cosine], cosine[cosine >= least_cosine]))
        if not parts:
            return None
        at, cosine = (np.concatenate(x) for x in zip(*parts))
        part = batch.take(pa.array(at))
        return record(field=_column(part, "field"), a=array(part, "a"), b=array(part, "b"), cosine=np.minimum(cosine, 1.0))

    def scored(met: DataFrame) -> DataFrame:
        """(field, a, b), each once, with the exact cosine where it is large enough; staged."""
        sign = lambda x: heads.select("field", F.col("id").alias(x), F.col("sign_a").alias(f"s_{x}"), F.col("sign_b").alias(f"t_{x}"))
        near = met.join(sign("a"), ["field", "a"]).join(sign("b"), ["field", "b"])
        near = near.where(F.bit_count(F.col("s_a").bitwiseXOR(F.col("s_b"))) + F.bit_count(F.col("t_a").bitwiseXOR(F.col("t_b"))) <= how.most_signs(least_cosine))
        pairs = stage(near.select("field", "a", "b"))
        needed = stage(pairs.select("field", F.col("a").alias("id")).union(pairs.select("field", "b")).distinct())
        used = of_heads.join(small_side(needed), ["field", "id"], "left_semi")
        side = lambda x: used.select("field", F.col("id").alias(x), F.col("vec").alias(f"v_{x}"))
        return stage(map_batches(pairs.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"]), rank, "field string, a long, b long, cosine double"))

    found = scored(met)
    for _ in range(how.rounds):
        both = found.select("field", "a", "b", "cosine").union(found.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
        best = Window.partitionBy("field", "a").orderBy(F.desc("cosine"), "b")
        listed = stage(both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= how.listed).select("field", F.col("a").alias("of"), F.col("b").alias("near")))
        # the best of one's best, and two that stand on one list: at most listed**2 a vector, however hot
        further = listed.select("field", F.col("of").alias("x"), F.col("near").alias("of")).join(listed, ["field", "of"]).select("field", "x", F.col("near").alias("y"))
        beside = listed.select("field", "of", F.col("near").alias("x")).join(listed, ["field", "of"]).select("field", "x", F.col("near").alias("y"))
        more = further.union(beside).where("x <> y").select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = found.unionByName(scored(more.join(found, ["field", "a", "b"], "left_anti")))
    return members, found


def most_similar(members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(field, id, neighbour, cosine, rank): the k other vectors most similar to each, ties by the smaller id.

    A vector's copies come first (cosine 1). Of every class only the k + 1 smallest ids can be among anyone's k, so no
    more are ever joined: a vector with a million copies costs k + 1 rows a neighbour.
    """
    order = Window.partitionBy("field", "head").orderBy("id")
    first = stage(members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("field", F.col("head").alias("of"), F.col("id").alias("neighbour")))
    # classes first: how near each class is to each, itself included; then the k nearest members of the near classes
    near = pairs.select("field", F.col("a").alias("head"), F.col("b").alias("of"), "cosine").union(pairs.select("field", F.col("b").alias("head"), F.col("a").alias("of"), "cosine"))
    own = members.select("field", "head").distinct().select("field", "head", F.col("head").alias("of"), F.lit(1.0).alias("cosine"))
    ranked = near.union(own).join(first, ["field", "of"])
    best = ranked.withColumn("n", F.row_number().over(Window.partitionBy("field", "head").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1)
    pairs_ = members.join(best.select("field", "head", "neighbour", "cosine"), ["field", "head"]).where("id <> neighbour")
    return pairs_.withColumn("rank", F.row_number().over(Window.partitionBy("field", "id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k).select("field", "id", "neighbour", "cosine", "rank")
