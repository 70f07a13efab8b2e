"""Near-duplicate texts: HyperMinHash sketches, banding of compressed registers, corrected estimates, verification.

Plan: one pass over the texts makes a sketch of each; texts with the same set of shingles form a class (exact
copies cost one row from here on); the classes' band keys are joined with themselves, the pairs that share a band
are thinned by the collision-corrected estimate of their registers, and the rest is verified on the texts.  The
only wide shuffles are 16 bytes per class and band, the sketches, and the texts of the surviving pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import hyperminhash, shingles
from weftgraph.llm.arrow import array, column, fixed_bytes, map_batches, record
from weftgraph.sources import small_side, stage, staged_rows

_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """What counts as alike, and how candidates are found.

    A pair of similarity ``threshold`` shares none of ``bands`` bands of ``rows`` registers with a probability of
    about ``(1 - threshold**rows)**bands`` (0.0015 at 0.6 as set for TESTDATA.md's queries); an estimate from the
    registers may fall ``slack`` standard errors short of the threshold before the pair is dropped unverified.
    """

    threshold: float = 0.8
    words: int = 5
    min_tokens: int = 0
    passes: int = 16
    bands: int = 80
    rows: int = 5
    slack: float = 4.0

    @property
    def registers(self) -> int:
        return self.passes << hyperminhash.BUCKET_BITS

    @property
    def least_estimate(self) -> float:
        t = self.threshold
        return t - self.slack * (t * (1 - t) / self.registers) ** 0.5


def sketches(texts: DataFrame, how: Similarity, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text) -> (id, n_shingles, print_a, print_b, registers). The prints identify the set of shingles; integer
    columns named in ``carry`` come along.

    Rows with a null id, fewer than ``min_tokens`` tokens or no shingle are left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts_, out = array(batch, "id"), column(batch, "text"), []
        for a, b in shingles.chunks(texts_):
            value, starts, count = shingles.shingle_hashes(texts_[a:b], how.words)
            kept = np.flatnonzero((count >= how.min_tokens) & (np.diff(starts) > 0))
            if not len(kept):
                continue
            unique, at = shingles.distinct(value, starts)
            sums = np.zeros((2, len(unique) + 1), _U)
            np.cumsum(unique, out=sums[0, 1:])
            np.cumsum(shingles.mix(unique + _U(0x51ED270B)), out=sums[1, 1:])
            print_a, print_b = sums[:, at[1:]] - sums[:, at[:-1]]
            registers = hyperminhash.sketch(unique, at, how.passes)[kept]
            out.append((ids[a:b][kept], np.diff(at)[kept], print_a[kept], print_b[kept], registers, a + kept))
        if not out:
            return None
        ids, n, print_a, print_b, registers, rows = (np.concatenate(x) for x in zip(*out))
        more = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in carry}
        return record(id=ids.astype(np.int64), n_shingles=n.astype(np.int32), print_a=print_a.view(np.int64), print_b=print_b.view(np.int64), registers=fixed_bytes(registers), **more)

    shape = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(texts.where("id is not null"), work, "id long, n_shingles int, print_a long, print_b long, registers binary" + shape)


def classes(sketched: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Sketches (staged) -> members (class_id, id), each id once, and one row per class (class_id, n_shingles,
    registers); the class id is its smallest id. Classes are made ``within`` equal values of these columns, which both
    keep."""
    prints = [*within, "print_a", "print_b"]
    heads = sketched.groupBy(*prints).agg(F.min("id").alias("class_id"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
    members = sketched.select(*prints, "id").distinct().join(sketched.groupBy(*prints).agg(F.min("id").alias("class_id")), prints).select("class_id", "id", *within)
    return members, heads.select("class_id", "n_shingles", "registers", *within)


def band_rows(heads: DataFrame, how: Similarity) -> DataFrame:
    """One row (key, class_id) per class and band; the band's number is mixed into the key."""
    columns = hyperminhash.band_columns(how.registers, how.bands, how.rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        registers = np.frombuffer(b"".join(column(batch, "registers")), np.uint16).reshape(batch.num_rows, -1)
        keys = hyperminhash.band_keys(registers, columns)
        return record(key=keys.ravel(), class_id=np.repeat(array(batch, "class_id"), keys.shape[1]))

    return map_batches(heads.select("class_id", "registers"), work, "key long, class_id long")


def sharing_pairs(keyed: DataFrame) -> DataFrame:
    """(key, class_id) -> distinct pairs (a, b), a < b, of classes with a key in common: a sorted merge on the key,
    which adaptive execution splits where one key is hot."""
    left = keyed.select("key", F.col("class_id").alias("a"))
    right = keyed.select("key", F.col("class_id").alias("b"))
    return left.join(right.hint("merge"), "key").where("a < b").select("a", "b").distinct()


def estimated(pairs: DataFrame, heads: DataFrame, how: Similarity, heads_b: DataFrame | None = None) -> DataFrame:
    """The pairs whose corrected estimate reaches the threshold less the slack; ``heads_b`` are those of b where they
    are others."""
    side = lambda x, heads=heads: heads.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(column(batch, x)), np.uint16).reshape(batch.num_rows, -1) for x in ("r_a", "r_b"))
        keep = hyperminhash.estimate(ra, rb, array(batch, "n_a"), array(batch, "n_b")) >= how.least_estimate
        return record(a=array(batch, "a")[keep], b=array(batch, "b")[keep])

    return map_batches(pairs.join(side("a"), "a").join(side("b", heads if heads_b is None else heads_b), "b"), work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """(a, b) staged -> (a, b, similarity) of the pairs that reach the threshold on their texts."""
    needed = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    used = texts.join(small_side(needed), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    side = lambda x: used.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        j = shingles.pair_jaccard(column(batch, "t_a"), column(batch, "t_b"), how.words)
        keep = j >= how.threshold
        return record(a=array(batch, "a")[keep], b=array(batch, "b")[keep], similarity=j[keep])

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), work, "a long, b long, similarity double")


@dataclass(frozen=True)
class Found:
    """members (class_id, id): every text and its class of equal shingle sets; links (a, b, similarity): pairs of
    different classes that are alike."""

    members: DataFrame
    links: DataFrame


def near_duplicates(texts: DataFrame, id_col: str, text: Column | str, how: Similarity) -> Found:
    """The classes of equal texts in ``texts`` and the alike pairs between different classes.

    An id delivered more than once counts once (of differing texts under one id each is looked at, the greatest is
    verified). Null ids, null or empty texts and texts without a shingle take no part. Extra columns are ignored;
    an empty table gives empty results.
    """
    plain = texts.select(F.col(id_col).cast("long").alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    members, heads = classes(stage(sketches(plain, how)))
    members, heads = stage(members), stage(heads)
    pairs = stage(estimated(sharing_pairs(band_rows(heads, how)), heads, how))
    return Found(members, stage(verified(pairs, plain, how)))


def all_pairs(found: Found) -> DataFrame:
    """Every pair (a, b), a < b, of texts that are alike, copies included: as many rows as there are such pairs."""
    left = found.members.select(F.col("class_id").alias("a"), F.col("id").alias("id_a"))
    right = found.members.select(F.col("class_id").alias("b"), F.col("id").alias("id_b"))
    inside = left.join(right, (F.col("a") == F.col("b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    between = found.links.join(left, "a").join(right, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return inside.union(between)


def groups(found: Found) -> DataFrame:
    """One row per text: (id, class_id, group_id, n_links). The group is the connected component of the links (its
    smallest class), n_links the number of other classes the text's class is alike to."""
    from weftgraph.operators.graph import components

    both = found.links.select("a", "b").union(found.links.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n_links"))
    group = components(both.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return (
        found.members.join(degree.withColumnRenamed("a", "class_id"), "class_id", "left")
        .join(group.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
