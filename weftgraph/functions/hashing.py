"""Digests and SimHash."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import simhash_tokens


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): the signed 64-bit SimHash over MD5 of every token; 0 for a text without tokens.

    Tokens are exploded and counted first, so a token is hashed once per text however often it occurs; the 64 bit
    sums are plain aggregates with partial sums on the map side.
    """
    tokens = df.select(key, F.explode_outer(simhash_tokens(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    counted = tokens.groupBy(key, "t").agg(F.count("t").alias("n"))
    # the low 64 bits of the digest are its last 16 hex digits, in two halves that fit a long
    digest = F.md5(F.col("t").cast("binary"))
    halves = counted.select(key, "n", F.conv(F.substring(digest, 17, 8), 16, 10).cast("long").alias("high"), F.conv(F.substring(digest, 25, 8), 16, 10).cast("long").alias("low"))
    vote = lambda half, i: F.sum(F.when(F.getbit(half, F.lit(i)) == 1, F.col("n")).otherwise(-F.col("n")))
    votes = halves.groupBy(key).agg(*[vote("low" if i < 32 else "high", i % 32).alias(f"b{i}") for i in range(64)])
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return votes.select(key, bits.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(df: DataFrame, key: str, print_: str, most: int = 3) -> DataFrame:
    """(a, b, distance) with a < b of prints within ``most`` bits: of most + 2 blocks at least two are equal, so only rows
    that share two blocks are joined. Two blocks are about 2 * 64 / (most + 2) bits (26 for 3), so that unlike rows meet
    rarely in a large collection."""
    blocks = most + 2
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned(F.col(print_), edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1).cast("long"))
    keys = F.array(*[F.shiftleft(part(i), edge[j + 1] - edge[j]).bitwiseOR(part(j)) for i, j in combinations(range(blocks), 2)])
    rows = df.where(F.col(print_).isNotNull()).select(F.col(key).alias("k"), F.col(print_).alias("p"), F.posexplode(keys).alias("block", "value"))
    left, right = rows.toDF("a", "pa", "block", "value"), rows.toDF("b", "pb", "block", "value")
    near = left.join(right, ["block", "value"]).where("a < b").select("a", "b", hamming(F.col("pa"), F.col("pb")).alias("distance"))
    return near.where(F.col("distance") <= most).distinct()
