"""Filling fixed-capacity containers: hierarchical residual packing.

Every document is sized with a public tokenizer; one above the capacity is cut into full containers and a rest.
Partitions pack their items best-fit in descending order and emit the containers that are nearly full; what they
leave underfull goes on as items of the next round, in partitions merged ``fan_in`` at a time, until one partition
is left or merging no longer helps.  No round gathers much more than ``partition_items`` items in a task: where so many
underfull containers are left that they don't fit one task, they are packed again in other company until a round
puts (almost) none of them together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.sources import stage, staged_rows


# Fixed value: the pattern that byte-level BPE vocabularies of this kind are split by before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each whole text; what looks like a special token is ordinary text."""
    encode = _encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """documents (id, text) -> (id, size): tokens of the whole text by the tokenizer (a file of base64 tokens and ranks); a null text has none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(id=array(batch, "id"), size=pa.array(count_tokens(column(batch, "text"), tokenizer), pa.int64()))

    return map_batches(documents.where("id is not null").select(F.col("id").cast("long").alias("id"), "text"), work, "id long, size long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the items of each bin: best fit, largest item first. The free space of the open bins is a bit set,
    so the tightest bin that takes an item is found without a search."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            space = size + ((fitting & -fitting).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        left = space - size
        if left or not size:
            free[left].append(b)
            mask |= 1 << left
    return bins


def _round(items: DataFrame, capacity: int, full: int, last: bool, number: int) -> DataFrame:
    """One round over the partitions of items (bin, size) -> (bin, size, into, total, closed). ``into`` is the new bin,
    named by the round, the smallest of its items and so unique; closed bins take part no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(array(b, "bin"), array(b, "size")) for b in batches if b.num_rows]
        if not parts:
            return
        names, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(names, kind="stable")  # the same whatever order the rows arrive in
        names, sizes = names[order], sizes[order]
        into, total = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        for members in best_fit(sizes, capacity):
            into[members], total[members] = names[members].min(), sizes[members].sum()
        closed = np.ones(len(names), bool) if last else total >= full
        for at in range(0, len(names), 10_000):
            s = slice(at, at + 10_000)
            yield record(bin=names[s], into=into[s], total=total[s], closed=closed[s])

    return items.mapInArrow(run, "bin long, into long, total long, closed boolean")


def pack(sizes: DataFrame, capacity: int = 2048, partition_items: int = 4_000, fan_in: int = 8, slack: float = 0.01) -> DataFrame:
    """sizes (id, size) -> (container, container_total, id, piece_no, first_token, n_tokens): every token of every item
    in exactly one container of at most ``capacity`` tokens; only items above the capacity are cut.

    A container with at most ``slack`` of its capacity unused is closed at once. Null and negative sizes count as 0;
    items of no tokens are assigned too (they take no space). Equal ids with different sizes are refused by counting
    the larger. The assignment depends on the rows only, not on their order or partitioning.
    """
    if capacity < 1 or fan_in < 2:
        raise ValueError("capacity must be at least 1 and fan_in at least 2")
    one = sizes.where("id is not null").groupBy("id").agg(F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    # full pieces are containers of their own; one rest a document, named by its id, is packed
    whole = F.when(F.col("size") > 0, F.floor((F.col("size") - 1) / capacity)).otherwise(0).cast("int")
    one = stage(one.withColumn("whole", whole))
    cut = one.where("whole > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no"))
    cut = cut.select(F.concat_ws("/", "id", "piece_no").alias("container"), F.lit(capacity).cast("long").alias("container_total"), "id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    first = F.col("whole").cast("long") * capacity
    pieces = one.select("id", F.col("whole").alias("piece_no"), first.alias("first_token"), (F.col("size") - first).alias("n_tokens"), F.col("id").alias("bin"))
    full = int(np.ceil(capacity * (1 - slack)))
    current = pieces.select("bin", F.col("n_tokens").alias("size"))
    count = staged_rows(one)
    partitions = max(1, -(-count // partition_items))
    number, assigned, out = 0, pieces, cut
    while True:
        last = partitions == 1
        spread = current.repartition(partitions, "bin") if number == 0 else current.repartition(partitions, F.xxhash64("bin", F.lit(number)))
        done = stage(_round(spread, capacity, full, last, number))
        step = assigned.join(done, "bin")
        out = out.union(step.where("closed").select(F.col("into").cast("string").alias("container"), F.col("total").alias("container_total"), "id", "piece_no", "first_token", "n_tokens"))
        if last:
            return out
        # the next round reads what is left from a table: no round is computed twice
        assigned = stage(step.where("not closed").select("id", "piece_no", "first_token", "n_tokens", F.col("into").alias("bin"), "total"))
        current = stage(assigned.groupBy("bin").agg(F.max("total").alias("size")))
        assigned = assigned.drop("total")
        before, count = count, staged_rows(current)
        number += 1
        if count > 0.99 * before and partitions <= -(-count // partition_items):
            # merging no longer helps: what is left stays as it is
            left = assigned.join(current, "bin")
            return out.union(left.select(F.col("bin").cast("string").alias("container"), F.col("size").alias("container_total"), "id", "piece_no", "first_token", "n_tokens"))
        partitions = max(1, min(-(-partitions // fan_in), partitions - 1), -(-count // partition_items))
