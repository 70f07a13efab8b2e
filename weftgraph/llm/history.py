"""Checking new batches against everything accepted before: multi-key sorted-neighbourhood runs.

Every document has several sort keys: its two digests (the leading hex digits, the rest is compared as well) and
``bands`` keys, each of some HyperMinHash registers, so that texts that are alike sort next to each other under some
key.  A run holds the entries (key, check, batch, ref) of one batch or, after a compaction, of many: cut into ranges of
the hashed key (the buckets of a bucketed table), sorted by key within each.  A sorted batch is merged with the
persisted ranges; the window around a new entry is the stretch of older entries with its key, as long as the stretch
is, so that no partner is lost to a fixed width.  Text entries stand for whole classes of equal texts of their batch.

What is stored is never shuffled: entries are merged bucket by bucket, registers are fetched from tables bucketed by
class for the candidates only, and texts are read for the pairs whose registers agree well enough.  Small runs are
compacted into one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import hyperminhash
from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.llm.near_duplicates import Similarity, classes, estimated, sketches, verified
from weftgraph.sources import stage, staged_rows

#: Entries of a bucket a run is laid out for.
BUCKET_ENTRIES = 2_000_000
#: The digests, which are told apart by the last bit of their key.
CONTENT, NORMALIZED = 0, 1
_COLUMNS = {"keys": "key long, check binary, batch int, ref long", "heads": "class_id long, batch int, n_shingles int, registers binary", "members": "class_id long, batch int, id long"}
_CLUSTERED = {"keys": "key", "heads": "class_id", "members": "class_id"}


def digest(written: Column | str) -> Column:
    """The 64 hex digits in lower case, however they are written around; null where there are none."""
    found = F.regexp_extract(F.lower(written), "([0-9a-f]{64})", 1)
    return F.when(found != "", found)


@dataclass(frozen=True)
class Batch:
    """The tables of one batch or of many: keys (key, check, batch, ref), heads (class_id, batch, n_shingles, registers)
    and members (class_id, batch, id); ``n_entries`` is about the number of keys."""

    keys: DataFrame
    heads: DataFrame
    members: DataFrame
    n_entries: int


def digest_entries(rows: DataFrame, kind: int, name: str) -> DataFrame:
    """rows (id, batch, digest as written) -> (key, check, batch, ref)."""
    hexes = rows.select("id", "batch", digest(name).alias("h")).where("h is not null")
    key = F.conv(F.substring("h", 1, 15), 16, 10).cast("long") * 2 + kind
    return hexes.select(key.alias("key"), F.unhex(F.substring("h", 16, 49)).alias("check"), F.col("batch").cast("int").alias("batch"), F.col("id").cast("long").alias("ref"))


def _text_entries(heads: DataFrame, how: Similarity) -> DataFrame:
    columns = hyperminhash.band_columns(how.registers, how.bands, how.rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        registers = np.frombuffer(b"".join(column(batch, "registers")), np.uint16).reshape(batch.num_rows, -1)
        keys = hyperminhash.band_keys(registers, columns)
        n = keys.shape[1]
        return record(key=keys.ravel(), check=pa.nulls(keys.size, pa.binary()), batch=np.repeat(array(batch, "batch"), n), ref=np.repeat(array(batch, "class_id"), n))

    return map_batches(heads.select("class_id", "batch", "registers"), work, _COLUMNS["keys"])


def prepared(documents: DataFrame, how: Similarity) -> Batch:
    """The tables of documents (id, batch, text, content_hash, normalized_hash); heads and members are staged.

    Rows with a null id or batch are left out; null digests and texts without a shingle have no entry of that kind.
    """
    rows = documents.where("id is not null and batch is not null").withColumn("batch", F.col("batch").cast("int"))
    sketched = stage(sketches(rows.select(F.col("id").cast("long").alias("id"), "batch", "text"), how, ("batch",)))
    members, heads = (stage(x) for x in classes(sketched, ("batch",)))
    digests = digest_entries(rows, CONTENT, "content_hash").union(digest_entries(rows, NORMALIZED, "normalized_hash"))
    return Batch(digests.union(_text_entries(heads, how)), heads, members, staged_rows(heads) * how.bands + 2 * staged_rows(members))


def windows(new: DataFrame, old: DataFrame) -> DataFrame:
    """(a: old ref, b: new ref, text) of entries with the same key of an older and a newer batch: a sorted merge of the
    two key sequences. ``text`` tells whether the key was one of texts."""
    left = old.select("key", F.col("check").alias("check_a"), F.col("batch").alias("batch_a"), F.col("ref").alias("a"))
    right = new.select("key", F.col("check").alias("check_b"), F.col("batch").alias("batch_b"), F.col("ref").alias("b"))
    # said so that the planner doesn't make the check a key of the join: the ranges are of the key alone
    same = F.coalesce(F.col("check_a") == F.col("check_b"), F.col("check_a").isNull() & F.col("check_b").isNull())
    both = left.join(right.hint("merge"), "key").where((F.col("batch_a") < F.col("batch_b")) & (F.col("a") != F.col("b")) & same)
    return both.select("a", "b", F.col("check_a").isNull().alias("text"))


class HistoryIndex:
    """Accepted documents as sorted runs under ``folder`` (any file system Spark can write to).

    A run is complete once its ``members`` are written, which happens last; what a lost job left behind is ignored. An id
    is expected in one batch; batches are numbered, and an accepted document is found by newcomers of greater numbers.
    """

    def __init__(self, spark: SparkSession, folder: str, how: Similarity, max_runs: int = 8):
        self.spark, self.folder, self.how, self.max_runs = spark, folder.rstrip("/"), how, max_runs

    def _path(self, below: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder + below)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(self._path())]
        return sorted(n for n in names if n.startswith("run-") and fs.exists(self._path(f"/{n}/members/_SUCCESS")))

    def _table(self, run: str, what: str) -> DataFrame:
        """A run's table, made known to the session where it isn't yet; the run's name ends with its number of buckets."""
        name = f"weftgraph_{run}_{what}".replace("-", "_")
        if not self.spark.catalog.tableExists(name):
            by = _CLUSTERED[what]
            self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS[what]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {run.rpartition('-')[2]} BUCKETS LOCATION '{self.folder}/{run}/{what}'")
        return self.spark.table(name)

    def tables(self, what: str, runs: list[str] | None = None) -> DataFrame:
        """The union of a table over the runs."""
        return reduce(DataFrame.unionByName, [self._table(n, what) for n in (self.runs() if runs is None else runs)])

    def _write(self, batch: Batch) -> str:
        buckets = 1 << max(3, (batch.n_entries // BUCKET_ENTRIES).bit_length())
        run = f"run-{len(self.runs()):06d}-{uuid.uuid4().hex[:8]}-{buckets}"
        for what in ("keys", "heads", "members"):
            rows, by = getattr(batch, what), _CLUSTERED[what]
            rows = rows.select(*[c.split()[0] for c in _COLUMNS[what].split(", ")]).repartition(buckets, by)
            rows.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", f"{self.folder}/{run}/{what}").saveAsTable(f"weftgraph_{run}_{what}".replace("-", "_"))
        return run

    def add(self, batch: Batch) -> str:
        """Accept a batch as a run; compact when there are too many."""
        run = self._write(batch)
        if len(self.runs()) > self.max_runs:
            return self.compact()
        return run

    def entries_met(self, keys: DataFrame) -> DataFrame:
        """Entries (key, check, batch, ref) merged with every run: (a, b, text)."""
        met = [windows(keys, self._table(n, "keys")) for n in self.runs()]
        return reduce(DataFrame.union, met) if met else self.spark.createDataFrame([], "a long, b long, text boolean")

    def candidates(self, batch: Batch) -> tuple[DataFrame, DataFrame]:
        """A new batch merged with the runs: pairs (a, b) of classes whose registers agree well enough, and pairs (a, b) of
        documents with a digest in common; both staged."""
        met = stage(self.entries_met(stage(batch.keys)).distinct())
        pairs = met.where("text").select("a", "b")
        near = [estimated(pairs, self._table(n, "heads"), self.how, batch.heads) for n in self.runs()]
        return stage(reduce(DataFrame.union, near) if near else pairs), met.where("not text").select("a", "b")

    def within(self, run: str) -> tuple[DataFrame, DataFrame]:
        """The same between the batches of one run: what merging each with those before it would have found. Both sides
        of the merge are the run's ranges, so nothing is shuffled."""
        keys, heads = self._table(run, "keys"), self._table(run, "heads")
        met = stage(windows(keys, keys).distinct())
        return stage(estimated(met.where("text").select("a", "b"), heads, self.how)), met.where("not text").select("a", "b")

    def expanded(self, links: DataFrame, members: DataFrame) -> DataFrame:
        """Links (a, b) of classes as pairs of documents, the older one first."""
        side = lambda c, x: members.select(F.col("class_id").alias(c), F.col("id").alias(x), F.col("batch").alias(f"batch_{x}"))
        return links.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").where("batch_x < batch_y").select("x", "y")

    def match(self, batch: Batch, texts: DataFrame) -> DataFrame:
        """A new batch -> distinct (accepted_id, new_id) of documents with an equal digest or alike texts; texts (id, text)
        of both sides are read for the pairs that the registers let through."""
        if not self.runs():
            return self.spark.createDataFrame([], "accepted_id long, new_id long")
        near, same = self.candidates(batch)
        found = self.expanded(verified(near, texts.select("id", "text"), self.how), self.tables("members").unionByName(batch.members))
        return found.union(same).distinct().toDF("accepted_id", "new_id")

    def compact(self) -> str:
        """Merge all runs into one. Entries keep their batches and class ids: a class that stands in several batches keeps
        an entry of each, since later batches must find the members of all."""
        old = self.runs()
        if len(old) < 2:
            return old[0] if old else ""
        entries = sum(staged_rows(self._table(n, "keys")) for n in old)
        run = self._write(Batch(*(self.tables(w, old) for w in ("keys", "heads", "members")), entries))
        for name in old:
            self._fs().delete(self._path(f"/{name}"), True)
            for what in _COLUMNS:
                self.spark.sql(f"DROP TABLE IF EXISTS weftgraph_{name.replace('-', '_')}_{what}")
        return run


def duplicates(index: HistoryIndex, documents: DataFrame, tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """documents (id, batch, text, content_hash, normalized_hash) -> distinct (accepted_id, new_id): for each document
    every document of a smaller batch that it duplicates (either digest) or nearly duplicates (texts); and of tasks
    (id, content_hash) those with the content digest of a document, the same way.

    All batches but the newest are stored as a run of the (empty) index and merged range by range with those before
    them; the newest is matched with what is stored and added. Rows with a null id or batch take no part. One row per
    pair: copies of one document are that many rows.
    """
    rows = documents.where("id is not null and batch is not null")
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None:
        empty = index.spark.createDataFrame([], "accepted_id long, new_id long")
        return empty, None if tasks is None else empty
    history, last = prepared(rows.where(F.col("batch") < newest), index.how), prepared(rows.where(F.col("batch") == newest), index.how)
    near, same = index.within(index.add(history))
    near_last, same_last = index.candidates(last)
    index.add(last)
    links = verified(near.union(near_last), rows.select("id", "text"), index.how)
    found = index.expanded(links, index.tables("members")).union(same).union(same_last).distinct()
    asked = None
    if tasks is not None:
        entries = digest_entries(tasks.where("id is not null").withColumn("batch", F.lit(newest + 1)), CONTENT, "content_hash").distinct()
        # a task's number may be that of a document: told apart from it by its sign
        asked = index.entries_met(entries.withColumn("ref", -1 - F.col("ref"))).select("a", (-1 - F.col("b")).alias("b")).distinct().toDF("accepted_id", "new_id")
    return found.toDF("accepted_id", "new_id"), asked
