"""Streaming jobs. Each is a function from a stream to a stream, or a batch function for ``foreachBatch`` that can be
run again on the same batch without changing the outcome."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import token_count
from weftgraph.pipeline import align, ingest
from weftgraph.sources.tables import shared_folder


def read_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 10) -> DataFrame:
    """A Parquet table's files as a stream, with the schema of what is there now."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a pattern, so that a single file is accepted as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{table[:-1]}[{table[-1]}].parquet")


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest_documents(documents: DataFrame) -> DataFrame:
    """The gate of a fetched document: (source_doc_id, content_hash, token_count, new_status). Stateless, so it runs on
    a stream as on a table."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").alias("source_doc_id"), "content_hash", text.alias("t"), token_count(text).alias("token_count"))
    signals = ingest.quality_signals(F.col("t"))
    reason = ingest.quality_gate(F.col("token_count"), signals["sentence_density"], signals["listy_ratio"])
    return rows.select("source_doc_id", "content_hash", "token_count", F.when(reason.isNull(), "cleaned").otherwise("low_quality").alias("new_status"))


def candidate_pool(folder: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch of candidates into the pool under ``folder``. Pools are numbered by batch, so a
    batch that is run again starts from the same pool and writes the same one; the last ``keep`` pools stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("normalized_form", "surface_forms", F.col("seen_source_doc_ids").alias("doc_ids"), "first_seen_at", "last_seen_at")
        old = spark.read.parquet(f"{folder}/pool-{number - 1}").drop("source_count") if number else rows.limit(0)
        align.pool_candidates(old, rows).write.mode("overwrite").parquet(f"{folder}/pool-{number}")
        if number >= keep:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/pool-{number - keep}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return merge


def run_once(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is there and ends; without ``batch`` the rows are returned. In complete mode each
    batch replaces the last."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch or keep).start()
    query.awaitTermination()
    if batch:
        return None
    return stream.sparkSession.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(*schema.fieldNames())
