"""Streams run once over a table's files, and drill-downs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph import streaming
from weftgraph.drilldown import drilldown
from weftgraph.queries.registry import Registry
from weftgraph.queries.stages import _SIGNALS
from weftgraph.sources.tables import shared_folder

R = Registry()


def _windows(k, **how):
    rows = streaming.run_once(streaming.event_windows(streaming.read_stream(k.spark, k.folder, "events"), late="31 days", **how), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


R.add("stream_event_windows", _windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")
R.add(
    "stream_sliding_windows",
    lambda k: _windows(k, length="2 hours", slide="1 hour"),
    "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) AS start, event_type, value FROM {events} UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type, value FROM {events}) x GROUP BY 1, 2",
)
R.add(
    "stream_ingest",
    lambda k: streaming.run_once(streaming.ingest_documents(streaming.read_stream(k.spark, k.folder, "documents"))).select("source_doc_id", "token_count", "new_status"),
    _SIGNALS + " SELECT source_doc_id, token_count, CASE WHEN token_count < 200 OR sentence_density < 1 OR (sentence_density < 2 AND listy_ratio > 0.4) THEN 'low_quality' ELSE 'cleaned' END AS new_status FROM s",
)


def _pool(k):
    folder = f"{shared_folder(k.spark)}/pool-{uuid.uuid4().hex}"
    streaming.run_once(streaming.read_stream(k.spark, k.folder, "evolution_candidates"), batch=streaming.candidate_pool(folder))
    fs = k.spark._jvm.org.apache.hadoop.fs.Path(folder)
    last = max(int(x.getPath().getName().split("-")[1]) for x in fs.getFileSystem(k.spark._jsc.hadoopConfiguration()).listStatus(fs))
    return k.spark.read.parquet(f"{folder}/pool-{last}").select("normalized_form", "source_count", F.array_join("surface_forms", "|").alias("forms"))


R.add(
    "stream_candidate_pool",
    _pool,
    "SELECT normalized_form, cast(len(list_distinct(flatten(list(coalesce(seen_source_doc_ids, []))))) AS int) AS source_count, array_to_string(list_sort(list_distinct(flatten(list(coalesce(surface_forms, []))))), '|') AS forms FROM {v_candidate} WHERE trim(normalized_form, ' ') <> '' GROUP BY normalized_form",
)
R.add("drilldown", lambda k: drilldown(k, "low_confidence_facts", limit=30).select("fact_id", "confidence"), "SELECT fact_id, confidence FROM {v_fact} WHERE lifecycle_state = 'active' AND confidence <= 0.6 ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 30")
