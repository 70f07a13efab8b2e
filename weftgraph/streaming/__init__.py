"""Structured Streaming: documents through the gates micro-batch by micro-batch, windows over events, candidate pools."""

from weftgraph.streaming.jobs import candidate_pool, event_windows, ingest_documents, read_stream, run_once

__all__ = ["candidate_pool", "event_windows", "ingest_documents", "read_stream", "run_once"]
