"""Confidence scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph import model


def mapped(key: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


#: Added before rounding, so that sums of decimals ending in 5 round up whatever their binary form.
NUDGE = 1e-9


def rounded(score: Column, places: int) -> Column:
    return F.round(score + NUDGE, places)


def clamped(score: Column) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def score_fact(source_rank: Column, method: Column, ontology_fit: Column, consistency: Column, temporal: Column) -> Column:
    w = model.FACT_WEIGHTS
    parts = (mapped(source_rank, model.SOURCE_AUTHORITY, 0.4), mapped(method, model.EXTRACTION_METHOD, 0.7), ontology_fit, consistency, temporal)
    return clamped(sum((x * p for x, p in zip(w, parts)), F.lit(0.0)))


def score_segment(source_rank: Column, quality: Column) -> Column:
    return clamped(0.6 * mapped(source_rank, model.SOURCE_AUTHORITY, 0.4) + 0.4 * quality)


def temporal_validity(days: Column) -> Column:
    return F.when(days <= 365, 1.0).when(days <= 3 * 365, 0.85).when(days <= 5 * 365, 0.7).otherwise(0.5)
