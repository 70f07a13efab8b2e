"""Vector functions as column expressions: doubles throughout, so that engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column | list[float]) -> Column:
    """The cosine of two vectors; null where either is null or all zero, or where the lengths differ."""
    other = F.array(*[F.lit(float(x)) for x in b]) if isinstance(b, list) else b
    product = F.sqrt(_dot(a, a)) * F.sqrt(_dot(other, other))
    return F.when((product > 0) & (F.size(a) == F.size(other)), _dot(a, other) / product)


def mean_vector(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, vec) -> (key, vec): the mean of each key's vectors, place by place."""
    places = rows.select(key, F.posexplode("vec").alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("p")).select(key, F.transform("p", lambda p: p["x"]).alias("vec"))


def embedded(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None, batch: int = 64, prefix: int = 512) -> DataFrame:
    """texts (id, text) -> (id, vec) by ``embedder(texts)``, asked for ``batch`` texts at a time, each by its first ``prefix``
    characters as the pipeline embeds them. Null and blank texts, and batches that fail or are answered in part, have no
    vector; without an embedder there are none."""
    shape = f"id {texts.schema['id'].dataType.simpleString()}, vec array<double>"
    if embedder is None:
        return texts.sparkSession.createDataFrame([], shape)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    vectors = embedder([t[:prefix] for t in part["text"]])
                except Exception:  # noqa: BLE001 - a model's failure is no failure of the job
                    vectors = None
                if vectors is not None and len(vectors) == len(part):
                    yield part[["id"]].assign(vec=[[float(x) for x in v] for v in vectors])

    return texts.select("id", "text").where("id is not null and trim(text) <> ''").mapInPandas(run, shape)
