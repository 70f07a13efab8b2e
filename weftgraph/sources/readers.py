"""Other sources than Parquet tables: JSON lines, YAML, whole files, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON by a schema; a line that cannot be read is a row of nulls with the line in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified_at, length, content) of whole files below a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("modificationTime").alias("modified_at"), "length", "content")


def read_yaml(spark: SparkSession, path: str, key: str | None, schema: str, pattern: str = "*.yaml") -> DataFrame:
    """The lists of mappings that stand under ``key`` (or at the top) of YAML files, by a schema; what a mapping lacks is
    null, what the schema lacks is left out."""
    import json

    import yaml

    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for content in batch.column(0).to_pylist():
                document = yaml.safe_load(content) or {}
                listed = document if key is None else document.get(key) or []
                out += [json.dumps({n: row.get(n) for n in names}, default=str, ensure_ascii=False) for row in listed if isinstance(row, dict)]
            yield pa.RecordBatch.from_pydict({"row": pa.array(out, pa.string())})

    read = read_files(spark, path, pattern).select("content").mapInArrow(rows, "row string")
    return read.select(F.from_json("row", schema).alias("r")).select("r.*")


def read_database(spark: SparkSession, url: str, table: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of a numeric column where one is named; filters and columns are pushed
    down by the source."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_by is not None:
        if bounds is None:
            raise ValueError("bounds of the split column are needed")
        reader = reader.option("partitionColumn", split_by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
