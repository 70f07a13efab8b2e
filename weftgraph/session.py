"""Sessions for local work and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, memory: str = "8g") -> SparkSession:
    """A local session with AQE, UTC and few shuffle partitions (the driver of a cluster sets its own)."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftgraph")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable by Python workers, once a context: where neither the working folder nor PYTHONPATH
    does so, a zip of it goes to every executor."""
    root = Path(__file__).resolve().parent.parent
    known = {Path.cwd(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)}
    context = spark.sparkContext
    if root in known or getattr(context, "_weftgraph_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "weftgraph").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._weftgraph_shipped = True
