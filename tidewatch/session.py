"""Spark session for local work; clusters bring their own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each context, so
    that functions sent there can import it wherever it is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidewatch-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tidewatch_src.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(f"{folder}/tidewatch_src.zip")
    sc._tidewatch_shipped = True
