"""Append-only ledgers of runs and of predictions, as JSON lines."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import config_hash
from .snapshots import exists

REQUIRED = ("timestamp", "git_sha", "config_hash", "data_snapshot_hash", "seed", "notes", "config", "metrics")
TEXT_SCHEMA = "timestamp string, git_sha string, config_hash string, data_snapshot_hash string, seed bigint, notes string, config string, metrics string"


def append_row(spark: SparkSession, path: str, row: dict) -> None:
    """One JSON line, as a new part file of the directory ``path``.  Numbers that
    are not finite stand as NaN and Infinity."""
    line = json.dumps(row, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def log_run(spark: SparkSession, path: str, config: dict, metrics: dict, *, seed: int, data_snapshot_hash: str, notes: str = "", sha: str = "unknown") -> dict:
    """Append a run; ``sha`` is the revision of the code that made it."""
    if not data_snapshot_hash:
        raise ValueError("a run needs the hash of its data")
    row = {
        "timestamp": datetime.now(UTC).isoformat(), "git_sha": sha, "config_hash": config_hash(config), "data_snapshot_hash": data_snapshot_hash, "seed": seed, "notes": notes,
        "config": config, "metrics": metrics,
    }
    append_row(spark, path, row)
    return row


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; config and metrics stay JSON text.  A missing ledger is empty;
    a line without one of the required fields is an error; blank lines are
    skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], TEXT_SCHEMA)
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = [c.split(" ")[0] for c in TEXT_SCHEMA.split(", ")]
    row = F.from_json("value", F.lit(TEXT_SCHEMA), {"allowNonNumericNumbers": "true"})
    parsed = lines.select(row.alias("r"))
    gone = F.concat_ws(", ", *[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in REQUIRED])
    checked = F.when(gone != "", F.raise_error(F.concat(F.lit("missing fields: "), gone)).cast("string")).otherwise(F.col("r.timestamp"))
    return parsed.select(checked.alias("timestamp"), *[F.col(f"r.{c}").alias(c) for c in fields[1:]])


def log_records(spark: SparkSession, path: str, records: DataFrame, config: dict, *, seed: int, data_snapshot_hash: str, sha: str = "unknown") -> int:
    """Log each metric record of a suite (one row for each strategy) as a run."""
    rows = [r.asDict(recursive=True) for r in records.orderBy("name").collect()]  # a few strategies
    for r in rows:
        log_run(spark, path, {**config, "strategy": r["name"]}, r, seed=seed, data_snapshot_hash=data_snapshot_hash, notes=r["name"], sha=sha)
    return len(rows)


def append_live(spark: SparkSession, predictions: str, runs: str, row: DataFrame, config: dict, *, seed: int, data_snapshot_hash: str, sha: str = "unknown") -> dict:
    """Append a live row to the ledger of predictions, and log it as a run.  A row
    that stands there already (same asof and configuration) is refused."""
    live = {k: str(v) if hasattr(v, "isoformat") else v for k, v in row.head().asDict(recursive=True).items()}
    live["config"] = config_hash(config)
    if exists(spark, predictions):
        before = read_merged(spark, predictions)
        if before.where((F.col("asof") == live["asof"]) & (F.col("config") == live["config"])).limit(1).count():
            raise ValueError(f"{live['asof']} is predicted already")
    append_row(spark, predictions, live)
    log_run(spark, runs, config, live, seed=seed, data_snapshot_hash=data_snapshot_hash, notes="live", sha=sha)
    return live


def run_count(spark: SparkSession, path: str) -> int:
    """The number of runs so far, for multiple-testing adjustment."""
    return read_runs(spark, path).count()


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Any JSON-lines ledger with its layouts merged; absent fields are NULL."""
    return spark.read.json(path)


def write_results(path: str, results: dict) -> None:
    """A results file on the driver's disk, in readable form."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(results, f, indent=2, sort_keys=True, default=str)
