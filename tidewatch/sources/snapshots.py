"""Frozen snapshots: deterministic files, content hashes, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import row_digest


class SnapshotError(ValueError):
    """A snapshot is missing, frozen, sealed, or not what its manifest says."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file in any file system Spark reaches."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes (a single file of at most 2 GB)."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).head()[0]


def content_hash(df: DataFrame) -> DataFrame:
    """``digest``, one row: the same for the same rows in any order.

    Each row's SHA-256 is cut to eight 32-bit numbers, which are summed (and so
    counted with their repetition), so data of any size need one small aggregate.
    """
    words = [F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = df.select(row_digest(df.columns).alias("d")).agg(*[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"s{k}") for k, w in enumerate(words)], F.count(F.lit(1)).cast("string").alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", *[f"s{k}" for k in range(8)], "n"), 256).alias("digest"))


def manifest_stats(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("start"), F.max(date).alias("end"))


def write_csv_snapshot(df: DataFrame, path: str, date: str = "date") -> None:
    """CSV with six decimals, by date, refused if ``path`` exists."""
    spark = df.sparkSession
    if exists(spark, path):
        raise SnapshotError(f"{path} is frozen")
    text = df.select(*[F.when(F.col(f.name).isNotNull(), F.format_string("%.6f", F.col(f.name))).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])
    text.coalesce(1).sortWithinPartitions(date).write.mode("errorifexists").option("header", True).csv(path)


def freeze(df: DataFrame, base: str, name: str, manifest: dict | None = None, date: str = "date") -> dict:
    """Write a snapshot and its manifest; refused if either exists.  Doubles are
    rounded to six places, so what is read again is what was hashed."""
    spark = df.sparkSession
    path, listing = f"{base}/{name}.parquet", f"{base}/{name}.manifest.json"
    if exists(spark, path) or exists(spark, listing):
        raise SnapshotError(f"{name} is frozen")
    df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]).write.mode("errorifexists").parquet(path)
    held = spark.read.parquet(path)
    stats = manifest_stats(held, date).head()
    out = {**(manifest or {}), "rows": stats["rows"], "start": str(stats["start"]), "end": str(stats["end"]), "sha256": content_hash(held).head()[0], "columns": held.columns}
    write_text(spark, listing, json.dumps(out, indent=2, default=str))  # in the order given
    return out


def read_manifest(spark: SparkSession, base: str, name: str) -> dict:
    path = f"{base}/{name}.manifest.json"
    if not exists(spark, path):
        raise SnapshotError(f"no snapshot {name}")
    return json.loads(read_text(spark, path))


def snapshot_hash(spark: SparkSession, base: str, name: str) -> str:
    return read_manifest(spark, base, name)["sha256"]


def load(spark: SparkSession, base: str, name: str, verify: bool = True) -> DataFrame:
    """A snapshot; an error if its content is not the manifest's."""
    listing = read_manifest(spark, base, name)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if verify and content_hash(df).head()[0] != listing["sha256"]:
        raise SnapshotError(f"{name} has changed since it was frozen")
    return df


def load_csv(spark: SparkSession, path: str, schema: str, sha256: str) -> DataFrame:
    """A CSV snapshot, read only if its one file has the hash that is expected."""
    from .panel import read_csv_panel

    if file_hash(spark, path) != sha256:
        raise SnapshotError(f"{path} is not what its manifest says")
    return read_csv_panel(spark, path, schema)


def freeze_book(bars: DataFrame, positions: DataFrame, base: str, name: str = "book", jump_cut: float = 0.7, manifest: dict | None = None) -> dict:
    """Build a portfolio index and freeze it: its manifest holds the target
    weights, largest first, the date each series was cut at, and the positions
    without bars."""
    from ..operators import align, book

    weight = book.weights(positions)
    cuts = align.clean_suffix(bars, jump_cut).groupBy("series").agg(F.max("cut_date").alias("cut")).where("cut IS NOT NULL")
    excluded = positions.select("series").join(bars.select("series").distinct(), "series", "left_anti")
    listing = {
        **(manifest or {}), "target_weights": dict(book.target_weights(weight)), "cut_dates": {r.series: str(r.cut) for r in cuts.orderBy("series").collect()},
        "excluded": [r.series for r in excluded.orderBy("series").collect()],
    }
    return freeze(book.book_index(bars, weight, jump_cut), base, name, listing)


def freeze_split(panel: DataFrame, base: str, months: int = 18) -> dict:
    """``dev`` and ``holdout`` snapshots either side of the boundary date."""
    from ..operators.align import split_by_date

    parts = split_by_date(panel, months)
    spark = panel.sparkSession
    boundary = str(parts.select("boundary").head()[0])
    for part in ("dev", "holdout"):
        freeze(parts.where(F.col("part") == part).drop("part", "boundary"), base, part, {"holdout_boundary_date": boundary})
    write_text(spark, f"{base}/split.json", json.dumps({"holdout_boundary_date": boundary, "dissolved": False}))
    return {"holdout_boundary_date": boundary}


def split_state(spark: SparkSession, base: str) -> dict:
    return json.loads(read_text(spark, f"{base}/split.json"))


def load_dev(spark: SparkSession, base: str, verify: bool = True) -> DataFrame:
    """The development rows, or all once the holdout is dissolved."""
    state = split_state(spark, base)
    if state["dissolved"]:
        return load(spark, base, "full", verify)
    df = load(spark, base, "dev", verify)
    if df.where(F.col("date") > F.lit(state["holdout_boundary_date"]).cast("date")).limit(1).count():
        raise SnapshotError("development rows reach past the boundary")
    return df


def load_holdout(spark: SparkSession, base: str, *, explicit_permission: bool = False, verify: bool = True) -> DataFrame:
    if split_state(spark, base)["dissolved"]:
        raise SnapshotError("the holdout is dissolved")
    if not explicit_permission:
        raise SnapshotError("the holdout needs explicit permission")
    return load(spark, base, "holdout", verify)


def dissolve_holdout(spark: SparkSession, base: str) -> dict:
    """Join the parts for good; needs a recorded unlock (``unlock.json``)."""
    if not exists(spark, f"{base}/unlock.json") or not json.loads(read_text(spark, f"{base}/unlock.json")).get("unlocked"):
        raise SnapshotError("no recorded unlock")
    state = split_state(spark, base)
    if state["dissolved"]:
        raise SnapshotError("the holdout is dissolved already")
    both = load(spark, base, "dev").unionByName(load(spark, base, "holdout"))
    out = freeze(both, base, "full", {"holdout_boundary_date": state["holdout_boundary_date"], "dissolved": True})
    write_text(spark, f"{base}/split.json", json.dumps({**state, "dissolved": True}))
    return out
