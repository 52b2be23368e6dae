"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import Scratch as Scratch
from ..sources.scratch import scratch_root as scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job inside go as soon as the job has ended, for jobs
    of many rounds whose results are written; the session's own setting holds
    again afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


_memory: dict = {}


def claim_memory(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Let one operator at a time remember things in a worker process.

    Workers serve tasks of many stages one after another.  Who claims makes the
    owner before forget; the same owner keeps what it remembers.
    """
    if _memory.get("owner") != owner:
        _memory.get("forget", lambda: None)()
        _memory.update(owner=owner, forget=forget)


def arrow_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]],
    rows_per_batch: int = 2048,
) -> DataFrame:
    """Stream ``columns`` of ``df`` as tuples through a Python generator.

    ``make`` is called once for each task and returns a function from an
    iterator of input tuples to an iterator of output tuples.  Input arrives and
    output leaves in Arrow batches, so a task holds one batch at a time.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in work(rows()):
            held.append(row)
            if len(held) >= rows_per_batch:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    ship(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def doc_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and text alone (null text: empty); extra columns of any name
    are left behind, so none of them can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
