"""Token ids of documents in entropy-coded segments, in ascending doc_id order.

``write_segments`` range-partitions documents by id, encodes each partition in
order and closes a segment after ``segment_ids`` ids, so a task holds one segment
at most.  Segments (self-contained file images, see :mod:`.rans`) are rows of a
Parquet table in any file system Spark reaches; Spark's committer makes retries
of lost tasks safe.  ``read_segments`` decodes them again in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .common import Scratch, arrow_rows, doc_text
from .tokenize import encoded

SEGMENT_SCHEMA = "part int, segment int, data binary"


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 2_000_000) -> DataFrame:
    """Segments of every document's ids, each document ended by ``end_id``.

    One row per segment: its partition (ascending in doc_id), its number there,
    and the file image, whose head holds both and the ids before it in its
    partition.  Null text counts as empty; a null doc_id sorts first and is stored
    as -2**63; repeated rows are stored each; a text longer than a segment makes
    one longer segment; an empty table has none.  Columns besides doc_id and text
    are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        def work(rows):
            part = TaskContext.get().partitionId()
            segment = before = size = 0
            held: list[tuple[int, bytes]] = []

            def close():
                ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
                doc_ids = np.array([-(1 << 63) if d is None else d for d, _ in held], np.int64)
                tokens = np.array([len(b) // 4 for _, b in held], np.int64)
                return part, segment, rans.encode_segment(ids, doc_ids, tokens, part, segment, before)

            for (doc, _), ids in encoded(rows, tokenizer_path):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= segment_ids:
                    yield close()
                    segment, before, size, held = segment + 1, before + size, 0, []
            if held:
                yield close()

        return work

    ordered = doc_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_rows(ordered, ["doc_id", "text"], SEGMENT_SCHEMA, make, 1)


def read_segments(segments: DataFrame) -> DataFrame:
    """Documents read back: ``doc_id, start, n_tokens, ids_crc32``.

    Only the file images are read.  ``start`` counts the ids of all documents
    before.  The sizes in the heads are summed by partition, and these totals (one
    number each) on the driver; everything else stays in the tasks.  ValueError
    where a checksum fails.
    """

    def heads():
        return lambda rows: ((f.part, f.n_ids) for (data,) in rows for f in (rans.Segment(data),))

    totals = arrow_rows(segments, ["data"], "part int, n_ids long", heads).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, at = {}, 0
    for row in sorted(totals):
        base[row.part] = at
        at += row.n

    def make():
        def work(rows):
            for (data,) in rows:
                file = rans.Segment(data)
                start = base[file.part] + file.before
                for doc, ids in file.documents():
                    yield doc if doc != -(1 << 63) else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    start += len(ids)

        return work

    return arrow_rows(segments, ["data"], "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 2_000_000) -> DataFrame:
    """Write all documents' ids to the shared folder and read the files back.

    Null text is its end id alone; a null doc_id comes first and is kept; repeated
    ids and rows are documents each, in some order among themselves; an empty table
    gives no row; a very long text lies over segments' blocks.  Columns besides
    doc_id and text are ignored.
    """
    held = Scratch(docs.sparkSession).save(write_segments(docs, tokenizer_path, end_id, segment_ids), "segments")
    return read_segments(held)
