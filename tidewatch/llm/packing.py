"""Packing of documents' token ids into sequences of bounded length.

A document longer than the window is first cut into full windows; what remains
of each document is packed best-fit decreasing: the longest piece first, each
into the open sequence with the least room that still holds it, found by a
segment tree indexed by remaining capacity.

Pieces are dealt by a hash of what they are and of the input partition they come
from into groups of about ``docs_per_group`` documents' pieces, so rows of one id,
or repeated rows, do not all meet.  Each group is packed by itself: no task sees
more than a group, and the padding is that of one open sequence for each group.

A sequence is padded to the window, unless its length is a power of two, which
needs no padding.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, doc_text
from .tokenize import encoded

NO_ID = -(1 << 63)  # stands for a null doc_id while pandas holds the rows
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, padded_length long"

PACKED_COLUMNS = [c.split(" ")[0] for c in PACKED_SCHEMA.split(", ")]


class CapacityTree:
    """Open sequences by remaining capacity; finds the least capacity >= need."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the tightest open sequence, taken out."""
        count, k = self.count, need + self.size
        while not count[k]:
            while k & 1:  # a right child: what is larger lies further up
                k >>= 1
            if k <= 1:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; ``lengths`` descend and are 1..window."""
    tree, out, sequences = CapacityTree(window), [], 0
    for n in lengths:
        if (found := tree.take(n)) is None:
            room, sequence = window, sequences
            sequences += 1
        else:
            room, sequence = found
        out.append((sequence, window - room))
        if room > n:
            tree.add(room - n, sequence)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """Full windows and the remainder of every document's ids (with ``end_id``)."""
    end = end_id.to_bytes(4, "little")

    def make():
        def work(rows):
            for (doc, _), ids in encoded(rows, tokenizer_path):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, window):
                    part = ids[4 * at : 4 * (at + window)]
                    yield NO_ID if doc is None else doc, at, len(part) // 4, zlib.crc32(part), total

        return work

    return arrow_rows(doc_text(docs), ["doc_id", "text"], PIECE_SCHEMA, make)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, docs_per_group: int = 1000) -> DataFrame:
    """One row per piece, with its sequence and offset there.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length`` (of the sequence).  Null text counts as empty (one id, the
    end); repeated rows are packed each; a null doc_id is kept; a very long text
    is cut into windows; an empty table gives no row.  ``sequence_id`` is group *
    2**32 + number, the same in every run over equally partitioned input.  Columns
    besides doc_id and text are ignored.
    """
    groups = max(1, docs.select("doc_id").count() // docs_per_group)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit_decreasing(pdf["length"].tolist(), window)
        first = int(pdf["pack_group"].iloc[0]) << 32
        pdf = pdf.assign(sequence_id=[first + s for s, _ in placed], offset=[o for _, o in placed])
        used = pdf.groupby("sequence_id")["length"].transform("sum")
        return pdf.assign(padded_length=used.where((used & (used - 1)) == 0, window)).drop(columns=["pack_group"])[PACKED_COLUMNS]

    dealt = pieces(docs, tokenizer_path, end_id, window).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, PACKED_SCHEMA).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
