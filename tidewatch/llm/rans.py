"""Token-id files coded by a static range asymmetric numeral system.

One *segment* is a self-contained file image: a shared table of symbol
frequencies, a document index, and blocks of ids.  Its head says which part and
segment of a file set it is, how many ids its part holds before it, and how many
it holds itself.  A block holds ``lanes`` interleaved coder states; its words are
read in step order, and it keeps *checkpoints* (all lane states and the word
offset at a step), so that blocks, and the spans between checkpoints, decode
independently.  Checksums cover the head with its tables, each block's stored
bytes, and each block's ids; each span must end in the next checkpoint's states,
the last one in the states the coder started from.

Coding follows the published scheme: states of 64 bits with 32-bit words,
frequencies scaled to a power of two.  Everything is numpy over
(blocks x lanes), with one Python step for each row of lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

LANES = 256
STEPS = 512  # rows of lanes in a full block
CHECKPOINT = 256  # steps between checkpoints
MAGIC = b"TWANS2\0\0"
FIXED = "<IIQIIIQII"  # part, segment, ids before, bits, lanes, blocks, ids, bytes of tables, bytes of index
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_WORD = np.uint64(0xFFFFFFFF)


def scaled_frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to 2**bits, each at least 1.

    Rounding errors are taken from (or given to) the largest entries, in a fixed
    order, so that equal counts always give equal tables.
    """
    total = 1 << bits
    if len(counts) > total:
        raise ValueError(f"{len(counts)} symbols do not fit in {bits} bits")
    freq = np.maximum(1, counts * total // counts.sum()).astype(np.int64)
    excess = int(freq.sum()) - total
    order = np.lexsort((np.arange(len(freq)), -freq))
    if excess < 0:
        freq[order[0]] -= excess
    while excess > 0:
        for k in order:
            take = min(excess, int(freq[k]) // 2)
            freq[k] -= take
            excess -= take
            if not excess:
                break
    return freq


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, doc_tokens: np.ndarray, part: int = 0, segment: int = 0, before: int = 0) -> bytes:
    """A segment of ``ids`` (uint32), which are those of the documents in order;
    ``before``: how many ids its part holds before it."""
    symbols, where, counts = _distinct(ids)
    body = []
    bits = 0
    if len(ids):
        least = int(len(symbols) - 1).bit_length()
        bits = max(least, min(24, max(12, least + 3)))
        freq = scaled_frequencies(counts, bits)
        start = np.concatenate(([0], np.cumsum(freq)[:-1]))
        per = LANES * STEPS
        full = len(ids) // per
        if full:
            body += _encode_blocks(where[: full * per].reshape(full, STEPS, LANES), freq, start, bits)
        if len(ids) % per:
            body += _encode_blocks(where[full * per :].reshape(1, 1, -1) if len(ids) % per < LANES else _rows(where[full * per :]), freq, start, bits, len(ids) % per)
    crcs = [zlib.crc32(ids[k * LANES * STEPS : (k + 1) * LANES * STEPS].astype("<u4").tobytes()) for k in range(len(body))]
    table = _pack(symbols.astype("<u4")) + _pack((freq if len(ids) else np.zeros(0)).astype("<u4"))
    index = _pack(doc_ids.astype("<i8")) + _pack(doc_tokens.astype("<u4"))
    heads = b"".join(struct.pack("<III", len(b), zlib.crc32(b), c) for b, c in zip(body, crcs, strict=True))
    fixed = struct.pack(FIXED, part, segment, before, bits, LANES, len(body), len(ids), len(table), len(index))
    head = MAGIC + fixed + struct.pack("<I", zlib.crc32(fixed + table + index + heads))
    return head + table + index + heads + b"".join(body)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ids, the place of each id among them, and their counts."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    return symbols, place[ids], counts[symbols]


def _pack(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    packed = pa.compress(raw, codec="zstd", asbytes=True)
    return struct.pack("<II", len(raw), len(packed)) + packed


def _unpack(buf: bytes, at: int, dtype: str) -> tuple[np.ndarray, int]:
    raw, packed = struct.unpack_from("<II", buf, at)
    at += 8
    out = pa.decompress(buf[at : at + packed], raw, codec="zstd", asbytes=True)
    return np.frombuffer(out, dtype), at + packed


def _rows(flat: np.ndarray) -> np.ndarray:
    """One block of full rows; the last row is filled up (its fill is not coded)."""
    rows = -(-len(flat) // LANES)
    out = np.zeros(rows * LANES, flat.dtype)
    out[: len(flat)] = flat
    return out.reshape(1, rows, LANES)


def _encode_blocks(where: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int, count: int | None = None) -> list[bytes]:
    """Each block: states, checkpoints, words.  ``count``: ids of a single block
    whose last row is not full."""
    blocks, steps, lanes = where.shape
    shift = np.uint64(bits)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    limit = freq << np.uint64(63 - bits)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words = np.zeros((blocks, steps, lanes), np.uint32)
    used = np.zeros((blocks, steps, lanes), bool)
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        s = where[:, t, :]
        f = freq[s]
        put = x >= limit[s]
        words[:, t, :] = (x & _WORD).astype(np.uint32)
        y = np.where(put, x >> _32, x)
        q = y // f
        y = (q << shift) + (y - q * f) + start[s]
        last = lanes if count is None or t < steps - 1 else count - t * lanes
        if last < lanes:
            put[:, last:] = False
            y[:, last:] = x[:, last:]
        used[:, t, :] = put
        x = y
        if t and t % CHECKPOINT == 0:
            marks[t] = x.copy()
    out = []
    for b in range(blocks):
        offsets = np.concatenate(([0], np.cumsum(used[b].sum(axis=1))))
        own = words[b][used[b]]
        n = steps * lanes if count is None else count
        points = sorted(marks)
        head = struct.pack("<IIII", n, lanes, len(own), len(points))
        head += x[b].astype("<u8").tobytes()
        for t in points:
            head += struct.pack("<II", t, int(offsets[t])) + marks[t][b].astype("<u8").tobytes()
        out.append(head + own.astype("<u4").tobytes())
    return out


class Segment:
    """Reader of a segment's bytes; raises ValueError where a checksum fails."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no token segment")
        size = struct.calcsize(FIXED)
        if len(data) < 12 + size:
            raise ValueError("the segment is cut")
        fixed = data[8 : 8 + size]
        self.part, self.segment, self.before, self.bits, _, self.blocks, self.n_ids, table, index = struct.unpack(FIXED, fixed)
        at = 8 + size
        (crc,) = struct.unpack_from("<I", data, at)
        at += 4
        end = at + table + index + 12 * self.blocks
        if crc != zlib.crc32(fixed + data[at:end]):
            raise ValueError("the segment's head is damaged")
        self.symbols, p = _unpack(data, at, "<u4")
        self.freq, p = _unpack(data, p, "<u4")
        self.doc_ids, p = _unpack(data, p, "<i8")
        self.doc_tokens, p = _unpack(data, p, "<u4")
        self.heads = [struct.unpack_from("<III", data, p + 12 * k) for k in range(self.blocks)]
        self.data, self.at = data, end
        if len(data) != end + sum(n for n, _, _ in self.heads):
            raise ValueError("the segment is cut, or has more than its blocks")

    def ids(self) -> np.ndarray:
        """All ids (uint32); every span between checkpoints decodes side by side."""
        out = np.zeros(self.n_ids, np.uint32)
        if not self.n_ids:
            return out
        spans: dict[tuple[int, int, int], list] = {}
        at, first = self.at, 0
        for k, (size, stored, _) in enumerate(self.heads):
            if zlib.crc32(self.data[at : at + size]) != stored:
                raise ValueError(f"block {k} is damaged")
            n, lanes, n_words, points = struct.unpack_from("<IIII", self.data, at)
            p = at + 16
            starts = [(0, 0, np.frombuffer(self.data, "<u8", lanes, p))]
            p += 8 * lanes
            for _k in range(points):
                t, offset = struct.unpack_from("<II", self.data, p)
                starts.append((t, offset, np.frombuffer(self.data, "<u8", lanes, p + 8)))
                p += 8 + 8 * lanes
            words = np.frombuffer(self.data, "<u4", n_words, p)
            steps = -(-n // lanes)
            for k, (t, offset, state) in enumerate(starts):
                until = starts[k + 1][0] if k + 1 < len(starts) else steps
                count = min(n, until * lanes) - t * lanes
                after = starts[k + 1][2] if k + 1 < len(starts) else np.full(lanes, _LOW)
                spans.setdefault((until - t, lanes, count), []).append((first + t * lanes, state, words[offset : starts[k + 1][1] if k + 1 < len(starts) else n_words], after))
            at += size
            first += n
        slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        freq = self.freq.astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        for (steps, lanes, count), group in spans.items():
            for k in range(0, len(group), 64):
                part = group[k : k + 64]
                got = self._decode(part, steps, lanes, count, slot, freq, start)
                for (to, *_), row in zip(part, got, strict=True):
                    out[to : to + count] = row[:count]
        per = LANES * STEPS
        for k, (_, _, crc) in enumerate(self.heads):
            if zlib.crc32(out[k * per : (k + 1) * per].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {k} is damaged")
        return out

    def _decode(self, group, steps, lanes, count, slot, freq, start) -> np.ndarray:
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        x = np.array([s for _, s, _, _ in group], np.uint64)
        sizes = np.array([len(w) for _, _, w, _ in group])
        base = (np.cumsum(sizes) - sizes)[:, None]
        words = np.concatenate([w for _, _, w, _ in group] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        out = np.zeros((len(group), steps * lanes), np.uint32)
        for t in range(steps):
            low = x & mask
            s = slot[low]
            y = freq[s] * (x >> shift) + low - start[s]
            need = y < _LOW
            last = lanes if t < steps - 1 else count - t * lanes
            if last < lanes:
                need[:, last:], y[:, last:] = False, x[:, last:]
            seen = np.cumsum(need, axis=1)
            take = np.where(need, base + seen - 1, len(words) - 1)
            x = np.where(need, (y << _32) | words[take], y)
            base = base + seen[:, -1:]
            out[:, t * lanes : (t + 1) * lanes] = self.symbols[s]
        if not np.array_equal(x, np.array([end for *_, end in group])):
            raise ValueError("a span does not end in its checkpoint's states")
        return out

    def documents(self):
        """(doc_id, ids) in file order."""
        ids, at = self.ids(), 0
        for doc, n in zip(self.doc_ids.tolist(), self.doc_tokens.tolist(), strict=True):
            yield doc, ids[at : at + n]
            at += n
