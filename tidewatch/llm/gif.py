"""GIF files: LZW code streams, palettes, frame composition, timed frames.

``encode`` stores 8-bit samples losslessly as an animation, ``decode`` reads any
GIF87a/89a: LZW code streams of every code size, global and local palettes,
interlace, transparency, the disposal methods and delays.  A decoded frame is the
whole canvas as it is shown, with its time and a colour histogram.

Code streams are decoded with numpy: between two clear codes the width of each
code depends on its position alone, so all codes are cut out at once; the output
of code j is that of an earlier code and one sample more, so each output sample
points to an earlier one, and pointer doubling resolves them all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows, doc_text

#: Samples are padded with this byte to a positive multiple of this row length.
PAD, ROW = b" ", 192
ROWS_PER_FRAME = 128
DELAY_CS = 10  # hundredths of a second for each frame
TABLE = 4096


@dataclass
class Frame:
    """A shown canvas: RGB samples (height x width x 3), when and how long."""

    rgb: np.ndarray
    start_ms: int
    duration_ms: int
    indices: np.ndarray  # the frame's own samples, in its rectangle
    palette: np.ndarray


# LZW -------------------------------------------------------------------------


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; the table starts anew when it is full."""
    clear, end = 256, 257
    spans: list[list[int]] = []
    table: dict[int, int] = {}
    get, after, run = table.get, 258, []
    word = samples[0] << 8 if samples else -1
    for b in samples[1:]:
        key = word | b
        code = get(key)
        if code is not None:
            word = code
            continue
        run.append(word >> 8)
        word = b << 8
        if after == TABLE:
            spans.append(run)
            run, after = [], 258
            table.clear()
        else:
            table[key] = after << 8
            after += 1
    if samples:
        run.append(word >> 8)
    spans.append(run)
    codes, widths = [np.array([clear])], [np.array([9])]
    for k, run in enumerate(spans):
        codes.append(np.array(run + [end if k == len(spans) - 1 else clear]))
        widths.append(_widths(8, len(run) + 1))
    return _pack_bits(np.concatenate(codes), np.concatenate(widths))


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the table has gained an entry with
    each code but the first, and a width holds until the table outgrows it."""
    return _all_widths(size, n if n > 4 * TABLE else 4 * TABLE)[:n]


@lru_cache(16)
def _all_widths(size: int, n: int) -> np.ndarray:
    known = np.minimum((1 << size) + 2 + np.maximum(np.arange(n) - 1, 0), TABLE - 1)
    return np.maximum(size + 1, np.floor(np.log2(known)).astype(np.int64) + 1)


def _pack_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    spread, byte = codes.astype(np.int64) << (at & 7), at >> 3
    size = (int(ends[-1]) + 7 >> 3) + 3
    out = sum(np.bincount(byte + k, spread >> 8 * k & 255, size) for k in range(3))  # bits of two codes never meet: sums are unions
    return out[: size - 3].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int, expected: int) -> np.ndarray:
    """At most ``expected`` samples of a code stream with this minimum code size.

    A stream that ends early or is damaged gives the samples up to there.
    """
    clear, end = 1 << size, (1 << size) + 1
    padded = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    three = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    total, bit, out, got = 8 * len(data), 0, [], 0
    span = 4 * TABLE
    while got < expected and bit < total:
        widths = _widths(size, span)
        ends = _ends(size, span)
        n = int(np.searchsorted(ends, total - bit, side="right"))
        if not n:
            break
        at = bit + ends[:n] - widths[:n]
        codes = (three[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else n
        part, sound = _expand(codes[:k].astype(np.int64), size)
        out.append(part)
        got += len(part)
        if not sound:
            break
        if not len(stop):
            if n < span:
                break
            span *= 4  # a table that is full and never cleared: one longer cut
            out.pop()
            got -= len(part)
            continue
        if codes[k] == end:
            break
        bit += int(ends[k])
    return np.concatenate(out)[:expected] if out else np.zeros(0, np.uint8)


@lru_cache(64)
def _ends(size: int, n: int) -> np.ndarray:
    return np.cumsum(_widths(size, n))


def _expand(codes: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Samples of the codes between two clear codes; False if one is unknown."""
    first = (1 << size) + 2
    j = np.arange(len(codes))
    known = codes < np.minimum(first + j, TABLE)  # code j may be the entry being made
    if len(codes):
        known[0] = codes[0] < first - 2
    bad = np.flatnonzero(~known)
    if len(bad):
        codes, j = codes[: bad[0]], j[: bad[0]]
    if not len(codes):
        return np.zeros(0, np.uint8), not len(bad)
    literal = codes < first
    before = np.where(literal, j, codes - first)  # entry first + i: output of code i and one sample more
    depth, hop = (~literal).astype(np.int64), before.copy()
    while True:
        further = hop[hop]
        if (further == hop).all():
            break
        depth = depth + depth[hop]
        hop = further
    lengths = depth + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = int(ends[-1])
    shift = np.repeat(starts - starts[before], lengths)
    source = np.arange(n) - shift  # itself for literals
    values = np.zeros(n, np.uint8)
    values[starts[literal]] = codes[literal]
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return values[source], not len(bad)


# files -----------------------------------------------------------------------


@lru_cache(1)
def sample_palette() -> np.ndarray:
    """256 distinct colours, by bits: 3 of red, 3 of green, 2 of blue."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 36, (k >> 2 & 7) * 36, (k & 3) * 85], axis=1).astype(np.uint8)


def encode(payload: bytes, row: int = ROW, rows_per_frame: int = ROWS_PER_FRAME) -> bytes:
    """A GIF89a whose frames hold ``payload`` (whole rows) as palette indices."""
    rows = len(payload) // row
    height = min(rows, rows_per_frame)
    out = [b"GIF89a", struct.pack("<HHBBB", row, height, 0xF7, 0, 0), sample_palette().tobytes()]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for at in range(0, rows, height):
        part = payload[at * row : (at + height) * row]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(block)]) + block for k in range(0, len(stream), 255) if (block := stream[k : k + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


MOST_PIXELS = 1 << 25  # of a canvas or a frame's rectangle, unless a reader asks for more


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> list[Frame]:
    """The frames of a GIF, composed; ValueError if it is none."""
    return list(frames_of(data, most_pixels))


def frames_of(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames one by one.  A file that is cut gives those before the cut, the
    last as far as its samples go.  ValueError if it is no GIF, or if its canvas
    or a frame has more than ``most_pixels`` pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF file")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = _palette(data, at, n), at + 3 * n
    if width * height > most_pixels:
        raise ValueError(f"a canvas of {width} x {height} is too large")
    canvas = np.zeros((height, width, 3), np.uint8)
    if shared is not None and background < len(shared):
        canvas[:] = shared[background]
    empty = canvas[:1, :1].copy() if canvas.size else canvas
    delay, disposal, transparent, clock = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if at + 2 > len(data):
                break
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if kind != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette, at = _palette(data, at, n), at + 3 * n
        if at >= len(data):
            break
        if w * h > most_pixels:
            raise ValueError(f"a frame of {w} x {h} is too large")
        size = data[at]
        stream, at = _blocks(data, at + 1)
        samples = np.zeros(w * h, np.uint8)
        if 1 <= size <= 8:
            got = lzw_decode(stream, size, w * h)
            samples[: len(got)] = got
        samples = samples.reshape(h, w)
        if packed & 0x40:  # interlaced: four passes of rows
            order = [r for s, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, step)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        palette = np.zeros((256, 3), np.uint8) if palette is None else palette
        held = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        part = samples[: area.shape[0], : area.shape[1]]
        colours = palette[np.minimum(part, len(palette) - 1)]
        if transparent is None:
            area[:] = colours
        else:
            shown = part != transparent
            area[shown] = colours[shown]
        yield Frame(canvas.copy(), clock, delay * 10, samples, palette)
        clock += delay * 10
        if disposal == 2 and canvas.size:
            area[:] = empty
        elif held is not None:
            canvas = held
        delay, disposal, transparent = 0, 0, None


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)


def colour_histogram(rgb: np.ndarray, bits: int = 2) -> np.ndarray:
    """Counts of the colours by the top bits of red, green and blue."""
    top = (rgb >> (8 - bits)).astype(np.int64)
    return np.bincount((top[..., 0] << 2 * bits | top[..., 1] << bits | top[..., 2]).ravel(), minlength=1 << 3 * bits)


def samples_of(frames: list[Frame]) -> bytes:
    """The samples :func:`encode` stored, found by their colours on the canvas."""
    out = []
    for f in frames:
        place = np.zeros(1 << 8, np.uint8)
        own = f.palette.astype(np.uint16)
        place[(own[:, 0] // 36 << 5 | own[:, 1] // 36 << 2 | own[:, 2] // 85)] = np.arange(len(own))
        shown = f.rgb[: f.indices.shape[0], : f.indices.shape[1]].astype(np.uint16)
        out.append(place[shown[..., 0] // 36 << 5 | shown[..., 1] // 36 << 2 | shown[..., 2] // 85].tobytes())
    return b"".join(out)


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    rows = max(1, -(-len(raw) // ROW))
    return len(raw), raw.ljust(rows * ROW, PAD)


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a GIF (null: empty text)."""

    def make():
        def work(rows):
            for doc, text in rows:
                n, payload = padded(text)
                yield doc, n, encode(payload)

        return work

    return arrow_rows(doc_text(docs), ["doc_id", "text"], "doc_id long, n_bytes long, media binary", make, 64)


FRAME_SCHEMA = "media_id long, frame int, start_ms long, duration_ms long, width int, height int, rgb binary, histogram array<long>"


def decode_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per shown frame: times, canvas (RGB bytes), colour histogram.

    Null media, and bytes that are no GIF, give no frame; a file that is cut or
    asks for more than ``most_pixels`` gives the frames before that; repeated rows
    give their frames each.  A task holds one frame at a time.
    """

    def make():
        def work(rows):
            for key, data in rows:
                frames, k = frames_of(data or b"", most_pixels), 0
                while True:
                    try:
                        f = next(frames)
                    except (StopIteration, ValueError):
                        break
                    h, w = f.rgb.shape[:2]
                    yield key, k, f.start_ms, f.duration_ms, w, h, f.rgb.tobytes(), colour_histogram(f.rgb).tolist()
                    k += 1

        return work

    return arrow_rows(media, [id_col, media_col], FRAME_SCHEMA, make, 16)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a GIF, read back, with digests and features.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_frames, duration_ms``; the feature is the colour
    histogram of all frames (64 counts, comma-separated).  Null text counts as
    empty; repeated rows and equal texts give equal values; a null doc_id is kept;
    an empty table gives no row; a very long text is many frames, held by the task
    that reads it.  Columns besides doc_id and text are ignored.
    """

    def make():
        def work(rows):
            for doc, text in rows:
                n, payload = padded(text)
                data = encode(payload)
                frames = decode(data)
                back = samples_of(frames)
                histogram = sum(colour_histogram(f.rgb) for f in frames)
                yield (
                    doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                    ",".join(map(str, histogram.tolist())), len(frames), sum(f.duration_ms for f in frames),
                )

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    return arrow_rows(doc_text(docs), ["doc_id", "text"], schema, make)
