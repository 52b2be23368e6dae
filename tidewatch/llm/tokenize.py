"""Token ids by the tokenizers library, each distinct chunk encoded once.

For a byte-level BPE file without normalizer, texts are cut before each space
that follows a character other than white space: the pre-tokenizer always cuts
there, and nothing before it changes what follows.  The chunks of many texts are
hashed, counted and looked up in whole arrays; chunks new to the worker are cut
into pre-tokens and go to the library in long lists, and what it gives is
remembered.  A remembered chunk is compared byte by byte with each chunk that
takes its ids, so a clash of hashes cannot change a result.

A text of more than ``2 * PART`` characters goes through this part by part.  Any
other file, and any text that holds one of the file's added tokens, goes
through the library's ``encode_batch`` on whole texts.  The ids are those of
``encode(text, add_special_tokens=False)`` either way, with the file's own
truncation and padding turned off.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .bpe import SPLIT_PATTERN, byte_alphabet
from .common import claim_memory

_BASE = 0x9E3779B97F4A7C15 | 1  # an odd number: it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_FIRST = 1 << 16
PART = 400_000  # characters of a long text that are hashed and looked up at once, about


class _Powers:
    """Powers of a number modulo 2**64, as many as were asked for yet."""

    def __init__(self, of: int):
        self.of, self.known = of, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.of, len(self.known), 1 << 64))
            self.known = np.concatenate((self.known, self.known * step))
        return self.known[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)
_SALT = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def chunk_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin; ``raw`` holds the UTF-8 bytes of all texts
    one after another."""
    cut = np.flatnonzero(raw == 32)
    cut = cut[cut > 0]
    before = raw[cut - 1]
    cut = cut[~_ASCII_SPACE[before]]
    wide = np.flatnonzero(raw[cut - 1] >= 128)  # white space beyond ASCII ends in these bytes; others may, and are left whole too
    at = cut[wide]
    second, third = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    last = raw[at - 1]
    doubtful = (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (third == 0xE1) & (second == 0x9A) | (third == 0xE2) & ((second == 0x80) | (second == 0x81)) | (third == 0xE3) & (second == 0x80)
    keep = np.ones(len(cut), bool)
    keep[wide[doubtful]] = False
    marked = np.zeros(len(raw), bool)
    marked[cut[keep]] = True
    marked[text_starts] = True
    return np.flatnonzero(marked)


class _Pool:
    """Values of differing lengths one after another, in one growing array."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(_FIRST, kind), 0

    def add(self, values: np.ndarray) -> int:
        """The place of the values' first."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(self.used, len(self.data)), self.data.dtype)))
        self.data[at : self.used] = values
        return at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class LibraryEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``remember`` bounds the chunks kept, and ``remember_bytes`` their text; a full
    memory keeps what is common, or starts anew, which changes the time only.
    """

    def __init__(self, path: str, remember: int = 400_000, remember_bytes: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        alphabet = byte_alphabet()
        plain = model["type"] == "BPE" and not model.get("dropout") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.by_chunk = plain and all(c in model["vocab"] for c in alphabet.values())
        if not self.by_chunk:
            return
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.spaced = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
        self.words = Tokenizer(self.whole.model)  # the model alone, over pre-tokens between spaces
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.encode_words = getattr(self.words, "encode_batch_fast", self.words.encode_batch)
        pattern = regex.compile(SPLIT_PATTERN)
        self.findall, self.finditer = pattern.findall, pattern.finditer
        self.printable = np.array([ord(alphabet[b]) for b in range(256)], "<u2")
        self.printable[255] = 32  # no UTF-8 holds this byte: it parts the pre-tokens
        self.widths = np.zeros(1 + max(model["vocab"].values()), np.int64)
        for token, i in model["vocab"].items():
            self.widths[i] = len(token)  # one character of the alphabet for each byte
        self.limit, self.limit_bytes = remember, remember_bytes
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered."""
        if not self.by_chunk:
            return
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes, ascending; the chunk each stands for
        self.text, self.ids = _Pool(np.uint8), _Pool(np.uint32)
        self.spans = np.zeros((0, 4), np.int64)  # of each chunk: its text's place and length, its ids' place and number
        self.hits = np.zeros(0, np.int32)  # in how many batches each chunk stood

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._whole(texts)
        if any(len(t) > 2 * PART for t in texts):
            short = iter(self.encode_batch([t for t in texts if len(t) <= 2 * PART]))
            return [self._long(t) if len(t) > 2 * PART else next(short) for t in texts]
        raws = [t.encode() for t in texts]
        blob = b"".join(raws)
        if any(s.encode() in blob for s in self.specials):
            marked = [any(s in t for s in self.specials) for t in texts]
            if self.spaced:
                return self._whole(texts)
            out = iter(self._whole([t for t, m in zip(texts, marked, strict=True) if m]))
            rest = iter(self._by_chunk([r for r, m in zip(raws, marked, strict=True) if not m]))
            return [next(out) if m else next(rest) for m in marked]
        return self._by_chunk(raws, blob)

    def _long(self, text: str) -> bytes:
        """A long text by parts that end where a chunk does."""
        if any(s in text for s in self.specials):
            return self._whole([text])[0]
        out, at = bytearray(), 0
        while at < len(text):
            end = _cut(text, at + PART)
            if end - at > 4 * PART:  # hardly a space in it: its pre-tokens go to the library as they come
                out += self._streamed(text, at, end)
            else:
                out += self._by_chunk([text[at:end].encode()])[0]
            at = end
        return bytes(out)

    def _streamed(self, text: str, at: int, end: int) -> bytes:
        out, held, chars = bytearray(), [], 0
        for m in self.finditer(text, at, end):
            held.append(m.group())
            chars += len(held[-1])
            if chars >= PART:
                out += self._of_pieces(held).tobytes()
                held, chars = [], 0
        return bytes(out + self._of_pieces(held).tobytes())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _by_chunk(self, raws: list[bytes], blob: bytes | None = None) -> list[bytes]:
        blob = b"".join(raws) if blob is None else blob
        if not blob:
            return [b""] * len(raws)
        raw = np.frombuffer(blob, np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        text_ends = np.cumsum(sizes)
        starts = chunk_starts(raw, (text_ends - sizes)[sizes > 0])
        lengths = np.diff(starts, append=len(raw))
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SALT[raw] * _up(len(raw)))))
        hashes = (summed[starts + lengths] - summed[starts]) * _down(len(raw))[starts] ^ (lengths.astype(np.uint64) << np.uint64(48))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._places(distinct)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            if self._full(len(fresh), lengths[first[fresh]]):
                self._keep_common()
                known = self._places(distinct)
                fresh = np.flatnonzero(known < 0)
                if self._full(len(fresh), lengths[first[fresh]]):
                    self.forget()
                    fresh = np.arange(len(distinct))
            self._learn(distinct[fresh], blob, raw, starts[first[fresh]], lengths[first[fresh]])
            known = self._places(distinct)
        self.hits[known] += 1
        spans = self.spans[known[which]]
        if not np.array_equal(spans[:, 1], lengths) or not np.array_equal(self.text.data[ragged(spans[:, 0], lengths)], raw):
            return self._whole([r.decode() for r in raws])  # two chunks of one hash
        ids = self.ids.data[ragged(spans[:, 2], spans[:, 3])]
        before = np.concatenate(([0], np.cumsum(spans[:, 3])))
        bounds = before[np.searchsorted(starts, np.concatenate(([0], text_ends)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _full(self, chunks: int, lengths: np.ndarray) -> bool:
        return len(self.keys) + chunks > self.limit or self.text.used + int(lengths.sum()) > self.limit_bytes

    def _keep_common(self) -> None:
        """Forget the chunks that stood in few batches, so that half is free again."""
        least = 2
        while np.count_nonzero(self.hits >= least) > self.limit // 2 or int(self.spans[self.hits >= least, 1].sum()) > self.limit_bytes // 2:
            least *= 2
        kept = self.hits >= least
        now = np.cumsum(kept) - 1
        still = kept[self.place]
        self.keys, self.place = self.keys[still], now[self.place[still]]
        spans, self.hits = self.spans[kept], self.hits[kept] // 2
        text, ids = self.text.data[ragged(spans[:, 0], spans[:, 1])], self.ids.data[ragged(spans[:, 2], spans[:, 3])]
        self.text, self.ids = _Pool(np.uint8), _Pool(np.uint32)
        self.text.add(text)
        self.ids.add(ids)
        self.spans = np.stack((np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1], np.cumsum(spans[:, 3]) - spans[:, 3], spans[:, 3]), axis=1)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """The chunk of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.place[at], -1)

    def _learn(self, hashes: np.ndarray, blob: bytes, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Encode chunks and remember them; ``hashes`` ascend."""
        pieces: list[str] = []
        add, several, findall = pieces.append, pieces.extend, self.findall
        for a, n in zip(starts.tolist(), lengths.tolist()):
            chunk = blob[a : a + n].decode()
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                add(chunk)
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                add(chunk[:-1])
                add(chunk[-1])
            else:
                several(findall(chunk))
        ids = self._of_pieces(pieces)
        covered, ends = np.cumsum(self.widths[ids]), np.cumsum(lengths)
        stop = np.searchsorted(covered, ends) + 1  # ids up to each chunk's end: a byte is a token's own, so ends meet
        if not np.array_equal(covered[stop - 1], ends):
            raise ValueError("the tokenizer's ids do not spell the text")
        number = np.diff(stop, prepend=0)
        text_at, ids_at = self.text.add(raw[ragged(starts, lengths)]), self.ids.add(ids)
        new = np.stack((text_at + ends - lengths, lengths, ids_at + stop - number, number), axis=1)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.place = np.insert(self.keys, at, hashes), np.insert(self.place, at, len(self.spans) + np.arange(len(hashes)))
        self.spans = np.concatenate((self.spans, new))
        self.hits = np.concatenate((self.hits, np.zeros(len(new), np.int32)))


    def _of_pieces(self, pieces: list[str]) -> np.ndarray:
        """The ids of pre-tokens, one after another."""
        ids = [np.zeros(0, np.uint32)]
        for k in range(0, len(pieces), 100_000):
            groups = []
            for j in range(k, min(k + 100_000, len(pieces)), 1000):
                parted = np.frombuffer("\udcff".join(pieces[j : min(j + 1000, k + 100_000)]).encode("utf-8", "surrogateescape"), np.uint8)
                groups.append(self.printable[parted].tobytes().decode("utf-16-le"))
            ids += [np.array(e.ids, np.uint32) for e in self.encode_words(groups, add_special_tokens=False)]
        return np.concatenate(ids)


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a chunk begins: a space behind a
    character that is no white space."""
    while 0 <= (at := text.find(" ", at)):
        if not text[at - 1].isspace():
            return at
        at += 1
    return len(text)


_loaded: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    """One encoder for each worker process and file, kept between tasks."""
    claim_memory("tokenize", lambda: [e.forget() for e in _loaded.values()])
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def encoded(rows, path: str, at_once: int = 400_000):
    """(row, ids) for rows whose last field is the text; texts go to the encoder
    in groups of about ``at_once`` characters."""
    encoder, held, chars = loaded(path), [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1])
        if chars >= at_once:
            yield from zip(held, encoder.encode_batch([r[-1] for r in held]), strict=True)
            held, chars = [], 0
    if held:
        yield from zip(held, encoder.encode_batch([r[-1] for r in held]), strict=True)
