"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
lie inside a merged token: every merge result is itself a token.  Such a pair is
a *forced boundary*.  A text is cut at the boundaries of the pre-tokenizer and at
every forced boundary, the fragments are encoded independently (and remembered,
since they repeat), and the ids are concatenated.

Results equal ``tokenizers``' ``encode(text, add_special_tokens=False)`` and
``decode(ids, skip_special_tokens=False)`` for a byte-level BPE file without
normalizer; other files are refused when loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from .common import arrow_rows, claim_memory, doc_text

#: The split pattern of the byte-level pre-tokenizer, as its library defines it.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in character for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in byte order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


_SPACE_AFTER_SPACE = re.compile(r"\s ").search


class SpaceCuts:
    """Splits text into chunks that the pre-tokenizer never joins.

    A space after a character that is not white space always starts a new
    pre-token, and nothing before it can change what follows.  So text is cut
    before each such space, and each chunk is encoded by itself; runs of white
    space stay inside one chunk.
    """

    def __init__(self, specials: list[str]):
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.findall = regex.compile(SPLIT_PATTERN).findall

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; plain words need no pattern."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[:-1].isalpha() and word[-1] in ".,":
            return [chunk[:-1], chunk[-1]]
        return self.findall(chunk)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks, each without the space it starts with (but the first, which
        has none)."""
        parts = text.split(" ")
        if text[:1] != " " and not _SPACE_AFTER_SPACE(text):
            return parts
        out, held = [], None
        for p in parts:
            held = p if held is None else f"{held} {p}"
            if p and not p[-1].isspace():
                out.append(held)
                held = None
        if held is not None:
            out.append(held)
        return out

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if self.special is None:
            yield False, text
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        if at < len(text):
            yield False, text[at:]


class _Chunks(dict):
    """Encoded chunks, remembered; ``limit`` bounds the entries, and a full
    memory starts anew."""

    def __init__(self, encode, lead: str, limit: int):
        self.encode, self.lead, self.limit = encode, lead, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.lead + chunk)
        if len(self) >= self.limit:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class ForcedBoundaryBpe:
    """Encoder and decoder over a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, remember: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        back = {c: b for b, c in byte_alphabet().items()}
        as_bytes = lambda token: bytes(back[c] for c in token)
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in specials}
        self.table: list[bytes] = [b""] * (1 + max([*ids.values(), *specials.values()]))
        for token, i in ids.items():
            self.table[i] = token
        self.inside = bytearray(65536)
        for token in ids:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = 1
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}  # of a pair of ids
        self.made: list[int] = []  # the id that a rank's merge gives
        for pair in model["merges"]:
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault(ids[a] << 32 | ids[b], len(self.made))
            self.made.append(ids[a + b])
        self.special_ids = {}
        for token, i in specials.items():
            self.table[i] = token.encode()
            self.special_ids[token] = array("I", [i]).tobytes()
        self.cuts = SpaceCuts(list(specials))
        self.fragments: dict[bytes, bytes] = {}
        self.limit = remember
        self.first = _Chunks(self._chunk, "", remember)
        self.later = _Chunks(self._chunk, " ", remember)

    def forget(self) -> None:
        """Drop what is remembered."""
        for memory in (self.first, self.later, self.fragments):
            memory.clear()

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for special, part in self.cuts.segments(text):
            if special:
                out.append(self.special_ids[part])
            else:
                head, *rest = self.cuts.chunks(part)
                out.append(self.first[head] if head else b"")
                out.extend(map(self.later.__getitem__, rest))
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I").tolist()))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def forced_fragments(self, piece: bytes) -> Iterator[bytes]:
        """``piece`` cut between any two bytes that stand together in no token."""
        inside, start = self.inside, 0
        for k in range(1, len(piece)):
            if not inside[piece[k - 1] << 8 | piece[k]]:
                yield piece[start:k]
                start = k
        yield piece[start:]

    def _chunk(self, chunk: str) -> bytes:
        known, out = self.fragments, []
        for piece in self.cuts.pieces(chunk):
            for fragment in self.forced_fragments(piece.encode()):
                ids = known.get(fragment)
                if ids is None:
                    ids = array("I", self._merge([self.byte_ids[b] for b in fragment])).tobytes()
                    if len(known) >= self.limit:
                        known.clear()
                    if len(fragment) <= 64:
                        known[fragment] = ids
                out.append(ids)
        return b"".join(out)

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, made, never = self.rank.get, self.made, 1 << 60
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            k = ranks.index(low)
            ids[k : k + 2] = [made[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 32 | ids[k], never)
            if k < len(ranks):
                ranks[k] = rank(ids[k] << 32 | ids[k + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for long fragments."""
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := rank(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, k, a, b = heapq.heappop(heap)
            r = after[k] if ids[k] >= 0 else n
            if r >= n or ids[k] != a or ids[r] != b:
                continue
            ids[k], ids[r] = made[low], -1
            after[k] = after[r]
            if after[r] < n:
                before[after[r]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if y < n and (m := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


_loaded: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder for each worker process and file, kept between tasks."""
    claim_memory("bpe", lambda: [e.forget() for e in _loaded.values()])
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every
    whole text.

    Null text counts as empty and gives no ids; a null doc_id is kept; repeated
    rows give repeated results; an empty table gives no row; columns besides
    doc_id and text are ignored.
    """

    def make():
        bpe = loaded(tokenizer_path)
        return lambda rows: ((doc, bpe.encode(text)) for doc, text in rows)

    return arrow_rows(doc_text(docs), ["doc_id", "text"], "doc_id long, ids binary", make, 256)


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id`` and ``text`` from :func:`encode_documents`' ids (null: empty)."""

    def make():
        bpe = loaded(tokenizer_path)
        return lambda rows: ((doc, bpe.decode(ids or b"")) for doc, ids in rows)

    return arrow_rows(encoded, ["doc_id", "ids"], "doc_id long, text string", make, 256)


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of ids and of the decoded text, per document, in one pass.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256, same`` (whether the decoded
    text is the text).  Null text counts as empty; a null doc_id is kept, repeated
    ids and rows give a row each; an empty table gives no row; a very long text is
    encoded by the task that reads it, in some fifty bytes of memory a byte.
    Columns besides doc_id and text are ignored.
    """

    def make():
        bpe = loaded(tokenizer_path)

        def work(rows):
            for doc, text in rows:
                ids = bpe.encode(text)
                back = bpe.decode(ids)
                yield doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text

        return work

    return arrow_rows(doc_text(docs), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean", make)
