"""Spelling variants: near words by symmetric deletion, forms and roots.

Words are counted over whole texts.  Every word emits itself and each of its
single deletions with the place of the cut; words meet where these are equal.
Equal strings of one place are words that differ in that one letter, and a word
that equals another's deletion is one letter short of it: both are exact distance
one, so a meeting is its own check.  A key has at most as many words as there are
letters to put in at a place, and only counts and the best word leave it, never
its pairs.

Strings over ``KEY`` code points stand as 127-bit polynomial hashes; a form found
through one is checked letter by letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_rows, doc_text

KEY = 64
PIECE = 1 << 20  # code points of a text that are split into words at once
REMEMBERED = 200_000  # distinct words that a task counts before it hands them on

#: Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z go to lower case, all else parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15


def runs(text: str) -> Iterator[list[bytes]]:
    """The maximal runs of letters, as Latin-1 bytes, A-Z in lower case; long
    texts come in pieces that end between runs."""
    letters = text.encode("latin-1", "replace").translate(_TABLE)  # what Latin-1 does not hold parts words too
    at = 0
    while at < len(letters):
        end = letters.find(b" ", at + PIECE)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def typed(run: bytes, seed: int, every: int) -> bytes:
    """The run as written in a document: h is the crc32 of ``<doc_id>:<run>`` in
    UTF-8 (``seed``: that of the part up to the colon); where ``every`` divides
    h, code point h % length is missing.  0: no run is changed."""
    if every:
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def count_words(docs: DataFrame, least: int = 5, times: int = 3, every: int = 0) -> DataFrame:
    """``word, n``: words of at least ``least`` code points that stand at least
    ``times`` times in all texts.  ``every``: see :func:`typed`."""

    def make():
        def work(rows):
            counts: dict[bytes, int] = {}
            for doc, text in rows:
                seed = crc32(f"{'' if doc is None else doc}:".encode())
                for piece in runs(text):
                    for run, n in Counter(w for w in piece if len(w) >= least).items():
                        word = typed(run, seed, every)
                        if len(word) >= least:
                            counts[word] = counts.get(word, 0) + n
                    if len(counts) >= REMEMBERED:
                        yield from ((w.decode("latin-1"), n) for w, n in counts.items())
                        counts = {}
            yield from ((w.decode("latin-1"), n) for w, n in counts.items())

        return work

    counted = arrow_rows(doc_text(docs), ["doc_id", "text"], "word string, n long", make)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _long_key(h: int, length: int) -> str:
    return f"{length}#{h:032x}"  # no word holds '#'


def _long_keys(rows):
    """(key, place, wid, first) of long words: the hash of each deletion from the
    hashes of the parts around it."""
    for wid, word in rows:
        codes, m = word.encode("latin-1"), len(word)
        powers, before = [1], [0]
        for c in codes:
            powers.append(powers[-1] * _BASE % _PRIME)
            before.append((before[-1] * _BASE + c + 1) % _PRIME)
        whole = before[m]
        yield _long_key(whole, m), -1, wid, False
        for i in range(m):
            if m - 1 <= KEY:
                key = word[:i] + word[i + 1 :]
            else:
                key = _long_key((whole + (before[i] - before[i + 1]) * powers[m - 1 - i]) % _PRIME, m - 1)
            yield key, i, wid, not i or codes[i] != codes[i - 1]


def deletion_keys(words: DataFrame) -> DataFrame:
    """``key, place, wid, first`` of ``words`` (wid, word): the word itself at
    place -1, and its deletions by place; ``first``: no earlier place gives the
    same string."""
    n = F.char_length("word")
    cut = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2)).alias("key"), i.alias("place"), F.col("wid").alias("wid"),
            ((i == 0) | (F.substr("word", i + 1, F.lit(1)) != F.substr("word", i, F.lit(1)))).alias("first"),
        ),
    )
    itself = F.array(F.struct(F.col("word").alias("key"), F.lit(-1).alias("place"), F.col("wid").alias("wid"), F.lit(False).alias("first")))
    short = words.where(n <= KEY).select(F.inline(F.concat(itself, cut)))
    long = arrow_rows(words.where(n > KEY), ["wid", "word"], "key string, place int, wid long, first boolean", lambda: _long_keys)
    return short.unionByName(long)


def near_words(words: DataFrame) -> DataFrame:
    """``wid, n_near, best`` of the words (wid, word) that have near ones: their
    number, and the smallest wid among them."""
    by_key = Window.partitionBy("key").orderBy("place", "wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_place = Window.partitionBy("key", "place").orderBy("wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.col("place") < 0
    met = deletion_keys(words).select(
        "*", F.max(F.when(whole, F.col("wid"))).over(by_key).alias("shorter"), F.count(F.when(F.col("first"), 1)).over(by_key).alias("n_longer"), F.min(F.when(F.col("first"), F.col("wid"))).over(by_key).alias("longer")
    )
    met = met.select("*", F.count(F.lit(1)).over(by_place).alias("alike"), F.first("wid").over(by_place).alias("one"), F.nth_value("wid", 2).over(by_place).alias("two"))
    other = F.when(F.col("one") == F.col("wid"), F.col("two")).otherwise(F.col("one"))  # of one place: the letter there differs
    shorter = F.when(F.col("first"), F.col("shorter"))
    near = F.when(whole, F.col("n_longer")).otherwise(F.col("alike") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(whole, F.col("longer")).otherwise(F.least(other, shorter))
    found = met.select("wid", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``wid, root`` of ``forms`` (wid, form): the last one met on following
    forms.  Each round doubles how far a word looks, as each word's root is
    replaced by that one's own."""
    now, k = scratch.save(forms.select("wid", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0"), 0
    while now.where("moved").limit(1).count():
        there = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        k += 1
        now = scratch.save(now.join(there, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
    return now.select("wid", "root")


def spelling_variants(docs: DataFrame, least: int = 5, times: int = 3, every: int = 0) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word; see the module.

    Near words differ by one inserted, deleted or replaced code point.  The form
    is the near word of largest n (ties: smallest in code-point order) if that is
    at least twice the word's own, else null; the root is the last word met on
    following forms, the word itself if it has none.  Null text has no words, a
    null doc_id stands as an empty one in :func:`typed`; repeated rows count
    each; an empty table gives an empty result; columns besides doc_id and text
    are ignored.  Very long texts are read in pieces, and very long words have as
    many keys as letters.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(count_words(docs, least, times, every), "counted")
    # In the order of preference, so that the best of several words is the smallest number.
    words = scratch.save(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    near = scratch.save(near_words(words), "near")
    other = words.select(F.col("wid").alias("best"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    apart = F.levenshtein("word", "other", 1) != 1
    told = near.join(words, "wid").join(other, "best").where(F.col("other_n") >= 2 * F.col("n"))
    told = told.select("wid", F.col("best").alias("form"), F.when(apart, F.raise_error(F.lit("two long words have one hash"))).otherwise(F.col("other")).alias("form_word"), F.col("other_n").alias("form_n"))
    formed = scratch.save(told, "formed")
    ends = roots(formed.select("wid", "form"), scratch).join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    out = words.join(near.select("wid", "n_near"), "wid", "left").join(formed.select("wid", "form_word", "form_n"), "wid", "left").join(ends, "wid", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
