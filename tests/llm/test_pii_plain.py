"""Pseudonyms against a plain version: Python loops for the finding, the checks
and the permutations."""

import calendar
import datetime
import hashlib
import os
import re
import time

import pytest

from tidewatch.llm import pii

SMALL = "/root/testdata/sf0.001"
KEY = "plain key"
LETTERS = {"d": "0123456789", "n": "23456789", "b": "01", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "H": "0123456789ABCDEF"}
LETTERS |= {k: pii.ALPHABETS[k] for k in "aA"}


def feistel(value, mask, key):
    free = [k for k, m in enumerate(mask) if m in LETTERS]
    sizes = [len(LETTERS[mask[k]]) for k in free]
    numbers = [LETTERS[mask[k]].index(value[k]) for k in free]
    half = len(free) // 2
    x, y = numbers[:half], numbers[half:]
    for r in range(8):
        book = sizes[:half] if r % 2 == 0 else sizes[half:]
        secret = f"{key}|{mask}|{r}|{','.join(map(str, y))}"
        digits = "".join(hashlib.sha512(f"{secret}|{k}".encode()).hexdigest() for k in range(len(x) // 32 + 1))
        x, y = y, [(v + int(digits[4 * k : 4 * k + 4], 16)) % n for k, (v, n) in enumerate(zip(x, book, strict=True))]
    out = list(value)
    for k, v in zip(free, x + y, strict=True):
        out[k] = LETTERS[mask[k]][v]
    return "".join(out)


def pair(x, y, sizes, key):
    for r in range(8):
        by = int(hashlib.sha256(f"{key}|{r}|{x if r % 2 else y}".encode()).hexdigest()[:12], 16)
        if r % 2:
            y = (y + by) % sizes[1]
        else:
            x = (x + by) % sizes[0]
    return x, y


def kinds_of(text):
    return "".join(next((k for k in "dluaA" if c in LETTERS[k]), c) for c in text)


def email(v):
    head = v[: v.rindex(".", 0, v.rindex(".")) + 1] if v.count(".", v.index("@")) > 1 else v[: v.index("@") + 1]
    return feistel(v, kinds_of(head) + "=" * (len(v) - len(head)), f"{KEY}|email")


def ip(v):
    parts = v.split(".")
    low = [{1: 0, 2: 10, 3: 100}[len(p)] for p in parts]
    n = [{1: 10, 2: 90, 3: 156}[len(p)] for p in parts]
    a, b, c, d = (int(p) - q for p, q in zip(parts, low, strict=True))
    x, y = pair(a * n[1] + b, c * n[3] + d, (n[0] * n[1], n[2] * n[3]), f"{KEY}|ip")
    return ".".join(str(k + q) for k, q in zip((x // n[1], x % n[1], y // n[3], y % n[3]), low, strict=True))


def ssn(v):
    area, group, serial = map(int, v.split("-"))
    areas = [k for k in range(1, 900) if k != 666]
    x, y = pair(areas.index(area) * 99 + group - 1, serial - 1, (898 * 99, 9999), f"{KEY}|ssn")
    return f"{areas[x // 99]:03}-{x % 99 + 1:02}-{y + 1:04}"


def date(v):
    day = datetime.date.fromisoformat(v)
    first = datetime.date(1800, 1, 1).toordinal()
    cycle = sum(366 if calendar.isleap(y) else 365 for y in range(1800, 2200))
    at = (day.toordinal() - first) % cycle
    x, y = pair(at // 773, at % 773, (189, 773), f"{KEY}|date")
    return datetime.date.fromordinal(day.toordinal() - at + x * 773 + y).isoformat()


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10


def card(v):
    if luhn(v):
        return v
    moved = feistel(v, "=" + "d" * (len(v) - 2) + "=", f"{KEY}|card")[:-1]
    return next(moved + c for c in "0123456789" if luhn(moved + c) == 0)


def phone(v):
    area, exchange = v[4], v[10] if v[9] == " " else v[9]
    mask = list(v)
    for k, c in enumerate(v):
        if k > 1 and c.isdigit():
            mask[k] = "d"
    at = v.index(")") + 2
    mask[4], mask[at] = ("b" if area < "2" else "n"), ("b" if exchange < "2" else "n")
    return feistel(v, "".join(mask), f"{KEY}|phone")


def secret(v):
    return feistel(v, ("h" if re.search("[a-f]", v) else "H") * len(v), f"{KEY}|secret")


#: The forms that stand in the test texts, one rule each.
PLAIN = [
    (r"[^\W_][\w.%+\-]*@(?:[\w\-]+\.)+[^\W\d_]{2,}", email), (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", lambda v: ip(v) if all(int(p) < 256 and str(int(p)) == p for p in v.split(".")) else v),
    (r"(?<![\d./\-])\d{4}-\d\d-\d\d(?![\d/\-]|\.\d)", date), (r"(?<![\d\-])\d{3}-\d\d-\d{4}(?![\d\-])", ssn), (r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)", secret),
    (r"\+1 \(\d{3}\) \d{3}-\d{4}", phone), (r"(?<![\d.\-])\d{13,19}(?![\d\-]|\.\d)", card),
]


def plain(text):
    for pattern, change in PLAIN:
        parts, at = [], 0
        for m in re.finditer(pattern, text):
            parts += [text[at : m.start()], "\0" + change(m.group()).translate({k: 0xE000 + k for k in range(128)}) + "\0"]
            at = m.end()
        text = "".join([*parts, text[at:]])
    return "".join(chr(ord(c) - 0xE000) if 0xE000 <= ord(c) < 0xE080 else c for c in text.replace("\0", ""))


def test_every_kind_against_the_plain_version(spark):
    texts = ["a une.92@mail6.example.com b", "at 161.17.88.162.", "born 1985-03-12", "no 123-45-6789, 899-01-0001, 001-99-9999", "pay 4844508665317339", "call +1 (696) 555-2293 or +1 (017) 155-7713", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).collect()} == {k: plain(t) for k, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_a_whole_table_against_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).collect()}
    assert sum(before[d] != after[d] for d in before) > 10
    assert after == {d: plain(t) for d, t in before.items()}


def test_long_texts_take_linear_time(spark):
    long = ["a" * 1_000_000, "a." * 500_000, "7" * 1_000_000, "a@" * 300_000, "x@" + "a." * 300_000, "1 " * 300_000, "1.1.1.1." * 100_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).collect()}
    assert time.perf_counter() - began < 90 and got[0] == long[0] and got[2] == long[2]


def test_the_key_is_secret(spark):
    docs = spark.createDataFrame([(1, "123-45-6789")], "doc_id long, text string")
    one, two = (pii.pseudonymise(docs, k).first().text for k in ("k1", "k2"))
    assert one != two and re.fullmatch(r"\d{3}-\d\d-\d{4}", one)
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(docs, "")
    assert pii.session_key(spark) == pii.session_key(spark) != ""
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert pii.session_key(spark) == "given"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
