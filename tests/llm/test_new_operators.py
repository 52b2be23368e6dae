"""Spelling variants, conversation repair and nearest neighbours against plain Python."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import neighbours, repair, spelling, tokenize

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_spelling(rows, least, times, every):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= least
    n = {w: c for w, c in counts.items() if c >= times and len(w) >= least}
    near = {}
    for w in n:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        other = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
        near[w] = ((cut | more | other) - {w}) & n.keys()
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n.get(form[w], 0)) for w, c in n.items())


def spelled(df, **kw):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_variants(df, **kw).collect())


@pytest.mark.parametrize("every", [0, 5])
def test_spelling_variants(spark, every, monkeypatch):
    monkeypatch.setattr(spelling, "REMEMBERED", 50)
    monkeypatch.setattr(spelling, "PIECE", 40)
    rng = random.Random(every)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["AAAAB", "aaaab", "aaaaab", "×÷×÷×", "x" * 70, "x" * 69 + "y", "x" * 69]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", *(["-".join(rng.choices(words, weights, k=rng.randint(1, 60))) + " 日本 "] * 8)])) for _ in range(150)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert spelled(df, least=5, times=3, every=every) == plain_spelling(rows, 5, 3, every)
    assert spelled(df.limit(0)) == []


def test_chains_of_forms_end_in_one_root(spark):
    words = {"abcdefgh": 40, "abcdefg": 20, "abcdef": 9, "abcde": 4, "zzzzzz": 3, "zzzzz": 3}
    got = spelled(spark.createDataFrame([(1, " ".join(w for w, n in words.items() for _ in range(n)))], "doc_id long, text string"))
    assert [(w, f, r) for w, f, r, *_ in got] == [("abcde", "abcdef", "abcdefgh"), ("abcdef", "abcdefg", "abcdefgh"), ("abcdefg", "abcdefgh", "abcdefgh"), ("abcdefgh", "", "abcdefgh"), ("zzzzz", "", "zzzzz"), ("zzzzzz", "", "zzzzzz")]


def test_long_words_have_hashed_keys(spark):
    rng = random.Random(3)
    one = "".join(rng.choices("abcdé", k=3000))
    two, three = one[:1500] + "Q".lower() + one[1501:], one[:700] + one[701:]
    rows = [(k, f"{one} {one} {two} {three}") for k in range(3)]
    assert spelled(spark.createDataFrame(rows, "doc_id long, text string")) == plain_spelling(rows, 5, 3, 0)


def plain_repair(rows):
    name = lambda v: " " if v is None else str(v)
    convs = {}
    for c, t, r, x in rows:
        out = convs.setdefault(c, [])
        k, r, x = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20, name(r), name(x)
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return {c: repaired(sorted(own, key=lambda a: (a[0] is not None, a[0] or 0, a[1].encode(), a[2].encode()))) for c, own in convs.items()}


def repaired(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    need, full = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        to = need[state]
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cut, first = 3 * (faults[i] == "truncated"), role[:1]
            ways.append(plus(best(i + 1, state, 0), 4, "D"))
            if faults[i] not in ("blank", "duplicate"):
                if first and (first == to or (state == "" and first == "s")):
                    ways.append(plus(best(i + 1, first, 0), cut, "K", f"{role}:{text}"))
                ways.append(plus(best(i + 1, to, 0), 3 + cut, "R", f"{full[to]}:{text}"))
        if inserted < 2:
            ways.append(plus(best(i, to, inserted + 1), 3, "I", f"{full[to]}:"))
        return min((w for w in ways if w), key=lambda w: w[:2], default=None)

    def plus(rest, cost, edit, *line):
        return rest and (rest[0] + cost, edit + rest[1], line + rest[2])

    cost, audit, lines = best(0, "", 0)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("bits", [12, 2])
def test_conversation_repair(spark, bits, monkeypatch):
    """With bits = 2 most conversations lie over several segments."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    role = lambda: rng.choice(["user", "assistant", "system", "tool", "", None, "assistant", "user"])
    text = lambda: rng.choice(["a.", "b", "  ", "", None, "c!\n", "d?  ", "é", "\u00a0"])
    rows = [(rng.choice([None, *range(80)]), rng.choice([None, *range(8)]), role(), text()) for _ in range(700)]
    rows += [(1000, k, "user" if k % 2 else "assistant", f"t{k}" + ".?"[k % 2]) for k in range(120)]  # one long conversation
    rows += [(2000 + k, 0, "user", "x.") for k in range(60)]  # of which the damage takes some whole
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, gid int").repartition(3)
    assert {r[0]: tuple(r)[1:] for r in repair.repair_report(df).collect()} == plain_repair(rows)
    assert repair.repair_report(df.limit(0)).count() == 0


def gaussians(n, dim=8, seed=0):
    return np.random.default_rng(seed).normal(0, 1, (n, dim))


def checked(df, got, k):
    """Recall against brute force; every score, rank and tie is right."""
    rows = [(i, [float(x) for x in v]) for i, v in df.select("vec_id", "embedding").collect() if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    shares, queries = [], {i: v for i, v in sorted(rows, reverse=True) if i % 20 == 0}
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in rows if i != q and len(c) == len(v))
        own = sorted(found.pop(q, []))
        assert [r for r, *_ in own] == list(range(1, min(k, len(scores)) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert all(any(i == j and abs(s - t) < 1e-9 for s, i in scores) for _, t, j in own)
        worst = scores[len(own) - 1][0] if own else 0
        shares.append(sum(t <= worst + 1e-9 for _, t, _ in own) / len(own) if own else 1)
    assert not found
    return sum(shares) / len(shares)


def test_neighbours_of_odd_rows(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(gaussians(250))]
    rows += [(400 + k, rows[7][1]) for k in range(40)]  # copies
    rows += [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (580, [0.5] * 3), (581, [0.5, 0.25, 1.0]), (600, []), (620, [0.0] * 8), (None, [0.1] * 8), (20, rows[20][1]), (40, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    assert checked(df, neighbours.approximate_neighbours(df, 20, 20).collect(), 20) >= 0.9
    assert neighbours.approximate_neighbours(df.limit(0), 20).count() == 0
    few = df.where("vec_id < 12")
    assert checked(few, neighbours.approximate_neighbours(few, 20, 20).collect(), 20) == 1


def test_neighbours_by_inner_product_of_any_norms(spark):
    x = gaussians(1500, 12, 4) * np.exp(gaussians(1500, 1, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert checked(df, neighbours.approximate_neighbours(df, 20, 20).collect(), 20) >= 0.9


def test_trees_deal_rows_evenly():
    y = gaussians(4000, 6).astype(np.float32)
    leaf = neighbours.leaf_of(y, *neighbours.fit_tree(y, 4, np.random.default_rng(1)))
    assert set(leaf) == set(range(16)) and np.bincount(leaf).max() - np.bincount(leaf).min() <= 16


def test_long_texts_are_encoded_by_parts(monkeypatch):
    monkeypatch.setattr(tokenize, "PART", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokenize.LibraryEncoder(path)
    rng = random.Random(1)
    words = ["the", " ", "  ", "\n", "naïve", "日本語", "it's", " 12", "\u00a0", "\u2003 x", "end.", "\t", "😀", "x" * 90]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 900))) + " " * rng.randint(0, 3) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=700)), "y" * 5000, " " * 3000, "a b" * 800 + "<|endoftext|>" + "c d" * 300, ""]
    assert [array("I", b).tolist() for b in own.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
