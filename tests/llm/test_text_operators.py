import array
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, neardup, packing, pii, quality, rans, token_files, tokenize

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"abc XYZ  \n\n\t'stlldvere.,!0123éß漢字😀", " ", "　", "\x1c", "\x85", "\r", "​", "́", "\x00", "<|endoftext|>", "'ll", "  ", " \n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def documents(spark, texts):
    """Rows with null, repeated and clashing extra columns."""
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")


EDGES = [None, "", " ", "word", "a b c", "same text here for both rows", "same text here for both rows", "x" * 50_000, "long words " * 20_000]


def test_bpe_equals_the_library(library):
    own = bpe.ForcedBoundaryBpe(PATH)
    for text in [*odd_texts(3000, 1), "a" * 4000, " " * 3000, "the quick" * 300]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert array.array("I", own.encode(text)).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_never_inside_a_token():
    own = bpe.ForcedBoundaryBpe(PATH, remember=10)
    assert own.inside[ord("t") << 8 | ord("h")] and not own.inside[0x00 << 8 | 0xFF]
    fragments = list(own.forced_fragments(b"abc\x00\xff\x01"))
    assert b"".join(fragments) == b"abc\x00\xff\x01" and len(fragments) > 1
    assert own.decode(own.encode("forgetful memory " * 30)) == "forgetful memory " * 30


def test_bpe_over_a_table(spark, library):
    got = {r.doc_id: r for r in bpe.round_trip_digests(documents(spark, EDGES), PATH).collect()}
    for k, text in enumerate(EDGES):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and got[k].same
    encoded = bpe.encode_documents(documents(spark, EDGES), PATH)
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, PATH).collect()}
    assert back == {k: t or "" for k, t in enumerate(EDGES)}
    assert bpe.round_trip_digests(documents(spark, EDGES).limit(0), PATH).count() == 0


def test_library_encoder_equals_the_library(library):
    own = tokenize.LibraryEncoder(PATH, remember=50)
    texts = odd_texts(2000, 2)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [array.array("I", b).tolist() for b in own.encode_batch(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert own.encode_batch(["", *texts, ""]) == [array.array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in ["", *texts, ""]]
    other = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(other).encode("Hello there", add_special_tokens=False).ids
    assert array.array("I", tokenize.LibraryEncoder(other).encode_batch(["Hello there"])[0]).tolist() == plain


def test_a_clash_of_hashes_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokenize, "_SALT", np.zeros(256, np.uint64))  # chunks of one length have one hash
    own = tokenize.LibraryEncoder(PATH)
    texts = ["two men sat", "two men ran", "ten men sat"]
    for _ in range(2):
        assert [array.array("I", b).tolist() for b in own.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 131072, 131073, 200_000])
@pytest.mark.parametrize("symbols", [1, 7, 50_257])
def test_rans_round_trip(n, symbols):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), symbols).astype(np.uint32) if n else np.zeros(0, np.uint32)
    segment = rans.Segment(rans.encode_segment(ids, np.array([5, 6]), np.array([n // 2, n - n // 2])))
    assert (segment.ids() == ids).all()
    assert [(d, len(x)) for d, x in segment.documents()] == [(5, n // 2), (6, n - n // 2)]


def test_damage_of_every_byte_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 300
    data = rans.encode_segment(ids, np.array([1]), np.array([3000]), 3, 2, 77)
    for at in range(len(data)):
        for bad in (data[:at] + bytes([data[at] ^ 1 << at % 8]) + data[at + 1 :], data[:at]):
            with pytest.raises(ValueError):  # noqa: PT011
                rans.Segment(bad).ids()
    file = rans.Segment(data)
    assert (file.part, file.segment, file.before, file.n_ids) == (3, 2, 77, 3000)


def test_large_ids_and_scaled_tables():
    ids = np.array([4_000_000_000, 7, 7, 4_000_000_000, 1], np.uint32)
    assert (rans.Segment(rans.encode_segment(ids, np.array([0]), np.array([5]))).ids() == ids).all()
    freq = rans.scaled_frequencies(np.array([1, 1, 10**9]), 12)
    assert freq.sum() == 4096 and freq.min() >= 1
    with pytest.raises(ValueError, match="do not fit"):
        rans.scaled_frequencies(np.ones(5000, np.int64), 12)


def test_token_files_are_in_order(spark, library):
    docs = documents(spark, EDGES).repartition(3)
    got = token_files.token_file_index(docs, PATH, 2, segment_ids=3000).orderBy("doc_id").collect()
    at = 0
    for row, text in zip(got, EDGES, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_file_index(docs.limit(0), PATH, 2).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, None), (3, "b")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in token_files.token_file_index(nulls, PATH, 2).orderBy("start").collect()] == [(None, 0), (3, 2), (3, 3)]


def test_best_fit_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 60))), reverse=True)
        room: list[int] = []
        for n, (sequence, offset) in zip(lengths, packing.best_fit_decreasing(lengths, 32), strict=True):
            fits = [r for r in room if r >= n]
            if fits:
                assert 32 - offset == min(fits) == room[sequence]
                room[sequence] -= n
            else:
                assert (sequence, offset) == (len(room), 0)
                room.append(32 - n)


def test_packing_covers_every_id_once(spark, library):
    docs = documents(spark, [*EDGES, *odd_texts(300, 4)])
    got = packing.pack_documents(docs, PATH, 1, 2048, docs_per_group=100).toPandas()
    for doc, part in got.sort_values("start").groupby("doc_id"):
        text = docs.where(F.col("doc_id") == int(doc)).head().text if doc < 9 else None
        assert (part.start.to_numpy() == np.concatenate(([0], part.length.cumsum()[:-1]))).all() and part.length.sum() == part.doc_tokens.iloc[0]
        if doc < 9:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.to_numpy() == np.concatenate(([0], part.length.cumsum()[:-1]))).all() and part.length.sum() <= 2048
    assert packing.pack_documents(docs.limit(0), PATH, 1).count() == 0
    nulls = spark.createDataFrame([(None, None), (3, "b"), (3, "b")], "doc_id long, text string")
    assert sorted(((r.doc_id is None, r.length) for r in packing.pack_documents(nulls, PATH, 1).collect())) == [(False, 2), (False, 2), (True, 1)]


WORDS = [f"w{k}" for k in range(60)]


def near_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(8):
        base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.choice([3, 5, 12, 80, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(rng.choice(["  ", " ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return [*out, None, "", "  \t", "one", "ONE", "one two", "one two"]


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                shared = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


@pytest.mark.parametrize(("size", "long"), [(4, 32), (5, 2)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, size, long):
    """With long = 2 every way for long lists is taken."""
    monkeypatch.setattr(neardup, "LONG", long)
    texts = [t for s in range(3) for t in near_texts(s)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, texts), size).collect()}
    want = brute_components(texts, size, 80)
    assert got == {k: (n, c, k == c) for k, (n, c) in enumerate(want)}


def test_near_duplicates_edges(spark):
    nulls = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (7, "a b c d e"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(nulls, 4).where("doc_id IS NOT NULL").collect())
    assert got == [(False, 4, 4, True), (False, 4, 4, True), (False, 7, 4, False), (False, 8, 8, True)]
    assert neardup.near_duplicates(nulls.limit(0), 4).count() == 0
    assert sorted(r.doc_id or -1 for r in neardup.keep_one(nulls, 4).collect()) == [-1, 4, 4, 8]


PERSONAL = {
    "email": ["Write to une.92@mail6.example.com today.", "ANNA@EXAMPLE.COM", "ciónez.33@mail0.example.com"],
    "ip": ["at 161.17.88.162."],
    "card": ["pay 4844508665317339", "pay 4111 1111 1111 1111 now"],
    "phone": ["call +1 (696) 555-2293", "call 212-555-1234", "call +44 20 7946 0958"],
    "secret": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "TOKEN 9233A8ECF7C5B09FE5949719B6B82BC439E9329B!!"],
    "date": ["born 1985-03-12", "born 12.03.1985", "born 03/12/1985"],
    "ssn": ["number 123-45-6789"],
    "iban": ["to DE89 3704 0044 0532 0130 00", "to GB82WEST12345698765432"],
}
CLEAN = ["999.1.1.1", "v1.2.3", "4111111111111112", "1985-13-40", "000-12-3456", "DE00 3704 0044 0532 0130 00", "plain words", "12345", "a@b"]


def test_pii_keeps_formats_and_leaves_the_rest(spark):
    rows = [(k, t) for k, t in enumerate([t for v in PERSONAL.values() for t in v])]
    kinds = [k for k, v in PERSONAL.items() for _ in v]
    report = pii.pseudonym_report(spark.createDataFrame(rows, "doc_id long, text string"), "key").orderBy("doc_id").collect()
    again = pii.pseudonym_report(spark.createDataFrame([(r.doc_id, r.text) for r in report], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    for (_, old), new, twice, kind in zip(rows, report, again, kinds, strict=True):
        assert new.kinds == kind and new.n_found == 1 and new.text != old and len(new.text) == len(old)
        assert [c.isdigit() for c in new.text] == [c.isdigit() for c in old] or kind == "secret"
        assert twice.kinds == kind, "a pseudonym is a valid value of its kind"
    clean = pii.pseudonym_report(spark.createDataFrame([(k, t) for k, t in enumerate(CLEAN)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [r.text for r in clean] == CLEAN and all(r.n_found == 0 for r in clean)


def test_pii_is_a_permutation(spark):
    ssn = spark.range(3000).select(F.format_string("%03d-%02d-%04d", (F.col("id") % 665 + 1).cast("int"), (F.col("id") % 98 + 1).cast("int"), (F.col("id") + 1).cast("int")).alias("v"))
    day = spark.range(3000).select(F.date_add(F.to_date(F.lit("1990-01-01")), F.col("id").cast("int")).cast("string").alias("v"))
    ip = spark.range(3000).select(F.concat_ws(".", F.lit("10"), F.lit("1"), (F.col("id") / 256).cast("int"), F.col("id") % 256).alias("v"))
    for values, sound in ((ssn, f"p RLIKE r'^{pii.SSN}$'"), (day, "try_to_date(p) IS NOT NULL"), (ip, "p RLIKE r'^[0-9.]+$'")):
        got = values.select(pii.pseudonym(F.col("v"), "key")["value"].alias("p"))
        assert got.distinct().count() == 3000 and got.where(sound).count() == 3000


def test_secrets_without_digits(spark):
    old = ["sk-" + "abcdefghij" * 2, "AKIA" + "QWERTYUI" * 2, "ghp_" + "abcdef" * 6, "abcdef" * 6]
    docs = spark.createDataFrame([(k, f"my {t} here") for k, t in enumerate(old)], "doc_id long, text string")
    for (t, r) in zip(old, pii.pseudonym_report(docs, "key").orderBy("doc_id").collect(), strict=True):
        assert r.kinds == "secret" and t not in r.text and len(r.text) == len(t) + 8


def test_phones_with_any_area_code(spark):
    old = ["+1 (017) 555-7713", "+1 (117) 155-7713", "(017) 055-7713", "017-555-7713", "1.917.055.7713", "+(017) 555-7713", "+123 456 7890"]
    docs = spark.createDataFrame([(k, f"call {t} now") for k, t in enumerate(old)], "doc_id long, text string")
    for (t, r) in zip(old, pii.pseudonym_report(docs, "key").orderBy("doc_id").collect(), strict=True):
        assert r.kinds == "phone" and t not in r.text and [c.isdigit() for c in r.text] == [c.isdigit() for c in f"call {t} now"]
    every = spark.range(2000).select(F.format_string("+1 (%03d) 555-7713", F.col("id") % 1000).alias("v")).distinct()
    got = every.select(pii.pseudonym(F.col("v"), "key")["value"].alias("p"))
    assert got.distinct().count() == 1000 and got.where(f"p RLIKE r'^(?:{pii.PHONE})$'").count() == 1000


def test_pii_links_equal_values_and_handles_edges(spark):
    rows = [(1, "x 161.17.88.162 y 161.17.88.162", "a"), (2, "161.17.88.162", None), (3, None, "b"), (4, "", "c"), (4, "", "c")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, kinds string"), "key")
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] == f"x {texts[2]} y {texts[2]}" and texts[3] is None and texts[4] == "" and got.columns == ["doc_id", "text", "kinds"] and got.count() == 5
    assert pii.pseudonymise(got.limit(0), "key").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def quality_tables(spark, n=400):
    rng = random.Random(5)
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 200))]
        good = k % 4 > 0
        texts.append(" ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 8))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = quality_tables(spark)
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.97 and got.score.between(0, 1).all()
    kept = quality.keep_good(docs.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and abs(kept.count() - 300) < 12


def test_classifier_edges(spark):
    docs, labels = quality_tables(spark, 20)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000)], "doc_id long, text string")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(odd, labels.limit(0)).count() == 4 and quality.classify(odd.limit(0), labels).count() == 0


def test_forest_equals_its_trees_walked_one_by_one():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality.train(x, y, trees=30, depth=3)
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.9
    for row in x[:20]:
        total = forest.base
        for f, c, v in zip(forest.features, forest.thresholds, forest.values, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            total += v[at - len(f)]
        assert forest.margin(row[None])[0] == pytest.approx(total)


def test_one_id_with_two_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(4, " ".join(words), 1), (4, "quite another text of its own here", 2), (3, " ".join([*words, "more"]), 3), (3, " ".join([*words, "more"]), 4), (9, "x y", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect())
    assert got == [(3, 58, 3, True), (3, 58, 3, True), (4, 4, 4, True), (4, 57, 3, False), (9, 1, 9, True)]
    kept = neardup.keep_one(docs, 4)
    assert sorted(r.n for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs.columns


@pytest.mark.parametrize("ids", [0])
def test_a_passage_in_every_document(spark, monkeypatch, ids):
    """A common passage puts all documents in one long list; ids = 0: all by shuffles."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", ids)
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = []
    for k in range(60):
        own = " ".join(f"o{k}-{j}" for j in range(rng.choice([0, 2, 5, 40])))
        texts += [f"{own} {passage}", f"{own} {passage} end{k}"]
    texts.append(" ".join(f"q{j}" for j in range(50_000)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts), 4).collect()}
    assert got == dict(enumerate(brute_components(texts, 4, 80)))


def plain_boosting(x, y, trees, depth, rate, bins, l2, least):
    """Margins of Newton boosting with every split tried one by one."""
    share = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(share / (1 - share)))
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            parts = []
            for rows in nodes:
                best, cut = 1e-9, None
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left, right = [k for k in rows if x[k, f] <= e], [k for k in rows if x[k, f] > e]
                        if h[left].sum() >= least and h[right].sum() >= least:
                            gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                            if gain > best + 1e-12:
                                best, cut = gain, (left, right)
                parts += cut or (rows, [])
            nodes = parts
        for rows in nodes:
            if rows:
                margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_boosting_against_every_split_tried():
    rng = np.random.default_rng(31)
    x = rng.normal(size=(70, 3))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.5, 70) > 0.7).astype(float)
    params = {"trees": 4, "depth": 3, "rate": 0.3, "bins": 9, "l2": 1.0, "least": 1.0}
    np.testing.assert_allclose(quality.train(x, y, **params).margin(x), plain_boosting(x, y, **params), atol=1e-9)


def plain_statistics(text):
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(1, len(raw))
    of_words = lambda good: sum(map(bool, map(good, words))) / max(1, len(words))
    letters = bytes(range(65, 91)) + bytes(range(97, 123))
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return [
        np.log1p(len(raw)), share(letters), share(bytes(range(65, 91))), share(b"0123456789"), share(b" "), share(b"\n"), share(b"."), share(b","), share(b"!?"), share(b"#$%&*@^~_+=<>"), share(b"|"),
        share(b"\"'()[]{}"), share(bytes(range(128, 256))), np.log1p(len(words)), sum(map(len, words)) / max(1, len(words)), len(set(words)) / max(1, len(words)),
        max((words.count(w) for w in words), default=0) / max(1, len(words)), len(set(triples)) / max(1, len(words) - 2), np.log1p(len(lines)), len(set(lines)) / len(lines), max(map(len, lines)) / max(1, len(raw)),
        sum(x.endswith((".", "!", "?")) for x in lines) / len(lines), of_words(lambda w: len(w) <= 2), of_words(lambda w: len(w) >= 12), of_words(lambda w: len(w) > 1 and w.isupper()),
        of_words(lambda w: not w[-1].isalnum() and w[-1] not in ".,;:"),
    ]


def test_statistics_by_plain_counting():
    for text in ["", " ", "One. Two!\nTHREE four, 5 | (six)\n\nOne. Two!", "é漢字 wörter " * 9, *odd_texts(50, 4)]:
        np.testing.assert_allclose(quality.statistics(text), plain_statistics(text), atol=1e-12, err_msg=text)


def test_kept_rows_keep_columns_of_any_kind(spark):
    docs, labels = quality_tables(spark, 60)
    odd = docs.select("doc_id", "text", F.array("doc_id").alias("a`b"), F.struct("text").alias("x y"), F.lit(None).cast("binary").alias("score"))
    odd = odd.unionByName(odd.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(odd.limit(2))
    got = quality.keep_good(odd, labels, 0.0)
    assert got.schema == odd.schema and got.count() == 63 and quality.keep_good(odd.limit(0), labels).count() == 0
    again = quality.fit(docs.unionByName(docs).unionByName(docs), labels)
    assert (again.values == quality.fit(docs, labels).values).all()


def test_bpe_and_token_files_on_odd_tables(spark, library):
    rows = spark.createDataFrame([(None, "null id"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in bpe.round_trip_digests(rows, PATH).collect())
    assert got == [(-1, len(library.encode("null id", add_special_tokens=False).ids)), (5, 0), (5, 0)]
    assert bpe.encode_documents(rows.limit(0), PATH).count() == 0
    long = spark.createDataFrame([(1, "a b"), (2, "some words " * 5000), (None, "c")], "doc_id long, text string")
    index = sorted(token_files.token_file_index(long, PATH, 2, segment_ids=100).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [None, 1, 2] and index[2].n_tokens > 100 and index[2].start == index[1].start + index[1].n_tokens


def test_packing_of_repeated_ids_and_powers_of_two(spark):
    docs = spark.createDataFrame([(None, f"word {k}") for k in range(40)] + [(7, "x y z " * 900)] * 3, "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs, PATH, 1, window=256, docs_per_group=5).toPandas()
    assert got.length.sum() == got.drop_duplicates(["sequence_id", "offset"]).length.sum()
    for _, part in got.groupby("sequence_id"):
        used = part.length.sum()
        assert set(part.padded_length) == {used if used & (used - 1) == 0 else 256} and used <= 256
    assert (got.sequence_id // 2**32).nunique() > 1
