import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def least_of_component(texts, size=5, percent=80):
    """doc_id to the smallest one reachable, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({k: 32 for k in range(9, 14)}).split(" ") if x]
        sets[d] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "MinHash near-dedup", "PII", "packing"]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}

    good = stages["quality classifier"](spark, docs, SMALL).cache()
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and all(before[d] == t for d, t in kept.items())
    right = np.mean([(d in kept) == bool(q) for d, q in labels.items()])
    assert right > 0.95 and np.mean([d in kept for d, q in labels.items() if q]) > 0.98

    single = stages["MinHash near-dedup"](spark, good, SMALL).cache()
    least = least_of_component(kept)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {d for d, m in least.items() if d == m}

    safe = stages["PII"](spark, single, SMALL).cache()
    for r in safe.collect():
        assert len(r.text) == len(before[r.doc_id]) and ("@" in r.text) == ("@" in before[r.doc_id])
        if not any(c.isdigit() for c in before[r.doc_id]):
            assert r.text == before[r.doc_id]

    packed = stages["packing"](spark, safe, SMALL).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert set(packed.doc_id) == set(texts)
    for doc, part in packed.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist() and part.length.sum() == len(ids)

    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages_on_odd_tables(spark):
    """Nulls, repeated rows, columns with clashing names, and an empty table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    text = docs.first().text
    odd = docs.unionByName(docs.limit(3)).selectExpr("doc_id", "text", "lang", "source", "n_chars", "doc_id AS cls", "text AS kept", "array(doc_id) AS sketch", "n_chars AS score", "lang AS n", "source AS h1")
    more = spark.createDataFrame([(None, text, None), (10**12, None, "x"), (10**12, "", "x"), (10**12 + 1, text + " extra", "x")], "doc_id long, text string, lang string")
    odd = odd.unionByName(more, allowMissingColumns=True)
    for rows in (odd, odd.limit(0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, at, SMALL).cache()
            assert after.columns == odd.columns and after.count() <= at.count(), name
            at = after
        packed = corpus_pipeline.STAGES[-1][1](spark, at, SMALL)
        assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
