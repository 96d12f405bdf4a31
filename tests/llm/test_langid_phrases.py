"""Language identification and phrase fingerprints against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairsieve.llm.langid import ContextTrees, Scorer, identify, language_id
from pairsieve.llm.phrases import fingerprint, fingerprints, likeness

SF = "/root/testdata/sf0.01"


def plain_bits(training: bytes, text: bytes) -> float:
    """PPM of order three with escapes, byte by byte."""
    counts = [Counter() for _ in range(4)]
    padded = b"\0\0\0" + training
    for i in range(3, len(padded)):
        for depth in range(4):
            counts[depth][padded[i - depth:i], padded[i]] += 1
    padded, total = b"\0\0\0" + text, 0.0
    for i in range(3, len(padded)):
        for depth in (3, 2, 1, 0):
            own = {s: n for (c, s), n in counts[depth].items() if c == padded[i - depth:i]}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if padded[i] in own:
                total -= math.log2(own[padded[i]] / whole)
                break
            total -= math.log2(len(own) / whole)
        else:
            total += 8
    return total


def trees_of(*texts):
    rows = [(i, g) for i, t in enumerate(texts) for p in [b"\0\0\0" + t.encode()]
            for g in (int.from_bytes(p[k - 3:k + 1], "big") for k in range(3, len(p)))]
    keys = Counter(rows)
    return ContextTrees.from_counts(
        [f"l{i}" for i in range(len(texts))], np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array(list(keys.values())))


def test_code_lengths():
    training, texts = ["the cat sat on the mat", "die katze saß auf der matte"], ["the mat", "katze", "", "zzz é", None, "the the the"]
    bits, sizes = Scorer(trees_of(*training)).totals(pa.array(texts))
    for i, t in enumerate(texts):
        for k, tr in enumerate(training):
            assert bits[i, k] == pytest.approx(plain_bits(tr.encode(), (t or "").encode()), rel=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, source string, score string, carried string, lang_pred string"
    rows = [(i, t, lang, None, "s", "c", "p") for i, (t, lang) in enumerate([
        ("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", None), (None, "en"), ("", "fr"), ("123 !!", "en"),
        ("the cat and the dog", "en"), ("le chat", "fr"), ("the dog", "en"), ("le chien", "fr")])] + [(None, "le chat", None, None, "s", "c", "p")]
    docs = spark.createDataFrame(rows, schema)
    got = language_id(docs, carry=tuple(docs.columns)).collect()
    assert len(got) == len(rows) and all(r.carried.score == "s" for r in got)
    by_text = {r.carried.text: r.lang_pred for r in got}
    assert by_text[None] == by_text[""] == by_text["123 !!"] == "und"
    assert language_id(docs.filter("doc_id < 0")).count() == 0
    nothing = identify(docs, ContextTrees([])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def plain_fingerprints(texts):
    out = []
    for i, t in enumerate(texts):
        follows = texts[(i + 1) % len(texts)] or ""
        t = t or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + follows[:k]
        mark = fingerprint(t)
        out.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, fingerprint(edited),
                    likeness(mark, fingerprint(edited)), likeness(mark, fingerprint(follows))))
    return out


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_fingerprints(spark, parts):
    texts = ["the cat sat on the mat " * 5, None, "", "abc", "the cat sat on the mat " * 5, "🙂é" * 40, "x" * 3000, "the dog sat on the mat " * 6]
    docs = spark.createDataFrame([(i * 7, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted(fingerprints(docs, parts=parts).collect())
    assert [tuple(r)[1:] for r in got] == plain_fingerprints(texts) and [r.doc_id for r in got] == [i * 7 for i in range(len(texts))]


def test_fingerprint_edges(spark):
    docs = spark.createDataFrame([(None, "b"), (None, "aaaa bbbb"), (4, "x y z w"), (4, "x y z w"), (4, "other")], "doc_id long, text string")
    assert fingerprints(docs, parts=4).count() == 5
    assert fingerprints(docs.filter("doc_id = 9")).count() == 0
    assert fingerprints(docs.limit(1)).count() == 1


def test_edited_is_nearer_than_next(spark):
    rows = fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(rows) == 1000
    assert sum(r.near_edited > r.near_next for r in rows) > 900
