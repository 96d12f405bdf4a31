"""Repeated strings against a plain version, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from pairsieve.llm import suffixes
from pairsieve.llm.suffixes import remove_repeats, suffix_array


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 40), max_size=60)))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("text", ["banana", "abababab", "a" * 50, "graindraining", "abcabcabd" * 5])
def test_suffix_array_of_words(text):
    symbols = [ord(c) for c in text]
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def plain(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (name, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((name, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[:n * 5]
    passages = [text(n) for n in (70, 85, 90, 100, 160)]
    base, texts = text(400), []
    for _ in range(14):
        parts = [text(rng.randint(1, 90)), rng.choice(passages), text(rng.randint(0, 60)), rng.choice(passages)[:rng.randint(300, 500)]]
        rng.shuffle(parts)
        texts.append("".join(parts))
    for _ in range(8):
        at, own = rng.randrange(1500), base
        texts.append(own[:at] + "#" * rng.randint(0, 3) + own[at + 1:])
        cut = rng.randint(0, 700)
        texts.append(base[cut:cut + rng.randint(380, 900)])
    texts += [None, "", "short", base, base, "ab" * 900, "z" * 399, "z" * 399, "y" * 400, "y" * 401, "q" * 400, "xyz" * 134 + "!", text(300) * 2]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("many", [50_000, 3])
def test_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY_CELLS", many)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, core string, key int").repartition(3)
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == sorted(plain(rows))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "k" * 500), (3, "m n" * 200), (3, "m n" * 200), (4, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str)
    assert got == sorted(plain([(None, "k" * 500), (3, "m n" * 200), (3, "m n" * 200), (4, None)]), key=str)
    assert remove_repeats(docs.filter("doc_id = 9")).count() == 0


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == sorted(plain(rows))
