"""Token ids, grammar files and packing against plain versions."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pairsieve.llm.grammar import compress, grammar_round_trip
from pairsieve.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound
from pairsieve.llm.tokens import WordEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, length string, row string"
TEXTS = ["The cat, the cat. l'été Ünïté don't STOP!", "", None, "a b c\x85d é \x1c x", "ΣΑΣ İx ǅ ﬁ",
         "<|endoftext|> x<|startoftext|>y", "the " * 9000, "  lead trail  ", "12345 it's, we'll.. ,.", "日本語 テスト🙂"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def words():
    return WordEncoder(vocabulary_path("word_bpe_49k.json"))


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


def table(spark, texts=TEXTS):
    rows = [(i * 3, t, None, None, None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_words_give_the_library_ids(texts):
    from tokenizers import Tokenizer

    whole = test_words_give_the_library_ids.__dict__.setdefault("t", Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")))
    own = test_words_give_the_library_ids.__dict__.setdefault("w", WordEncoder(vocabulary_path("word_bpe_49k.json")))
    ids, begins = own.batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[begins[i]:begins[i + 1]].tolist() == ids_of(whole, t)


def test_documents_give_the_library_ids(whole, words):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).combine_chunks()
    ids, begins = words.batch(texts)
    for i, t in enumerate(texts.to_pylist()):
        assert ids[begins[i]:begins[i + 1]].tolist() == ids_of(whole, t)


def test_grammar_files(spark, whole):
    got = sorted(grammar_round_trip(table(spark), shard_tokens=50).collect())
    start, expected = 0, []
    for i, t in enumerate(TEXTS):
        ids = np.array([*ids_of(whole, t), 2], "<u4")
        expected.append((i * 3, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected


def test_grammar_empty_and_null_ids(spark):
    assert grammar_round_trip(table(spark, [])).count() == 0
    rows = [(None, "a b"), (None, "a b"), (7, "c"), (7, "d")]
    got = grammar_round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.start for r in got) == [0, 3, 6, 8] and sum(r.doc_id is None for r in got) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=8))
def test_grammar_random_access(parts):
    ids = np.concatenate([np.array(p, np.uint32) for p in parts])
    sizes = np.array([len(p) for p in parts])
    grammar, begins = compress(ids, np.cumsum(sizes) - sizes, frequent=2)
    assert grammar.expand().tolist() == ids.tolist()
    for i, part in enumerate(parts):
        end = begins[i + 1] if i + 1 < len(parts) else None
        assert grammar.expand(begins[i], end).tolist() == part
        assert [grammar.token_at(k, begins[i]) for k in range(len(part))] == part


def test_grammar_takes_pairs_of_small_counts():
    ids = np.concatenate([[1, 2, 100 + i] for i in range(5)]).astype(np.uint32)
    grammar, _ = compress(ids, np.array([0]))
    assert grammar.rules.tolist() == [[1, 2]] and len(grammar.symbols) == 10


def test_grammar_takes_the_most_frequent_first():
    ids = np.concatenate([[1 if i < 20 else 1000 + i, 2, 3] for i in range(200)]).astype(np.uint32)
    grammar, _ = compress(ids, np.array([0]))
    assert grammar.rules[0].tolist() == [2, 3] and [1, 2] not in grammar.rules.tolist()
    assert grammar.expand().tolist() == ids.tolist()


def check_packing(rows, whole, texts, capacity=4096):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*ids_of(whole, t), 1]
        own = sorted(by_doc[i * 3], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r.start:r.start + capacity], "<u4")
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(spark, whole):
    rows = best_fit_packing(table(spark)).collect()
    lengths = np.array([r.length for r in rows])
    assert check_packing(rows, whole, TEXTS) == lower_bound(lengths, np.ones(len(lengths), int))
    assert best_fit_packing(table(spark, [])).count() == 0


def test_packing_exchanges_between_groups(spark, whole):
    texts = [" ".join(["cat"] * n) for n in list(range(30, 700, 7)) + [0, 0, 5]]
    rows = best_fit_packing(table(spark, texts), group_pieces=10).collect()
    lengths = np.array([r.length for r in rows])
    assert check_packing(rows, whole, texts) <= lower_bound(lengths, np.ones(len(lengths), int)) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bound_holds(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = 99
        for i in range(len(bins)):
            if bins[i] + rest[0] <= 12:
                best = min(best, fewest(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1:]]))
        return min(best, fewest(rest[1:], [*bins, rest[0]]))

    own = np.array(lengths)
    bound = lower_bound(own, np.ones(len(own), int), 12)
    bins, offsets = best_fit_decreasing(own, 12)
    assert bound <= fewest(sorted(lengths, reverse=True), []) <= bins.max() + 1
