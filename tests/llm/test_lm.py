"""The language model's scores against plain counts, and the model's own promises."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairsieve.llm import lm
from pairsieve.llm.lm import CONTEXT, Model, Trainer, head_of, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def plain(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    return {d: (held[d], len(words(t)), sum(counts[w] > 0 for w in words(t)), total,
                sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words(t))) for d, t in rows}


@pytest.mark.parametrize("head", [1 << 19, 12])
def test_counts_and_base(spark, head):
    rows = [(i, t) for i, t in enumerate(["The cat sat  on\tthe mat", None, "", " \n", "a\x85b É é", "the dog. the DOG", "cat " * 3000, "unseen words here"] * 3)]
    rows.append((None, "the cat"))
    docs = spark.createDataFrame([(*r, "s", "w") for r in rows], "doc_id long, text string, score string, word string")
    got = {r.doc_id: r for r in score_documents(docs, head_words=head, model_words=5).collect()}
    for d, expected in plain(rows).items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[:4]
        assert r.base_score == pytest.approx(expected[4], abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(docs).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) + abs(r.score) < 1e-5


def test_probabilities_add_up():
    model = Model.start(np.array([0.5, 0.3, 0.2]))
    context = np.array([[0, 1, 2, 3][:CONTEXT]] * 3)
    assert np.exp(model.log_probabilities(context, np.arange(3))).sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_an_order():
    rng, share = np.random.default_rng(1), np.full(5, 0.2)
    model = Model.start(share)
    trainer = Trainer(model, share, 3)
    last = rng.integers(0, 5, 4000)
    contexts, nexts = np.stack([last, *[rng.integers(0, 5, 4000) for _ in range(CONTEXT - 1)]], 1), (last + 1) % 5
    for _ in range(60):
        trainer.step(contexts, nexts)
    assert model.log_probabilities(contexts, nexts).mean() > math.log(0.5)


def test_head_cuts_no_tie(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "word string, n long")
    assert head_of(counts, 2)[0] == ["a"] and head_of(counts, 3)[0] == ["a", "b", "c"] and head_of(counts, 9)[0] == ["a", "b", "c", "d"]


def test_better_than_counts_alone(spark):
    rows = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_have_places(spark):
    """Words beyond the most frequent 1,024, exchanged among their places, change the score."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    common, seen, rare = " ".join(f"f{i}" for i in range(1100)), " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    texts = [" ".join([common] * 3 + [seen] * (i < 30) + [rare] * (i < 4)) for i in range(40)]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = list(zip(free, texts)) + list(zip(held, ["f1 x0 f2 x1", "f1 x1 f2 x0", "f1 y0 f2 y1", "f1 y1 f2 y0"]))
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one, two, three, four = (got[h] for h in held)
    assert one.base_score == pytest.approx(two.base_score) and abs(one.score - two.score) > 1e-3
    assert three.base_score == pytest.approx(four.base_score) and abs(three.score - four.score) > 1e-3


def test_classes_add_up():
    share = np.random.default_rng(2).random(700)
    model = Model.start(share / share.sum())
    assert np.exp(model.log_probabilities(np.tile(np.arange(CONTEXT), (700, 1)), np.arange(700))).sum() == pytest.approx(1, abs=1e-4)


def test_three_levels_add_up(monkeypatch):
    """op1: a place costs its group, its class and its word, not all classes; probabilities still add up."""
    rng, n = np.random.default_rng(2), 50
    for name, value in (("CLASS", 4), ("GROUP", 3), ("LEVELS", (1, 4, 12))):
        monkeypatch.setattr(lm, name, value)
    model = Model.start(rng.dirichlet(np.ones(n)))
    assert [len(t) for t in model.tables()[1:4]] == [50, 13, 5]
    contexts = np.tile(rng.integers(0, n, (1, CONTEXT)), (n, 1))
    trainer = Trainer(model, np.full(n, 1 / n), 3)
    for _ in range(5):
        trainer.step(rng.integers(0, n, (3000, CONTEXT)), rng.integers(0, n, 3000))
    assert np.exp(model.log_probabilities(contexts, np.arange(n))).sum() == pytest.approx(1, abs=1e-5)


def test_a_step_adds_up_repeated_rows():
    share = np.full(6, 1 / 6)
    trainer = Trainer(Model.start(share), share, 1)
    old, index = trainer.m.inputs.copy(), np.array([3, 1, 3, 3, 5])
    values = np.random.default_rng(4).normal(0, 1, (5, old.shape[1])).astype(np.float32)
    trainer._move(0, index, values, 2)
    for row in range(6):
        slope = values[index == row].sum(0) / 2
        moved = lm.RATE * slope / np.sqrt(lm.SQUARE + slope * slope)
        assert np.allclose(trainer.m.inputs[row], old[row] + moved, atol=1e-5)
    assert trainer.times[0].tolist() == [0, 1, 0, 3, 0, 1, 0]
