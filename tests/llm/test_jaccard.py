"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairsieve.llm import jaccard
from pairsieve.llm.components import components
from pairsieve.llm.jaccard import Trie, jaccard_components, links_between, ranked, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_components(rows):
    ids, sets = [d for d, _ in rows], [plain_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(rows))}


def corpus(seed, families, members, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, members)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own + passage
            if rng.random() < 0.2:
                own = own[:len(own) * 9 // 10]
            texts.append(" ".join(own))
    texts += [None, "", " \n ", "A b", "a B", "a b c d", "One two three four five", "one TWO three four five", "x " * 500, "x " * 900]
    rng.shuffle(texts)
    return [(i * 2 + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,group,cell,few", [(1, 512, 1024, 64), (2, 3, 6, 2), (5, 512, 1024, 0)])
def test_components(spark, monkeypatch, seed, group, cell, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = corpus(seed, 30, 9, 120)
    docs = spark.createDataFrame([(*r, "n", "k") for r in rows], "doc_id long, text string, node string, key string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, group=group, cell=cell).collect()}
    assert got == plain_components(rows)


def test_one_large_family(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(150)] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, group=50, cell=64).collect()}
    assert got == plain_components(rows)


def test_common_passage(spark):
    """Short texts around one passage: its shingles are common, and few of the texts are near."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = [f"o{i}-{j}" for j in range(rng.choice([2, 4, 8, 12, 40]))]
        rows.append((i, " ".join(rng.choice([passage + own, own + passage]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, cell=32).collect()}
    assert got == plain_components(rows) and 1 < len({c for _, c in got.values()}) < 300


def test_large_sets_of_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(40):
        cut = rng.randint(0, 60)
        rows.append((i, " ".join([f"o{i}-{j}" for j in range(rng.randint(0, 70))] + passage[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, cell=5).collect()}
    assert got == plain_components(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, None), (None, None)], "doc_id long, text string")
    rows = jaccard_components(docs).collect()
    assert len(rows) == 5 and sorted((r.n_shingles, r.component_id or -1) for r in rows) == [(0, -1), (0, 7), (2, 7), (2, 7), (2, 7)]
    assert jaccard_components(docs.filter("doc_id = 1")).count() == 0


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == plain_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(5))
def test_trie(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(60, 25, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(15, 25), replace=False), rng.choice(200, rng.integers(0, 5))])) for _ in range(60)]
    ranks, width = ranked(sets)
    trie = Trie()
    for i, r in enumerate(ranks):
        trie.add(r, i, i % 3)
    for i, r in enumerate(ranks):
        held = np.zeros(width, bool)
        held[r] = True
        assert sorted(trie.near(r, held)) == [j for j in range(60) if near(set(sets[i]), set(sets[j]))]
    for i, r in enumerate(ranks[:10]):
        held = np.zeros(width, bool)
        held[r] = True
        others = [j for j in range(60) if j % 3 != 1 and near(set(sets[i]), set(sets[j]))]
        found = trie.near(r, held, settled=lambda side: side == 1)
        assert set(others) <= set(found) and len(found) == len(set(found))


@pytest.mark.parametrize("sides", [60, 3])
def test_links_span(sides):
    rng = np.random.default_rng(sides)
    base = rng.choice(200, 60, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 57, replace=False), rng.choice(400, 2)])) for _ in range(60)]
    side = [i % sides for i in range(60)]
    links = links_between(sets, side, sets, side)
    assert len(links) < sides and all(near(set(sets[a]), set(sets[b])) for a, b in links)
    at = {s: s for s in range(sides)}

    def root(s):
        return s if at[s] == s else root(at[s])

    for a, b in links:
        at[root(side[a])] = root(side[b])
    for i in range(60):
        for j in range(60):
            assert root(side[i]) == root(side[j]) or not near(set(sets[i]), set(sets[j]))


def test_shingle_hashes_follow_words():
    sets = shingle_sets(pa.array(["a b c d e f", "A  b\tc d e f", None, "", "a b", "a b c d e"]))
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 1] and (sets[0] == sets[1]).all()


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {n: n for e in edges for n in e}

    def root(n):
        return n if at[n] == n else root(at[n])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        at[high] = low
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
