"""Mixing against its promises, exact dedup and every pipeline stage against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from pairsieve.llm.exact import exact_dedup
from pairsieve.llm.jaccard import one_per_component
from pairsieve.llm.mixing import mix_sources
from test_jaccard import plain_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, carried string, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "k", "r", "c", 1) for d, t, lang, s in rows], SCHEMA)


@pytest.mark.parametrize("bits,page", [(64, 100_000), (3, 4)])
def test_exact_dedup(spark, bits, page):
    rows = [(i, t, "en", "s") for i, t in enumerate([None, "", "a", "A", "a", "b" * 5000, "b" * 5000, *[f"t{i % 37}" for i in range(120)]])]
    docs = table(spark, rows).repartition(3)
    got = {r.doc_id: r for r in exact_dedup(docs, hash_bits=bits, page_slots=page).collect()}
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    for d, t, *_ in rows:
        own = groups[t or ""]
        assert (got[d].keep_id, got[d].group_size, got[d].kept) == (max(own), len(own), d == max(own))
        assert got[d].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_repeated_rows(spark):
    docs = table(spark, [(5, "x", "en", "s")] * 4 + [(None, "x", "en", "s"), (None, "y", None, None), (None, "y", None, None)])
    rows = exact_dedup(docs, carry=("key", "row")).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows if r.keep_id == 5) == 1 and sum(r.kept for r in rows if r.keep_id is None) == 1
    assert all(r.carried.key == "k" for r in rows) and exact_dedup(docs.filter("doc_id = 1")).count() == 0


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left, open_ = left - sum(3 * sizes[s] for s in full), open_ - full
    return target


def test_mixing(spark):
    sources = ["b", "a", None, "é", "Z", "a b", ""]
    rows = [(i, None if i % 11 == 0 else "w " * (i * 7 % 40), "en", sources[min(i % 13, 6)]) for i in range(400)] + [(900, "one " * 5000, None, "b")]
    docs = table(spark, rows).repartition(4)
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    again = {r.doc_id: r for r in mix_sources(docs.repartition(7)).collect()}
    sizes, taken = Counter(), Counter()
    for d, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        taken[s] += got[d].taken
        assert got[d].size == len(WORD.findall(t or "")) and 0 <= got[d].taken <= 3 * got[d].size
    target = plain_targets(sizes)
    for d, _, _, s in rows:
        assert got[d].source_size == sizes[s] and got[d].target == pytest.approx(target[s]) and got[d].taken == again[d].taken
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1
    assert mix_sources(docs.filter("doc_id < 0")).count() == 0
    assert mix_sources(docs.filter("text IS NULL")).filter("taken > 0").count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "", "en", None, 0), (10_003, "12 34 !!", None, "src1", 8)], docs.schema)
    junk = docs.limit(1).selectExpr("cast(10004 as bigint) as doc_id", "text", "lang", "source", "n_chars")
    frame = docs.unionByName(extra).unionByName(junk)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]

    one = stages["language_id"](spark, frame, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in frame.collect() if r.doc_id not in (10_001, 10_002, 10_003))
    assert one.columns == docs.columns

    two = stages["exact_dedup"](spark, one, SF).cache()
    last = {}
    for r in one.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in two.collect()) == sorted(last.values()) and two.columns == docs.columns

    three = stages["ngram_jaccard"](spark, two, SF).cache()
    plain = plain_components([(r.doc_id, r.text) for r in two.collect()])
    assert sorted(r.doc_id for r in three.collect()) == sorted(d for d, (n, c) in plain.items() if c == d or n == 0)
    assert three.columns == docs.columns

    four = stages["mix_sources"](spark, three, SF).cache()
    words, target = Counter(), plain_targets(Counter({s: n for s, n in Counter(
        s for r in three.collect() for s in [r.source] * len(WORD.findall(r.text))).items()}))
    texts = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) or r.text == texts[r.doc_id]
    assert all(abs(words[s] - target[s]) < 1 for s in target) and four.columns == docs.columns

    five = stages["best_fit_packing"](spark, four, SF).collect()
    loads = defaultdict(int)
    for r in five:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 4096 and sum(r.piece == 0 for r in five) == four.count()


def test_stage_edges(spark):
    rows = [(None, "a b c d e f g", "en", None), (None, "a b c d e f g", "en", None), (None, "A b c d e f g", "en", "s"), (4, None, None, None),
            (4, None, None, None), (4, "", "fr", "s"), (7, "q", None, "s")]
    left = one_per_component(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left if r.doc_id) == [(4, ""), (4, ""), (4, ""), (7, "q")]
    assert sum(r.doc_id is None for r in left) == 1 and left[0].key == "k"
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 100
