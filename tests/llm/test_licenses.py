"""The license scan against plain word matching."""

import random
import re

from pairsieve.llm.licenses import TEMPLATES, Template, scan_licenses, word_array, words_of
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i:i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_of(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def texts():
    rng = random.Random(2)
    pieces = ["under", "the", "MIT", "License", "under the MIT licence", "Under the\nMIT-License.", "Apache License, Version 2.0", "apache license",
              "CC BY-NC", "cc by nc by nc cc", "CC-BY", "é", "🙂license", "version_2", "x", "nc", "\x00", "²"]
    made = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [None, "", " \t", "cc", "cc by", "cc by nc", "CC BY NC CC BY NC", "under the mit license" * 3, "a " * 30_000 + "cc-by-nc"] + made


def test_base_phrases(spark):
    data = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "cc by nc", "y", 2), (3, "cc by nc", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, label string, template int").repartition(3)
    rows = scan_licenses(docs).collect()
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, *base_of(r)) for r in rows), key=key) == sorted(((d, *plain(t)) for d, t, *_ in data), key=key)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 or not r.base_labels
    assert scan_licenses(docs.filter("doc_id < 0")).count() == 0


def test_edited_passages(spark):
    rng = random.Random(7)
    whole = next(t for t in TEMPLATES if t.label == "mit" and not t.base).words
    exact = ["lorem"] * 20 + whole + ["ipsum"] * 9
    edited = list(whole)
    edited[30] = "changed"
    edited[50:50] = ["two", "more"]
    del edited[10]
    twice = whole + ["between"] * 3 + edited
    half = whole[:len(whole) // 2] + ["other"] * 40
    shuffled = list(whole)
    rng.shuffle(shuffled)
    rows = [(0, " ".join(exact)), (1, " ".join(edited)), (2, " ".join(twice)), (3, " ".join(half)), (4, " ".join(shuffled)),
            (5, "This work is licensed under the GNU General Public License, version 3."), (6, "nothing of the kind")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "mit", "", "", "gpl", ""]
    assert got[0].score == 1 and 0.8 <= got[1].score < 1 and 0.4 < got[3].score < 0.6 and got[6].score == 0
    assert all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for r in got.values())


def test_shuffled_templates_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert {d: base_of(r) for d, r in rows.items()} == {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").collect()}
    monkeypatch.setattr("pairsieve.llm.licenses.BROADCAST_POSITIONS", 0)
    assert {r.doc_id: r for r in scan_licenses(docs).collect()} == rows


def test_words(spark):
    given = ["Ab1-c_d é\x7fX{y}", "", "ÀB 2\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    assert [r.w for r in docs.orderBy("i").select(word_array(F.col("t")).alias("w")).collect()] == [words_of(t) for t in given]
    own = (Template("a", "x y z"),)
    assert scan_licenses(spark.createDataFrame([(1, "x y z")], "doc_id long, text string"), templates=own).first().labels == "a"
