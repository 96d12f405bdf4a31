"""License scan by diagonal voting.

Every run of ``GRAM`` words of every text is joined with the positions at which a template has the
same words.  A match at word ``p`` of the text and position ``t`` of the template votes for the
diagonal ``p - t``, where the template would begin; the votes are summed up per text, template and
diagonal before anything is shuffled.  A word put in or left out moves the rest of a passage to a
diagonal nearby, so a diagonal with more votes than its neighbours takes theirs over.  What is left
is verified: the template's words that were met there, counted once, must make up a given share of it.

The join compares the words themselves, so no hash can be mistaken.  A base phrase stands where all
its runs vote for one diagonal, neighbours not counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import text_of
from pairsieve.llm.secrets import let
from pairsieve.session import small_table

#: Words per run; no template may be shorter.
GRAM = 3
#: Diagonals on either side that a passage may drift to, for templates of ``LONG`` words or more.
DRIFT = 6
LONG = 24
#: Share of a template's words that make its passage a license.
SHARE = 0.8
#: Positions of all templates up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_POSITIONS = 200_000
#: Characters that are not part of a word: ASCII without letters and digits (a fixed value).
_APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


# The phrases that are always found, and well-known passages of public licenses.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so"""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer"""),
    Template("apache-2", """you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0"""),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation"""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software"""),
)


def words_of(text: str) -> list[str]:
    """The words of a Python string by the rule of the scan."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _UPPER.lower())))


def word_array(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    plain = F.translate(text, _UPPER + _APART, _UPPER.lower() + " " * len(_APART))
    return F.array_remove(F.split(plain, " ", -1), "")


def _runs(words: Column) -> Column:
    """All runs of ``GRAM`` words, written with one space between words."""
    runs = words
    for k in range(1, GRAM):
        runs = F.zip_with(runs, F.slice(words, F.lit(k + 1), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(runs, F.lit(1), F.greatest(F.size(words) - (GRAM - 1), F.lit(0)))


def template_positions(spark: SparkSession, templates: tuple[Template, ...]) -> tuple[DataFrame, int]:
    """``run``, ``template`` (its number), ``at``; and how many positions there are.

    One more row, for the empty run that no text has, stands for the text itself.
    """
    rows = [("", -1, 0)]
    for number, template in enumerate(templates):
        words = template.words
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least: {template.text!r}")
        rows += [(" ".join(words[i:i + GRAM]), number, i) for i in range(len(words) - GRAM + 1)]
    return small_table(spark, rows, "run string, template int, at int"), len(rows)


def votes(docs: DataFrame, templates: tuple[Template, ...], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per text, template and diagonal the template positions that voted (``ats``, sorted).

    Every text also has a row of template -1, so that texts without any vote stay.
    """
    positions, count = template_positions(docs.sparkSession, templates)
    made = let(word_array(text_of(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.concat(F.array(F.lit("")), _runs(w)).alias("runs")))
    runs = (
        docs.select(F.monotonically_increasing_id().alias("row"), ref(doc_id).alias("doc_id"), made.alias("made"))
        .select("row", "doc_id", "made.n_words", F.posexplode("made.runs").alias("place", "run"))
    )
    met = runs.join(F.broadcast(positions) if count <= BROADCAST_POSITIONS else positions, "run")
    return met.groupBy("row", "doc_id", "n_words", "template", (F.col("place") - 1 - F.col("at")).alias("diagonal")).agg(
        F.array_sort(F.collect_set("at")).alias("ats"))  # as many as the template has, at most


def _covered(ats: Column) -> Column:
    """Words covered by the runs that begin at the sorted distinct positions."""
    steps = F.zip_with(ats, F.slice(ats, F.lit(2), F.size(ats)), lambda a, b: F.least(F.coalesce(b - a, F.lit(GRAM)), F.lit(GRAM)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def passages(found: DataFrame, templates: tuple[Template, ...], drift: int = DRIFT, long: int = LONG) -> DataFrame:
    """Peaks among the diagonals with their neighbours merged in: ``whole`` and ``share`` per peak.

    ``whole``: the diagonal alone has every run.  Of neighbours with equal votes the first one is
    the peak.  A diagonal is handled beside at most twice ``drift`` others.
    """
    sizes = small_table(found.sparkSession, [(i, len(t.words), t.base, t.label) for i, t in enumerate(templates)],
                        "template int, size int, base boolean, label string")
    own = found.filter("template >= 0").join(F.broadcast(sizes), "template")
    around = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-drift, drift)
    near = F.collect_list(F.struct("diagonal", "ats")).over(around)  # 2 * drift + 1 at most
    reach = F.when(F.col("base") | (F.col("size") < long), 0).otherwise(drift)
    mine = own.withColumn("near", near).withColumn("reach", reach).withColumn(
        "near", F.filter("near", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("reach")))
    stronger = F.exists("near", lambda x: (F.size(x["ats"]) > F.size("ats")) | (
        (F.size(x["ats"]) == F.size("ats")) & (x["diagonal"] < F.col("diagonal"))))
    merged = F.array_sort(F.array_distinct(F.flatten(F.transform("near", lambda x: x["ats"]))))
    return mine.filter(~stronger).select(
        "row", "doc_id", "n_words", "label", "base", F.col("diagonal").cast("long").alias("start"),
        (F.size("ats") == F.col("size") - (GRAM - 1)).alias("whole"),
        (_covered(merged) / F.col("size")).alias("share"))


def scan_licenses(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES,
    share: float = SHARE, drift: int = DRIFT,
) -> DataFrame:
    """One row per row of ``docs``: ids, word count, base places, labels and a score.

    ``n_base``, ``first_word`` and ``last_word`` count and locate the places of base phrases, words
    counted from 0; without any, 0 and nulls.  ``labels`` are those of base phrases and of every
    passage that has ``share`` of its template, ``score`` the largest share of any template, 0
    without a vote.  Null text is empty text and has no words; a null id stays null; repeated rows
    are scanned one by one; an empty table gives no rows; other columns of ``docs`` are not read, so
    their names cannot clash.  A very long text is held as one array of words in one task, as it
    was as a text; its votes are grouped by diagonal, so they spread over tasks.
    """
    found = votes(docs, templates, text, doc_id)
    peaks = passages(found, templates, drift).withColumn("hit", F.when(F.col("base"), F.col("whole")).otherwise(F.col("share") >= share))
    base = F.col("base") & F.col("whole")
    frame = peaks.unionByName(found.filter("template < 0").select("row", "doc_id", "n_words"), allowMissingColumns=True)
    labels = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    return frame.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("hit")).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")
