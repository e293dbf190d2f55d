"""License scans by diagonal voting.

Every rolling hash of k words of a text is joined by Spark to the template positions with that hash.  A hit votes
for the diagonal text position - template position; neighbouring diagonals (words put in or left out) are merged, and
a merged diagonal is verified: the share of the template's windows that it holds must reach COVERAGE inside a span
about as long as the template, and the windows that tell the template from its relatives must all be among them.  Where
verified spans of different labels overlap, the one of the larger share stays (then of more windows; ties stay both).
Exact phrases are found besides, as the base.  The score is the largest share, 1 for a phrase.

Templates are a fixed, short list, so their side is broadcast (its size is checked).  Only matching windows
are shuffled.

Cases: null and empty texts have no words, no labels and score 0; repeated rows get equal rows; templates and phrases
that repeat or overlap in a text all count; spans of equal share and windows keep both labels; labels are distinct and
sorted; very long texts are scanned whole; further columns are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import in_arrow, slices, text_or_empty
from .grams import LETTERS, Batch

K = 3
NEAR = 2
COVERAGE = 0.6
#: Phrases of the base and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: License statements by label, and the K-word windows that tell each from its relatives.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("the mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ()),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("license version 2",)),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ()),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ()),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("commons attribution noncommercial",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("commons attribution sharealike",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public", "license version 3")),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public", "either version 3")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public", "license version 2")),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public", "either version 2")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general",)),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general", "either version 3")),
    ("bsd", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    ("bsd", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ()),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("unlicense", "This is free and unencumbered software released into the public domain", ()),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
)


def _words(text: str) -> np.ndarray:
    return Batch([text.encode()], LETTERS, lower=True).words()


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the K-word windows of one text."""
    b = Batch([text.encode()], LETTERS, lower=True)
    return b.word_grams(b.words(), K)


def template_windows() -> list[tuple[int, int, str, int, int, list[int]]]:
    """(hash, template, label, position, windows of the template, positions that it is told by)."""
    out = []
    for i, (label, text, tells) in enumerate(TEMPLATES):
        at, grams = _windows(text)
        where = dict(zip(grams.tolist(), at.tolist(), strict=True))
        told = [where[int(_windows(x)[1][0])] for x in tells]
        out += [(int(h.astype(np.int64)), i, label, int(p), len(at), told) for p, h in zip(at, grams, strict=True)]
    assert len(out) < 100_000, "templates are broadcast"
    return out


BASE = "doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, base_labels string"


def base_scan(docs: DataFrame) -> DataFrame:
    phrases = [(_words(p), label) for p, label in PHRASES]

    def run(batches):
        for b in batches:
            raw, rows = [t.encode() for t in b.column(2).to_pylist()], []
            for a, z in slices(raw):
                x = Batch(raw[a:z], LETTERS, lower=True)
                w, first = x.words(), np.concatenate(([0], np.cumsum(x.n_words)))
                found = []
                for wanted, label in phrases:
                    n = len(w) - len(wanted) + 1
                    if n > 0:
                        hit = x.owner[:n] == x.owner[len(wanted) - 1 :]
                        for j, h in enumerate(wanted):
                            hit &= w[j : j + n] == h
                        found += [(int(x.owner[i]), int(i - first[x.owner[i]]), label) for i in np.flatnonzero(hit)]
                by: dict[int, list] = {}
                for o, at, label in found:
                    by.setdefault(o, []).append((at, label))
                for o in range(x.n):
                    hits = by.get(o, [])
                    rows.append((int(x.n_words[o]), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({label for _, label in hits}))))
            ints = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.record_batch([b.column(0), b.column(1), *ints, pa.array([r[4] for r in rows], pa.string())], names=[c.split()[0] for c in BASE.split(", ")])

    return in_arrow(docs, run, BASE)


def windows(docs: DataFrame) -> DataFrame:
    """One row for each window of K words: its position and hash."""

    def run(batches):
        for b in batches:
            raw = [t.encode() for t in b.column(2).to_pylist()]
            hashes, lengths = [], []
            for a, z in slices(raw):
                x = Batch(raw[a:z], LETTERS, lower=True)
                at, grams = x.word_grams(x.words(), K)
                hashes.append(grams.view(np.int64))
                lengths.append(np.bincount(x.owner[at], minlength=x.n))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths) if lengths else np.zeros(0)))).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "row_key", "hashes"])

    listed = in_arrow(docs, run, "doc_id long, row_key long, hashes array<long>")
    return listed.select("doc_id", "row_key", F.posexplode("hashes").alias("at", "hash"))


def scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), text_or_empty().alias("text"))
    known = spark.createDataFrame(template_windows(), "hash long, template int, label string, spot int, windows int, told array<int>")
    hits = windows(texts).join(F.broadcast(known), "hash").withColumn("diagonal", F.col("at") - F.col("spot"))
    keys = ["doc_id", "row_key", "template", "label", "windows", "told"]
    votes = hits.groupBy(*keys, "diagonal").agg(F.collect_set("spot").alias("spots"), F.min("at").alias("start"), F.max("at").alias("stop"))
    order = W.partitionBy(*keys).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    grouped = votes.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(order))
    spots = F.array_distinct(F.flatten(F.collect_list("spots")))
    bands = grouped.groupBy(*keys, "band").agg(spots.alias("spots"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    held, length = F.size("spots"), F.col("stop") - F.col("start") + 1
    share = F.least(held / F.greatest(F.col("windows"), length - NEAR * K), F.lit(1.0))
    judged = bands.withColumn("share", share).withColumn("held", held).withColumn("sure", (F.col("share") >= COVERAGE) & (F.size(F.array_except("told", "spots")) == 0))
    # a verified span is no longer than this, so one that overlaps another starts this near
    reach = max(int(w / COVERAGE) + 1 for *_, w, _ in template_windows()) + NEAR * K + K
    span = F.struct("label", "start", "stop", "share", "held")
    around = W.partitionBy("doc_id", "row_key").orderBy("start").rangeBetween(-reach, reach)
    rivals = judged.withColumn("rivals", F.collect_list(F.when(F.col("sure"), span)).over(around))
    better = F.exists("rivals", lambda r: (r["label"] != F.col("label")) & (r["start"] <= F.col("stop")) & (F.col("start") <= r["stop"]) & (F.struct(r["share"], r["held"]) > F.struct("share", "held")))
    told = rivals.select("doc_id", "row_key", "share", F.when(F.col("sure") & ~better, F.col("label")).alias("label"))
    found = told.groupBy("doc_id", "row_key").agg(F.max("share").alias("share"), F.collect_set("label").alias("found"))
    base = base_scan(texts)
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.row_key") == F.col("f.row_key")), "left")
    listed = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(listed, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select("b.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.cast("double").alias("score"))
