"""License scans by diagonal voting.

Every rolling word k-gram hash of a text is joined in Spark to the template positions that have the same hash; a match
votes for the diagonal (place in the text minus place in the template). Votes are added up by diagonal, neighbouring
diagonals that lie close in the text are merged (insertions and deletions move a copy to the next diagonals), and the
resulting spans are verified word by word. Phrases are templates matched by two-word grams and must stand unchanged;
longer templates are matched by four-word grams; those of up to ``SHORT`` words must be whole, others need ``COVERED``
of their words in order.

The template table comes from the fixed library below (some hundred positions), whatever the input: it is broadcast.

Defined results: a null or empty text has no words, no places, null first and last word, empty labels and score 0.
Rows of equal or null id are separate rows, equal rows have equal results. Extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import id_filter, wanted
from .store import discard, materialize, small_batches, tidied

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASE_GRAM, GRAM, DRIFT, GAP, COVERED, SHORT = 2, 4, 3, 12, 0.6, 12

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further templates by label: notices and characteristic passages of public licenses (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWERED))


class Library:
    """The templates in order: label, words, whether a phrase; and the hashes of their grams."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        self.entries = [(label, words_of(p), True) for p, label in phrases.items()] + [(label, words_of(t), False) for label, t in templates]

    def positions(self) -> list[tuple[int, int, int]]:
        """(gram, template, place) for every gram of every template."""
        out = []
        for t, (_, own, phrase) in enumerate(self.entries):
            data, offsets = K.utf8_rows(pa.array([" ".join(own)]))
            h, at = K.grams(K.words(data, offsets, K.ALNUM), tuple(range(PHRASE_GRAM if phrase else GRAM)))
            out += [(int(x), t, int(i)) for x, i in zip(h.view(np.int64), at)]
        return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every rolling hash of a text: its two-word grams and its four-word grams, each in text order."""
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(2))
        for i, j in K.blocks(offsets):
            w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM)
            counts = np.diff(w.first)
            lists = []
            for k in (PHRASE_GRAM, GRAM):
                h, _ = K.grams(w, tuple(range(k)))
                ends = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], names=["doc_id", "text_hash", "two", "four"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(2))
        counts = [np.diff(K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM).first) for i, j in K.blocks(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=["doc_id", "text_hash", "n_words"])


def verify_span(own: list[str], entry: tuple[str, list[str], bool], start: int, end: int) -> tuple[int, int, float] | None:
    """The first word, the word after the last, and the share of the template's words found in order; None if too few."""
    _, template, phrase = entry
    if phrase:
        return (start, start + len(template), 1.0) if start >= 0 and own[start : start + len(template)] == template else None
    lo, hi = max(0, start - DRIFT), min(len(own), end + DRIFT)
    blocks = [b for b in difflib.SequenceMatcher(None, own[lo:hi], template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    first, last = lo + blocks[0].a, lo + blocks[-1].a + blocks[-1].size
    share = sum(b.size for b in blocks) / max(len(template), last - first)
    return (first, last, share) if share >= (COVERED if len(template) > SHORT else 1.0) else None


def with_spans(rows: DataFrame, spans: DataFrame, how: str = "left") -> DataFrame:
    """Rows (doc_id, text_hash) with their spans; null ids meet each other."""
    named = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans")
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), how).drop("__id", "__hash")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", library: Library | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames: ``doc_id, text_hash, n_words`` of every row, and the verified spans by ``doc_id, text_hash``:
    ``spans array<struct<label, phrase, start, end, share>>`` of texts that have any."""
    spark, library = docs.sparkSession, library or Library()
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    table = F.broadcast(spark.createDataFrame(library.positions(), "gram long, template int, place int"))  # the fixed library
    grams = rows.mapInArrow(lambda b: tidied(_grams(b)), "doc_id long, text_hash long, two array<long>, four array<long>")
    pairs = grams.select("doc_id", "text_hash", F.explode(F.array(F.struct(F.col("two").alias("g")), F.struct(F.col("four").alias("g")))).alias("k")).select("doc_id", "text_hash", F.posexplode("k.g").alias("at", "gram"))
    votes = pairs.join(table, "gram").select("doc_id", "text_hash", "template", (F.col("at") - F.col("place")).alias("diagonal"), "at")
    lines = votes.groupBy("doc_id", "text_hash", "template", "diagonal").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count_distinct("at").alias("votes"))
    # neighbouring diagonals of one text and template; phrases keep each diagonal
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("start", "diagonal")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT
    opens = (reach.isNull() | apart | (F.col("start") > reach + GAP) | (F.col("template") < len(PHRASES))).cast("int")
    merged = lines.withColumn("open", opens).withColumn("part", F.sum("open").over(order)).groupBy("doc_id", "text_hash", "template", "part")
    spans = merged.agg(F.min("diagonal").alias("from"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("votes").alias("votes"))
    need = {t: max(1, round(0.3 * (len(w) - (PHRASE_GRAM if p else GRAM) + 1))) if not p else len(w) - PHRASE_GRAM + 1 for t, (_, w, p) in enumerate(library.entries)}
    enough = F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("template"))
    # a span reaches as far as its template would
    length = F.element_at(F.create_map(*[F.lit(x) for t, (_, w, _) in enumerate(library.entries) for x in (t, len(w))]), F.col("template"))
    held = spans.where(F.col("votes") >= enough).select("doc_id", "text_hash", F.struct("template", F.greatest("from", F.lit(0)).alias("start"), F.greatest(F.col("from") + length, F.col("end") + GRAM).alias("end")).alias("s"))
    wanted_rows, path = materialize(held.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("spans")), "license-spans")
    some = wanted(rows, "text_hash", id_filter(wanted_rows, "text_hash")).dropDuplicates(["doc_id", "text_hash"])
    some = with_spans(some, wanted_rows, "inner")
    entries = library.entries

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
        for batch in batches:
            for r in range(batch.num_rows):
                own = words_of(batch.column(2)[r].as_py())
                found = {}
                for s in batch.column(3)[r].as_py():
                    entry = entries[s["template"]]
                    if (v := verify_span(own, entry, s["start"], s["end"])) is not None:
                        found[s["template"], v[0]] = {"label": entry[0], "phrase": entry[2], "start": v[0], "end": v[1], "share": v[2]}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([list(found.values())], kind)], names=["doc_id", "text_hash", "spans"])

    out = "doc_id long, text_hash long, spans array<struct<label: string, phrase: boolean, start: int, end: int, share: double>>"
    verified, _ = materialize(some.select("doc_id", "text_hash", "text", "spans").mapInArrow(lambda b: tidied(verify(b)), out), "licenses")
    discard(spark, path)
    return rows.mapInArrow(_counts, "doc_id long, text_hash long, n_words long"), verified
