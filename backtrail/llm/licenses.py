"""License scans: text blocks that contain most words of a license notice, by an exact set-similarity join.

A template is a set of words with a label. A block of its size is a window of 2 h words that starts at a multiple of h,
h being the template's words rounded up to a power of two, so any h words in a row lie in one block. A block meets the
template if it contains at least a share of its words. Words of the templates are numbered by how often they occur in
the whole corpus, rarest first. If a block is to contain o of a template's n words, it holds one of the n - o + 1 rarest
(prefix filter), holds at least o words of templates (length filter), and behind the first word that both share there
are enough words left on both sides (positional filter). What passes is counted word by word. So blocks without a rare
word of a template cost nothing, and none that meets the threshold is lost. The templates are the small, fixed side:
they go to every task, the texts stay where they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and public license notices, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "This document is confidential and may not be reproduced or distributed without prior written permission"),
)
THRESHOLD = "0.85"  # a notice of five words or fewer needs all of them: at 0.8 "under the", "mit" and one more word would do

#: A-Z in lower case; every other ASCII character but digits and a-z parts words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = "n_words bigint, places array<struct<label:string,word:bigint>>, blocks array<struct<label:string,template:int,start:bigint,stop:bigint,containment:double>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def block_half(template: str) -> int:
    """Words from one block of this template to the next: its own, rounded up to a power of two."""
    return 1 << (len(words(template)) - 1).bit_length()


def least_shared(size: int, threshold: str) -> int:
    """Words of a template of `size` different ones that a block needs."""
    return max(1, ceil(Fraction(threshold) * size))


class Index:
    """Templates with their words numbered from the rarest on; `order` lists the words by frequency."""

    def __init__(self, templates, order: list[bytes], threshold: str):
        self.number = {w: i for i, w in enumerate(order)}
        self.sets = [np.unique([self.number[w] for w in words(t)]) for _, t in templates]
        self.need = [least_shared(len(s), threshold) for s in self.sets]
        self.half = [block_half(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.posting: dict[int, list[tuple[int, int]]] = {}  # word -> (template, place in its prefix)
        for t, s in enumerate(self.sets):
            for i, w in enumerate(s[: len(s) - self.need[t] + 1].tolist()):
                self.posting.setdefault(w, []).append((t, i))
        self.rare = {w for w, i in self.number.items() if i in self.posting}

    def blocks(self, text: list[bytes]) -> list[dict]:
        """Every block of the text that contains enough of a template, by start, then template."""
        if self.rare.isdisjoint(text):
            return []
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in text), np.int32, len(text))
        found, tried = [], set()
        for at in np.flatnonzero(np.isin(ids, list(self.posting))).tolist():
            for t, i in self.posting[int(ids[at])]:
                half = self.half[t]
                for block in (at // half - 1, at // half):
                    if block < 0 or (t, block) in tried:
                        continue
                    tried.add((t, block))
                    window = np.unique(ids[block * half : (block + 2) * half])
                    window = window[window >= 0]
                    shared = self._shared(window, t)
                    if shared >= self.need[t]:
                        start, stop = block * half, min((block + 2) * half, len(text))
                        found.append({"label": self.labels[t], "template": t, "start": start, "stop": stop, "containment": shared / len(self.sets[t])})
        return sorted(found, key=lambda b: (b["start"], b["template"]))

    def _shared(self, window: np.ndarray, t: int) -> int:
        """Words shared by a block and template t; 0 where a filter tells that they are too few."""
        own, need = self.sets[t], self.need[t]
        if len(window) < need:
            return 0
        common, i, j = np.intersect1d(own[: len(own) - need + 1], window[: len(window) - need + 1], assume_unique=True, return_indices=True)
        if not len(common) or 1 + min(len(own) - i[0] - 1, len(window) - j[0] - 1) < need:
            return 0
        return len(np.intersect1d(own, window, assume_unique=True))


def places(text: list[bytes], phrases) -> list[dict]:
    """(label, first word) of every place where the words of a phrase stand one after the other, by word."""
    joined = b" " + b" ".join(text) + b" "
    found = []
    for phrase, label in phrases:
        sought = b" " + b" ".join(words(phrase)) + b" "
        at, seen, word = joined.find(sought), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            found.append({"label": label, "word": word})
            seen = at
            at = joined.find(sought, at + 1)
    return sorted(found, key=lambda p: (p["word"], p["label"]))


def word_order(docs: DataFrame, text: str, vocabulary: set[bytes]) -> list[bytes]:
    """The vocabulary by how often its words occur in all texts, rarest first, ties by the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(filter(vocabulary.__contains__, words(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {bytes(r.word): r.n for r in counted.collect()}  # no more than the words of the templates
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: str = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, places (label, word), blocks (label, template, start, stop, containment).

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case; start, stop and word count words
    from 0, stop is exclusive, template numbers `templates` (label, text). places has each place of a phrase,
    overlaps included; blocks each block that contains at least `threshold` (a decimal as text, so that it is exact, above 0)
    of a template's different words. A text without a word, empty or null, has none. Rows with a null id are kept, repeated
    rows come back as often as given. Other columns are ignored. Templates without a word are refused. Empty in, empty out.
    """
    if not all(words(t) for _, t in (*templates, *((label, p) for p, label in phrases))):
        raise ValueError("templates and phrases need a word")
    index = Index(templates, word_order(docs, text, {w for _, t in templates for w in words(t)}), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                body = words(x.as_py())
                rows.append((len(body), places(body, phrases), index.blocks(body)))
            place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
            block = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), place, block))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [doc_id, "n_words", "places", "blocks"])

    kept = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))
    return kept.mapInArrow(run, f"`{doc_id}` {kept.schema[doc_id].dataType.simpleString()}, {FOUND}")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + i.decode() + "'" for i in items) + "]"


def sql(templates=TEMPLATES, phrases=PHRASES, threshold: str = THRESHOLD) -> str:
    """DuckDB SQL for the digest of `scan`: every block is compared with every template."""
    rows = []
    for i, (label, t) in enumerate(templates):
        own = sorted(set(words(t)))
        rows.append(f"({i}, '{label}', {block_half(t)}, {len(own)}, {least_shared(len(own), threshold)}, {_sql_list(own)})")
    at = [f"lead(word, {k}) OVER (PARTITION BY rid ORDER BY i)" if k else "word" for k in range(max(len(words(p)) for p, _ in phrases))]
    base = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM ahead WHERE " + " AND ".join(f"w{k} = '{w.decode()}'" for k, w in enumerate(words(p)))
        for p, label in phrases
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
tok AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
ahead AS (SELECT rid, i, {", ".join(f"{a} AS w{k}" for k, a in enumerate(at))} FROM tok),
base AS ({base}),
template(t, label, half, size, need, own) AS (VALUES {", ".join(rows)}),
owned AS (SELECT t, label, half, size, need, unnest(own) AS word FROM template),
hit AS (SELECT rid, t, label, size, need, word, i // half AS b FROM tok JOIN owned USING (word)),
held AS (SELECT rid, t, label, size, count(DISTINCT word) AS n
  FROM (SELECT * FROM hit UNION ALL SELECT rid, t, label, size, need, word, b - 1 AS b FROM hit WHERE b > 0)
  GROUP BY rid, t, label, size, need, b HAVING count(DISTINCT word) >= need),
named AS (SELECT rid, label, n::DOUBLE / size AS score, false AS base, NULL AS i FROM held
  UNION ALL SELECT rid, label, 1.0, true, i FROM base),
per AS (SELECT rid, count(*) FILTER (base) AS n_base, min(i) AS first_word, max(i) AS last_word, max(score) AS score, count(*) FILTER (NOT base) AS n_blocks,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN per USING (rid)"""
