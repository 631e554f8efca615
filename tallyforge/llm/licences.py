"""Licence scan by a positional index of rare words.

Method. Templates are notices and grants of public licences with the key phrases that must stand in them. A first scan counts in how many texts each word of the
templates occurs, which gives its inverse document frequency. Each key phrase is posted in the index under the word of it with the highest such frequency, with the word's
place in the phrase. The second scan looks up each text's words that have postings, its rarest licence words, takes the place in the phrase from the
place in the text, and compares the phrase's other words at the places that follow. A template holds at an alignment at which all its key phrases stand
in their order and at their distances, give or take `slack` words; the share of its words found at their places, weighted by inverse document frequency, is
the score. Base phrases are templates of one phrase each: every place of them is found, as their rarest word is always looked up.

Scale. Two scans of the texts. The first sends one number for each word of the templates from each task, the second shuffles nothing; the index is a few
thousand numbers, of a size that the templates alone fix. Work in a text grows with its length and the places found, so hot sources, copies and very long texts are as good as any others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import text_steps
from .scratch import small_batches

#: Phrases that are labels of their own wherever they stand (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, text and key phrases of each template: wording of the licences themselves (fixed values). Without key phrases the whole text is one.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction")),
    ("mit", "licensed under the MIT license", ()),
    ("mit", "released under the MIT license", ()),
    ("mit", "SPDX-License-Identifier: MIT", ()),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("licensed under the apache license version 2", "except in compliance with the license")),
    ("apache-2", "licensed under the Apache License, Version 2.0", ()),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ()),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("terms of the gnu general public license as published by", "either version 2 of the license")),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ()),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("terms of the gnu general public license as published by", "either version 3 of the license")),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ()),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0", ()),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("terms of the gnu lesser general public license as published by", "either version 2 1 of the license")),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("terms of the gnu lesser general public license as published by", "either version 3 of the license")),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("terms of the gnu affero general public license as published by", "either version 3 of the license")),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("subject to the terms of the mozilla public license v 2",)),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice", ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice")),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software for any purpose with or without fee is hereby granted",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("provided as is without any express or implied warranty in no event will the authors be held liable",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",)),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("terms of the eclipse public license 2",)),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights to",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by", "licensed under CC BY 4.0", ()),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under CC BY-SA", ()),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives",)),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA", ("cc by nc sa",)),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND", ("cc by nc nd",)),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words by which the distance of two key phrases may differ from the template's.
SLACK = 12
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,stop:long,score:double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def word_hashes(words: list[str]) -> np.ndarray:
    """The kernel's hash of each word."""
    out = [step.words("alnum").hashes() for step in text_steps(pa.array([" ".join(words)]))]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass
class Template:
    label: str
    words: list[str]
    phrases: list[tuple[int, int]]  # number of the phrase and its place in the template, in order
    base: bool


@dataclass
class Index:
    """Phrases posted under their rarest word, and the templates that ask for them."""

    templates: list[Template] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, base: dict[str, str], templates: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Index:
        self, numbers = cls(), {}
        for is_base, label, text, keys in [*[(True, v, k, ()) for k, v in base.items()], *[(False, *t) for t in templates]]:
            words, at, found = words_of(text), 0, []
            if not words:
                raise ValueError(f"a template of {label} has no words")
            for key in keys or (text,):
                k = words_of(key)
                at = next((i for i in range(at, len(words) - len(k) + 1) if k and words[i : i + len(k)] == k), -1)
                if at < 0:
                    raise ValueError(f"{key!r} does not stand in the template of {label} behind the phrases before it")
                found.append((numbers.setdefault(tuple(k), len(numbers)), at))
                at += len(k)
            self.templates.append(Template(label, words, found, is_base))
        self.phrases = [list(k) for k in numbers]
        return self

    def vocabulary(self) -> list[str]:
        return sorted({w for t in self.templates for w in t.words})


def document_frequencies(docs: DataFrame, words: list[str], *, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and of those that hold each word: one scan, summed inside each task, so that each sends a number a word."""
    small_batches(docs.sparkSession)
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    known = hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for step in text_steps(batch.column(0)):
                w = step.words("alnum")
                h = w.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pairs = np.unique(w.rows()[hit] * len(known) + at[hit])
                total[:-1] += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

    found = {r["at"]: r.n for r in docs.select(F.col(text_col).cast("string")).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return found.get(len(known), 0), {words[order[i]]: found.get(i, 0) for i in range(len(known))}


class Scanner:
    """The index made ready for texts: postings by hash of the rarest word, weights of the templates' words."""

    def __init__(self, index: Index, rows: int, frequency: dict[str, int], slack: int = SLACK):
        idf = {w: float(np.log((1 + rows) / (1 + frequency.get(w, 0)))) + 1e-6 for w in index.vocabulary()}
        self.templates, self.slack = index.templates, slack
        self.phrases = [word_hashes(p) for p in index.phrases]
        postings: dict[int, list[tuple[int, int]]] = {}
        for number, p in enumerate(index.phrases):
            place = max(range(len(p)), key=lambda i: (idf[p[i]], -i))
            postings.setdefault(int(self.phrases[number][place]), []).append((number, place))
        self.rare = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(h)] for h in self.rare]
        self.hashes = [word_hashes(t.words) for t in index.templates]
        self.weights = [np.array([idf[w] for w in t.words]) for t in index.templates]

    def places(self, h: np.ndarray, of: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """row: phrase: places (words of the step) at which the phrase stands, in order. h: word hashes; of: word range of each row."""
        found: dict[int, dict[int, list[int]]] = {}
        if not len(h) or not len(self.rare):
            return found
        at = np.minimum(np.searchsorted(self.rare, h), len(self.rare) - 1)
        rare = np.flatnonzero(self.rare[at] == h)
        for word in np.unique(at[rare]).tolist():
            here = rare[at[rare] == word]
            rows = np.searchsorted(of, here, "right") - 1
            for number, place in self.postings[word]:
                phrase = self.phrases[number]
                start = here - place
                good = (start >= of[rows]) & (start + len(phrase) <= of[rows + 1])
                start, row = start[good], rows[good]
                for j, x in enumerate(phrase):
                    same = h[start + j] == x
                    start, row = start[same], row[same]
                for r, s in zip(row.tolist(), start.tolist(), strict=True):
                    found.setdefault(r, {}).setdefault(number, []).append(s)
        return found

    def matches(self, h: np.ndarray, lo: int, hi: int, places: dict[int, list[int]]) -> list[tuple[str, int, int, float, bool]]:
        """label, start, stop, score and whether it is a base phrase, of each template that holds somewhere in the words lo to hi; starts and stops count from lo."""
        out = []
        for t, th, weight in zip(self.templates, self.hashes, self.weights, strict=True):
            if any(number not in places for number, _ in t.phrases):
                continue
            (first, rel), rest = t.phrases[0], t.phrases[1:]
            for start in places[first]:
                begin = [start - rel]  # where the template would begin by each of its phrases
                behind = start + len(self.phrases[first])
                for number, where in rest:
                    # the nearest to its place, behind the phrase before
                    wanted, known = begin[-1] + where, places[number]
                    i = bisect_left(known, wanted)
                    near = min((p for p in known[max(0, i - 1) : i + 1] if p >= behind), key=lambda p: (abs(p - wanted), p), default=None)
                    if near is None or abs(near - wanted) > self.slack:
                        break
                    begin.append(near - where)
                    behind = near + len(self.phrases[number])
                else:
                    # each stretch of the template is compared from the phrase that it begins with
                    cuts = [0, *[where for _, where in rest], len(th)]
                    share = 0.0
                    for b, i, j in zip(begin, cuts, cuts[1:], strict=False):
                        i2, j2 = max(i, lo - b), min(j, hi - b)
                        if i2 < j2:
                            share += float(weight[i2:j2][h[b + i2 : b + j2] == th[i2:j2]].sum())
                    out.append((t.label, max(begin[0], lo) - lo, min(begin[-1] + len(th), hi) - lo, min(1.0, share / float(weight.sum())), t.base))
        return out


def licence_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start), base_labels, labels, score, spans.

    base_labels and labels are distinct and sorted; labels has the base ones and those of all templates that hold. score: the best match, 1 where a template stands whole, 0 without any.
    spans: label, start, stop (words, from 0) and score of each match, base phrases included, by start. Null and empty texts have no words and no labels; rows that repeat are all returned; a null id stays
    null; an empty table gives no rows. Texts are taken whole, however long. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = Index.of(base, templates)
    scanner = spark.sparkContext.broadcast(Scanner(index, *document_frequencies(docs, index.vocabulary(), text_col=text_col), slack))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
    names = pa.list_(pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner.value
        for batch in batches:
            for step in text_steps(batch.column(1)):
                w = step.words("alnum")
                h, n = w.hashes(), step.hi - step.lo
                rows: list[list[tuple[str, int, int, float, bool]]] = [[] for _ in range(n)]
                for r, places in s.places(h, w.of).items():
                    rows[r] = sorted(s.matches(h, int(w.of[r]), int(w.of[r + 1]), places), key=lambda m: (m[1], m[2], m[0]))
                starts = [[m[1] for m in found if m[4]] for found in rows]
                columns = [
                    batch.column(0).slice(step.lo, n),
                    pa.array(np.diff(w.of).astype(np.int64)),
                    pa.array([len(x) for x in starts], pa.int64()),
                    pa.array([min(x, default=None) for x in starts], pa.int64()),
                    pa.array([max(x, default=None) for x in starts], pa.int64()),
                    pa.array([sorted({m[0] for m in found if m[4]}) for found in rows], names),
                    pa.array([sorted({m[0] for m in found}) for found in rows], names),
                    pa.array([max((m[3] for m in found), default=0.0) for found in rows], pa.float64()),
                    pa.array([[{"label": m[0], "start": m[1], "stop": m[2], "score": m[3]} for m in found] for found in rows], span),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, RESULT)
