"""License scans: phrases, and an exact containment join of text blocks with templates.

A block of a text, for a template of L words, is a run of L + L // 4 consecutive words,
whatever the lines and comment marks between them. A block matches a template when it
holds at least ``threshold`` of the template's distinct words, and all the words that
name the license. Tokens are ordered by their frequency in the whole corpus, rarest
first. A block can match only if it has one of a template's rarest tokens (prefix
filter), and if the text is long enough (length filter). Where such a token is the rarest that both
share, rarer ones are missing: what the template has from its rank on, and what the
words in reach have from that rank on, must still make up the threshold (positional filter). What passes is
counted exactly, so every matching block is found. Of matches that overlap, the one with
most words in common is taken: a notice is not also one of a license whose words it contains.
Matches with equally many words and an equal share are ties, and all of them stay.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import Powers, chunks, letter_words, scan

THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Usual license notices, as publishers word them: label, words that must be there, text.
TEMPLATES = (
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "mit", "Licensed under the MIT License."),
    ("mit", "", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files, to deal in the Software without restriction."""),
    ("apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "apache 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    ("gpl-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation."""),
    ("gpl-3.0", "gnu 3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl-2.0", "gnu 2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "gnu lesser", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation."""),
    ("agpl-3.0", "gnu affero", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License."""),
    ("cc-by-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "cc by nd 4", "Licensed under CC BY-ND 4.0."),
    ("cc-by-4.0", "commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "commons sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "commons noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "commons noderivatives 4", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("bsd", "", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", "", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met."""),
    ("mpl-2.0", "mozilla 2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("zlib", "", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software."""),
    ("unlicense", "", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."""),
)

SCANNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_blocks", T.LongType()),
    ]
)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = scan(pa.array(texts, pa.large_string()), letter_words(), Powers())
    return [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def _vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate(_hashes([x for _, must, text in templates for x in (must, text)])))


def _slots(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, -1 if it has none."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> np.ndarray:
    """How often each template token occurs in all texts; one number per token reaches the driver."""
    vocabulary = _vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind, total = Powers(), letter_words(), np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                found = _slots(vocabulary, scan(texts, kind, powers).hash)
                total += np.bincount(found[found >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["token", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[row["token"]] = row["n"]
    return out


@dataclass(frozen=True)
class _Template:
    label: str
    tokens: frozenset[int]  # vocabulary places
    must: frozenset[int]
    needed: int
    reach: int  # words of a block


@dataclass(frozen=True)
class Hit:
    """A template's words within ``start`` and ``end`` (words of a text)."""

    template: int
    start: int
    end: int
    both: int
    share: float

    def rank(self) -> tuple[int, float]:
        return self.both, self.share


class _Index:
    """Templates by the tokens of their prefixes."""

    def __init__(self, templates, frequencies: np.ndarray, threshold: float) -> None:
        self.vocabulary = _vocabulary(templates)
        order = np.lexsort((self.vocabulary, frequencies))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.rank = rank
        self.templates: list[_Template] = []
        self.posting: dict[int, list[tuple[int, int]]] = {}  # templates of a token, and how many of their tokens are not rarer
        for (label, _, _), words, names in zip(templates, _hashes([t for _, _, t in templates]), _hashes([m for _, m, _ in templates]), strict=True):
            tokens = sorted({int(x) for x in _slots(self.vocabulary, words)}, key=lambda x: rank[x])
            needed = math.ceil(threshold * len(tokens) - 1e-9)
            for i, token in enumerate(tokens[: len(tokens) - needed + 1]):
                self.posting.setdefault(token, []).append((len(self.templates), len(tokens) - i))
            must = frozenset(int(x) for x in _slots(self.vocabulary, names))
            self.templates.append(_Template(label, frozenset(tokens), must, needed, len(words) + len(words) // 4))
        self.widest = max(t.reach for t in self.templates)
        self.in_prefix = np.zeros(len(self.vocabulary), dtype=bool)
        self.in_prefix[list(self.posting)] = True

    def hits(self, places: np.ndarray, slots: np.ndarray, n_words: int) -> list[Hit]:
        """Matches in a text, given the places and tokens of its vocabulary words; the better of those that overlap."""
        near: dict[int, list[int]] = {}
        ranks = self.rank[slots]
        for i in np.flatnonzero(self.in_prefix[slots]).tolist():
            place = int(places[i])
            for t, left in self.posting[int(slots[i])]:
                template = self.templates[t]
                # as the rarest shared token: no rarer word in reach counts
                lo, hi = np.searchsorted(places, (place - template.reach + 1, place + template.reach))
                if min(left, np.count_nonzero(ranks[lo:hi] >= ranks[i])) >= template.needed:
                    near.setdefault(t, []).append(place)
        found = [hit for t, at in near.items() if n_words >= self.templates[t].needed for hit in self._of_template(t, at, places, slots)]
        found.sort(key=lambda h: h.start)
        starts = [h.start for h in found]
        # a match is no longer than the widest block, and those of a template do not overlap: few are near
        beside = lambda h: found[bisect_left(starts, h.start - self.widest) : bisect_left(starts, h.end)]
        return [x for x in found if not any(_covers(y, x) for y in beside(x))]

    def _of_template(self, t: int, at: list[int], places: np.ndarray, slots: np.ndarray) -> list[Hit]:
        template, out = self.templates[t], []
        cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] >= 2 * template.reach), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo = np.searchsorted(places, at[a] - template.reach, side="right")
            hi = np.searchsorted(places, at[b - 1] + template.reach)
            own = [(p, s) for p, s in zip(places[lo:hi].tolist(), slots[lo:hi].tolist(), strict=True) if s in template.tokens]
            in_reach = {s for _, s in own}
            if len(in_reach) >= template.needed and template.must <= in_reach:
                out += _blocks(t, template, own)
        return out


def _blocks(t: int, template: _Template, own: list[tuple[int, int]]) -> list[Hit]:
    """The best blocks, none overlapping another, in a stretch with tokens ``own`` (place, token) of a template."""
    count: dict[int, int] = {}
    hits, right = [], 0
    for i, (start, token) in enumerate(own):
        while right < len(own) and own[right][0] < start + template.reach:
            count[own[right][1]] = count.get(own[right][1], 0) + 1
            right += 1
        if len(count) >= template.needed and template.must <= count.keys():
            seen: set[int] = set()
            for place, other in own[i:right]:
                if other not in seen:
                    seen.add(other)
                    end = place + 1
            hits.append(Hit(t, start, end, len(seen), len(seen) / len(template.tokens)))
        count[token] -= 1
        if not count[token]:
            del count[token]
    taken: list[Hit] = []  # in order of place
    starts: list[int] = []
    for hit in sorted(hits, key=lambda h: (-h.both, h.end - h.start, h.start)):
        i = bisect_left(starts, hit.start)
        if (i == 0 or taken[i - 1].end <= hit.start) and (i == len(taken) or hit.end <= starts[i]):
            taken.insert(i, hit)
            starts.insert(i, hit.start)
    return taken


def _covers(better: Hit, hit: Hit) -> bool:
    """Whether a match with more words in common lies over half of another."""
    shared = min(better.end, hit.end) - max(better.start, hit.start)
    return better.rank() > hit.rank() and 2 * shared >= hit.end - hit.start


def _scanner(index: _Index, phrases):
    wanted = list(zip([label for _, label in phrases], _hashes([p for p, _ in phrases]), strict=True))

    def scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), letter_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                words = scan(texts, kind, powers)
                h, n = words.hash, len(texts)
                base: list[set[str]] = [set() for _ in range(n)]
                places = []
                for label, phrase in wanted:
                    m = len(h) - len(phrase) + 1
                    if m <= 0:
                        continue
                    hit = words.text[:m] == words.text[len(phrase) - 1 :]
                    for k, x in enumerate(phrase):
                        hit &= h[k : k + m] == x
                    at = np.flatnonzero(hit)
                    places.append(at)
                    for t in np.unique(words.text[at]).tolist():
                        base[t].add(label)
                at = np.sort(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)
                owner = words.text[at]
                count = np.bincount(owner, minlength=n)
                bounds = np.searchsorted(owner, np.arange(n + 1))
                inner = at - words.bounds[owner]
                first = [int(inner[a]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                last = [int(inner[b - 1]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

                found: list[set[str]] = [set() for _ in range(n)]
                score, blocks = [0.0] * n, [0] * n
                slot = _slots(index.vocabulary, h)
                seen = np.flatnonzero(slot >= 0)
                for t in np.unique(words.text[seen][index.in_prefix[slot[seen]]]).tolist():
                    begin, end = words.bounds[t], words.bounds[t + 1]
                    own = seen[np.searchsorted(seen, begin) : np.searchsorted(seen, end)]
                    for hit in index.hits(own - begin, slot[own], int(end - begin)):
                        blocks[t] += 1
                        found[t].add(index.templates[hit.template].label)
                        score[t] = max(score[t], hit.share)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)]),
                        pa.array(score, pa.float64()),
                        pa.array(blocks, pa.int64()),
                    ],
                    names=SCANNED.names,
                )

    return scan_texts


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """License phrases and template matches of every row's whole text.

    Needs ``doc_id`` and ``text``; other columns are ignored. One row per input row,
    with the phrase's places (``n_base, first_word, last_word, base_labels``), all
    labels, the largest containment that a block reached (0 if none met the
    threshold) and the number of matching blocks. Null text is empty: no words, no
    labels. Repeated rows are scanned each; a very long text is scanned whole, and only
    words around a template's rarest ones are counted. An empty table gives no rows.
    ``templates`` (label, words that must be there, text) are held by every task.
    """
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = _Index(templates, token_frequencies(shaped, templates), threshold)
    return shaped.mapInArrow(_scanner(index, phrases), SCANNED)
