"""License scans with a generalised suffix automaton of licence tokens.

The templates' words become one automaton that knows every run of words of every template.  A text is
streamed through it word by word, which gives the longest run of every template that ends at each word
(the matching statistics); maximal long runs at all places of a template are chained into spans, the later
of two overlapping runs shortened by what they share, and the share of a template's words that a chain
covers decides its label.  Fixed phrases are counted besides.

The automaton has at most two states per template word, and every end place of a template is stored once: in
the order of a walk of the suffix links' tree, where a state's places are one stretch.  It is built once per
task from the templates, which travel with the function (a proven bound: ``MAX_TEMPLATE_WORDS``).  One pass
over the texts, no shuffle; words that no template has cost one dictionary look-up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import text_batches, valid_text

MAX_TEMPLATE_WORDS = 100_000

#: A-Z to lower case, other ASCII but letters and digits to blanks; bytes of other alphabets are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


#: Phrases and their labels (fixed values of the base scan).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence templates: well-known public notices, by label (fixed values).
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "mit-short": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                  "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                  "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
           "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                  "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
                  "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                  "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-short": "GNU General Public License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "copyright": "Copyright All rights reserved.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
               "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                 "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                 "non-commercial, and by any means.",
}


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers (a fresh start at the root before every template)."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[tuple[int, int]] = field(default_factory=list)  # (template, position after) of all ends, in the order of the walk
    stretch: list[tuple[int, int]] = field(default_factory=list)  # where in ``places`` those of a state and of all it is a suffix of stand

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the shorter runs of ``q`` that end one word after ``p``."""
        c = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:  # the run is known from another template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    @classmethod
    def of(cls, templates: list[list[int]]) -> Automaton:
        a = cls()
        own: dict[int, list[tuple[int, int]]] = {}
        for t, run in enumerate(templates):
            last = 0
            for i, w in enumerate(run):
                last = a._extend(last, w)
                own.setdefault(last, []).append((t, i + 1))
        below: dict[int, list[int]] = {}
        for s in range(1, len(a.link)):
            below.setdefault(a.link[s], []).append(s)
        a.stretch = [(0, 0)] * len(a.link)
        walk = [(0, -1)]  # (state, where its stretch begins, or -1 on the way down)
        while walk:
            s, begin = walk.pop()
            if begin >= 0:
                a.stretch[s] = (begin, len(a.places))
                continue
            walk.append((s, len(a.places)))
            a.places += own.get(s, [])
            walk += [(c, -1) for c in below.get(s, [])]
        return a

    def ends(self, state: int) -> list[tuple[int, int]]:
        """All places where the state's runs end, as (template, position after)."""
        return self.places[slice(*self.stretch[state])]

    def further_ends(self, state: int) -> list[tuple[int, int]]:
        """The places that the state's suffix link has besides the state's own."""
        (a, b), (c, d) = self.stretch[self.link[state]], self.stretch[state]
        return self.places[a:c] + self.places[d:b]

    def statistics(self, run: list[int]) -> tuple[list[int], list[int]]:
        """For every word the length of the longest known run that ends there, and its state (0: none)."""
        step, link, length = self.step, self.link, self.length
        state = n = 0
        lengths, states = [0] * len(run), [0] * len(run)
        for i, w in enumerate(run):
            if w < 0:
                state = n = 0
                continue
            nxt = step[state].get(w)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = step[state].get(w)
            if nxt is None:
                n = 0
            else:
                state = nxt
                n += 1
            lengths[i], states[i] = n, state
        return lengths, states


class Scanner:
    """``min_run``: shortest run that counts (or the whole template if that is shorter); ``max_gap``: most words between the
    runs of a chain, in the text and in the template; ``cover``: least share of a template's words for its label, where a
    template of under ``whole_words`` words needs all of them (four words of "released under the MIT License" are prose)."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, *, min_run: int = 4, max_gap: int = 12,
                 cover: float = 0.8, whole_words: int = 8) -> None:
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.labels = [*templates]
        texts = [words(t) for t in templates.values()]
        if sum(map(len, texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        self.number: dict[bytes, int] = {}
        runs = [[self.number.setdefault(w, len(self.number)) for w in t] for t in texts]
        self.phrases = [([self.number.setdefault(w, len(self.number)) for w in words(p)], label) for p, label in phrases.items()]
        self.sizes = [len(r) for r in runs]
        self.automaton = Automaton.of(runs)
        self.min_run, self.max_gap = min_run, max_gap
        self.cover = [1.0 if n < whole_words else cover for n in self.sizes]

    def matches(self, ids: np.ndarray, *, every_place: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """``(word after, length, template, template position after)``: at every word the longest run that ends
        there and is in the template, where it is long enough to count; with ``every_place`` the longest one
        at each place of the template.

        The state of the longest known run has its own templates; its suffix links lead to the longest runs
        that further templates (or places) have.
        """
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return
        least = max(1, min([self.min_run, *self.sizes]))
        link, length, further = self.automaton.link, self.automaton.length, self.automaton.further_ends
        for part in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):  # stretches of template words
            if len(part) < least:
                continue
            lengths, states = self.automaton.statistics(ids[part].tolist())
            for i, (n, state) in enumerate(zip(lengths, states)):
                seen: set[int] = set()  # templates whose longest run is found
                places = self.automaton.ends(state) if n >= least else []
                while n >= least:
                    new = [(t, e) for t, e in places if t not in seen and n >= min(self.min_run, self.sizes[t])]
                    for t, e in new:
                        yield int(part[i]) + 1, n, t, e
                    if not every_place:
                        seen.update(t for t, _ in new)
                    n = length[link[state]]
                    places = further(state) if n >= least else []
                    state = link[state]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """``(template, first word, word after, share of the template covered)``, the best chain of every template.

        A run that begins before its chain's end, in the text or in the template, counts without the words
        up to there; the gaps are those of what is left of it.  Of all chains that end with a run the one
        that covers most is kept (the first of equals); whether a run fits depends on the chain's end only.
        """
        found: dict[int, dict[tuple[int, int], tuple[int, int, int, int]]] = {}
        for end, n, t, e in self.matches(ids, every_place=True):
            runs = found.setdefault(t, {})
            runs.pop((end - 1, e - 1), None)  # the run one word shorter is part of this one
            runs[end, e] = (end, e, end - n, e - n)
        out = []
        for t, by_end in sorted(found.items()):
            best = (0, 0, 0)  # words covered, first, after
            chains: list[tuple[int, int, int, int]] = []  # text end, template end, covered, first word; by text end
            for b, tb, a, ta in sorted(by_end.values()):
                covered, first = b - a, -a
                for end, t_end, c, f in chains[bisect_left(chains, a - self.max_gap, key=lambda c: c[0]):]:
                    d = max(0, end - a, t_end - ta)  # words shared
                    if d < b - a and a + d - end <= self.max_gap and ta + d - t_end <= self.max_gap:
                        covered, first = max((covered, first), (c + b - a - d, -f))
                chains.append((b, tb, covered, -first))
                best = max(best, (covered, first, -b))
            out.append((t, -best[1], -best[2], min(1.0, best[0] / self.sizes[t])))
        return out

    def scan(self, text: str | None) -> tuple:
        """(words, base places, first, last, base labels, labels, score, spans); null and empty texts have none."""
        w = words(text)
        get = self.number.get
        ids = np.array([get(x, -1) for x in w], np.int64)
        places: list[np.ndarray] = []
        base = set()
        for run, label in self.phrases:
            n = len(run)
            if len(ids) < n:
                continue
            hit = np.ones(len(ids) - n + 1, bool)
            for j, word in enumerate(run):
                hit &= ids[j:len(ids) - n + 1 + j] == word
            if hit.any():
                places.append(np.flatnonzero(hit))
                base.add(label)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        spans = self.spans(ids)
        labels = base | {self.labels[t] for t, _, _, share in spans if share >= self.cover[t]}
        score = max((share for _, _, _, share in spans), default=0.0)
        return (len(w), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)),
                ",".join(sorted(labels)), max(score, 1.0 if base else 0.0), [(self.labels[t], a, b, c) for t, a, b, c in spans])


_SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                     ("spans", pa.list_(pa.struct([("template", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("cover", pa.float64())])))])


def license_scan(docs: DataFrame, *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id",
                 text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``: a row per input row.

    A template's label is given where its best chain covers enough of it; the score is the largest share
    covered, 1 with a base phrase.  Null and empty texts have no words and no labels (empty strings),
    malformed UTF-8 is read as U+FFFD, repeated rows keep a row each, an empty table gives an empty result, other columns are not read.
    """
    text_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), valid_text(F.col(text_col)).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, **options)
        for b in batches:
            rows = [dict(zip(_SCHEMA.names, scanner.scan(t))) for t in b.column("text").to_pylist()]
            for r in rows:
                r["spans"] = [dict(zip(("template", "from_word", "to_word", "cover"), s)) for s in r["spans"]]
            got = pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *got.columns], names=["doc_id", *_SCHEMA.names])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                 "score double, spans array<struct<template: string, from_word: long, to_word: long, cover: double>>")
