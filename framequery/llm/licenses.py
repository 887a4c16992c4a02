"""Licence scans: a generalised suffix automaton over the words of licence templates.

Texts are streamed through the automaton word by word, which yields matching statistics: for each word, the length
of the longest run ending there that some template contains. Maximal runs are then chained, per template and in the
order of both text and template, into spans of the text that the template covers.

Words are those of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in the text with A-Z in lower case.

Defined results: a null text is empty; a text without words has no spans, null first and last word and score 0.
Repeated rows each get their row. Only the id and the text column are read, other columns are left aside.
Memory holds the automaton, one Arrow batch and the words of one text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8, word_table

#: Fixed phrases and the label of each.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and texts of common licences, label and text.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: Runs shorter than this many words are no evidence for a template by themselves.
MIN_RUN = 3
#: Part of a template's words that chained runs must cover for its label.
MIN_COVER = 0.6
#: Words of the text that may lie between two runs of a chain.
MAX_GAP = 40

_TABLE = word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of the prefixes that first reached the state
        for s, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].append((s, i + 1))
        self._pull_ends_up()

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another sequence has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _pull_ends_up(self) -> None:
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])
        self.ends = [sorted(set(x)) for x in self.ends]

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest known run) after each word."""
        v, run = 0, 0
        step, link, length = self.next, self.link, self.length
        for c in sequence:
            while v and c not in step[v]:
                v = link[v]
                run = length[v]
            if c in step[v]:
                v, run = step[v][c], run + 1
            yield v, run


class LicenceScanner:
    """Phrases and templates in one automaton. `scan` gives one text's findings."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, min_run: int = MIN_RUN, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP):
        phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
        self.min_run, self.min_cover, self.max_gap = min_run, min_cover, max_gap
        texts = [(label, words_of(x.encode()), True) for x, label in phrases.items()] + [(label, words_of(x.encode()), False) for label, x in templates]
        self.vocabulary: dict[bytes, int] = {}
        self.labels = [label for label, _, _ in texts]
        self.sizes = [len(x) for _, x, _ in texts]
        self.phrase = [p for _, _, p in texts]
        self.automaton = Automaton([[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in x] for _, x, _ in texts])
        sizes = [n for n, p in zip(self.sizes, self.phrase, strict=True) if p]
        self.shortest = min([*sizes, min_run])
        #: For each state, the phrases that end there, and the other templates' ends.
        self.phrases_at = [[s for s, e in ends if self.phrase[s] and e == self.sizes[s]] for ends in self.automaton.ends]
        self.templates_at = [[(s, e) for s, e in ends if not self.phrase[s]] for ends in self.automaton.ends]

    @classmethod
    def of_table(cls, templates: DataFrame, label_col: str = "label", text_col: str = "text", most_bytes: int = 64 << 20) -> LicenceScanner:
        """A scanner for a table of templates, whole licence texts for instance. The automaton is each task's own, so that
        templates of more than most_bytes altogether are refused; rows with a null are left aside."""
        rows = templates.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).dropna()
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"templates hold {size} bytes, more than {most_bytes}")
        return cls(templates=[(r["label"], r["text"]) for r in rows.orderBy("label", "text").collect()])  # bounded above

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Places of phrases (start, label), and covered spans (first word, end word, label, part of the template)."""
        known = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int32, len(words)) if words else np.empty(0, np.int32)
        places: list[tuple[int, str]] = []
        runs: dict[int, list[tuple[int, int, int]]] = {}  # template -> (start in the text, start in the template, length)
        # a run of a template has no unknown word, so only stretches of known words are streamed
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (known >= 0).astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            v_before, run_before = 0, 0
            for i, (v, run) in enumerate(self.automaton.statistics(known[a:b].tolist()), a):
                for s in self._phrases(v, run):
                    places.append((i + 1 - self.sizes[s], self.labels[s]))
                if run <= run_before and run_before >= self.min_run:  # the run before could not be extended
                    self._note(runs, i, v_before, run_before)
                v_before, run_before = v, run
            if run_before >= self.min_run:
                self._note(runs, b, v_before, run_before)
        return places, [(*span, self.labels[s], cover) for s, found in runs.items() for *span, cover in self._chain(s, found)]

    def _phrases(self, v: int, run: int) -> list[int]:
        """Phrases that end with this state's run; ends lists of a state hold those of all longer runs, so lengths decide."""
        found = []
        while v > 0:
            for s in self.phrases_at[v]:
                if self.sizes[s] <= run and self.automaton.length[self.automaton.link[v]] < self.sizes[s] <= self.automaton.length[v]:
                    found.append(s)
            v = self.automaton.link[v]
        return found

    def _note(self, runs: dict, end: int, v: int, run: int) -> None:
        for s, e in self.templates_at[v]:
            runs.setdefault(s, []).append((end - run, e - run, run))

    def _chain(self, s: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """Best chains of one template: runs that follow each other in text and template, gaps limited. Runs of a text
        come in its order, so a chain that is behind by more than the gap can't be extended and leaves the list."""
        open_chains: list[tuple[int, int, int, int]] = []  # first word, end in the text, end in the template, covered words
        closed: list[tuple[int, int, int]] = []
        for start, at, run in sorted(found):
            stays = []
            for c in open_chains:
                (stays if start - c[1] <= self.max_gap else closed).append(c if start - c[1] <= self.max_gap else (c[0], c[1], c[3]))
            open_chains = stays
            best = max((c for c in open_chains if c[2] <= at and c[1] <= start), key=lambda c: (c[3], c[0]), default=None)
            entry = (best[0], start + run, at + run, best[3] + run) if best else (start, start + run, at + run, run)
            # of the chains that end at one place of the template only the best is kept: at most one for each of its words
            open_chains = [c for c in open_chains if c[2] != entry[2] or c[1] != entry[1]]
            rival = next((c for c in open_chains if c[2] == entry[2]), None)
            if rival and rival[3] <= entry[3]:
                open_chains.remove(rival)
                closed.append((rival[0], rival[1], rival[3]))
            open_chains.append(entry)
        closed += [(c[0], c[1], c[3]) for c in open_chains]
        spans: list[tuple[int, int, float]] = []  # those that cover most, as far as they don't overlap; in order
        for a, b, n in sorted(closed, key=lambda c: (-c[2], c[0])):
            at = bisect_left(spans, (a, b, 0.0))
            if (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or b <= spans[at][0]):
                spans.insert(at, (a, b, n / self.sizes[s]))
        return spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,stop:int,cover:double>>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: LicenceScanner | None = None) -> DataFrame:
    """One row for each row of docs: its phrases, labels, score (the best part of a template covered) and covered spans."""
    scanner = scanner or LicenceScanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                words = words_of(text)
                places, spans = scanner.scan(words)
                starts = [p for p, _ in places]
                base = {label for _, label in places}
                sure = [x for x in spans if x[3] >= scanner.min_cover]
                score = max([1.0 if places else 0.0, *(min(1.0, x[3]) for x in spans)])
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in sure})), score, [{"label": x[2], "start": x[0], "stop": x[1], "cover": x[3]} for x in sorted(sure)]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("cover", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)
