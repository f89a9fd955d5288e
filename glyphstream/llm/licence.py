"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every token sequence that occurs in some template. A file's words
run through it once and give the matching statistics: at each word, the longest
sequence ending there that some template has. Matches that can't grow are chained,
per template, in the order of both file and template; a chain covers part of the
template, and a template that is covered well enough is a finding with a span.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .words import PLAIN, lowered, plain_words

# The phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence texts and notices, by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("gpl", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]


class SuffixAutomaton:
    """Of several token sequences; each state knows the places (sequence, end) of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._grow(last, token, ends)
                ends[last].add((s, at))
        for state in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            ends[self.link[state]] |= ends[state] if self.link[state] else set()
        self.places = [sorted(x) for x in ends]

    def _state(self, length: int, next_: dict[int, int], link: int, ends: list) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _grow(self, last: int, token: int, ends: list) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(last, token, known, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, token, q, ends)
        return new

    def _copy(self, p: int, token: int, q: int, ends: list) -> int:
        """The strings of q that are no longer than p's plus the token get a state of their own."""
        own = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = own
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = own
            p = self.link[p]
        return own

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token, the length and the state of the longest match ending there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield length, state


class Scanner:
    """phrases: labels by phrase. min_match: words of a match that counts for a chain. gap: words of the
    file or the template that a chain may skip between matches. cover: part of a template to find it."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], min_match: int = 3, gap: int = 12, cover: float = 0.6):
        self.min_match, self.gap, self.cover = min_match, gap, cover
        texts = [(label, plain_words(phrase)) for phrase, label in phrases.items()]
        self.n_phrases = len(texts)
        texts += [(label, plain_words(text)) for label, text in templates]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(words) for _, words in texts]
        self.ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton([[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in texts])
        # The phrases that are a suffix of a state's longest string: its own and those of the shorter strings it links to.
        auto = self.automaton
        self.ending: list[list[tuple[int, int]]] = [[] for _ in auto.link]
        for state in sorted(range(1, len(auto.link)), key=auto.length.__getitem__):
            own = [(s, self.sizes[s]) for s, at in auto.places[state] if s < self.n_phrases and at + 1 == self.sizes[s] == auto.length[state]]
            self.ending[state] = own + self.ending[auto.link[state]]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, float, int, int]]]:
        """Words; base places (first word, label); findings (label, covered part, first and last word)."""
        words = PLAIN.findall(lowered(text))
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]]).astype(np.int8)))
        starts, ends = known[::2], known[1::2]
        long = ends - starts >= 2
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            before = (0, 0)
            for at, (length, state) in enumerate(self.automaton.statistics(ids[start:end].tolist()), start):
                if length >= 2:
                    base += [(at - size + 1, self.labels[s]) for s, size in self.ending[state] if length >= size]
                if before[0] >= self.min_match and length <= before[0]:
                    matches.append((at - 1, *before))
                before = (length, state)
            if before[0] >= self.min_match:
                matches.append((end - 1, *before))
        return len(words), base, self._chains(matches) if matches else []

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """matches: (last word, length, state) in the file's order. A chain is open while matches go on
        in its template within the gap; the longest one so far goes on. Of chains of one template that
        overlap in the file the one that covers most is found; chains that stand apart are all found."""
        open_: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # file end, template end, covered, file start
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # covered, file start, file end
        for end, length, state in matches:
            for s, at in self.automaton.places[state]:
                if s < self.n_phrases:
                    continue
                best = (length, end - length + 1)
                for f_end, t_end, covered, start in open_[s]:
                    new = min(length, at - t_end, end - f_end)
                    if new > 0 and end - new - f_end <= self.gap and at - new - t_end <= self.gap and covered + new > best[0]:
                        best = (covered + new, start)
                open_[s] = [x for x in open_[s] if end - x[0] <= self.gap + self.sizes[s]] + [(end, at, *best)]
                if best[0] >= self.cover * self.sizes[s]:
                    own = found[s]
                    if not own or best[1] > own[-1][2]:
                        own.append((best[0], best[1], end))
                    elif best[0] > own[-1][0]:
                        own[-1] = (best[0], best[1], end)
        return [(self.labels[s], covered / self.sizes[s], start, end) for s, own in found.items() for covered, start, end in own]


@cache
def default_scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


def scan_licences(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and the findings, if spans).

    docs needs doc_id and text; other columns are dropped. A null or empty text has no words:
    counts 0, places null, labels empty, score 0. score is the largest covered part of a
    template; a whole base phrase is a template that is covered fully. Each row stands for
    itself, so repeated rows give equal rows, and null ids stay.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", findings array<struct<label:string,covered:double,first_word:long,last_word:long>>" * spans

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = default_scanner()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, base, found = scanner.scan(text)
                own = {label for _, label in base}
                at = [x for x, _ in base]
                row = [n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in found}))]
                rows.append([*row, max([float(bool(base)), *(x[1] for x in found)]), *[[dict(zip(("label", "covered", "first_word", "last_word"), x, strict=True)) for x in found]] * spans])
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["findings"] * spans])
            out = out.astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)
