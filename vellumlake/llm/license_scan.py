"""License scans by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of all license templates.  A text streams
through it and gives, for each word, the longest run of template words that ends
there; long maximal runs are chained, in order, into spans that cover a template.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, mapped, words

#: Phrases whose every place counts, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: What public licenses disclaim, in their own words.
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
BSD_TWO = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THREE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
ISC_AS_IS = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
#: Public notices of common licenses, and whole short licenses, by SPDX-like labels.
TEMPLATES = (
    ("mit", f"{MIT} {AS_IS}"),
    ("bsd-2-clause", f"{BSD_TWO} {BSD_AS_IS}"),
    ("bsd-3-clause", f"{BSD_TWO} {BSD_THREE} {BSD_AS_IS}"),
    ("isc", f"{ISC} {ISC_AS_IS}"),
    ("zlib", ZLIB),
    ("unlicense", UNLICENSE),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", MIT),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", ISC),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under the creative commons zero license"),
)


class Automaton:
    """A generalised suffix automaton of word sequences; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence, 1):
                last = self._extend(last, token, ends)
                ends[last].add((number, place))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] |= ends[state]
        ends[0] = set()
        #: Where in which template a state's runs end.
        self.ends = [sorted(x) for x in ends]

    def _extend(self, last: int, token: int, ends: list) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        while last != -1 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            q = self.next[last][token]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q, ends)
        return new

    def _state(self, length: int, following: dict, ends: list) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int, ends: list) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def runs(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end in tokens, length, state) of the maximal runs of at least that many words."""
        out, state, length = [], 0, 0
        for i, token in enumerate(tokens):
            before = (i, length, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length = 0
            if before[1] >= least and length <= before[1]:
                out.append(before)
        if length >= least:
            out.append((len(tokens), length, state))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 3, cover: float = 0.75):
        self.labels = [x for x, _ in templates]
        sequences = [self.hashes(x) for _, x in templates]
        self.vocabulary = np.unique(np.concatenate([*sequences, np.zeros(0, np.uint64)]))
        ids = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        self.sizes = [len(s) for s in ids]
        self.automaton = Automaton(ids)
        self.phrases = [(self.hashes(p), label) for p, label in phrases]
        self.least, self.cover = least, cover

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        return words(pa.array([text]), marks=False)[0]

    def gather(self, tokens: list[int], base: int, by: dict[int, list[tuple[int, int, int]]]) -> None:
        """Puts the (text place, template place, length) of a stretch's runs to their templates."""
        for end, length, state in self.automaton.runs(tokens, self.least):
            for template, place in self.automaton.ends[state]:
                by.setdefault(template, []).append((base + end - length, place - length, length))

    def chained(self, by: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int]]:
        """(template, words covered, first word, end word) of each template's chains: runs in the order of both, not two templates' length apart.

        The best chain of a template comes first, then all that overlap none before them
        and cover enough of it, so each copy in a text has its span.
        """
        out = []
        for template, found in by.items():
            found = sorted(set(found))
            best: list[tuple[int, int]] = []
            for i, (a, p, n) in enumerate(found):
                mine = (n, a)
                for j in range(i - 1, -1, -1):
                    b, q, m = found[j]
                    if a - b > 2 * self.sizes[template]:
                        break
                    if b + m <= a and q + m <= p and best[j][0] + n > mine[0]:
                        mine = (best[j][0] + n, best[j][1])
                best.append(mine)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(found)), key=lambda i: (-best[i][0], i)):
                covered, first = best[i]
                if taken and covered < self.cover * self.sizes[template]:
                    break
                end = found[i][0] + found[i][2]
                at = bisect.bisect_left(taken, (first, end))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (first, end))
                    out.append((template, covered, first, end))
        return out

    def __call__(self, texts: pa.Array) -> list[dict]:
        h, _, at, _ = words(texts, marks=False)
        n = len(at) - 1
        # every place of each phrase
        base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for phrase, label in self.phrases:
            if len(h) >= len(phrase):
                hit = h[: len(h) - len(phrase) + 1] == phrase[0]
                for i in range(1, len(phrase)):
                    hit &= h[i : len(h) - len(phrase) + 1 + i] == phrase[i]
                for p in np.flatnonzero(hit).tolist():
                    r = int(np.searchsorted(at, p, side="right")) - 1
                    if p + len(phrase) <= at[r + 1]:
                        base[r].append((p - int(at[r]), label))
        # stretches of template words, broken at other words and where texts end
        place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == h
        inside = known.copy()
        edge = np.zeros(len(h) + 1, bool)
        edge[at] = True
        change = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1], [True])) | edge) if len(h) else np.zeros(0, np.int64)
        runs: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(n)]
        for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            if b - a >= self.least and known[a]:
                r = int(np.searchsorted(at, a, side="right")) - 1
                self.gather(place[a:b].tolist(), a - int(at[r]), runs[r])
        out = []
        for r in range(n):
            spans = self.chained(runs[r])
            full: dict[int, float] = {}
            for t, k, _, _ in spans:
                full[t] = max(full.get(t, 0.0), k / self.sizes[t])
            labels = {self.labels[t] for t, s in full.items() if s >= self.cover}
            starts = [p for p, _ in base[r]]
            own = {x for _, x in base[r]}
            out.append({"n_words": int(at[r + 1] - at[r]), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | labels)), "score": max([1.0 if own else 0.0, *full.values()]), "spans": [{"label": self.labels[t], "start": a, "end": b, "covered": k / self.sizes[t]} for t, k, a, b in sorted(spans, key=lambda x: (x[2], x[0]))]})
        return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def licenses(docs: DataFrame, templates=TEMPLATES, least: int = 3, cover: float = 0.75) -> DataFrame:
    """One row for each row of docs: words, phrase places, labels, the best cover of a template as score, and covered spans (words from 0).

    A label of its own needs a chain of runs of `least` words or more that covers at
    least `cover` of one of its templates.  Null texts are empty; rows without a doc_id
    are left out; rows that repeat are scanned one by one; of chains that cover as much
    the first counts; texts of any length are scanned whole; an empty table gives no
    rows; other columns are ignored.
    """
    scanner = Scanner(templates, least=least, cover=cover)

    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        found = scanner(batch.column("text"))
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))}
        return {"doc_id": batch.column("doc_id")} | {k: pa.array([f[k] for f in found], t) for k, t in kinds.items()}

    return mapped(documents(docs), scan, SCHEMA)


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """licenses() of the whole table documents, spans as text; see there for nulls, empty and repeated rows."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
