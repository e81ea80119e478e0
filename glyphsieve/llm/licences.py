"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates. Streaming a document through it
gives the matching statistics: at each word the longest suffix that some template holds.
The suffix links of that state tell where else shorter suffixes end, so every match of at
least MATCH words with a template that can be extended to neither side is found, also where
another template has a longer one. The contract's phrases are templates too: a phrase ends
where its state is on the suffix path of the current one.

Matches of a template are chained: the next one begins behind the last in the document and
in the template, with at most GAP words between them in both, and what they share in either
counts once. For each match the chain that ends there and covers most is kept (of equals,
the one that begins last). Chains are taken by the words they cover, most first (of equals,
the one that ends first), as long as they share no word with one taken before and cover SHARE
of the template or ENOUGH words; so a template can have several spans. A span inside one of
another label that covers more of its template is dropped: texts borrow from each other.

Words that no template has reset the automaton, so only runs of template words are streamed.
A text is held whole in its worker; the work follows its template words.

Edge cases: null and empty texts have no words and no spans (score 0); an empty table gives
no rows. Repeated rows and ids give a row each. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, mapped, small_batches

#: The contract's phrases, and public licence notices and texts.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details you should have received a copy of the gnu affero general public license along with this program"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("artistic", "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher"),
]
#: Words of a match, words between two matches of a chain, least share of a template, and words that suffice for a long one.
MATCH, GAP, SHARE, ENOUGH = 3, 12, 0.75, 20
SCHEMA = "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, spans array<struct<label:string,first:bigint,last:bigint,matched:bigint,coverage:double>>"


class Automaton:
    """Of several token sequences. State 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].append((t, at))
        # A state's ends are its own and those of the states below it in the link tree.
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                ends[self.link[s]] = sorted({*ends[self.link[s]], *ends[s]})
        self.ends = ends

    def _state(self, length: int, link: int, arcs: dict[int, int], ends: list) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int, ends: list) -> int:
        """q's strings that end p's by c, as a state of their own."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q, ends)
        new = self._state(self.len[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q, ends)
        return new

    def statistics(self, tokens: list[int]):
        """(state, length) of the longest match that ends at each token."""
        state, length, arcs, link, size = 0, 0, self.next, self.link, self.len
        for c in tokens:
            while state and c not in arcs[state]:
                state = link[state]
                length = size[state]
            if c in arcs[state]:
                state = arcs[state][c]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [p for p, _ in phrases] + [t for _, t in templates]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        words = [t.encode().split() for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        self.sequences = [[self.vocabulary[w] for w in ws] for ws in words]
        self.machine = Automaton(self.sequences)
        # The phrases that end where a state's match does, with their lengths.
        own: dict[int, list[tuple[int, str]]] = {}
        for k, (_, label) in enumerate(phrases):
            *_, (state, length) = self.machine.statistics(self.sequences[k])
            own.setdefault(state, []).append((length, label))
        self.phrases = []
        for s in range(len(self.machine.len)):
            found, at = [], s
            while at > 0:
                found += own.get(at, [])
                at = self.machine.link[at]
            self.phrases.append(found)
        self.templates = range(len(phrases), len(texts))
        # Where else the longest suffixes of a state's match end: (template, its word, words in common at most), deepest state first.
        self.alike: list[list[tuple[int, int, int]]] = []
        for s in range(len(self.machine.len)):
            at, seen = s, {}
            while at > 0 and self.machine.len[at] >= MATCH:
                for t, end in self.machine.ends[at]:
                    if t in self.templates:
                        seen.setdefault((t, end), self.machine.len[at])
                at = self.machine.link[at]
            self.alike.append([(t, end, most) for (t, end), most in seen.items()])

    def matches(self, ids: list[int]):
        """(template, document start, words, template start) of all matches of MATCH words or more that nothing extends, and the places of phrases."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        places: list[tuple[int, str]] = []
        upto = len(ids) - 1
        for i, (state, length) in enumerate(self.machine.statistics(ids)):
            for size, label in self.phrases[state]:
                if size <= length:
                    places.append((i - size + 1, label))
            if length >= MATCH:
                for t, end, most in self.alike[state]:
                    own = self.sequences[t]
                    if i == upto or end + 1 == len(own) or own[end + 1] != ids[i + 1]:
                        n = min(length, most)
                        found.setdefault(t, []).append((i - n + 1, n, end - n + 1))
        return found, places

    def scan(self, words: list[bytes]) -> tuple[list, list]:
        """Places (word, label) of the phrases, and spans (label, first, last, matched, coverage)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        steps = np.diff(known)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        places: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        long = ends - starts > 1
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            found, own = self.matches(ids[a:b].tolist())
            places += [(a + i, label) for i, label in own]
            for t, each in found.items():
                matches.setdefault(t, []).extend((a + i, n, j) for i, n, j in each)
        spans = {s for t, each in matches.items() for s in self.chained(t, each)}
        inside = lambda s, o: s[0] != o[0] and o[1] <= s[1] and s[2] <= o[2] and s[4] < o[4]
        return sorted(places), sorted((s for s in spans if not any(inside(s, o) for o in spans)), key=lambda s: (s[1], s[2], s[0], -s[4]))

    def chained(self, t: int, matches: list[tuple[int, int, int]]) -> list:
        """Spans of a template from its matches (document start, words, template start)."""
        total = len(self.sequences[t])
        # (document end, template end, document start, template start, covered, first): the best chain to each match.
        best: list[tuple[int, int, int, int, int, int]] = []
        near = 0
        ordered = sorted(matches)
        longest = max(n for _, n, _ in ordered)
        for start, n, at in ordered:
            covered, first = n, start
            # What begins longer ago than the longest match and a gap ends too far away.
            while best and near < len(best) and best[near][2] < start - longest - GAP:
                near += 1
            for end, upto, before, place, has, since in best[near:]:
                if before < start and place < at and end < start + n and upto < at + n and start - end <= GAP and at - upto <= GAP:
                    has += n - max(0, end - start, upto - at)
                    if (has, since) > (covered, first):
                        covered, first = has, since
            best.append((start + n, at + n, start, at, covered, first))
        out: list[tuple] = []
        for end, _, _, _, covered, first in sorted(best, key=lambda m: (-m[4], m[0], -m[5], m[1])):
            if covered < min(SHARE * total, ENOUGH):
                break
            if all(end - 1 < low or high < first for _, low, high, *_ in out):
                out.append((self.labels[t], first, end - 1, covered, min(1.0, covered / total)))
        return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places of the phrases and spans of the templates."""

    def run(batches):
        s = scanner()
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
        for batch in small_batches(batches):
            sizes, places, spans = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().translate(WORD_BYTES).split()
                p, f = s.scan(words)
                sizes.append(len(words))
                places.append([{"word": w, "label": x} for w, x in p])
                spans.append([dict(zip(("label", "first", "last", "matched", "coverage"), x, strict=True)) for x in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)], names=["doc_id", "n_words", "places", "spans"])

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n = F.size("places").cast("long")
    return found.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )
