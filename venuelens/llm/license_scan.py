"""License scans: template markup compiled into token automata.

A template is wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be left out, ``<<var;min=0;max=9>>``
stands for that many words of any kind. All templates form one automaton over words, which is made deterministic while
it runs. A place is accepted if all wording outside the regions matches word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from venuelens.llm.common import map_rows, narrow

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Published license wording to its end, with regions marked: names and years can be replaced, headings and
# list marks left out. Words are what counts, so punctuation is left out here.
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0-grant": "licensed under the <<beginOptional>>terms of the<<endOptional>> apache license version 2 0",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at <<var;min=1;max=12>> unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
    "bsd-2-clause-text": """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met <<var;min=0;max=2>> redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer <<var;min=0;max=2>>
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by <<var;min=1;max=12>> as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
        shall <<var;min=1;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of
        such damage""",
    "bsd-3-clause-text": """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met <<var;min=0;max=2>> redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer <<var;min=0;max=2>>
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution <<var;min=0;max=2>>
        neither the name of <<var;min=1;max=12>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission
        this software is provided by <<var;min=1;max=12>> as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
        shall <<var;min=1;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of
        such damage""",
    "cc-by-nc-grant": """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>>
        cc by nc <<beginOptional>>sa<<endOptional>> <<var;min=0;max=2>>""",
    "gpl-grant": "licensed under the gnu general public license version <<var;min=1;max=1>>",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version <<var;min=1;max=1>> of the license or at
        your option any later version this program is distributed in the hope that it will be useful but without any warranty
        without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
        license for more details you should have received a copy of the gnu general public license along with this program
        if not see <<var;min=1;max=6>>""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var;min=1;max=12>> disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall <<var;min=1;max=12>> be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "mit-grant": """<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit
        license""",
    "mit-text": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=12>><<endOptional>>
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included
        in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;min=1;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
}

MARK = re.compile(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>")


def words_of(text: bytes) -> list[bytes]:
    """Words after lowering A-Z; bytes of other characters belong to words, so bytes give the same words as code points."""
    return WORD.findall(text.lower())


class Automaton:
    """All templates in one machine: states are sets of places in templates."""

    def __init__(self, templates: dict[str, str]):
        self.edges: list[dict[bytes | None, set[int]]] = [{}]
        self.skips: list[set[int]] = [set()]
        self.accepts: dict[int, str] = {}
        self.needed: set[bytes] = set()
        self.moves: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        for label, markup in templates.items():
            self.add(label, markup)
        self.start = self.closed({0})
        if any(None in self.edges[s] for s in self.start):
            raise ValueError("a template starts with a replaceable region")
        self.first = {w for s in self.start for w in self.edges[s]}
        self.words = {w for e in self.edges for w in e if w is not None}

    def state(self) -> int:
        self.edges.append({})
        self.skips.append(set())
        return len(self.edges) - 1

    def add(self, label: str, markup: str) -> None:
        at, opened, mandatory = self.state(), [], []
        self.skips[0].add(at)
        cut = 0
        for m in [*MARK.finditer(markup), None]:
            for word in words_of(markup[cut:m.start() if m else None].encode()):
                at = self.step(at, word)
                if not opened:
                    mandatory.append(word)
            if m is None:
                break
            cut = m.end()
            if m[1] == "beginOptional":
                opened.append(at)
            elif m[1] == "endOptional":
                after = self.state()
                self.skips[opened.pop()].add(after)
                self.skips[at].add(after)
                at = after
            else:
                for n in range(int(m[3])):
                    if n >= int(m[2]):
                        opened.append(at)
                    at = self.step(at, None)
                for _ in range(int(m[3]) - int(m[2])):
                    self.skips[opened.pop()].add(at)
        if opened or not mandatory:
            raise ValueError(f"{label}: open region or no mandatory word")
        self.accepts[at] = label
        self.needed.add(max(mandatory, key=len))

    def step(self, at: int, word: bytes | None) -> int:
        after = self.state()
        self.edges[at].setdefault(word, set()).add(after)
        return after

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        if word not in self.words:
            word = b""  # all words that no template names act alike
        after = self.moves.get((states, word))
        if after is None:
            after = self.closed({t for s in states for w in (word, None) for t in self.edges[s].get(w, ())})
            self.moves[states, word] = after
        return after

    def places(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, start, end) of the longest place of every label at every start."""
        found: dict[tuple[int, str], int] = {}
        for start, word in enumerate(words):
            if word in self.first:
                states, at = self.start, start
                while states:
                    for s in states & self.accepts.keys():
                        found[start, self.accepts[s]] = at
                    if at == len(words):
                        break
                    states = self.move(states, words[at])
                    at += 1
        return [(label, start, end) for (start, label), end in sorted(found.items())]


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automaton = Automaton(templates)
        self.base = Automaton(dict(zip(phrases.values(), phrases)))
        self.hint = re.compile(b"|".join(map(re.escape, sorted(self.automaton.needed | self.base.needed))))

    def scan(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            low = (text or "").encode().lower()
            words = WORD.findall(low)
            base, own = [], []
            if self.hint.search(low):
                base, own = self.base.places(words), self.automaton.places(words)
            covered, end = 0, 0
            for _, s, e in sorted(base + own, key=lambda p: p[1:]):
                covered += max(0, e - max(s, end))
                end = max(end, e)
            starts = [s for _, s, _ in base]
            yield (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                   ",".join(sorted({n for n, _, _ in base})), ",".join(sorted({n for n, _, _ in base + own})),
                   covered / len(words) if words else 0.0,
                   [{"label": n, "start": s, "end": e} for n, s, e in own])


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                 phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document row: words, base places, labels, the share of words in license wording, and the accepted places.

    A null or empty text has no words, no places, null first and last word, empty labels and score 0. Rows with equal
    or null ids are scanned one by one; an empty table gives no rows; other columns are not read. Overlapping places all
    count; of the places of one label at one start the longest counts.
    """
    scanner = templates or TEMPLATES, phrases or PHRASES

    def run(rows, s):
        return s.scan(rows)

    return map_rows(narrow(docs, doc_id=doc_id, text=text), run,
                    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                    "labels string, score double, places array<struct<label: string, start: long, end: long>>",
                    lambda: Scanner(*scanner))
