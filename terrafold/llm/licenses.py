"""License scan by template markup.

A template is a license notice in which ``<<optional>> ... <</optional>>`` may be
missing (such parts nest), ``<<any:N>>`` stands for up to N words and
``<<match:PATTERN>>`` for one word that the pattern matches whole.  Each template is
compiled into an automaton over words; a text carries the template's label where the
automaton accepts a run of its words, that is where all mandatory wording matches
exactly.  The score grows with the words that templates cover and the base places.

Defined results: a null or empty text has no words, no places and no labels and
scores 0; places may overlap, templates too; of a template the longest run from a word
counts; repeated rows are returned as often as they stand; very long texts are read
whole, one at a time; other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

#: Phrases whose places are counted, and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: Notices as templates, short references first, then whole wordings.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<optional>>version<</optional>> 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "<<optional>>creative commons<</optional>> cc by <<optional>>sa<</optional>> 4 0 <<optional>>international<</optional>>",
    "cc-by-nc": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by nc <<optional>>nd<</optional>> <<any:2>>",
    "copyright": "copyright <<optional>>c<</optional>> <<any:8>> all rights reserved",
    "gpl": "licensed under the <<optional>>terms of the<</optional>> <<optional>>gnu<</optional>> <<optional>>lesser<</optional>> general public license <<optional>>as published by the free software foundation<</optional>> <<optional>><<optional>>either<</optional>> version <<match:[0-9]+>><</optional>>",
    "mit": "<<optional>>released<</optional>> under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license <<optional>>v<</optional>> <<optional>>version<</optional>> 2 0",
    "mit-text": """<<optional>><<optional>>the<</optional>> mit license <<optional>>mit<</optional>><</optional>>
        <<optional>>copyright <<optional>>c<</optional>> <<match:[0-9]{4}>> <<any:12>><</optional>>
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files <<optional>>the software<</optional>> to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the
        software <<optional>>the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software<</optional>>""",
    "isc-text": """permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        <<optional>>the software is provided as is and <<any:6>> disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness<</optional>>""",
    "bsd-2-clause-text": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<match:1|a>> redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimer <<match:2|b>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution""",
    "bsd-3-clause-text": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<match:1|a>> redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimer <<match:2|b>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution <<match:3|c>> neither the name of <<any:12>> nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission""",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    "gpl-header": """<<match:this|[0-9a-z]+>> <<optional>>program<</optional>> is free software you can redistribute it and or modify it
        under the terms of the gnu <<optional>><<match:lesser|library|affero>><</optional>> general public license as published by the free software
        foundation either version <<match:[0-9]+>> <<optional>><<match:[0-9]+>><</optional>> of the license or <<optional>>at your
        option<</optional>> any later version""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or
        non commercial and by any means""",
}
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Word bytes stay (A-Z as a-z), all others become spaces.
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD or 65 <= b <= 90 else 32 for b in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


_PART = re.compile(r"<<(?:optional|any:\d+|match:.+?)>>|<</optional>>|[^<]+")


@dataclass
class Automaton:
    """States are numbers; ``arcs[state]`` maps a word to the next states, ``tests[state]``
    has pairs of a pattern and the state after a word that it matches, ``wild[state]``
    are next states for any word, ``free[state]`` for none."""

    arcs: list[dict[bytes, set[int]]] = field(default_factory=list)
    tests: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    wild: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    end: int = 0

    def _state(self) -> int:
        self.arcs.append({})
        self.tests.append([])
        self.wild.append(set())
        self.free.append(set())
        return len(self.arcs) - 1

    @classmethod
    def compile(cls, template: str) -> Automaton:
        auto = cls()
        at, opened = auto._state(), []
        for part in _PART.findall(template):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<</optional>>":
                # a state of its own, so that what is skipped can't be entered from behind
                nxt = auto._state()
                auto.free[at].add(nxt)
                auto.free[opened.pop()].add(nxt)
                at = nxt
            elif part.startswith("<<match:"):
                nxt = auto._state()
                auto.tests[at].append((re.compile(part[8:-2].encode()), nxt))
                at = nxt
            elif part.startswith("<<any:"):
                end = auto._state()
                auto.free[at].add(end)
                for _ in range(int(part[6:-2])):
                    nxt = auto._state()
                    auto.wild[at].add(nxt)
                    auto.free[nxt].add(end)
                    at = nxt
                at = end
            else:
                for word in words_of(part.encode()):
                    nxt = auto._state()
                    auto.arcs[at].setdefault(word, set()).add(nxt)
                    at = nxt
        if opened:
            raise ValueError("an optional part isn't closed")
        auto.end = at
        return auto

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for nxt in self.free[todo.pop()] - out:
                out.add(nxt)
                todo.append(nxt)
        return out

    def _after(self, states: set[int], word: bytes) -> set[int]:
        out = {n for s in states for n in self.arcs[s].get(word, ())} | {n for s in states for n in self.wild[s]}
        return self._closed(out | {n for s in states for p, n in self.tests[s] if p.fullmatch(word)})

    def begins(self) -> tuple[set[bytes], bool]:
        """The words that a run may begin with, and whether a pattern or any word may begin one."""
        first = self._closed({0})
        return {w for s in first for w in self.arcs[s]}, any(self.tests[s] or self.wild[s] for s in first)

    def longest(self, words: list[bytes], start: int) -> int:
        """Words of the longest accepted run from ``start`` (0: none)."""
        states, best = self._closed({0}), 0
        for i in range(start, len(words)):
            states = self._after(states, words[i])
            if not states:
                break
            if self.end in states:
                best = i + 1 - start
        return best


class LicenseScanner:
    """``starts`` has the templates by the words that may begin a run; a template
    that a pattern may begin is tried one word before its second words."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[bytes, str] = BASE):
        self.base = base
        self.automata = [(label, Automaton.compile(t)) for label, t in templates.items()]
        self.starts: dict[bytes, list[tuple[int, int]]] = {}
        self.everywhere: list[int] = []
        for i, (_, auto) in enumerate(self.automata):
            first, open_ = auto.begins()
            ahead, second = 0, first
            if open_:
                after = {n for s in auto._closed({0}) for n in [*auto.wild[s], *(n for _, n in auto.tests[s])]}
                behind = auto._closed(after)
                ahead, second = 1, {w for s in behind for w in auto.arcs[s]}
                if first or auto.end in behind or any(auto.wild[s] or auto.tests[s] for s in behind):
                    self.everywhere.append(i)
                    continue
            for word in second:
                self.starts.setdefault(word, []).append((i, ahead))

    def _runs(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, start, words) of all runs, by start of where they were found."""
        for at, word in enumerate(words):
            tried = self.starts.get(word, ())
            for k, ahead in [*tried, *((k, 0) for k in self.everywhere)] if self.everywhere else tried:
                if at >= ahead and (n := self.automata[k][1].longest(words, at - ahead)):
                    yield k, at - ahead, n

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places: list[int] = []
        base_labels: set[str] = set()
        for phrase, label in self.base.items():
            needle = b" " + phrase + b" "
            before, word, at = 0, 0, line.find(needle)
            while at >= 0:
                word += line.count(b" ", before, at)
                before = at
                places.append(word)
                base_labels.add(label)
                at = line.find(needle, at + 1)
        labels, spans = set(base_labels), []
        for k, start, n in self._runs(words):
            labels.add(self.automata[k][0])
            spans.append((start, start + n))
        covered = end = 0
        for a, b in sorted(spans):
            covered += max(0, b - max(a, end))
            end = max(end, b)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            # certainty that the text carries a notice: each base place and each covered word adds to it
            "score": 1.0 - 1.0 / (1 + len(places) + covered),
        }


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    scanner = LicenseScanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.scan(t) | {"doc_id": d} for d, t in zip(batch.column(0).to_pylist(), utf8(batch), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
)
