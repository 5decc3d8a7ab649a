"""License scans by template-markup matching.

A template is the wording of a license or notice with two kinds of regions: ``[words]`` may be left out, and ``{a b|c}`` stands for
one of its alternatives (``{*2-9}``: two to nine words of any kind). Regions nest. All templates become one automaton over words; a
text is accepted where the words outside these regions, the mandatory wording, follow each other exactly. The automaton is made
deterministic as texts need it, so that a text is read once whatever the number of templates; where a template ends, a second walk
over the words just before finds where it began. Phrases are templates without regions whose places are counted.

Words are runs of digits, letters in lower case (A-Z are lowered) and bytes outside ASCII. Texts are read in pieces of a megabyte, with
the automaton's state carried on, so memory doesn't grow with a text's length.

Defined results: a null text is an empty one, with no words, no labels and a score of 0; null or repeated ids and repeated rows get a row each; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from cataloom.llm import kernels as K

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of public licenses and notices, with the regions that vary between copies.
_GRANTED = "{licensed|released|distributed|published|made available|available} under [the terms of]"
_WORK = "[{this|the} {work|program|software|file|library|project|code|source code|document} is]"
TEMPLATES = (
    ("mit-notice", f"{_WORK} {_GRANTED} [the] [terms of the] mit license"),
    (
        "mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and {noninfringement|non infringement} in no event shall the {authors|author|*1-6} or copyright {holders|holder} be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software"
    ),
    (
        "isc-text", "permission to use copy modify and {or|} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies"
    ),
    (
        "bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the "
        "above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    (
        "bsd-3-clause-text", "[3] neither the name of {*1-20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission"
    ),
    ("apache-2.0-notice", f"{_WORK} {_GRANTED} [the] apache license [v|version] 2 [0]"),
    (
        "apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at [http|https] [www] apache org licenses license 2 0 [html|txt] unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    *(
        (f"gpl-{v}.0-notice", f"{_WORK} {_GRANTED} [the] gnu general public license [as published by the free software foundation] [either] [v|version] {v} [0]")
        for v in (1, 2, 3)
    ),
    *(
        (f"lgpl-{v}-notice", f"{_WORK} {_GRANTED} [the] gnu {{lesser|library}} general public license [as published by the free software foundation] [either] [v|version] {v.replace('.', ' ')}")
        for v in ("2.0", "2.1", "3.0")
    ),
    (
        "gpl-header", "this {program|library|file|*1-6} is free software you can redistribute it and or modify it under the terms of the gnu [lesser|library|affero] general public license as "
        "published by the free software foundation [either] version {1|2|2 1|3} [of the license] [or at your option any later version]"
    ),
    ("mpl-2.0-header", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
    ),
    *(
        (
            f"cc-{parts}-{v}.0-notice",
            f"{_WORK} {_GRANTED} [a|the] {{cc|creative commons}} {{{parts.replace('-', ' ')}|{' '.join({'by': 'attribution', 'nc': 'noncommercial', 'sa': 'sharealike', 'nd': 'noderivatives'}[p] for p in parts.split('-'))}}} "
            f"[international|unported|generic] [license] [v|version] {v} 0"
        )
        for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
        for v in (1, 2, 3, 4)
    ),
    ("cc0-notice", f"{_WORK} {_GRANTED} [the] {{cc0|creative commons zero}}"),
    ("spdx-tag", "spdx license identifier {*1-1}"),
)

#: Score of a text that has a phrase, but no more of a template.
PHRASE_SCORE = 0.5
#: Bytes of a text that are split into words at once, and deterministic states that are kept before the table is begun anew.
PIECE, STATES = 1 << 20, 1 << 15

_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of a piece each."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_WORD_BYTES)
        if at + PIECE < len(text):
            cut = piece.rfind(b" ") + 1
            # A word longer than a piece: look for its end.
            while not cut:
                more = text[at + len(piece) : at + len(piece) + PIECE].translate(_WORD_BYTES)
                cut = len(piece) + (more.find(b" ") + 1 or (len(more) if len(more) < PIECE else 0)) if b" " in more or len(more) < PIECE else 0
                piece += more
            piece = piece[:cut]
        at += len(piece)
        yield piece.split()


def parse(markup: str) -> list:
    """Markup as a list of words, ("optional" | "choice", alternatives) and ("any", least, most)."""
    tokens, at = markup.replace("[", " [ ").replace("]", " ] ").replace("{", " { ").replace("}", " } ").replace("|", " | ").split(), 0

    def alternatives(closing: str | None) -> list[list]:
        nonlocal at
        found: list[list] = [[]]
        while at < len(tokens) and tokens[at] != closing:
            token = tokens[at]
            at += 1
            if token == "|":
                found.append([])
            elif token in "[{":
                inner = alternatives("]" if token == "[" else "}")
                at += 1
                found[-1].append(("optional" if token == "[" else "choice", inner))
            elif token.startswith("*"):
                found[-1].append(("any", *map(int, token[1:].split("-"))))
            else:
                found[-1].append(token.encode())
        return found

    return alternatives(None)[0]


def longest(items: list) -> int:
    """How many words the longest wording of a template has."""
    return sum(1 if isinstance(x, bytes) else x[2] if x[0] == "any" else max(map(longest, x[1]), default=0) for x in items)


class Automaton:
    """All templates and phrases as one automaton over words.

    States are numbers; ``edges`` lead on by a word, ``any`` by whatever word, ``free`` by none. ``share`` is the part of its template's mandatory
    words and replaceable regions that lies before a state, ``ends`` the (is it a phrase, number in ``wordings``) that it completes; ``wordings`` has label, most words and first states.
    """

    def __init__(self, templates: tuple, phrases: tuple):
        self.edges: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.count: list[int] = []
        self.ends: dict[int, tuple[bool, int]] = {}
        self.share: dict[int, float] = {}
        self.wordings: list[tuple[str, int, frozenset]] = []
        for is_phrase, (label, markup) in [(False, t) for t in templates] + [(True, (label, phrase)) for phrase, label in phrases]:
            begin, items = self._state(0), parse(markup)
            end = self._sequence(items, begin, True)
            self.ends[end] = is_phrase, len(self.wordings)
            self.wordings.append((label, longest(items), self._closed([begin])))
            if not is_phrase:
                total = max(self.count[end], 1)
                self.share |= {s: self.count[s] / total for s in range(begin, len(self.count))}
        self.reach = max((n for _, n, _ in self.wordings), default=0)
        self.begin = frozenset().union(*(x for _, _, x in self.wordings))
        self.vocabulary = {w for e in self.edges for w in e}
        self.table: dict[frozenset, tuple] = {}
        self.forget()

    def _state(self, count: int) -> int:
        self.edges.append({})
        self.any.append([])
        self.free.append([])
        self.count.append(count)
        return len(self.count) - 1

    def _sequence(self, items: list, at: int, mandatory: bool) -> int:
        for item in items:
            if isinstance(item, bytes):
                to = self._state(self.count[at] + mandatory)
                self.edges[at].setdefault(item, []).append(to)
            elif item[0] == "any":
                inside = [at]
                for _ in range(item[2]):
                    inside.append(self._state(self.count[at]))
                    self.any[inside[-2]].append(inside[-1])
                to = self._state(self.count[at] + mandatory)
                for s in inside[item[1] :]:
                    self.free[s].append(to)
            else:
                to = self._state(self.count[at] + (mandatory and item[0] == "choice"))
                for one in item[1]:
                    self.free[self._sequence(one, at, False)].append(to)
                if item[0] == "optional":
                    self.free[at].append(to)
            at = to
        return at

    def _closed(self, states: list[int]) -> frozenset:
        found, left = set(states), list(states)
        while left:
            new = [s for s in self.free[left.pop()] if s not in found]
            found.update(new)
            left += new
        return frozenset(found)

    def _stepped(self, states: frozenset, word: bytes | None) -> list[int]:
        return [t for s in states for t in (*self.edges[s].get(word, ()), *self.any[s])]

    def _row(self, states: frozenset) -> tuple:
        """(next rows by word, states, best share, ends) of a deterministic state."""
        if states not in self.table:
            ends = [self.ends[s] for s in states if s in self.ends]
            self.table[states] = {}, states, max((self.share.get(s, 0.0) for s in states), default=0.0), ends
        return self.table[states]

    def forget(self) -> None:
        self.table = {}
        self.start = self._row(self.begin)

    def follow(self, row: tuple, word: bytes | None) -> tuple:
        """The row that a word (None: one that no template has) leads to."""
        to = self._row(self._closed(self._stepped(row[1], word)) | self.begin)
        row[0][word] = to
        return to

    def begins(self, before: list[bytes], number: int) -> int:
        """How many words long the longest match of a template is that ends with ``before``."""
        live: dict[int, int] = {}
        for i, word in enumerate(before):
            here = dict.fromkeys(self.wordings[number][2], i) | live
            live = {}
            for s, at in here.items():
                for t in self._closed([*self.edges[s].get(word, ()), *self.any[s]]):
                    live[t] = min(at, live.get(t, at))
        return max((len(before) - at for s, at in live.items() if self.ends.get(s) == (False, number)), default=0)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]], float]:
        """(words, places of phrases with their labels, spans of templates with their labels, score) of a text."""
        row = start = self.start
        n, best, places, spans, tail = 0, 0.0, [], {}, []
        vocabulary = self.vocabulary
        for piece in words(text):
            for i, word in enumerate(piece):
                if word not in vocabulary:
                    if row is start:
                        continue
                    word = None
                to = row[0].get(word)
                if to is None:
                    if len(self.table) > STATES:
                        self.forget()
                        start, row = self.start, self._row(row[1])
                    to = self.follow(row, word)
                row = to
                if row[2] > best:
                    best = row[2]
                if row[3]:
                    after = n + i + 1
                    for is_phrase, number in row[3]:
                        label, most, _ = self.wordings[number]
                        if is_phrase:
                            places.append((after - most, label))
                        else:
                            before = piece[max(0, i + 1 - most) : i + 1]
                            if len(before) < most and tail:
                                before = tail[len(before) - most :] + before
                            # Of matches with one beginning the longest stays.
                            spans[label, after - self.begins(before, number)] = after
            n += len(piece)
            tail = (tail + piece[-self.reach :])[-self.reach :]
        if places:
            best = max(best, PHRASE_SCORE)
        return n, places, sorted((label, a, b) for (label, a), b in spans.items()), best


@lru_cache(2)
def _automaton(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton(templates, phrases)


def scanned(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word, last_word (the first and last place), base_labels, labels (with those of templates), score (the largest
    share of a template's mandatory words and replaceable regions found in one go, at least PHRASE_SCORE with a phrase), spans (label, first word, word after the last) of templates."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(templates, phrases)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, places, found, score = automaton.scan((text.as_py() or "").encode())
                base = {label for _, label in places}
                at = [p for p, _ in places]
                rows.append((
                    n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), score,
                    [{"label": x, "first": a, "after": b} for x, a, b in found]
                ))
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return K.small_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,after:long>>"
    )
