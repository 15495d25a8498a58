"""Licence scans with a generalised suffix automaton.

The words of all licence templates form one suffix automaton. A file streams through it: after
each word the state and length say how long the longest match is that ends there (matching
statistics), whichever template it comes from. Matches that can't be made longer and have
``shortest`` words or more are chained per template, in the order of both file and template,
into spans; a span that covers enough of its template is a find. Base phrases are strings of
the same automaton, so each place of theirs is seen on the way.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from latent.llm.common import ids_and_texts, map_batches

# Phrases and their labels, and notices by which works state their licence.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation; either "
     "version 2 of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0"),
]

#: All ASCII characters but letters and digits stand between words.
GAPS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:int,end:int,coverage:double>>")


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, in UTF-8."""
    return text.encode().lower().translate(GAPS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences.

    ``ends[state]`` gives for each string that holds the state's words the end of their first
    place; ``suffixes[state]`` the (length, phrase) of phrases that end the state's longest
    words.
    """

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])
    suffixes: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        self.suffixes.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, to: int) -> int:
        """A copy of ``to`` for the words that are one longer than those of ``state``."""
        copy = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.ends[copy] = dict(self.ends[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        to = self.next[last].get(word)
        if to is not None:  # an earlier string has these words
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = (to if self.length[to] == self.length[at] + 1
                              else self._split(at, word, to))
        return new

    @classmethod
    def of(cls, strings: list[list[bytes]], phrases: list[list[bytes]]) -> "Automaton":
        """Automaton of the strings and phrases; phrases have no ends of their own."""
        self = cls()
        tops: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate([*strings, *phrases]):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                if number < len(strings):
                    self.ends[last].setdefault(number, i)
            if number >= len(strings):
                tops.setdefault(last, []).append((len(words), number - len(strings)))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        for state in reversed(order[1:]):  # a place of the words is one of their suffixes
            up = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                up[number] = min(end, up.get(number, end))
        for state in order[1:]:
            self.suffixes[state] = self.suffixes[self.link[state]] + [
                t for t in tops.get(state, ()) if t[0] == self.length[state]]
        return self


class Scanner:
    """Finds phrases and licence spans in word sequences; one per task."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, shortest: int = 3,
                 gap: int = 8, covered: float = 0.8):
        self.labels = [label for label, _ in templates]
        strings = [words_of(text) for _, text in templates]
        self.sizes = [len(s) for s in strings]
        self.phrase_labels = list(phrases.values())
        self.automaton = Automaton.of(strings, [words_of(p) for p in phrases])
        self.shortest, self.gap, self.covered = shortest, gap, covered

    def stream(self, words: Iterable[bytes]):
        """((start, phrase) of all places, (start, end, state) of maximal long matches)."""
        a, least = self.automaton, self.shortest
        moves, link, length, suffixes = a.next, a.link, a.length, a.suffixes
        root, state, size = moves[0], 0, 0
        places, matches, i = [], [], -1
        for i, word in enumerate(words):
            if not state:  # no match so far
                state = root.get(word, 0)
                size = 1 if state else 0
            else:
                to = moves[state].get(word)
                if to is None:
                    if size >= least:
                        matches.append((i - size, i, state))
                    while state and to is None:
                        state = link[state]
                        to = moves[state].get(word)
                    size = 0 if to is None else length[state] + 1
                    state = to or 0
                else:
                    state, size = to, size + 1
            if suffixes[state]:
                places += [(i - n + 1, p) for n, p in suffixes[state] if n <= size]
        if size >= least:
            matches.append((i + 1 - size, i + 1, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, coverage) of the chains of matches that cover a template.

        A match goes on a template's chain if it lies behind the chain's end in the file and
        in the template, by at most ``gap`` words in the file, else it begins a new chain.
        """
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: start, end, its end, covered
        found = []

        def close(number):
            start, end, _, covered = open_.pop(number)
            if covered >= self.covered * self.sizes[number]:
                found.append((self.labels[number], start, end, covered / self.sizes[number]))

        for start, end, state in matches:
            for number, last in self.automaton.ends[state].items():
                first = last + 1 - (end - start)
                if number in open_:
                    s, e, t, c = open_[number]
                    # Matches may share words: only the new ones count.
                    new = min(end - max(start, e), last + 1 - max(first, t))
                    if new > 0 and start - e <= self.gap and last >= t:
                        open_[number] = (s, end, last + 1, c + new)
                        continue
                    close(number)
                open_[number] = (start, end, last + 1, end - start)
        for number in list(open_):
            close(number)
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))

    def scan(self, text: str) -> dict:
        words = words_of(text)
        places, matches = self.stream(words)
        spans = self.spans(matches)
        base = sorted({self.phrase_labels[p] for _, p in places})
        starts = [s for s, _ in places]
        return {"n_words": len(words), "n_base": len(places),
                "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(base),
                "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
                "score": max((s[3] for s in spans), default=1.0 if places else 0.0),
                "spans": [{"label": s[0], "start": s[1], "end": s[2], "coverage": s[3]}
                          for s in spans]}


def scan(docs: DataFrame, **settings) -> DataFrame:
    """Base phrases, labels and licence spans of every whole text of ``docs``.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word`` are the smallest
    and largest of their starts; ``score`` is the best coverage of a template, 1 if only a
    phrase was found, 0 for none. A null or empty text has no words, null starts and empty
    labels; null ids and repeated rows stay; an empty table gives an empty result.
    """
    def start():
        scanner = Scanner(**settings)

        def step(batch):
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                     "score", "spans")
            return {"doc_id": batch.column(0)} | {n: [r[n] for r in rows] for n in names}
        return step

    return map_batches(ids_and_texts(docs), start, RESULT)
