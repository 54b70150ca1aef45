"""License notices: exact phrases, and fuzzy search for short notices.

Exact phrases are runs of whole words. For fuzzy search each notice is split into one
piece more than the errors it may have. A match with that many errors leaves
one piece untouched, so exact hits of the pieces (one automaton for all notices) name every
candidate place; the regex library then verifies the few characters around each with
its bounded-error matching and gives the span. Of spans of a notice that overlap, the one with fewest errors stays. Only A-Z are lower-cased, so spans count
characters of the text as given. Null and empty texts have no words, no labels, score 0.0; long
texts are searched whole. The scan is a column over a text, so repeated rows are scanned each for itself and other columns stay as they are.
"""

from __future__ import annotations

import bisect
import heapq
import sys
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ordermill.llm.spans import byte_table, blocks, part_of, word_places

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases of whole words, and what is no part of a word.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_IN_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = {upper: upper + 32 for upper in range(65, 91)}


class Notice(NamedTuple):
    label: str
    text: str
    errors: int


NOTICES = (
    Notice("apache", "licensed under the apache license, version 2.0", 5),
    Notice("gpl", "licensed under the gnu general public license", 5),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 7),
    Notice("cc-by-nc", "licensed under cc by-nc 4.0", 2),
    Notice("cc-by", "licensed under a creative commons attribution", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "subject to the terms of the mozilla public license", 5),
)


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their places."""
    edges = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


class Searcher:
    """Finds notices with errors; built once per task."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.errors}}}") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for place, piece in pieces(notice.text, notice.errors):
                seeds.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, users in seeds.items():
            self.automaton.add_word(piece, (len(piece), users))
        if seeds:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) of each match, none over another of its notice; fewer errors go first."""
        windows: dict[int, set[tuple[int, int]]] = {}
        if not self.notices:
            return []
        for last, (length, users) in self.automaton.iter(text):
            for i, place in users:
                slack = self.notices[i].errors
                start = max(0, last + 1 - length - place - slack)
                end = min(len(text), last + 1 - length - place + len(self.notices[i].text) + slack)
                windows.setdefault(i, set()).add((start, end))
        return sorted((start, end, i, errors) for i, listed in windows.items() for start, end, errors in self.apart(i, text, listed))

    def apart(self, i: int, text: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The matches of one notice in its windows; what a match leaves of a window is searched again."""
        least = max(1, len(self.notices[i].text) - self.notices[i].errors)
        waiting: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int, int]] = []

        def search(start: int, end: int) -> None:
            if end - start >= least and (match := self.patterns[i].search(text, start, end)) and match.end() > match.start():
                heapq.heappush(waiting, (sum(match.fuzzy_counts), match.start(), match.end(), start, end))

        # Windows that touch are joined up to a bounded length, so that the work is in proportion to the text.
        joined: list[tuple[int, int]] = []
        for start, end in sorted(windows):
            if joined and start <= joined[-1][1] and max(end, joined[-1][1]) - joined[-1][0] <= 2 * len(self.notices[i].text):
                joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
            else:
                joined.append((start, end))
        for start, end in joined:
            search(start, end)
        while waiting:
            errors, first, after, start, end = heapq.heappop(waiting)
            at = bisect.bisect_left(taken, (first,))
            if at and taken[at - 1][1] > first:
                at -= 1
            elif at == len(taken) or taken[at][0] >= after:
                taken.insert(at, (first, after, errors))
            # From the taken match that this one is or lies over, as far as the window goes.
            search(start, taken[at][0])
            search(taken[at][1], end)
        return taken


_SCAN = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "spans:array<struct<start:int,end:int,label:string,errors:int>>>"
)


def license_scan(phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
    """A function from a text column to a struct of word counts, labels, score and spans.

    score is 1.0 for an exact phrase, else the largest share of a found notice's
    characters that are without error, else 0.0.
    """

    def scan(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(notices)
        word = regex.compile(f"[^{_GAP}]+")
        exact = [
            (label, regex.compile(f"(?<![^{_GAP}])" + f"[{_GAP}]+".join(map(regex.escape, phrase.split())) + f"(?![^{_GAP}])"))
            for phrase, label in phrases.items()
        ]
        hints = sorted({max(phrase.split(), key=len) for phrase in phrases})
        for texts in arrays:
            words = np.zeros(len(texts), np.int64)
            for block in blocks(texts, ~_IN_WORD):
                starts, _ = word_places(block, _IN_WORD)
                words[block.rows] += np.bincount(part_of(block, starts), minlength=len(block.rows))
            rows = []
            for value, n_words in zip(texts, words):
                text = (value.as_py() or "").translate(_LOWER)
                hits = []
                if any(hint in text for hint in hints):
                    hits = sorted((m.start(), label) for label, pattern in exact for m in pattern.finditer(text, overlapped=True))
                places, at, count = [], 0, 0
                for start, _ in hits:
                    count += sum(1 for _ in word.finditer(text, at, start))
                    at = start
                    places.append(count)
                spans = searcher.spans(text)
                base = sorted({label for _, label in hits})
                score = 1.0 if base else max((1 - errors / len(notices[i].text) for _, _, i, errors in spans), default=0.0)
                rows.append(
                    {
                        "n_words": int(n_words),
                        "n_base": len(places),
                        "first_word": places[0] if places else None,
                        "last_word": places[-1] if places else None,
                        "base_labels": ",".join(base),
                        "labels": ",".join(sorted({*base, *(notices[i].label for _, _, i, _ in spans)})),
                        "score": score,
                        "spans": [{"start": a, "end": b, "label": notices[i].label, "errors": e} for a, b, i, e in spans],
                    }
                )
            yield pa.array(rows, _ARROW)

    return F.arrow_udf(scan, _SCAN, F.ArrowUDFType.SCALAR_ITER)


_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("errors", pa.int32())]))),
    ]
)
