"""Operator 11: short licence notices, found with a bounded number of edits.

Texts are read as their words with one space between (A-Z in lower case), so case, line ends and punctuation are no edits.
A notice may be off by one character in each CHARS_AN_EDIT. If k edits are allowed, one of k + 1 parts of it stands
unchanged somewhere (pigeonhole), so those parts are looked for exactly, all at once; only around them the regex library
matches the whole notice with at most k edits. What distinguishes a notice from another, its numbers and its name, must
stand as it is. Places of several notices that overlap go to the one with the smallest share of edits, then the longest.

Base phrases are those of the contract, whole words in a row, without edits.

Defined results: a null text is empty and has no words; repeated rows give repeated results; a null doc_id stays null; ties
at one place go to the notice that is listed first; texts are read whole, however long; an empty table gives no rows;
spans are code points of the text as it is, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.words import FOLD, utf8

#: Phrases and labels of the contract.
BASE: dict[str, str] = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Characters of a notice for each edit that it may be off by.
CHARS_AN_EDIT = 12
#: Windows that a worker remembers; characters by which a window is widened to end with a word.
MEMO, WIDEST = 4096, 64


class Notice(NamedTuple):
    """Words of a notice, its label, and the words of it (besides numbers) that must stand as they are."""

    words: str
    label: str
    named: tuple[str, ...] = ()


NOTICES: tuple[Notice, ...] = (
    Notice("under the mit license", "mit", ("mit",)),
    Notice("licensed under mit", "mit", ("mit",)),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    Notice("apache license version 2", "apache-2", ("apache",)),
    Notice("apache software license version 2", "apache-2", ("apache",)),
    Notice("cc by nc", "cc-by-nc"),
    Notice("creative commons attribution noncommercial", "cc-by-nc", ("attribution",)),
    Notice("creative commons attribution non commercial", "cc-by-nc", ("attribution",)),
    Notice("cc by sa", "cc-by-sa"),
    Notice("creative commons attribution sharealike", "cc-by-sa", ("attribution",)),
    Notice("cc by nd", "cc-by-nd"),
    Notice("cc by 4 0", "cc-by"),
    Notice("creative commons attribution 4 0", "cc-by", ("attribution",)),
    Notice("gnu general public license version 2", "gpl-2", ("gnu",)),
    Notice("gnu general public license version 3", "gpl-3", ("gnu",)),
    Notice("gnu lesser general public license", "lgpl", ("lesser",)),
    Notice("gnu affero general public license", "agpl", ("affero",)),
    Notice("mozilla public license version 2", "mpl-2", ("mozilla",)),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    Notice("under the bsd license", "bsd", ("bsd",)),
    Notice("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
    Notice("spdx license identifier mit", "mit", ("mit",)),
    Notice("spdx license identifier apache 2 0", "apache-2", ("apache",)),
    Notice("spdx license identifier gpl 3 0", "gpl-3", ("gpl",)),
    Notice("spdx license identifier gpl 2 0", "gpl-2", ("gpl",)),
)


class Found(NamedTuple):
    """A place in a normal text: the notice's number, start, end and edits."""

    notice: int
    start: int
    end: int
    edits: int


class Search:
    """The notices, ready to be looked for in normal texts: words with one space between and one at either end."""

    def __init__(self, notices: tuple[Notice, ...], chars_an_edit: int) -> None:
        self.notices = notices
        self.padded = [f" {n.words} " for n in notices]
        self.allowed = [len(n.words) // chars_an_edit for n in notices]
        self.fuzzy = [regex.compile(f"(?be)(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}") for p, k in zip(self.padded, self.allowed)]
        self.kept = [sorted({*n.named, *filter(str.isdigit, n.words.split())}) for n in notices]
        self.numbers = [sum(map(str.isdigit, n.words.split())) for n in notices]
        self.seeds = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for number, (p, k) in enumerate(zip(self.padded, self.allowed)):
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                of.setdefault(p[a:b], []).append((number, a))
        for seed, uses in of.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()
        self.best = lru_cache(MEMO)(self._best)

    def _best(self, number: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the closest place of a notice in a window that leaves its name and numbers whole."""
        kept, numbers, at = self.kept[number], self.numbers[number], 0
        if not all(f" {w} " in window for w in kept):
            return None
        while m := self.fuzzy[number].search(window, at):
            end = window.find(" ", m.end() - 1)
            words = window[window.rfind(" ", 0, m.start() + 1) + 1 : end if end >= 0 else len(window)].split()
            if all(w in words for w in kept) and sum(map(str.isdigit, words)) == numbers:
                return m.start(), m.end(), sum(m.fuzzy_counts)
            at = m.start() + 1
        return None

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end): parts of the text, of whole words, in which a notice can be; each holds one place at most."""
        known: dict[int, tuple[int, int]] = {}
        for last, (length, uses) in self.seeds.iter(text):
            for number, offset in uses:
                k, begin = self.allowed[number], last - length + 1 - offset
                a, b = max(0, begin - k), min(len(text), begin + len(self.padded[number]) + k)
                if known.get(number) != (a, b):
                    known[number] = a, b
                    left, right = text.rfind(" ", max(0, a - WIDEST), a + 1), text.find(" ", b - 1, b + WIDEST)
                    yield number, a if left < 0 else left, b if right < 0 else right + 1

    def places(self, text: str) -> list[Found]:
        """Where notices stand in a normal text, by start, each place with one notice only."""
        met = {Found(number, a + m[0], a + m[1], m[2]) for number, a, b in self.windows(text) if (m := self.best(number, text[a:b]))}
        worth = sorted(met, key=lambda f: (f.edits / len(self.padded[f.notice]), f.start - f.end, f.notice, f.start))
        return _apart(worth)


def _apart(worth: list[Found]) -> list[Found]:
    """Of places in the order of their worth those that don't overlap a better one, by start; one shared space is no overlap.

    Taken places are kept by the stretches of text they lie in, so that each is held against its neighbours only.
    """
    size = max((f.end - f.start for f in worth), default=1)
    taken: dict[int, list[Found]] = {}
    for f in worth:
        near = (g for cell in range(f.start // size - 1, f.start // size + 2) for g in taken.get(cell, ()))
        if all(f.end - 1 <= g.start or g.end - 1 <= f.start for g in near):
            taken.setdefault(f.start // size, []).append(f)
    return sorted((f for fs in taken.values() for f in fs), key=lambda f: f.start)


@lru_cache(maxsize=4)
def search(notices: tuple[Notice, ...] = NOTICES, chars_an_edit: int = CHARS_AN_EDIT) -> Search:
    return Search(notices, chars_an_edit)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(place of the space before it, label) of each base phrase in a normal text, as UTF-8."""
    out = []
    for phrase, label in BASE.items():
        padded = f" {phrase} ".encode()
        at = text.find(padded)
        while at >= 0:
            out.append((at, label))
            at = text.find(padded, at + 1)
    return sorted(out)


_RUN = regex.compile(r"(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])+")


def spans_in(text: str, places: list[Found], notices: tuple[Notice, ...]) -> list[dict]:
    """The places in the text as it is: label, start, end and edits; words of the text are those of its normal form."""
    if not places:
        return []
    begins, ends, starts, at = [], [], [], 1
    for m in _RUN.finditer(text):
        begins.append(m.start())
        ends.append(m.end())
        starts.append(at)  # of the word in the normal text
        at += m.end() - m.start() + 1
    out, w = [], 0
    for f in places:
        while w + 1 < len(starts) and starts[w] + (ends[w] - begins[w]) <= f.start:
            w += 1
        last = w
        while last + 1 < len(starts) and starts[last + 1] < f.end - 1:
            last += 1
        out.append({"label": notices[f.notice].label, "start": begins[w], "end": ends[last], "edits": f.edits})
    return out


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SPANS = "array<struct<label:string,start:int,end:int,edits:int>>"


def licence_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of `docs` (doc_id, text).

    A row's score is that of its surest notice: 1 less its share of edits; 1 for a base phrase, 0 without any.
    """

    def told(text: bytes | None, find: Search) -> tuple:
        words = (text or b"").translate(FOLD).split()
        normal = b" %b " % b" ".join(words)
        base = base_places(normal)
        first, last = (normal.count(b" ", 0, base[k][0]) for k in (0, -1)) if base else (None, None)
        places = find.places(normal.decode())
        spans = spans_in(text.decode(), places, find.notices) if places else []
        sure = [1 - f.edits / len(find.notices[f.notice].words) for f in places] + [1.0] * bool(base)
        own = sorted({label for _, label in base})
        every = sorted({*own, *(s["label"] for s in spans)})
        return len(words), len(base), first, last, ",".join(own), ",".join(every), max(sure, default=0.0), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = search(notices, chars_an_edit)
        names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]
        for batch in batches:
            rows = [told(t, find) for part in in_parts(utf8(batch.column("text"))) for t in part]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names, "spans"])
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_SCHEMA}, spans {_SPANS}")
