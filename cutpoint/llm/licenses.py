"""License scans: exact phrases, and short notices within a bounded number of edits."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import session
from .words import _LOWER, CLASSES, Words, chunks, find

#: Phrases whose words stand consecutively, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices for the fuzzy search, with their labels.
NOTICES = {
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version 2 0": "mpl",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10


@dataclass
class Notice:
    """A notice, its label, its edits, and the pattern that verifies them."""

    text: str
    label: str
    edits: int
    pattern: regex.Pattern

    def matches(self, text: str, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """``(start, end, edits)`` of matches that do not overlap: the best of all windows (of
        equal ones the first), then the best beside it, and so on.

        A window is searched when it is met and again, in parts, where a better match took
        some of it, so each search is about as long as the notice, however long the text.
        """
        heap: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []

        def look(a: int, b: int) -> None:
            if b - a >= len(self.text) - self.edits and (m := self.pattern.search(text, a, b)):
                heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for window in windows:
            look(*window)
        out = []
        while heap:
            edits, start, end, a, b = heappop(heap)
            first = max(0, bisect_left(taken, (a, a)) - 1)
            near = []  # what is taken of the window
            while first < len(taken) and taken[first][0] < b:
                if taken[first][1] > a:
                    near.append(taken[first])
                first += 1
            if not any(s < end and start < e for s, e in near):
                out.append((start, end, edits))
                insort(taken, (start, end))
                near = sorted([*near, (start, end)])
            at = a
            for s, e in [*near, (b, b)]:
                look(at, s)
                at = max(at, e)
        return out


class Scanner:
    """Finds notices: a text within k edits of a notice keeps one of its k + 1 pieces exact."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT) -> None:
        self.notices = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, label) in enumerate(notices.items()):
            k = len(text) // chars_per_edit
            pattern = regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH)
            self.notices.append(Notice(text, label, k, pattern))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(notice, start, end, edits)`` of the matches in a normalised text."""
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for n, offset in uses:
                notice = self.notices[n]
                start = end + 1 - size - offset - notice.edits
                near.setdefault(n, []).append((max(0, start), min(len(text), start + len(notice.text) + 2 * notice.edits)))
        out = []
        for n, found in near.items():
            notice, windows = self.notices[n], []
            for start, stop in sorted(found):
                # seeds of one place make one window
                if windows and start - windows[-1][0] <= 2 * notice.edits:
                    windows[-1] = (windows[-1][0], max(windows[-1][1], stop))
                else:
                    windows.append((start, stop))
            out += [(n, *m) for m in notice.matches(text, windows)]
        return sorted(out, key=lambda m: m[1:3])


def normalised(data: np.ndarray) -> tuple[str, np.ndarray]:
    """Lower-case words joined by one space, one character for a byte; places of its bytes."""
    inside = CLASSES["alnum"][data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    places = np.flatnonzero(keep)
    out = np.where(inside[places], _LOWER[data[places]], 0x20).astype(np.uint8)
    return out.tobytes().decode("latin-1"), places


def phrase_places(w: Words, phrases: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers where phrases start, and which phrase."""
    doc, places, which = w.doc, [], []
    for n, phrase in enumerate(phrases):
        data = np.frombuffer(phrase.encode(), np.uint8)
        h = find(data, np.array([0, len(data)]), "alnum", True).hashes
        last = len(w.hashes) - len(h) + 1
        if last <= 0:
            continue
        at = np.flatnonzero(w.hashes[:last] == h[0])
        for k in range(1, len(h)):
            at = at[w.hashes[at + k] == h[k]]
        at = at[doc[at] == doc[at + len(h) - 1]]
        places.append(at)
        which.append(np.full(len(at), n))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, which = np.concatenate(places), np.concatenate(which)
    order = np.argsort(places, kind="stable")
    return places[order], which[order]


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """License phrases and near-verbatim notices in whole texts.

    Returns per input row: doc_id, n_words, n_base (places of phrases), first_word and
    last_word (their least and greatest start; null without any), base_labels, labels
    (sorted distinct, of phrases and of notices too), score (1 with a phrase; else the
    best 1 - edits / length of a notice; else 0) and notices: label, start and end
    (characters of the text, end exclusive) and edits of each match. Null texts are
    empty; other columns are not read; repeated rows are scanned each.
    """
    session(docs)
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    names = list(phrases.values())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, j, w in chunks(batch.column(1), "alnum", True):
                places, which = phrase_places(w, phrases)
                cut = np.searchsorted(places, w.offsets)
                for k in range(j - i):
                    own, first = places[cut[k] : cut[k + 1]], w.offsets[k]
                    base = {names[x] for x in which[cut[k] : cut[k + 1]]}
                    data = w.data[w.text_starts[k] : w.text_starts[k + 1]]
                    text, back = normalised(data)
                    matches = [m for m in scanner.scan(text) if m[2] > m[1]]
                    # characters that begin before each byte
                    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if matches else None
                    hits = [(scanner.notices[n], int(chars[back[a]]), int(chars[back[b - 1] + 1]), e) for n, a, b, e in matches]
                    labels = base | {n.label for n, *_ in hits}
                    best = 1.0 if base else max((1 - e / len(n.text) for n, _, _, e in hits), default=0.0)
                    found = [{"label": n.label, "start": a, "end": b, "edits": e} for n, a, b, e in hits]
                    bounds = (int(own[0] - first), int(own[-1] - first)) if len(own) else (None, None)
                    values = (int(w.offsets[k + 1] - first), len(own), *bounds, ",".join(sorted(base)), ",".join(sorted(labels)), best, found)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            heads = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], heads
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, notices array<struct<label:string,start:int,end:int,edits:int>>",
    )
