"""Periodic runs of words, found by suffix automata over the recurring parts of texts."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import session
from .words import Words, chunks, grams, joined

#: End positions that one block of an ordered set holds at most.
BLOCK = 1024
#: Times that a span of a text is searched for recurring groups; more would find the same runs.
PASSES = 8

Run = tuple[int, int, int]


class Ends:
    """An ordered set of end positions in blocks, so that adding one moves few others."""

    __slots__ = ("blocks", "count", "firsts")

    def __init__(self, only: int) -> None:
        self.blocks, self.firsts, self.count = [[only]], [only], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x`` in; its neighbours before and after it."""
        b = max(0, bisect_right(self.firsts, x) - 1)
        block = self.blocks[b]
        k = bisect_right(block, x)
        before = block[k - 1] if k else self.blocks[b - 1][-1] if b else None
        after = block[k] if k < len(block) else self.firsts[b + 1] if b + 1 < len(self.blocks) else None
        block.insert(k, x)
        self.count += 1
        self.firsts[b] = block[0]
        if len(block) > BLOCK:
            half = block[BLOCK // 2 :]
            del block[BLOCK // 2 :]
            self.blocks.insert(b + 1, half)
            self.firsts.insert(b + 1, half[0])
        return before, after


def automaton(letters: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``letters``: the longest length and the suffix link of each
    state, and the state of each prefix but the empty one."""
    longest, link, follow, prefix = [0], [-1], [{}], []
    last = 0
    for letter in letters:
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        follow.append({})
        prefix.append(new)
        at = last
        while at >= 0 and letter not in follow[at]:
            follow[at][letter] = new
            at = link[at]
        if at >= 0:
            met = follow[at][letter]
            if longest[met] != longest[at] + 1:
                split = len(longest)
                longest.append(longest[at] + 1)
                link.append(link[met])
                follow.append(follow[met].copy())
                link[met] = split
                while at >= 0 and follow[at].get(letter) == met:
                    follow[at][letter] = split
                    at = link[at]
                met = split
            link[new] = met
        last = new
    return longest, link, prefix


def runs_of(letters: Sequence[int], least: int, times: int) -> list[Run]:
    """``(start, length, period)`` of the runs of at least ``least`` letters and ``times`` periods.

    Sets of end positions grow up the suffix links, the smaller into the larger. Where two
    ends a < b become neighbours, the state's longest word is all that the prefixes up to a
    and b have in common at their ends. If it spans the distance b - a often enough, it is a
    square seed: it starts where its run does, and is extended to the run's end. A state
    too short to make up ``least`` letters with any distance that it spans, and all above
    it, are left out. The distance is the smallest period, as otherwise an end would lie
    between.
    """
    if len(letters) < least:
        return []
    longest, link, prefix = automaton(letters)
    shortest = -(-least * (times - 1) // times)
    sets: list[Ends | None] = [None] * len(longest)
    for end, state in enumerate(prefix, 1):
        sets[state] = Ends(end)
    seeds: dict[tuple[int, int], int] = {}
    # longer states first: all below a state are merged before it is
    order = np.argsort(-np.array(longest), kind="stable").tolist()
    for state in order:
        up, own = link[state], sets[state]
        if own is None or up <= 0 or longest[up] < shortest:
            continue
        sets[state], large = None, sets[up]
        if large is None:
            sets[up] = own
            continue
        if large.count < own.count:
            own, large = large, own
        sets[up] = large
        common = longest[up]
        pairs: list[tuple[int | None, int | None]] = []
        last = None
        for x in own:
            before, after = large.add(x)
            if last is not None and before == last:
                pairs.pop()  # they were neighbours in their own set
            else:
                pairs.append((before, x))
            pairs.append((x, after))
            last = x
        for a, b in pairs:
            if a is not None and b is not None and common >= (times - 1) * (b - a) and common + b - a >= least:
                key = (a - common, b - a)
                seeds[key] = max(seeds.get(key, 0), b)
    out = []
    for (start, period), end in seeds.items():
        while end < len(letters) and letters[end] == letters[end - period]:
            end += 1
        out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint spans of words, each run wholly in one of them.

    All but one period of a run, ``least * (times - 1) / times`` words or more, stand again a
    period on. So each word of a run lies in a group of that many words, or of 16, whose
    next or last place in its span is no further off than a share of ``times`` of the span.
    Words that no such group holds end spans; shorter spans may rule out more groups, so
    each is looked at again, up to PASSES times.
    """
    size = max(1, min(16, -(-least * (times - 1) // times)))
    spans = [(0, len(hashes), 1)]
    done = []
    while spans:
        start, stop, passes = spans.pop()
        n = stop - start
        if n < least:
            continue
        g = grams(hashes[start:stop], size)
        order = np.argsort(g, kind="stable")
        near = (g[order][1:] == g[order][:-1]) & (np.diff(order) <= n // times)
        again = np.zeros(len(g), bool)
        again[order[1:][near]] = True
        again[order[:-1][near]] = True
        at = np.flatnonzero(again)
        covered = np.zeros(n + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
        edge = np.diff((np.cumsum(covered[:n]) > 0).astype(np.int8), prepend=0, append=0)
        parts = [(start + a, start + b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        if passes == PASSES or parts == [(start, stop)]:
            done += parts
        else:
            spans += [(*part, passes + 1) for part in parts]
    return sorted(done)


def text_runs(w: Words, first: int, stop: int, least: int, times: int) -> list[Run]:
    """The runs of the words ``first`` to ``stop``, told apart by their bytes."""
    out = []
    for a, b in stretches(w.hashes[first:stop], least, times):
        numbers: dict[bytes, int] = {}
        place = zip(w.starts[first + a : first + b].tolist(), w.ends[first + a : first + b].tolist(), strict=True)
        letters = [numbers.setdefault(w.data[s:e].tobytes(), len(numbers)) for s, e in place]
        out += [(a + s, n, p) for s, n, p in runs_of(letters, least, times)]
    return out


def periodic_runs(
    docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Periodic runs of words in whole texts, and the texts with each run cut to one period.

    Words are runs without white space. A run is a stretch of words with smallest period q
    (words q apart are identical), of at least ``least`` words and ``times`` (2 or more)
    periods, that no neighbouring word extends. Every run is found, nested and overlapping
    ones too.

    Returns per input row: doc_id, n_words, runs (array of start, length, period, by start,
    then period; words count from 0), strongest (the run of greatest length / period; of
    equals the first; null without a run), collapsed_sha256 (of the words that no run
    contains after its first period, joined by one space) and collapsed (that text; null
    where it lacks no word). Null texts have no words; repeated rows are searched each; an
    empty table stays empty. Other columns are not read. A text is worked on alone: memory
    grows with the longest part of one text whose word groups recur.
    """
    if least < 1 or times < 2:
        raise ValueError("a run has one word or more, and two periods or more")
    session(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        for batch in batches:
            n_words, runs, strongest, sha, text = [], [], [], [], []
            for i, j, w in chunks(batch.column(1), "space", False):
                for k in range(j - i):
                    a, b = int(w.offsets[k]), int(w.offsets[k + 1])
                    found = text_runs(w, a, b, least, times)
                    keep = None
                    if found:
                        step = np.zeros(b - a + 1, np.int32)
                        for s, n, p in found:
                            step[s + p] += 1
                            step[s + n] -= 1
                        keep = np.cumsum(step[:-1]) == 0
                    rest = joined(w, a, b, keep)
                    n_words.append(b - a)
                    runs.append([named(r) for r in found])
                    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                    strongest.append(best and named(best))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    text.append(rest.decode() if found else None)
            cols = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(strongest, run_type)]
            cols += [pa.array(sha, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols], ["doc_id", "n_words", "runs", "strongest", "collapsed_sha256", "collapsed"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    run = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(
        scan, f"doc_id {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed_sha256 string, collapsed string"
    )
