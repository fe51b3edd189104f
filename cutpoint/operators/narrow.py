"""Exact searches without shuffling all distinct scores: branch and bound over bins.

One pass counts the classes in bins of the score line. No cut inside a bin gets more right
than a cut before it would with all the bin's negatives besides, and a cut at the bin's end
gets right what the counts say. Bins that cannot hold the best cut stay one row each; only
the scores of the others are counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import undefined_score
from .profile import Shape, refuse

#: Bins of each doubling of the score, so there are no more than 2 * 2100 * PER_OCTAVE bins
#: at all; and equal-width bins of each stretch that is looked at again.
PER_OCTAVE, AGAIN = 64, 1024
#: Stretches of the score line that a pass filters by at most: neighbours are joined.
STRETCHES = 48
#: Looks at stretches after the first; none if they hold no more than this share of the
#: rows or this number, or if the last look did not halve them.
LOOKS, ENOUGH, FEW = 3, 0.04, 20_000


@dataclass
class Bins:
    """Counts of consecutive stretches of the score line that have rows: first and last
    score, negatives and positives."""

    first: np.ndarray
    last: np.ndarray
    neg: np.ndarray
    pos: np.ndarray

    def part(self, at: Any) -> Bins:
        return Bins(self.first[at], self.last[at], self.neg[at], self.pos[at])


def line_bin(score: Column) -> Column:
    """A bin of the whole score line that never falls as the score grows; 0 holds zero."""
    zero = 1080 * PER_OCTAVE  # below the least float above zero
    place = F.floor(F.log2(F.abs(score)) * PER_OCTAVE)
    place = F.least(place, F.lit(1024 * PER_OCTAVE).cast("long")) + zero
    place = F.when(F.abs(score) == float("inf"), F.lit(1025 * PER_OCTAVE + zero)).otherwise(place)
    return F.when(score == 0, F.lit(0)).when(score > 0, place).otherwise(-place).cast("long")


def _bins(rows: list) -> Bins:
    rows = sorted(rows, key=lambda r: r.low)
    column = lambda name, kind: np.array([r[name] for r in rows], kind)
    return Bins(column("low", np.float64), column("high", np.float64), column("neg", np.int64), column("pos", np.int64))


def survey(scored: DataFrame, labels: Sequence[Any] | None = None) -> tuple[Shape, Bins]:
    """Profile, refusals and bins from one pass over the rows; a row a bin comes back."""
    good = ~undefined_score(F.col("score"))
    ones = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    found = scored.groupBy(F.when(good, line_bin(F.col("score"))).alias("bin")).agg(
        F.count("*").alias("rows"), ones(F.col("y") == -1).alias("neg"), ones(F.col("y") == 1).alias("pos"),
        ones(F.col("missing")).alias("missing"), F.min("score").alias("low"), F.max("score").alias("high"),
    ).collect()
    total = lambda name: sum(r[name] for r in found)
    known = [r for r in found if r.bin is not None]
    shape = Shape(
        total("rows"), total("pos"), total("neg"), min((r.low for r in known), default=0.0), max((r.high for r in known), default=0.0)
    )
    refuse(scored, shape, sum(r.rows for r in found if r.bin is None), total("missing"), labels)
    return shape, _bins(known)


def may_win(bins: Bins, positives: int, outside: bool) -> np.ndarray:
    """Which bins can hold the best cut. ``outside`` tells that a cut below all scores counts,
    and one at the highest; else the last bin is always among them."""
    after = np.cumsum(bins.neg - bins.pos) + positives
    most = after + bins.pos
    sure = after.max() if outside else after[:-1].max(initial=-1)
    out = most >= max(sure, positives if outside else -1)
    out[-1] |= not outside
    return out


def _stretches(open_: np.ndarray, bins: Bins) -> np.ndarray:
    """``open_``, with gaps closed (those of fewest rows first) down to STRETCHES runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    starts, stops = edge[::2], edge[1::2]
    if len(starts) <= STRETCHES:
        return open_
    rows = np.append(0, np.cumsum(bins.neg + bins.pos))
    gaps = rows[starts[1:]] - rows[stops[:-1]]
    out = open_.copy()
    for g in np.argsort(gaps, kind="stable")[: len(starts) - STRETCHES]:
        out[stops[g] : starts[g + 1]] = True
    return out


def _runs(open_: np.ndarray, bins: Bins) -> list[tuple[float, float]]:
    """First and last score of each run of open bins."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    return [(float(bins.first[a]), float(bins.last[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _within(spans: list[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for low, high in spans:
        out = out | F.col("score").between(low, high)
    return out


def _looked_at_again(scored: DataFrame, spans: list[tuple[float, float]]) -> Bins:
    """Equal-width bins of each span, of the rows in them."""
    place = F.lit(None).cast("long")
    for n, (low, high) in enumerate(spans):
        width = high / AGAIN - low / AGAIN
        share = (F.col("score") / AGAIN - low / AGAIN) / (width if 0 < width < float("inf") else 1.0)
        # a width that is no number leaves the span one bin
        inside = F.least(F.floor(share * AGAIN), F.lit(AGAIN - 1).cast("long")) if 0 < width < float("inf") else F.lit(0)
        place = F.when(F.col("score").between(low, high), inside + n * AGAIN).otherwise(place)
    ones = lambda y: F.sum((F.col("y") == y).cast("long"))
    found = scored.where(_within(spans)).groupBy(place.alias("bin")).agg(
        ones(-1).alias("neg"), ones(1).alias("pos"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    return _bins(found.collect())  # AGAIN rows a span


def narrowed(scored: DataFrame, shape: Shape, bins: Bins, outside: bool = True) -> tuple[DataFrame, int]:
    """``(score, neg, pos, first)`` that give the same best cut as the counts of all distinct
    scores, and how many rows these are at most.

    A bin that cannot win is one row at its last score, first being its least; other rows
    have their own score as first.
    """
    before = shape.rows
    for look in range(LOOKS + 1):
        open_ = may_win(bins, shape.positives, outside) & (bins.first < bins.last)  # one score is counted already
        open_ = _stretches(open_, bins)
        left = int((bins.neg + bins.pos)[open_].sum())
        if look == LOOKS or left <= max(FEW, ENOUGH * shape.rows) or look and left > before / 2:
            break
        before = left
        found = _looked_at_again(scored, _runs(open_, bins))
        shut = bins.part(~open_)
        joined = [np.concatenate([getattr(shut, c), getattr(found, c)]) for c in ("first", "last", "neg", "pos")]
        order = np.argsort(joined[0], kind="stable")
        bins = Bins(*(c[order] for c in joined))
    shut = bins.part(~open_)
    closed = [(float(h), int(n), int(p), float(f)) for f, h, n, p in zip(shut.first, shut.last, shut.neg, shut.pos, strict=True)]
    spark = scored.sparkSession
    out = spark.createDataFrame(closed, "score double, neg long, pos long, first double")
    if left:
        ones = lambda y: F.sum((F.col("y") == y).cast("long"))
        each = scored.where(_within(_runs(open_, bins))).groupBy("score").agg(ones(-1).alias("neg"), ones(1).alias("pos"))
        out = out.unionByName(each.withColumn("first", F.col("score")))
    return out, left + len(closed)
