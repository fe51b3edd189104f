"""Bin counts of a stream; its range has to be given, since a stream has no known ends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import EmptyInputError, SingleClassError
from ..functions.columns import bin_of
from ..operators.search import bin_edge


def stream_bins(scored: DataFrame, lowest: float, highest: float, bins: int = 1024) -> DataFrame:
    """``(bin, neg, pos)`` so far, as a streaming aggregate with one state row per bin.

    Scores outside the range count in the first and last bin; rows without a score or
    class are left out.
    """
    kept = scored.where("y is not null and score is not null and not isnan(score)")
    held = F.greatest(F.lit(lowest), F.least(F.col("score"), F.lit(highest)))
    at = bin_of(held, lowest, highest, bins).alias("bin")
    return kept.groupBy(at).agg(
        F.sum((F.col("y") == -1).cast("long")).alias("neg"), F.sum((F.col("y") == 1).cast("long")).alias("pos")
    )


def start(counts: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the counts in a table in memory: one row per bin."""
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def threshold(counts: DataFrame, lowest: float, highest: float, bins: int = 1024) -> tuple[float, int]:
    """Cut-off and rows it gets right, from a table of bin counts (one row per bin)."""
    rows = sorted(counts.collect())
    total = sum(r.pos for r in rows)
    if not rows:
        raise EmptyInputError
    if not total or total == sum(r.pos + r.neg for r in rows):
        raise SingleClassError(1 if total else -1)
    best, best_bin, right = total, None, total
    for r in rows:
        right += r.neg - r.pos
        if right > best:
            best, best_bin = right, r.bin
    if best_bin is None:
        return math.nextafter(lowest, -math.inf), best
    return bin_edge(best_bin, lowest, highest, bins), best
