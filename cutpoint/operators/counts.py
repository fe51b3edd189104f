"""Class counts, the sufficient statistic of every search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bin_of, grid_bucket
from ..plans.running import running


def _neg_pos() -> list[Column]:
    return [
        F.sum((F.col("y") == -1).cast("long")).alias("neg"),
        F.sum((F.col("y") == 1).cast("long")).alias("pos"),
    ]


def class_counts(scored: DataFrame) -> DataFrame:
    """``(score, neg, pos)``, one row for each distinct score."""
    return scored.groupBy("score").agg(*_neg_pos())


def bin_counts(scored: DataFrame, lowest: float, highest: float, bins: int) -> DataFrame:
    """``(bin, neg, pos)``: no more rows than bins, whatever the input."""
    return scored.groupBy(bin_of(F.col("score"), lowest, highest, bins).alias("bin")).agg(*_neg_pos())


def grid_counts(scored: DataFrame, lowest: float, highest: float, steps: int) -> DataFrame:
    """``(bucket, neg, pos)``: bucket is how many grid points are below the score."""
    return scored.groupBy(grid_bucket(F.col("score"), lowest, highest, steps).alias("bucket")).agg(*_neg_pos())


def tally(scored: DataFrame, candidates: Sequence[float] | DataFrame, rows: int | None) -> DataFrame:
    """``(pos, threshold, correct)`` for candidates: numbers in their order, or a table
    ``(pos, threshold)`` of any size, whose repeated rows are tallied each. A candidate
    that is null or no number is left out.

    Candidates stand among the distinct scores, each after its equal, and running sums
    give what is at or below each: rows are never paired with candidates, and where there
    are many of either, both are merged in ranges of scores. ``rows`` bounds the rows and
    the candidates; None is unknown.
    """
    if not isinstance(candidates, DataFrame):
        listed = [(i, float(c)) for i, c in enumerate(candidates)]
        candidates = scored.sparkSession.createDataFrame(listed, "pos int, threshold double")
    cut = F.col("threshold").cast("double")
    zero = F.lit(0).cast("long")
    marks = candidates.where(cut.isNotNull() & ~F.isnan(cut)).select(
        cut.alias("score"), F.lit(1).alias("kind"), zero.alias("neg"), zero.alias("pos"), F.col("pos").alias("at")
    )
    nowhere = F.lit(None).cast(dict(marks.dtypes)["at"]).alias("at")
    counts = class_counts(scored).select("score", F.lit(0).alias("kind"), "neg", "pos", nowhere)
    every = running(counts.unionByName(marks), ["score", "kind", "at"], ["neg", "pos"], rows)
    total = scored.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)).alias("all_pos"))
    placed = every.where("kind = 1").crossJoin(F.broadcast(total))  # one row
    correct = F.col("cum_neg") + F.col("all_pos") - F.col("cum_pos")
    return placed.select(F.col("at").alias("pos"), F.col("score").alias("threshold"), correct.alias("correct"))


def first_best(tallies: DataFrame) -> DataFrame:
    """The row with most correct; of equals, the first."""
    best = F.max(F.struct("correct", (-F.col("pos")).alias("back"), "threshold"))["threshold"]
    return tallies.agg(best.alias("threshold"), F.max("correct").alias("correct"))
