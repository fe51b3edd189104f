"""The searches that look at every row: exact, hist, ls, grid. Each gives one row,
``(threshold, correct, rows, accuracy)``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from ..functions.columns import bin_of_value, grid_value, midpoint_of
from ..plans.running import running
from .counts import bin_counts, class_counts, first_best, grid_counts
from .narrow import Bins, narrowed
from .profile import Shape, need_finite


def answer(best: DataFrame, rows: int) -> DataFrame:
    """The result row from ``(threshold, correct)``."""
    share = F.col("correct") / F.lit(rows)
    return best.select("threshold", F.col("correct").cast("long").alias("correct"), F.lit(rows).cast("long").alias("rows"), share.alias("accuracy"))


def curve(scored: DataFrame, shape: Shape, one_task: bool = True) -> DataFrame:
    """``(score, neg, pos, cum_neg, cum_pos, next_score, correct)``: what a cut at each
    distinct score gets right. One task may sort few rows, unless ``one_task`` is false."""
    return curve_of(class_counts(scored), shape.positives, shape.rows if one_task else None)


def curve_of(counts: DataFrame, positives: int, rows: int | None, first: str = "score") -> DataFrame:
    """``curve`` from class counts ``(score, neg, pos)``, of which there are ``rows`` at most.
    A row may stand for all scores from its ``first`` on: next_score is the next row's."""
    swept = running(counts, ["score"], ["neg", "pos"], rows, lead=first)
    if first != "score":
        swept = swept.withColumnRenamed(f"next_{first}", "next_score")
    return swept.withColumn("correct", F.col("cum_neg") + F.lit(positives) - F.col("cum_pos"))


def exact(scored: DataFrame, shape: Shape, one_task: bool = True) -> DataFrame:
    """The best cut of all: between two scores, at the highest, or below the lowest.

    Of equal cuts the lowest wins, and all-positive only if it is strictly better. All
    distinct scores are counted and shuffled; ``exact_narrowed`` counts few of them.
    """
    return _best_of_all(curve(scored, shape, one_task), shape)


def exact_of(counts: DataFrame, shape: Shape) -> DataFrame:
    """``exact`` from class counts ``(score, neg, pos)``."""
    return _best_of_all(curve_of(counts, shape.positives, shape.rows), shape)


def exact_narrowed(scored: DataFrame, shape: Shape, bins: Bins) -> DataFrame:
    """``exact`` after a survey: scores are counted where a bin may hold the best cut."""
    counts, most = narrowed(scored, shape, bins)
    return _best_of_all(curve_of(counts, shape.positives, most, "first"), shape)


def _best_of_all(each: DataFrame, shape: Shape) -> DataFrame:
    cut = F.when(F.col("next_score").isNull(), F.col("score")).otherwise(midpoint_of(F.col("score"), F.col("next_score")))
    each = each.select("correct", (-F.col("score")).alias("back"), cut.alias("threshold"))
    best = each.agg(F.max(F.struct("correct", "back", "threshold")).alias("best")).select("best.*")
    outside = F.lit(shape.positives) > F.col("correct")
    return answer(
        best.select(
            F.when(outside, F.lit(shape.below)).otherwise(F.col("threshold")).alias("threshold"),
            F.greatest("correct", F.lit(shape.positives)).alias("correct"),
        ),
        shape.rows,
    )


def bin_edge(winner: int, lowest: float, highest: float, bins: int) -> float:
    """The largest float still in bin ``winner`` or before, by bisection with the binning
    itself; the last bin ends at ``highest``."""
    if bin_of_value(highest, lowest, highest, bins) <= winner:
        return highest
    low, high = lowest, highest
    while math.nextafter(low, math.inf) < high:
        middle = low + (high - low) / 2
        if not low < middle < high:
            middle = math.nextafter(low, math.inf)
        if bin_of_value(middle, lowest, highest, bins) <= winner:
            low = middle
        else:
            high = middle
    return low


def hist(scored: DataFrame, shape: Shape, bins: int = 1024) -> DataFrame:
    """The best cut at an edge of equal-width bins; what is shuffled is one row per bin
    and task. All-positive wins ties, then the lowest bin."""
    need_finite(shape, "hist")
    if bins < 1:
        raise InsufficientDataError("no_of_bins has to be 1 or more")
    counts = bin_counts(scored, shape.lowest, shape.highest, bins)
    swept = running(counts, ["bin"], ["neg", "pos"], bins)
    correct = F.col("cum_neg") + F.lit(shape.positives) - F.col("cum_pos")
    best = swept.agg(F.max(F.struct(correct.alias("correct"), (-F.col("bin")).alias("back"))).alias("best")).first().best
    if shape.positives >= best.correct:
        found = (shape.below, shape.positives)
    else:
        found = (bin_edge(-best.back, shape.lowest, shape.highest, bins), best.correct)
    return answer(scored.sparkSession.createDataFrame([found], "threshold double, correct long"), shape.rows)


def linear(scored: DataFrame, shape: Shape, bins: Bins | None = None) -> DataFrame:
    """The best midpoint of neighbours in the sorted rows, duplicates included.

    A score that repeats is its own midpoint; from the counts that is known without
    trying candidates one by one. The first in sorted order wins ties. After a survey,
    scores are counted where one of its ``bins`` may hold the best midpoint.
    """
    if shape.rows < 2:
        raise InsufficientDataError("ls needs two rows at least")
    if bins is None:
        each = curve(scored, shape)
    else:
        counts, most = narrowed(scored, shape, bins, outside=False)
        each = curve_of(counts, shape.positives, most, "first")
    several = F.col("neg") + F.col("pos") > 1
    cut = F.when(several, F.col("score")).otherwise(midpoint_of(F.col("score"), F.col("next_score")))
    each = each.where(several | F.col("next_score").isNotNull())
    each = each.select("correct", (-F.col("score")).alias("back"), cut.alias("threshold"))
    best = each.agg(F.max(F.struct("correct", "back", "threshold")).alias("best")).select("best.threshold", "best.correct")
    return answer(best, shape.rows)


def grid_tallies(scored: DataFrame, shape: Shape, places: int = 2) -> DataFrame:
    """``(pos, threshold, correct)`` of the even grid, then of the float below it."""
    need_finite(shape, "grid")
    spark = scored.sparkSession
    steps = 10**places if shape.highest > shape.lowest else 1
    points = spark.range(steps + 1 if shape.highest > shape.lowest else 1).select(F.col("id").alias("bucket"))
    counts = grid_counts(scored, shape.lowest, shape.highest, steps)
    wide = points.join(counts, "bucket", "left").na.fill(0, ["neg", "pos"])
    swept = running(wide, ["bucket"], ["neg", "pos"], steps + 1)
    inside = swept.select(
        F.col("bucket").alias("pos"),
        grid_value(F.col("bucket"), shape.lowest, shape.highest, steps).alias("threshold")
        if shape.highest > shape.lowest
        else F.lit(shape.lowest).alias("threshold"),
        (F.col("cum_neg") + F.lit(shape.positives) - F.col("cum_pos")).alias("correct"),
    )
    last = [(steps + 1 if shape.highest > shape.lowest else 1, shape.below, shape.positives)]
    return inside.unionByName(spark.createDataFrame(last, "pos long, threshold double, correct long"))


def grid(scored: DataFrame, shape: Shape, places: int = 2) -> DataFrame:
    """The best point of the grid; the first wins ties."""
    return answer(first_best(grid_tallies(scored, shape, places)), shape.rows)
