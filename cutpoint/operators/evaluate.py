"""What a given cut-off does, and what the best one could do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import midpoint_of, predict
from ..plans.running import running
from .narrow import narrowed, survey
from .profile import Shape
from .search import curve, curve_of


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """``(score, y, predicted)`` by the rule: positive if above."""
    return scored.select("score", "y", predict(F.col("score"), threshold).alias("predicted"))


def accuracy(scored: DataFrame, threshold: float, miss: bool = False) -> DataFrame:
    """One row: rows, correct, accuracy; ``miss`` gives the share of wrong rows instead."""
    right = predict(F.col("score"), threshold) == F.col("y")
    out = scored.agg(F.count("*").alias("rows"), F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("correct"))
    share = F.col("correct") / F.nullif(F.col("rows"), F.lit(0))
    return out.withColumn("accuracy", 1 - share if miss else share)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn."""
    up = F.col("score") > F.lit(float(threshold))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    pos = F.col("y") == 1
    return scored.agg(count(up & pos).alias("tp"), count(up & ~pos).alias("fp"), count(~up & ~pos).alias("tn"), count(~up & pos).alias("fn"))


def threshold_curve(scored: DataFrame, shape: Shape) -> DataFrame:
    """``(score, cum_neg, cum_pos, correct, accuracy)`` of a cut at each distinct score."""
    return curve(scored, shape).select(
        "score", "cum_neg", "cum_pos", "correct", (F.col("correct") / F.lit(shape.rows)).alias("accuracy")
    )


def ceiling(scored: DataFrame, shape: Shape) -> DataFrame:
    """One row: the most rows any cut gets right, and their share."""
    counts, most = narrowed(scored, shape, survey(scored)[1])  # scores are counted where the best cut may be
    best = curve_of(counts, shape.positives, most, "first").agg(F.max("correct").alias("correct"))
    best = best.select(F.greatest("correct", F.lit(shape.positives)).alias("correct"))
    return best.withColumn("accuracy", F.col("correct") / F.lit(shape.rows))


def class_means(scored: DataFrame) -> DataFrame:
    """One row: neg_mean, pos_mean and all_mean; NaN for a class without rows."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(float("nan")))
    return scored.agg(
        mean(F.when(F.col("y") == -1, F.col("score"))).alias("neg_mean"),
        mean(F.when(F.col("y") == 1, F.col("score"))).alias("pos_mean"),
        mean(F.col("score")).alias("all_mean"),
    )


def pairwise(scored: DataFrame, shape: Shape) -> DataFrame:
    """Neighbouring distinct scores with the cut between them: (score, next_score, middle)."""
    pairs = curve(scored, shape).where("next_score is not null")
    return pairs.select("score", "next_score", midpoint_of(F.col("score"), F.col("next_score")).alias("middle"))


def exact_by(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Extension: the exact search for each group of ``keys`` in one plan.

    ``df`` holds the keys with score and y. Where all-positive is strictly better, threshold
    is null and all_positive true: the cut lies below the group's lowest score.

    All groups share one order, by keys and score, so a group of any size is dealt to many
    tasks: within a group, sums over all that stands before differ by a constant from those
    over the group, and a neighbour of other keys is none. ``rows`` bounds the distinct
    scores of all groups, if that is known to be few.
    """
    counts = df.groupBy(*keys, "score").agg(
        F.sum((F.col("y") == -1).cast("long")).alias("neg"), F.sum((F.col("y") == 1).cast("long")).alias("pos")
    )
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    counts = counts.withColumn("place", F.struct(group.alias("group"), "score"))
    swept = running(counts, [*keys, "score"], ["neg", "pos"], rows, lead="place")
    after = F.when(F.col("next_place.group").eqNullSafe(F.col("place.group")), F.col("next_place.score"))
    swept = swept.withColumn("after", after)
    cut = F.when(F.col("after").isNull(), F.col("score")).otherwise(midpoint_of(F.col("score"), F.col("after")))
    found = F.struct((F.col("cum_neg") - F.col("cum_pos")).alias("gain"), (-F.col("score")).alias("back"), cut.alias("cut"))
    best = swept.groupBy(*keys).agg(
        F.max(found).alias("best"),
        F.sum("pos").alias("all_pos"),
        (F.min(F.col("cum_neg") - F.col("neg")) - F.min(F.col("cum_pos") - F.col("pos"))).alias("before"),
    )
    correct = F.col("best.gain") - F.col("before") + F.col("all_pos")
    all_positive = F.col("all_pos") > correct
    return best.select(
        *keys,
        F.when(all_positive, F.lit(None).cast("double")).otherwise(F.col("best.cut")).alias("threshold"),
        all_positive.alias("all_positive"),
        F.greatest("all_pos", correct).alias("correct"),
    )
