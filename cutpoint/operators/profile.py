"""One pass over the rows: what is there, and whether it can be used."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import (
    EmptyInputError,
    InsufficientDataError,
    MissingLabelsError,
    SingleClassError,
    UndefinedScoresError,
    UnexpectedLabelsError,
)
from ..functions.columns import check_labels, undefined_score

#: Unexpected labels that an error names.
NAMED = 5


def profile(scored: DataFrame) -> DataFrame:
    """One row: rows, positives, negatives, bad_scores, null_labels, lowest, highest."""
    ones = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    good = F.when(~undefined_score(F.col("score")), F.col("score"))
    return scored.agg(
        F.count("*").alias("rows"),
        ones(F.coalesce(F.col("y") == 1, F.lit(False))).alias("positives"),
        ones(F.coalesce(F.col("y") == -1, F.lit(False))).alias("negatives"),
        ones(undefined_score(F.col("score"))).alias("bad_scores"),
        ones(F.col("missing")).alias("null_labels"),
        F.min(good).alias("lowest"),
        F.max(good).alias("highest"),
    )


def unexpected_labels(scored: DataFrame) -> DataFrame:
    """Distinct labels of neither class; missing ones are not among them."""
    return scored.where("y is null and not missing").select("label").distinct()


@dataclass(frozen=True)
class Shape:
    """A profile that passed."""

    rows: int
    positives: int
    negatives: int
    lowest: float
    highest: float

    @property
    def below(self) -> float:
        """The float below the lowest score: a cut-off that makes every row positive."""
        return math.nextafter(self.lowest, -math.inf)


def admit(scored: DataFrame, labels: Sequence[Any] | None = None) -> Shape:
    """The profile of the rows, or a refusal."""
    row = profile(scored).first()
    shape = Shape(row.rows, row.positives, row.negatives, row.lowest, row.highest)
    return refuse(scored, shape, row.bad_scores, row.null_labels, labels)


def refuse(scored: DataFrame, shape: Shape, bad_scores: int, null_labels: int, labels: Sequence[Any] | None = None) -> Shape:
    """``shape``, unless its rows cannot be used. Refused are, in this order: no rows,
    undefined scores, missing labels, labels of neither class, one class only."""
    if not shape.rows:
        raise EmptyInputError
    if bad_scores:
        raise UndefinedScoresError(bad_scores)
    if null_labels:
        raise MissingLabelsError(null_labels)
    if shape.positives + shape.negatives < shape.rows:
        raise UnexpectedLabelsError([r.label for r in unexpected_labels(scored).limit(NAMED).collect()])
    if not shape.positives or not shape.negatives:
        raise SingleClassError(check_labels(labels)[bool(shape.positives)])
    return shape


def need_finite(shape: Shape, what: str) -> None:
    """Refuse infinite scores where a finite span is needed."""
    if math.isinf(shape.lowest) or math.isinf(shape.highest):
        raise InsufficientDataError(f"{what} needs finite scores; exact and ls do not")
