"""Scalar expressions over scores and labels. All stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LabelMappingError


def check_labels(labels: Any) -> tuple[Any, Any]:
    """A pair of class labels, negative first; (-1, 1) for None."""
    if labels is None:
        return -1, 1
    if not isinstance(labels, list | tuple) or len(labels) != 2:
        raise LabelMappingError("labels has to be a list or tuple of two values, negative class first")
    return labels[0], labels[1]


def is_label(column: Column, kind: T.DataType, value: Any) -> Column:
    """Whether a label equals ``value``, without casts that ANSI mode would refuse."""
    if isinstance(kind, T.StringType):
        return column == F.lit(str(value))
    if isinstance(value, str):
        return column.cast("string") == F.lit(value)
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        return column.cast("int") == F.lit(value)
    return column == F.lit(value)


def undefined_score(column: Column) -> Column:
    """Null, or not a number."""
    return column.isNull() | F.isnan(column.cast("double"))


def missing_label(column: Column, kind: T.DataType) -> Column:
    """Null, or NaN where the column can hold it."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def map_labels(df: DataFrame, label_col: str = "label", labels: Sequence[Any] | None = None) -> Column:
    """-1 for the negative label, 1 for the positive one, null for any other."""
    neg, pos = check_labels(labels)
    kind = df.schema[label_col].dataType
    at = F.col(label_col)
    return F.when(is_label(at, kind, neg), -1).when(is_label(at, kind, pos), 1)


def predict(score: Column, threshold: Column | float) -> Column:
    """1 above the threshold, -1 on it or below."""
    return F.when(score > (threshold if isinstance(threshold, Column) else F.lit(float(threshold))), 1).otherwise(-1)


def granular(score: Column, places: int) -> Column:
    """Rounded half-even, in decimal arithmetic, to so many places."""
    return F.bround(score.cast("double"), places)


def bin_of(score: Column, lowest: float, highest: float, bins: int) -> Column:
    """Number of the equal-width bin of a score; the highest score is in the last bin."""
    if highest == lowest:
        return F.lit(0).cast("long")
    share = (score - F.lit(lowest)) / F.lit(highest - lowest)
    return F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1).cast("long"))


def bin_of_value(value: float, lowest: float, highest: float, bins: int) -> int:
    """``bin_of`` for one Python float, in the same order of operations."""
    if highest == lowest:
        return 0
    return min(math.floor((value - lowest) / (highest - lowest) * bins), bins - 1)


def grid_value(at: Column, lowest: float, highest: float, steps: int) -> Column:
    """The ``at``-th of ``steps + 1`` even points; the last is ``highest`` itself."""
    step = (highest - lowest) / steps
    return F.when(at >= steps, F.lit(highest)).otherwise(at.cast("double") * F.lit(step) + F.lit(lowest))


def grid_values(lowest: float, highest: float, steps: int) -> list[float]:
    """The points of ``grid_value``, then the float below ``lowest``."""
    below = math.nextafter(lowest, -math.inf)
    if lowest == highest:
        return [lowest, below]
    step = (highest - lowest) / steps
    return [i * step + lowest for i in range(steps)] + [highest, below]


def grid_bucket(score: Column, lowest: float, highest: float, steps: int) -> Column:
    """How many grid points are below a score: an estimate, put right by its neighbours."""
    step = (highest - lowest) / steps
    near = F.floor((score - F.lit(lowest)) / F.lit(step)).cast("long") if step > 0 else F.lit(0).cast("long")
    near = F.greatest(F.lit(1).cast("long"), F.least(near, F.lit(steps - 1).cast("long")))
    out = near - 1
    for d in (-1, 0, 1):
        out = out + (grid_value(near + d, lowest, highest, steps) < score).cast("long")
    return out


def midpoint(a: float, b: float) -> float:
    """A value from ``a`` up to below ``b``, halfway where floats allow it."""
    middle = (a + b) / 2
    if math.isinf(middle) and not (math.isinf(a) or math.isinf(b)):
        middle = a / 2 + b / 2
    return a if math.isnan(middle) or middle >= b else middle


def midpoint_of(a: Column, b: Column) -> Column:
    """``midpoint`` as an expression."""
    middle = (a + b) / 2
    large = F.abs(middle) == float("inf")
    middle = F.when(large & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), a / 2 + b / 2).otherwise(middle)
    return F.when(F.isnan(middle) | (middle >= b), a).otherwise(middle)
