"""Scored rows from DataFrames and from anything in memory."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import (
    EmptyInputError,
    LengthMismatchError,
    MissingLabelsError,
    NotIterableError,
    SingleClassError,
    UndefinedScoresError,
    UnexpectedLabelsError,
)
from ..functions.columns import check_labels, map_labels, missing_label


def scored(df: DataFrame, score_col: str = "score", label_col: str = "label", labels: Sequence[Any] | None = None) -> DataFrame:
    """``(score double, y int, label, missing)``: only two columns are read.

    y is -1 or 1, and null for a label that is missing or of neither class.
    """
    kind = df.schema[label_col].dataType
    return df.select(
        F.col(score_col).cast("double").alias("score"),
        map_labels(df, label_col, labels).alias("y"),
        F.col(label_col).alias("label"),
        missing_label(F.col(label_col), kind).alias("missing"),
    )


def as_list(values: Any, name: str) -> Sequence[Any] | np.ndarray:
    """Values by position: arrays and Series as the array below them, mappings by their keys."""
    if callable(plain := getattr(values, "to_numpy", None)):
        values = plain()
    if isinstance(values, list | np.ndarray):
        return values
    if not isinstance(values, Iterable) and not hasattr(values, "__getitem__"):
        raise NotIterableError(name)
    return list(values)


def from_memory(
    spark: SparkSession, scores: Any, classes: Any, labels: Sequence[Any] | None = None
) -> DataFrame:
    """``scored`` rows of two parallel sequences, refused here if they cannot be used.

    Checked in this order: lengths, undefined scores, no rows, missing classes, classes
    other than the pair, one class only. Columns go to Spark as Arrow arrays.
    """
    left, right = pd.Series(as_list(scores, "scores")), pd.Series(as_list(classes, "actual_classes"))
    neg, pos = check_labels(labels)
    if len(left) != len(right):
        raise LengthMismatchError(len(left), len(right))
    if bad := int(left.isna().sum()):
        raise UndefinedScoresError(bad)
    if left.empty:
        raise EmptyInputError
    if missing := int(right.isna().sum()):
        raise MissingLabelsError(missing)
    y = np.where(right == neg, -1, np.where(right == pos, 1, 0)).astype(np.int32)
    if not y.all():
        raise UnexpectedLabelsError(right[y == 0].drop_duplicates().head(5).tolist())
    if (y == y[0]).all():
        raise SingleClassError(neg if y[0] < 0 else pos)
    columns = {"score": left.to_numpy(np.float64), "y": y, "label": y, "missing": np.zeros(len(y), bool)}
    return spark.createDataFrame(pa.table(columns))
