"""From an algorithm and its parameters to the plan that answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import report
from ..errors import AlgorithmNotWiredError
from ..operators import sampling, search
from ..operators.narrow import Bins, survey
from ..operators.profile import Shape, admit
from ..registry import Algorithm


def solve(
    scored: DataFrame, algorithm: Algorithm, params: Mapping[str, Any], seed: int | None = None, labels: Sequence[Any] | None = None
) -> DataFrame:
    """One row, ``(threshold, correct, rows, accuracy)``, or a refusal of the rows."""
    bins: Bins | None = None
    if algorithm.id in ("exact", "ls"):
        shape, bins = survey(scored, labels)
    else:
        shape = admit(scored, labels)
    return _search(scored, shape, bins, algorithm, params, seed)


def _search(
    scored: DataFrame, shape: Shape, bins: Bins | None, algorithm: Algorithm, params: Mapping[str, Any], seed: int | None
) -> DataFrame:
    if shape.rows > algorithm.data_vol_thresh:
        report.say(
            "warning", "%d rows are more than the %d that %s is quick for", shape.rows, algorithm.data_vol_thresh, algorithm.id
        )
    report.say("info", "searching %d rows by %s", shape.rows, algorithm.full_name)
    rows = scored.select("score", "y")
    if algorithm.id == "exact":
        return search.exact_narrowed(rows, shape, bins)
    if algorithm.id == "hist":
        return search.hist(rows, shape, params["no_of_bins"])
    if algorithm.id == "ls":
        return search.linear(rows, shape, bins)
    if algorithm.id == "grid":
        return search.grid(rows, shape, params["no_of_decimal_places"])
    if algorithm.id == "sgrid":
        found = sampling.sgrid(rows, shape, params["no_of_decimal_places"], params["stoch_ratio"], params["reshuffle"], seed)
        return search.answer(found, shape.rows)
    if algorithm.id == "gen":
        found = sampling.genetic(rows, shape, dict(params), seed)
    elif algorithm.id == "sgd":
        found = sampling.descend(rows, shape, dict(params), seed)
    else:
        raise AlgorithmNotWiredError(f"{algorithm.id} has no plan")
    best = scored.sparkSession.createDataFrame([found], "threshold double, correct long")
    return search.answer(best, shape.rows)


def threshold_of(result: DataFrame) -> float:
    """The answer as a Python float."""
    return float(result.select(F.col("threshold")).first()[0])
