"""Everything this package raises. Each class is also the builtin a caller would expect."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any


class CutpointError(Exception):
    """Root of all errors of this package."""


class ConfigurationError(CutpointError, ValueError):
    """An option or parameter that cannot be used."""


class _UnknownName(ConfigurationError):
    what = "name"

    def __init__(self, name: Any, available: Iterable[str]) -> None:
        self.name, self.available = name, tuple(available)
        super().__init__(f"no {self.what} is called {name!r}; there are {', '.join(self.available)}")


class UnknownAlgorithmError(_UnknownName):
    what = "algorithm"


class UnknownBackendError(_UnknownName):
    what = "backend"


class InvalidInputError(CutpointError, ValueError):
    """Rows that no cut-off can be found for."""


class EmptyInputError(InvalidInputError):
    def __init__(self) -> None:
        super().__init__("there are no rows")


class LengthMismatchError(InvalidInputError):
    def __init__(self, score_count: int, class_count: int) -> None:
        self.score_count, self.class_count = score_count, class_count
        super().__init__(f"{score_count} scores stand against {class_count} classes")


class _Counted(InvalidInputError):
    text = ""

    def __init__(self, count: int) -> None:
        self.count = count
        super().__init__(self.text.format(count))


class MissingLabelsError(_Counted):
    text = "{} rows have no class"


class UndefinedScoresError(_Counted):
    text = "{} rows have no score, or one that is not a number"


class UnexpectedLabelsError(InvalidInputError):
    def __init__(self, unexpected: Iterable[Any]) -> None:
        self.unexpected = list(unexpected)
        super().__init__(f"classes other than the two declared ones: {self.unexpected!r}")


class SingleClassError(InvalidInputError):
    def __init__(self, only: Any) -> None:
        self.only = only
        super().__init__(f"every row is of class {only!r}, so nothing can be told apart")


class InsufficientDataError(InvalidInputError):
    """Too few rows, bins or finite scores for the chosen algorithm."""


class LabelMappingError(CutpointError, TypeError):
    """``labels`` is not a pair."""


class NotIterableError(CutpointError, AttributeError):
    def __init__(self, attribute: str) -> None:
        self.attribute = attribute
        super().__init__(f"{attribute} cannot be iterated over")


class BackendDependencyError(CutpointError, ImportError):
    """A backend needs something that is not installed."""


class ParallelBootstrapError(CutpointError, RuntimeError):
    """Workers could not be started."""


class AlgorithmNotWiredError(CutpointError, NotImplementedError):
    """A registered algorithm without a plan."""


class ShardMergeError(CutpointError, ValueError):
    """Partial results that do not fit together."""
