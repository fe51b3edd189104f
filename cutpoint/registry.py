"""The seven algorithms: names, sizes they are comfortable with, parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .errors import ConfigurationError, InsufficientDataError, UnknownAlgorithmError


@dataclass(frozen=True)
class Algorithm:
    """``data_vol_thresh`` is advice: above it a run warns, and goes on."""

    id: str
    full_name: str
    synonyms: tuple[str, ...]
    data_vol_thresh: int
    defaults: Mapping[str, Any] = field(default_factory=dict)


# Identifiers, synonyms, sizes and parameter defaults of the public interface.
ALGORITHMS = (
    Algorithm(
        "exact", "Exact sweep", ("sweep", "exact_sweep", "sorted_sweep", "auto", "default", "default_heuristics"), 10_000_000
    ),
    Algorithm("hist", "Histogram sweep", ("histogram", "binned", "bins"), 50_000_000, {"no_of_bins": 1024}),
    Algorithm("ls", "Linear search", ("linear", "linear_search"), 10_000, {"n_jobs": 1}),
    Algorithm(
        "sgd",
        "Stochastic gradient descent",
        ("curve_fitting",),
        2_000_000,
        {"num_of_iters": 200, "stop_thresh": 0.001, "stop_patience": 3, "alpha": 0.01, "stoch_ratio": 0.05, "step_ratio": 0.05},
    ),
    Algorithm(
        "gen",
        "Genetic search",
        ("genetic", "sim"),
        100_000,
        {
            "population_size": 30, "number_of_generations": 20, "number_of_iterations": 10, "sus_factor": 2,
            "stoch_ratio": 0.02, "mutation_chance": 0.05, "mutation_factor": 0.10,
        },
    ),
    Algorithm("grid", "Grid search", ("grid-search", "gs"), 1_000_000, {"no_of_decimal_places": 2}),
    Algorithm(
        "sgrid",
        "Stochastic grid search",
        ("random-grid-search", "rn-grid", "s-grid"),
        10_000_000,
        {"no_of_decimal_places": 2, "stoch_ratio": 0.05, "reshuffle": False},
    ),
)
DEFAULT = ALGORITHMS[0]
#: The default where rows come as a DataFrame: its result is small whatever the data.
FRAME_DEFAULT = ALGORITHMS[1]


def by_name(name: Any) -> Algorithm:
    """The algorithm of an id, or else of a synonym, in any case."""
    if isinstance(name, Algorithm):
        return name
    if isinstance(name, str):
        low = name.lower()
        for found in (lambda a: a.id == low), (lambda a: low in a.synonyms):
            for a in ALGORITHMS:
                if found(a):
                    return a
    raise UnknownAlgorithmError(name, [a.id for a in ALGORITHMS])


def _count(name: str, value: Any, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigurationError(f"{name} has to be a whole number of at least {least}, not {value!r}")
    return value


def jobs(value: Any) -> int | None:
    """Validate a worker count: None is all, -1 all but one, else 1 or more. Spark decides."""
    if value is None or value == -1 and not isinstance(value, bool):
        return value
    return _count("n_jobs", value)


def resolve_params(algorithm: Algorithm, given: Any) -> dict[str, Any]:
    """Defaults under the caller's values; a key that the algorithm does not read is refused."""
    if not isinstance(given, Mapping):
        raise ConfigurationError(f"algorithm_params has to be a mapping, not {type(given).__name__}")
    if odd := sorted(map(str, set(given) - set(algorithm.defaults))):
        reads = ", ".join(algorithm.defaults) or "none: there is nothing to tune"
        raise ConfigurationError(f"{algorithm.id} does not read {', '.join(odd)}; it reads {reads}")
    params = {**algorithm.defaults, **given}
    if "no_of_bins" in params and (not isinstance(params["no_of_bins"], int) or params["no_of_bins"] < 1):
        raise InsufficientDataError("no_of_bins has to be 1 or more")
    if algorithm.id == "gen":
        for name in ("population_size", "number_of_generations", "number_of_iterations"):
            _count(name, params[name])
        _count("sus_factor", params["sus_factor"])
        if params["sus_factor"] >= params["population_size"]:
            raise ConfigurationError("sus_factor has to leave some agents to breed from")
    if "n_jobs" in params:
        jobs(params["n_jobs"])
    return params
