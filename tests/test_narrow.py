import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutpoint import FrameCutpoint, errors
from cutpoint.operators import narrow, search
from cutpoint.operators.profile import admit
from cutpoint.queries import SOURCES, source
from cutpoint.sources.frames import scored

from . import brute


def frame(spark, rows):
    return scored(spark.createDataFrame([(float(s), int(y)) for s, y in rows], "score double, label int").repartition(3))


def line(seed):
    """Scores of very different spread, with ties, zeros of both signs and very large ones."""
    rng = random.Random(seed)
    kinds = [
        lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), lambda: rng.gauss(0, 1), lambda: 1 + rng.random() * 1e-9,
        lambda: rng.choice([0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf]), lambda: rng.randint(-3, 3),
    ]
    some = rng.sample(kinds, rng.randint(1, 5))
    lean = rng.random()
    rows = [(rng.choice(some)(), rng.choice([-1, 1])) for _ in range(rng.randint(2, 400))]
    rows = [(s, 1 if (s > 0.3) ^ (rng.random() < lean / 3) else -1) if seed % 3 else (s, y) for s, y in rows]
    return [*rows, (0.5, 1), (0.25, -1)]


@pytest.mark.parametrize("seed", range(12))
def test_narrowed_searches_equal_whole_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(narrow, "FEW", 3)
    if seed % 2:
        monkeypatch.setattr(narrow, "PER_OCTAVE", 1)
        monkeypatch.setattr(narrow, "AGAIN", 4)
        monkeypatch.setattr(narrow, "STRETCHES", 2)
    data = frame(spark, line(seed))
    shape, bins = narrow.survey(data)
    assert shape == admit(data)
    assert bins.neg.sum() + bins.pos.sum() == shape.rows and (bins.last[:-1] < bins.first[1:]).all()
    assert search.exact_narrowed(data, shape, bins).first() == search.exact(data, shape).first()
    assert search.linear(data, shape, bins).first() == search.linear(data, shape).first()


def test_line_bins_never_fall(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=2000), 10 ** rng.uniform(-320, 308, 2000), -(10 ** rng.uniform(-320, 308, 2000)), 2.0 ** np.arange(-1074, 1024)])
    values = np.concatenate([values, np.nextafter(values, np.inf), np.nextafter(values, -np.inf), [np.inf, -np.inf, 0.0, -0.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    got = sorted((r.score, r.bin) for r in df.select("score", narrow.line_bin(F.col("score")).alias("bin")).collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    assert max(abs(b) for _, b in got) <= 2105 * narrow.PER_OCTAVE


@pytest.mark.parametrize("name", sorted({*SOURCES, "docs01"} - {"gaps", "eighths", "bad3"}))
def test_few_scores_of_the_sources_are_counted(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(narrow, "FEW", 0)
    df, labels = source(spark, sf_dir, name)
    data = scored(df, labels=labels)
    shape, bins = narrow.survey(data, labels)
    counts, most = narrow.narrowed(data, shape, bins)
    assert search.exact_narrowed(data, shape, bins).first() == search.exact(data, shape).first()
    if name not in ("words", "docs01"):  # noise, where any score may win, and few rows
        assert most < 0.05 * shape.rows + 700


def test_close_scores_are_looked_at_again(spark, monkeypatch):
    """All scores in one bin of the line."""
    monkeypatch.setattr(narrow, "FEW", 10)
    rng = np.random.default_rng(3)
    s = 1 + rng.random(4000) * 1e-7
    rows = [(x, 1 if (x > 1 + 6e-8) ^ (rng.random() < 0.1) else -1) for x in s.tolist()]
    data = frame(spark, rows)
    shape, bins = narrow.survey(data)
    assert len(bins.first) == 1
    _, most = narrow.narrowed(data, shape, bins)
    assert most < 1500
    assert search.exact_narrowed(data, shape, bins).first().threshold == brute.exact(rows)


def test_refusals_are_those_of_the_profile(spark):
    def refused(algorithm, rows):
        with pytest.raises(errors.InvalidInputError) as e:
            FrameCutpoint(algorithm).solve(spark.createDataFrame(rows, "score double, label int"))
        return type(e.value), vars(e.value)

    for rows in ([], [(None, 1), (math.nan, None), (1.0, 3)], [(1.0, None), (2.0, 7)], [(1.0, 7), (2.0, 7), (3.0, 1)], [(1.0, 1), (2.0, 1)]):
        assert refused("exact", rows) == refused("ls", rows) == refused("hist", rows)


def test_answers_come_from_one_scan(spark, sf_dir):
    df, labels = source(spark, sf_dir, "noisy")
    for algorithm in ("exact", "ls"):
        plan = FrameCutpoint(algorithm, labels=labels).solve(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "PushedFilters: [" in plan
