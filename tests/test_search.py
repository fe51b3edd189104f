import math
import random
from types import SimpleNamespace

import numpy as np
import pytest

from cutpoint import FrameCutpoint
from cutpoint.errors import ConfigurationError
from cutpoint.functions.columns import grid_bucket, grid_values
from cutpoint.operators import counts, evaluate, search
from cutpoint.operators.profile import admit
from cutpoint.plans import running
from cutpoint.sources.frames import scored

from . import brute


def frame(spark, rows):
    return spark.createDataFrame([(float(s), y) for s, y in rows], "score double, label int").repartition(3)


def awkward(seed):
    rng = random.Random(seed)
    places = rng.choice([1, 2, 3])
    rows = [(round(rng.random(), places), rng.choice([-1, 1])) for _ in range(rng.randint(2, 40))]
    return [*rows, (0.5, 1), (0.4, -1)]


def solve(spark, rows, algorithm, **params):
    return FrameCutpoint(algorithm, params, seed=1).solve(frame(spark, rows)).first()


@pytest.mark.parametrize("seed", range(8))
def test_every_full_search_equals_brute_force(spark, seed):
    rows = awkward(seed)
    got = solve(spark, rows, "exact")
    assert (got.threshold, got.correct) == (t := brute.exact(rows), brute.right(rows, t))
    got = solve(spark, rows, "ls")
    assert got.threshold == pytest.approx(brute.linear(rows), abs=0) or got.correct == brute.right(rows, brute.linear(rows))
    best, cuts = brute.grid(rows, 1)
    got = solve(spark, rows, "grid", no_of_decimal_places=1)
    assert (got.threshold, got.correct) == (best, brute.right(rows, best))
    k, correct, at = brute.hist(rows, 7)
    got = solve(spark, rows, "hist", no_of_bins=7)
    assert got.correct == correct == brute.right(rows, got.threshold)
    if k is not None:
        assert at(got.threshold) <= k and (got.threshold == max(s for s, _ in rows) or at(math.nextafter(got.threshold, 2)) > k)


def test_two_level_sums_equal_one_window(spark):
    rows = [(random.Random(i).random() // 0.001, 1 if i % 3 else -1) for i in range(3000)]
    data = scored(frame(spark, rows))
    shape = admit(data)
    one, two = (search.exact(data, shape, one_task=b).first() for b in (True, False))
    assert one == two
    assert one.threshold == brute.exact(rows)


# fixed values: small cases with known answers
KNOWN = [
    ([0.1, 0.3, 0.4, 0.7], [-1, -1, 1, 1], 0.35),
    ([0.1, math.inf, 0.6, 0.9], [-1, 1, 1, -1], 0.35),
    ([0.1, 0.2, 0.3], [1, 1, -1], math.nextafter(0.1, -math.inf)),
    ([0.5] * 6, [-1, 1] * 3, 0.5),
    ([1, 2, 6, 9], [-1, -1, 1, 1], 4.0),
    ([-math.inf, math.inf], [-1, 1], -math.inf),
    ([1e308, 1.7e308], [-1, 1], 1e308 / 2 + 1.7e308 / 2),
    ([1.0, math.nextafter(1.0, 2)], [-1, 1], 1.0),
]


@pytest.mark.parametrize(("scores", "classes", "expected"), KNOWN)
def test_known_answers(spark, scores, classes, expected):
    got = solve(spark, list(zip(scores, classes)), "exact")
    assert got.threshold == expected


def test_hist_known(spark):
    scores = [0, 0.1, 0.3, 0.35, 0.6, 0.62, 0.8, 1]
    classes = [-1, -1, 1, -1, 1, -1, 1, 1]
    found = solve(spark, list(zip(scores, classes)), "hist", no_of_bins=4)
    assert (found.correct, found.threshold) == (6, pytest.approx(0.25))  # every inner edge gets six


def test_grid_bucket_is_exact_at_edges(spark):
    low, high, steps = 0.1, 0.7, 100
    cuts = grid_values(low, high, steps)[:-1]
    values = [v for c in cuts for v in (c, math.nextafter(c, 1), math.nextafter(c, 0))]
    values = [v for v in values if low <= v <= high]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    got = df.select("score", grid_bucket(df.score, low, high, steps).alias("b")).collect()
    assert all(r.b == sum(c < r.score for c in cuts) for r in got)


def test_tally_keeps_order_and_repeats(spark):
    rows = awkward(3)
    data = scored(frame(spark, rows))
    cuts = [0.5, 2.0, -1.0, 0.5, 0.123]
    for n in (len(rows), None):
        got = counts.tally(data, cuts, n).orderBy("pos").collect()
        assert [(r.threshold, r.correct) for r in got] == [(c, brute.right(rows, c)) for c in cuts]


@pytest.mark.parametrize("one_task", [True, False])
def test_candidates_from_a_table(spark, monkeypatch, one_task):
    """A million candidates, repeated and undefined ones among them, without a list of them."""
    rows = awkward(4)
    data = scored(frame(spark, rows))
    table = spark.range(1_000_000 if not one_task else 500).selectExpr("id AS pos", "(id % 250007) / 100000.0 AS threshold")
    odd = spark.createDataFrame([(-1, None), (-2, math.nan), (-3, math.inf)], "pos long, threshold double")
    got = counts.tally(data, table.unionByName(odd), len(rows) + 503 if one_task else None)
    wanted = got.where("pos < 0 or pos % 99991 = 7").collect()
    assert {r.pos: r.correct for r in wanted} == {r.pos: brute.right(rows, r.threshold) for r in wanted}
    assert {r.pos for r in wanted if r.pos < 0} == {-3} and got.count() == (501 if one_task else 1_000_001)


def test_evaluation(spark):
    rows = awkward(5)
    data = scored(frame(spark, rows))
    shape = admit(data)
    assert evaluate.accuracy(data, 0.5).first().correct == brute.right(rows, 0.5)
    c = evaluate.confusion(data, 0.5).first()
    assert c.tp + c.tn == brute.right(rows, 0.5) and sum(c) == len(rows)
    assert evaluate.ceiling(data, shape).first().correct == brute.right(rows, brute.exact(rows))
    means = evaluate.class_means(data).first()
    assert means.pos_mean == pytest.approx(sum(s for s, y in rows if y == 1) / sum(y == 1 for _, y in rows))
    assert evaluate.threshold_curve(data, shape).count() == len({s for s, _ in rows})


def test_by_group_equals_group_alone(spark):
    groups = {g: awkward(g) for g in range(4)}
    df = spark.createDataFrame([(g, float(s), y) for g, rows in groups.items() for s, y in rows], "g int, score double, y int")
    for r in evaluate.exact_by(df, ["g"]).collect():
        best = brute.exact(groups[r.g])
        assert r.correct == brute.right(groups[r.g], best)
        assert r.all_positive or r.threshold == best


def test_metamorphic_scale(spark):
    rows = awkward(7)
    a = solve(spark, rows, "exact").threshold
    b = solve(spark, [(s * 1024, y) for s, y in rows], "exact").threshold
    assert b == a * 1024 or b == math.nextafter(a * 1024, b)


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, other: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ConfigurationError, match="spark.checkpoint.dir"):
        running.shared_dir(far)


def test_groups_in_one_order_equal_groups_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), None if g == 2 else g, float(s), int(y)) for g in range(4) for s, y in zip(rng.integers(0, 9, 60), rng.choice([-1, 1], 60, p=[0.2, 0.8] if g == 1 else [0.5, 0.5]))]
    df = spark.createDataFrame(rows, "a string, b int, score double, y int")
    got = {r.a: r for r in evaluate.exact_by(df, ["a", "b"]).collect()}
    assert got == {r.a: r for r in evaluate.exact_by(df, ["a", "b"], rows=len(rows)).collect()}
    for g in map(str, range(4)):
        own = scored(df.where(df.a == g), "score", "y")
        best = search.exact(own, admit(own)).first()
        assert got[g].correct == best.correct and (got[g].all_positive or got[g].threshold == best.threshold)


def test_ceiling_sweeps_few_of_the_scores(spark, monkeypatch):
    """F1: the most that any cut gets right was found by sorting all distinct scores."""
    rows = [(i / 4000, 1 if (i > 2000) != (i % 7 == 0) else -1) for i in range(4000)]
    data = scored(spark.createDataFrame(rows, "score double, label int"))
    swept, sweep = [], search.running
    monkeypatch.setattr(search, "running", lambda df, *a, **k: swept.append(df.count()) or sweep(df, *a, **k))
    assert evaluate.ceiling(data, admit(data)).first().correct == brute.right(rows, brute.exact(rows))
    assert sum(swept) < 1000
