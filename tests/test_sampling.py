import math
from collections import Counter

import numpy as np
import pytest

from cutpoint import FrameCutpoint
from cutpoint.errors import ConfigurationError
from cutpoint.operators import counts, draws, evaluate, sampling
from cutpoint.operators.profile import admit
from cutpoint.operators.search import grid_tallies
from cutpoint.sources.frames import scored


@pytest.fixture(scope="module")
def overlapping(spark):
    rng = np.random.default_rng(0)
    s = rng.random(2000)
    y = np.where((s > 0.5) ^ (rng.random(2000) < 0.15), 1, -1)
    return spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, label int").persist()


def test_full_sample_equals_grid(overlapping):
    for reshuffle in (False, True):
        a = FrameCutpoint("sgrid", {"stoch_ratio": 1.0, "reshuffle": reshuffle}, seed=1).solve(overlapping).first()
        assert a == FrameCutpoint("grid").solve(overlapping).first()


@pytest.mark.parametrize("algorithm", ["sgrid", "gen", "sgd"])
def test_near_the_best_and_repeatable(overlapping, algorithm):
    best = FrameCutpoint("exact").solve(overlapping).first()
    found = [FrameCutpoint(algorithm, {"stoch_ratio": 0.5}, seed=3).solve(overlapping).first() for _ in range(2)]
    assert found[0] == found[1]
    assert found[0].accuracy >= best.accuracy - 0.05
    assert 0 <= found[0].threshold <= 1


def seen_at(data, shape, steps, k, seed, bucket):
    """What the point of one bucket sees on a shared sample."""
    counted = counts.grid_counts(data, shape.lowest, shape.highest, steps)
    seen, _ = sampling.shared_sample(counted, shape, k, steps + 1, seed)
    return {r.bucket: r.seen for r in seen.collect()}[bucket]


def test_shared_sample_is_distributed_as_rows(overlapping):
    data = scored(overlapping)
    shape = admit(data)
    seen = [seen_at(data, shape, 10, 200, i, 5) for i in range(30)]
    exact = sampling.counter(data, shape)([shape.lowest + 5 * (shape.highest - shape.lowest) / 10])[0]
    assert np.mean(seen) == pytest.approx(200 * exact / shape.rows, abs=5)


def test_draw_limits():
    rng = np.random.default_rng(1)
    assert draws.draw(rng, 5, 0, 5) == 5
    assert draws.draw(rng, 2_000_000_000, 0, 10) == 10
    assert 0 <= draws.draw(rng, 2_000_000_000, 2_000_000_000, 10) <= 10
    assert draws.draw(rng, 0, 3_000_000_000, 7) == 0 and draws.draw(rng, 3_000_000_000, 1, 3_000_000_001) == 3_000_000_000
    assert sampling.sample_size(0.0001, 100) == 1


@pytest.mark.parametrize(
    ("good", "bad", "k"),
    [
        (40, 3_000_000_000, 2_700_000_000), (3_000_000_000, 40, 2_700_000_000), (2_000_000_000, 2_000_000_000, 50),
        (2_000_000_000, 2_000_000_000, 3_999_999_950), (2_000_000_000, 1_500_000_000, 3_150_000_000),
    ],
)
def test_large_draws_have_the_spread_of_a_sample(good, bad, k):
    rng = np.random.default_rng(5)
    seen = np.array([draws.draw(rng, good, bad, k) for _ in range(3000)], float)
    rows = good + bad
    mean, spread = k * good / rows, np.sqrt(k * (good / rows) * (bad / rows) * ((rows - k) / (rows - 1)))
    assert abs(seen.mean() - mean) < 5 * spread / np.sqrt(3000)
    assert seen.std() == pytest.approx(spread, rel=0.07)
    assert seen.min() >= max(0, k - bad) and seen.max() <= min(good, k)


@pytest.mark.parametrize(("good", "bad", "k"), [(2_000_000_000, 3_000_000_000, 40), (2_000_000_000, 2_000_000_000, 3_999_999_970), (60, 2_000_000_000, 700_000_000)])
def test_large_draws_by_chi_square(good, bad, k):
    """Against the exact probabilities: draws of few rows of very many, of nearly all, and of few good ones."""
    rows, n = good + bad, 20_000
    rng = np.random.default_rng(11)
    seen = Counter(draws.draw(rng, good, bad, k) for _ in range(n))
    log = lambda top, low: math.fsum(math.log(top - i) - math.log(i + 1) for i in range(low))
    few = min(k, rows - k, good)
    base = 0 if few != rows - k else good - few  # all but a few: count what is left over
    chance = {}
    for x in range(few + 1):
        if few == k:
            chance[x] = math.exp(log(good, x) + log(bad, k - x) - log(rows, k))
        elif few == rows - k:
            chance[base + few - x] = math.exp(log(good, x) + log(bad, few - x) - log(rows, few))
        else:
            chance[x] = math.exp(log(k, x) + log(rows - k, good - x) - log(rows, good))
    assert sum(chance.values()) == pytest.approx(1, abs=1e-6)
    likely = [x for x, p in chance.items() if p * n >= 10]
    chi = sum((seen[x] - n * chance[x]) ** 2 / (n * chance[x]) for x in likely)
    assert chi < len(likely) + 4.5 * math.sqrt(2 * len(likely))
    assert set(seen) <= set(chance)


def test_log_steps_are_those_of_factorials():
    for a in (0, 5, 1 << 20, 3 << 20):
        for d in (-min(a, 7), 0, 3, 4000):
            assert draws.log_steps(a, d) == pytest.approx(math.lgamma(a + d + 1) - math.lgamma(a + 1), abs=1e-6)
    whole = math.fsum(math.log(10**15 + i) for i in range(1, 1001))
    assert draws.log_steps(10**15, 1000) == pytest.approx(whole, abs=1e-9 * whole)


def test_deal_is_a_sample_without_replacement():
    rng = np.random.default_rng(2)
    cells = np.array([5, 0, 3_000_000_000, 40, 2_000_000_000, 1])
    seen = np.array([draws.deal(rng, cells, 4_000_000_000) for _ in range(2000)])
    assert (seen.sum(1) == 4_000_000_000).all() and (seen <= cells).all() and (seen >= 0).all()
    assert seen.mean(0) == pytest.approx(cells * (4_000_000_000 / cells.sum()), rel=0.02, abs=0.05)
    share = 0.8
    assert seen[:, 3].std() == pytest.approx(np.sqrt(40 * share * (1 - share)), rel=0.1)
    assert draws.deal(rng, cells[:2], 99).tolist() == [5, 0]


def test_shared_sample_has_the_spread_of_a_sample(overlapping):
    data = scored(overlapping)
    shape = admit(data)
    seen = [seen_at(data, shape, 10, 1800, i, 5) for i in range(120)]
    exact = sampling.counter(data, shape)([shape.lowest + 5 * (shape.highest - shape.lowest) / 10])[0]
    share = exact / shape.rows
    assert np.std(seen) == pytest.approx(np.sqrt(1800 * share * (1 - share) * 200 / 1999), rel=0.3)


@pytest.mark.parametrize("reshuffle", [True, False])
def test_the_driver_draws_what_a_task_would(overlapping, monkeypatch, reshuffle):
    params = {"stoch_ratio": 0.1, "reshuffle": reshuffle}
    here = FrameCutpoint("sgrid", params, seed=6).solve(overlapping).first()
    monkeypatch.setattr(sampling, "DRIVER_PLACES", 0)
    assert FrameCutpoint("sgrid", params, seed=6).solve(overlapping).first() == here


@pytest.mark.parametrize("one_task", [True, False])
def test_shared_sample_adds_up_in_ranges_too(overlapping, monkeypatch, one_task):
    monkeypatch.setattr(sampling, "DRIVER_PLACES", 0)
    monkeypatch.setattr(sampling, "ONE_TASK_PLACES", 10**9 if one_task else 0)
    data = scored(overlapping)
    shape = admit(data)
    seen, positive = sampling.shared_sample(counts.grid_counts(data, shape.lowest, shape.highest, 1000), shape, 1500, 1001, 4)
    rows = sorted(seen.collect(), key=lambda r: r.bucket)
    tallies = {r.pos: r.correct for r in grid_tallies(data, shape, 3).collect()}
    assert all(r.correct == tallies[r.bucket] for r in rows)
    assert rows[-1].seen == 1500 - positive and all(0 <= r.seen <= 1500 for r in rows)
    # a sample of all rows sees what is there
    seen, positive = sampling.shared_sample(counts.grid_counts(data, shape.lowest, shape.highest, 1000), shape, shape.rows, 1001, 4)
    assert positive == shape.positives and all(r.seen == r.correct for r in seen.collect())


def test_fine_grids_stay_rows(overlapping, monkeypatch):
    """Ten million places: nothing but the answer and a row a task comes to the driver."""
    monkeypatch.setattr(sampling, "ONE_TASK_PLACES", 1000)
    best = FrameCutpoint("exact").solve(overlapping).first()
    got = FrameCutpoint("sgrid", {"no_of_decimal_places": 7, "stoch_ratio": 0.5}, seed=2).solve(overlapping)
    assert best.accuracy - 0.05 <= got.first().accuracy <= best.accuracy
    assert got.first() == FrameCutpoint("sgrid", {"no_of_decimal_places": 7, "stoch_ratio": 0.5}, seed=2).solve(overlapping).first()


def test_wide_data_is_looked_up_in_one_range(spark, overlapping, monkeypatch):
    # few rows are else one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        looked_up(overlapping, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scans(plan):
    """Scans of a plan that ran."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return scans(plan.executedPlan())
    if "QueryStage" in name:
        return scans(plan.plan())
    below = plan.children()
    return [plan] * name.startswith("Scan") + [s for i in range(below.size()) for s in scans(below.apply(i))]


def looked_up(overlapping, monkeypatch):
    data = scored(overlapping)
    shape = admit(data)
    cuts = [0.1, 0.5, 0.9, -1.0, 2.0, shape.lowest, shape.highest]
    near = sampling.counter(data, shape)(cuts)
    monkeypatch.setattr(sampling, "DRIVER_SCORES", 10)
    far = sampling.counter(data.repartition(4), shape)
    assert isinstance(far, sampling.Lookup) and len(far.parts) > 1
    assert far(cuts) == near
    assert [far([c])[0] for c in cuts] == near
    step = far.inside([0.5])
    step.collect()
    assert [scan.metrics().apply("numFiles").value() for scan in scans(step._jdf.queryExecution().executedPlan())] == [1]
    few = {"gen": {"population_size": 5, "number_of_generations": 2}, "sgd": {"num_of_iters": 4}}
    assert far.means() == pytest.approx(tuple(evaluate.class_means(data).first()))
    solved = lambda: {a: FrameCutpoint(a, {"stoch_ratio": 0.5, **p}, seed=3).solve(overlapping).first() for a, p in few.items()}
    found = solved()
    monkeypatch.undo()
    assert sampling.counter(data, shape).means() == pytest.approx(far.means())
    for a, row in solved().items():
        assert (row.threshold, row.correct) == (pytest.approx(found[a].threshold), found[a].correct)


def test_a_lookup_reads_one_block_once(overlapping, monkeypatch):
    """a walk of 200 steps read the whole range of a cut-off, again for each step."""
    data = scored(overlapping).repartition(4)
    shape = admit(data)
    cuts = [0.2, 0.50001, 0.8]
    near = sampling.counter(data, shape)(cuts)
    monkeypatch.setattr(sampling, "DRIVER_SCORES", 10)
    monkeypatch.setattr(sampling, "FEW", 20, raising=False)
    monkeypatch.setattr(sampling, "BLOCKS", 1000, raising=False)
    far = sampling.counter(data, shape)
    assert far(cuts) == near
    context = overlapping.sparkSession.sparkContext
    context.setJobGroup("again", "again")
    try:
        assert far(cuts) == near and [far([c])[0] for c in cuts] == near
        assert not context.statusTracker().getJobIdsForGroup("again")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert all(1 < far.inside([c]).count() <= 20 for c in cuts)


# fixed values: settings of the genetic search that cannot work
BAD = [
    {"population_size": 0}, {"population_size": -1}, {"population_size": 2.5}, {"population_size": True},
    {"number_of_generations": 0}, {"number_of_generations": "3"}, {"number_of_iterations": 0}, {"number_of_iterations": -2},
    {"sus_factor": 0}, {"sus_factor": 30}, {"sus_factor": 31}, {"population_size": 2, "sus_factor": 2},
]


@pytest.mark.parametrize("params", BAD)
def test_genetic_refusals(params):
    with pytest.raises(ConfigurationError):
        FrameCutpoint("gen", params)
