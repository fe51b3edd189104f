import hashlib
import math

import numpy as np
import pytest

from cutpoint.llm import centroids


def brute(rows, k=8, rounds=10, dims=64):
    """The rounds by the definition, in Python's whole numbers."""
    def fit(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if fit(v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assigned():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centres))
            out.append((i, c, d, v))
        return out

    for _ in range(rounds):
        found = assigned()
        for c in range(len(centres)):
            own = [v for _, n, _, v in found if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = [sum(d for _, n, d, _ in found if n == c) for c in range(len(centres))]
    return sorted((repr(i), c, d, inertia[c], sum(inertia), sha[c]) for i, c, d, _ in found)


def rows_of(seed, n=300):
    """Clouds of vectors, equal ones, and ones that are not kept."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    rows = [(i, (middle[rng.integers(12)] + rng.normal(size=64) * rng.choice([0.01, 0.3, 1])).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(100)] + [(7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    bad = [list(rows[0][1]) for _ in range(3)]
    bad[0][3], bad[1][63], bad[2][0] = None, math.nan, math.inf
    return rows + [(2000, None), (2001, []), (2002, [0.5] * 63), *zip(range(2003, 2006), bad), (2006, [0.0] * 64), (2007, [-1e-9] * 64)]


@pytest.mark.parametrize(("seed", "trees"), [(0, 4096), (1, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, trees):
    monkeypatch.setattr(centroids, "TREE_ROWS", trees)
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    got = centroids.cluster_vectors(df).collect()
    expected = brute(rows)
    assert sorted((repr(r.vec_id), *r[1:]) for r in got) == expected
    assert len({r[1] for r in expected}) > 3


def test_whole_balls_are_assigned():
    """Far clouds: most nodes go whole to a centroid, and the rows are those of plain search."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-50_000, 50_000, (6, 64))
    x = middle[rng.integers(6, size=3000)] + rng.integers(-300, 300, (3000, 64))
    order, tree = centroids.grow(x)
    x = x[order]
    assert sorted(order) == list(range(3000))
    for n, (a, b) in enumerate(zip(tree["first"], tree["stop"])):
        assert (tree["total"][n] == x[a:b].sum(0)).all()
        assert (np.sqrt(((x[a:b] - tree["centre"][n]) ** 2).sum(1)) <= tree["radius"][n]).all()
    found, whole = np.full(3000, -1), 0
    for _, rows, c in centroids.assign(x, tree, middle):
        assert (found[rows] == -1).all()
        found[rows] = c
        whole += (rows.stop - rows.start) * isinstance(c, int)
    assert (found == centroids.squared(x, middle).argmin(1)).all()
    assert whole > 2500


def test_equal_vectors_are_one_ball_and_ties_go_to_the_smaller():
    x = np.full((5000, 64), 7)
    _, tree = centroids.grow(x)
    assert len(tree["first"]) == 1
    most = np.concatenate([np.full((900, 2), 9), np.arange(200).reshape(100, 2) - 300])
    order, tree = centroids.grow(most)
    assert (tree["left"] >= 0).any() and (tree["stop"] - tree["first"])[tree["left"] < 0].max() <= 900
    found = np.full(1000, -1)
    for _, rows, c in centroids.assign(most[order], tree, np.array([[8, 9], [10, 9], [-200, -200]])):
        found[rows] = c
    assert (found[(most[order] == 9).all(1)] == 0).all()


def test_few_vectors_other_ids_and_large_numbers(spark):
    rows = [("a", [1.0, 2.0]), ("b", [1.0, 3.0]), ("b", [1.0, 3.0]), ("c", [1e30, 0.0]), ("d", [1e5, -1e5])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = centroids.cluster_vectors(df, dims=2).collect()
    assert sorted(r.vec_id for r in got) == ["a", "b", "b", "d"] and {r.inertia for r in got} == {0}
    assert centroids.cluster_vectors(df.limit(0), dims=2).count() == 0
    assert centroids.cluster_vectors(df).count() == 0
