"""Centroid clustering: exact k-means on whole numbers, filtered by metric trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, release, session

#: Vectors of one tree at most, and of a leaf.
TREE_ROWS, LEAF = 4096, 32
#: Components beyond this have squared distances that a long may not hold.
MOST = 1 << 27
#: Binary columns of a tree.
PARTS = ("x", "first", "stop", "left", "centre", "radius", "total")


def grow(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A ball tree over the rows of ``x``: an order of the rows, and by node first and stop
    (rows in that order), left (its first child, the second follows; -1 for a leaf), centre,
    radius (never too small) and total, the rows' sum.

    A ball is cut by the hyperplane between two of its far points, down to LEAF rows or to
    equal ones.
    """
    order = np.arange(len(x))
    spans, left, centre, radius, total = [(0, len(x))], [], [], [], []
    at = 0
    while at < len(spans):
        first, stop = spans[at]
        own = x[order[first:stop]]
        total.append(own.sum(0))
        middle = total[-1] / len(own)
        apart = own - middle
        far = np.einsum("ij,ij->i", apart, apart)
        centre.append(middle)
        radius.append(np.sqrt(far.max()) * (1 + 1e-9) + 1e-6)
        left.append(-1)
        if len(own) > LEAF and far.max() > 0:
            a = own[far.argmax()]
            b = own[((own - a).astype(np.float64) ** 2).sum(1).argmax()]
            side = apart @ (b - a).astype(np.float64)
            # where most are at the far end, the mean still parts them
            beyond = side > np.median(side) if (side > np.median(side)).any() else side > side.mean()
            order[first:stop] = order[first:stop][np.argsort(beyond, kind="stable")]
            middle = stop - int(beyond.sum())
            left[-1] = len(spans)
            spans += [(first, middle), (middle, stop)]
        at += 1
    spans = np.array(spans, np.int64)
    return order, {
        "first": spans[:, 0], "stop": spans[:, 1], "left": np.array(left, np.int64),
        "centre": np.array(centre), "radius": np.array(radius), "total": np.array(total, np.int64),
    }


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors to whole centroids."""
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (x - c for c in centroids)], axis=1)


def assign(x: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[int, slice, int | np.ndarray]]:
    """``(node, rows, nearest)`` of nodes that make up all rows of ``x`` (in tree order);
    nearest is one centroid for a whole ball, or an array for the rows of a leaf.

    By the triangle inequality no point of a ball is nearer to a centroid than the ball's
    centre less its radius, nor further than the centre plus the radius. A ball for which
    one centroid beats all others by that goes to it whole; other balls are opened, and at
    leaves distances are exact whole numbers, of equal ones the first centroid counts.
    """
    span = lambda n: slice(int(tree["first"][n]), int(tree["stop"][n]))
    nodes = np.array([0])
    while len(nodes):
        apart = np.sqrt(((tree["centre"][nodes][:, None, :] - centroids[None]) ** 2).sum(2))
        best = apart.argmin(1)
        rows = np.arange(len(nodes))
        reach = apart[rows, best] + 2 * tree["radius"][nodes]
        apart[rows, best] = np.inf
        whole = apart.min(1) > reach * (1 + 1e-9) + 1e-6
        for n, c in zip(nodes[whole].tolist(), best[whole].tolist(), strict=True):
            yield n, span(n), c
        nodes = nodes[~whole]
        leaf = tree["left"][nodes] < 0
        for n in nodes[leaf].tolist():
            yield n, span(n), squared(x[span(n)], centroids).argmin(1)
        inner = tree["left"][nodes[~leaf]]
        nodes = np.concatenate([inner, inner + 1])


def _forest(kept: DataFrame, dims: int) -> DataFrame:
    """One row a tree of ``(vec_id, x)``: ids and vectors in tree order, and its nodes. Trees
    are local to a partition, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree(table: pa.Table) -> pa.RecordBatch:
            x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            order, nodes = grow(x)
            ids = table.column("vec_id").combine_chunks().take(pa.array(order))
            flat = [x[order], nodes["first"], nodes["stop"], nodes["left"], nodes["centre"], nodes["radius"], nodes["total"]]
            cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([f.tobytes()], pa.binary()) for f in flat)]
            return pa.RecordBatch.from_arrays(cols, ["ids", *PARTS])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= TREE_ROWS:
                table = pa.Table.from_batches(held)
                yield tree(table.slice(0, TREE_ROWS))
                held = table.slice(TREE_ROWS).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield tree(pa.Table.from_batches(held))

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{p} binary" for p in PARTS))


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """Row number, vectors and nodes of each tree of a batch."""
    for i in range(batch.num_rows):
        got = {p: np.frombuffer(batch.column(p)[i].as_py(), np.float64 if p in ("centre", "radius") else np.int64) for p in PARTS}
        for p in ("x", "centre", "total"):
            got[p] = got[p].reshape(-1, dims)
        yield i, got.pop("x"), got


def _sums(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(cluster, at, n, total)``: rows of each cluster and the sum of their components. A
    whole ball counts by its node's count and total."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x, tree in _trees(batch, dims):
                for node, rows, c in assign(x, tree, centroids):
                    if isinstance(c, int):
                        count[c] += rows.stop - rows.start
                        total[c] += tree["total"][node]
                    else:
                        np.add.at(count, c, 1)
                        np.add.at(total, c, x[rows])
        cluster, at = np.repeat(np.arange(k, dtype=np.int32), dims), np.tile(np.arange(dims, dtype=np.int32), k)
        cols = [cluster, at, np.repeat(count, dims), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cluster", "at", "n", "total"])

    found = forest.mapInArrow(run, "cluster int, at int, n long, total long")
    return found.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _assigned(forest: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """``(vec_id, cluster, distance)`` of all rows."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, tree in _trees(batch, dims):
                cluster = np.empty(len(x), np.int32)
                for _, rows, c in assign(x, tree, centroids):
                    cluster[rows] = c
                apart = x - centroids[cluster]
                cols = [batch.column("ids")[i].values, pa.array(cluster), pa.array(np.einsum("ij,ij->i", apart, apart))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """k-means of vectors as whole numbers, floor(scale * component), without any rounding.

    The first centroids are the ``k`` vectors of least sha256 of ``<seed>:<id>``. Each round
    gives every vector to its nearest centroid (of equally near ones the smaller number) and
    moves each centroid that has vectors to the floor of their mean. Then vectors are
    assigned once more.

    Each partition grows metric trees of at most TREE_ROWS vectors, which are written once
    and read in each round; what a round brings to the driver is a sum for each cluster and
    component. Trees of equal vectors are one ball, however many there are.

    Returns vec_id, cluster, distance (squared), cluster_inertia and inertia (distances
    summed over the cluster and over all; null beyond a long) and centroid_sha256 (of the
    cluster's components, comma-joined) for each kept vector. Not kept are vectors that are
    null, have another number of components, hold a null or non-finite one, or one of more
    than 2**27 after scaling, whose distances a long may not hold. Repeated rows count each;
    a row with a null id is hashed as one of an empty id. With fewer than ``k`` kept vectors
    each begins a cluster. An empty table stays empty. Other columns are not read.
    """
    session(vectors)
    kind = vectors.schema[id_col].dataType.simpleString()
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.size("v") == dims)
    scaled = F.transform("v", lambda c: c.cast("double") * scale)
    own = own.select("vec_id", scaled.alias("v")).where(F.forall("v", lambda c: F.coalesce(F.abs(c) <= MOST, F.lit(False))))
    kept = own.select("vec_id", F.transform("v", lambda c: F.floor(c).cast("long")).alias("x"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()  # k rows
    outcome = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], outcome)
    centroids = np.array([r.x for r in first], np.int64)
    forest = materialise(_forest(kept, dims), "trees")
    for _ in range(rounds):
        for r in _sums(forest, centroids).where("n > 0").collect():  # k * dims rows
            centroids[r.cluster, r.at] = r.total // r.n
    found = materialise(_assigned(forest, centroids, kind), "assigned")
    release(forest)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: int(n) if n < 1 << 63 else None
    whole = fits(sum(r.own for r in inertia))
    facts = [(r.cluster, fits(r.own), whole, sha[r.cluster]) for r in inertia]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
