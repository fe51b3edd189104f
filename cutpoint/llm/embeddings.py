"""Embedding near-dedup: spherical k-means cells, blocked cosines, one vector kept a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, numbered, with_least
from .runtime import by_group, materialise, release, session, tidy

#: Vectors that train the cells (the documented bound), cells at most, vectors a cell.
SAMPLE, MOST_CELLS, CELL_ROWS = 40_000, 4096, 1024
#: Vectors whose cosines with all centroids are in memory at once.
SLICE = 512
#: Vectors of a block; two blocks are compared at once.
BLOCK = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; a cell that empties keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        # few rows at a time: the cosines of all would be a large array
        own = np.concatenate([(x[a : a + SLICE] @ centres.T).argmax(1) for a in range(0, len(x), SLICE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), centres)
    return centres


def borders(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each unit vector, and the others within ``reach`` of whose border it is.

    Distances of centroids come from their cosines, for the home cells of a few vectors at
    a time: no array is larger than those vectors times the centroids.
    """
    best, visits = np.zeros(len(x), np.int32), []
    for a in range(0, len(x), 256):
        part = x[a : a + 256]
        cos = part @ centres.T
        own = cos.argmax(1)
        rows = np.arange(len(part))
        apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[own] @ centres.T)))
        near = cos[rows, own][:, None] - cos <= reach * apart * (1 + 1e-9) + 1e-7
        near[rows, own] = False
        best[a : a + 256] = own
        visits += [np.flatnonzero(n).astype(np.int32) for n in near]
    return best, visits


def _cells(reps: DataFrame, centres: np.ndarray, reach: float) -> DataFrame:
    """Home cell of each vector, and the other cells that it visits.

    Let x and y be linked, so no farther apart than twice ``reach``, with different home
    cells. The plane between two centroids separates them, so one of both is within
    ``reach`` of it. A vector visits every cell whose plane is that near: each linked
    pair meets in the home cell of one.
    """
    sent = reps.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            rows = [np.array(v, np.float64) for v in batch.column(3).to_pylist()]
            home, visits = np.zeros(len(rows), np.int32), [np.zeros(0, np.int32)] * len(rows)
            same = [i for i, r in enumerate(rows) if len(c) and len(r) == c.shape[1]]
            if same:
                best, visited = borders(unit(np.stack([rows[i] for i in same])), c, reach)
                for k, i in enumerate(same):
                    home[i], visits[i] = best[k], visited[k]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(r) for r in rows], pa.int32()),
                    pa.array(home),
                    pa.array(visits, pa.list_(pa.int32())),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["node", "label", "copies", "dim", "home", "visits", "v"],
            )

    return reps.mapInArrow(
        run, "node long, label long, copies long, dim int, home int, visits array<int>, v binary"
    )


def _compare(cosine: float):
    """Links inside a group of one or two blocks: per vector the copies linked, and links
    that join what is linked."""

    def fn(cols: dict[str, pa.ChunkedArray], starts: np.ndarray) -> pa.RecordBatch:
        node, copies = cols["node"].to_numpy(), cols["copies"].to_numpy()
        side, home, cell = cols["side"].to_numpy(), cols["home"].to_numpy(), cols["cell"].to_numpy()
        kind = cols["kind"].to_numpy()
        raw, visits = cols["v"].to_pylist(), cols["visits"].to_pylist()
        u: list[int] = []
        v: list[int | None] = []
        n: list[int] = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = unit(np.stack([np.frombuffer(r, np.float64) for r in raw[a:b]]))
            left = np.flatnonzero(side[a:b] == 0)
            right = np.flatnonzero(side[a:b] == 1) if kind[a] else left
            if not len(left) or not len(right):
                continue
            near = x[left] @ x[right].T >= cosine
            if not kind[a]:
                np.fill_diagonal(near, False)
            elif kind[a] == 2:  # the right side visits; a pair that also meets in its cell counts once
                c = cell[a]
                for h in np.unique(home[a + right]):
                    if c > h:
                        also = np.array([h in visits[a + i] for i in left])
                        near[np.ix_(also, home[a + right] == h)] = False
            if not near.any():
                continue
            own = node[a:b]
            for who, other, seen in ((left, right, near), *(((right, left, near.T),) if kind[a] else ())):
                total = seen @ copies[a + other]
                some = np.flatnonzero(total)
                u += own[who[some]].tolist()
                v += [None] * len(some)
                n += total[some].tolist()
            first = near.argmax(1)
            for i in np.flatnonzero(near.any(1)):
                u.append(int(own[left[i]]))
                v.append(int(own[right[first[i]]]))
                n.append(0)
            _join_rest(near, left, right, own, first, u, v, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"]
        )

    return fn


def _join_rest(near, left, right, own, first, u, v, n) -> None:
    """Links that the first partner of each row does not already imply."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[p]
        return i

    for i in np.flatnonzero(near.any(1)):
        parent[root(int(left[i]))] = root(int(right[first[i]]))
    for i in np.flatnonzero(near.any(1)):
        for j in np.flatnonzero(near[i]):
            a, b = root(int(left[i])), root(int(right[j]))
            if a != b:
                parent[a] = b
                u.append(int(own[left[i]]))
                v.append(int(own[right[j]]))
                n.append(0)


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links of vectors with equal labels and a cosine of ``cosine`` or more.

    Equal vectors of a label are one node with a number of copies. Cells come from
    spherical k-means on a bounded sample, but every vector is assigned, and it also
    visits each cell whose border is so near that a partner may lie behind it: no linked
    pair is missed. A cell is compared in pairs of blocks, in double precision.

    Returns per input row vec_id, n_links (other vectors linked directly),
    component_id (least id reachable) and kept (vec_id = component_id). Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null label or
    id, link with nothing (a null id: component_id null, kept true). Vectors of different
    lengths do not link. Rows with an equal id are counted each and are one node for
    components. Ids and labels may be of any type that can be ordered; labels are equal as
    their type has it. Other columns are not read.
    """
    session(vectors)
    v = F.col(vector_col).cast("array<double>")
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(F.col(id_col).alias("vec_id"), numbered(vectors, id_col).alias("id"), label.alias("label"), v.alias("v"))
    rows = rows.withColumn("good", good_of(rows) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(1), "label", "v"))
    reps = rows.where("good").groupBy("k1", "k2").agg(
        F.min("id").alias("node"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("v").alias("v")
    )
    reps = materialise(reps, "vectors")

    dims = reps.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    centres = np.zeros((0, 0))
    if dims:
        place = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = reps.where(F.size("v") == dims["dim"]).where(place < F.lit(SAMPLE / dims["count"]))
        sample = sample.select("node", "v").toArrow()  # about SAMPLE vectors
        k = min(MOST_CELLS, -(-dims["count"] // CELL_ROWS))
        if sample.num_rows:
            x = pa.compute.list_flatten(sample["v"]).to_numpy().reshape(sample.num_rows, -1)
            centres = spherical_kmeans(unit(x[np.argsort(sample["node"].to_numpy(), kind="stable")]), k, seed)
    reach = float(np.sqrt(2 - 2 * cosine) / 2)
    cells = materialise(_cells(reps.select("node", "label", "copies", "v"), centres, reach), "cells")

    key = ["label", "dim", "cell"]
    homes = cells.withColumn("cell", F.col("home"))
    guests = cells.withColumn("cell", F.explode("visits"))
    sizes = homes.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    guest_sizes = guests.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guest_blocks"))
    plan = materialise(sizes.join(guest_sizes, key, "left").na.fill(0, ["guest_blocks"]), "plan")
    keep = [*key, "node", "copies", "home", "visits", "v"]
    homes = homes.select(*keep).join(plan, key).withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), "blocks").cast("int"))
    guests = guests.select(*keep).join(plan, key).withColumn(
        "own", F.pmod(F.xxhash64(F.lit(2), "node"), "guest_blocks").cast("int")
    )
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.col("own")
    inside = homes.select(
        *keep,
        F.inline(
            F.transform(
                blocks,
                lambda o: F.struct(
                    F.when(o == own, 0).otherwise(1).alias("kind"),
                    F.least(own, o).alias("i"),
                    F.greatest(own, o).alias("j"),
                    F.when(own <= o, 0).otherwise(1).alias("side"),
                ),
            )
        ),
    )
    guest_list = F.when(F.col("guest_blocks") > 0, F.sequence(F.lit(0), F.col("guest_blocks") - 1))
    hosts = homes.select(
        *keep, F.lit(2).alias("kind"), own.alias("i"), F.explode(guest_list).alias("j"), F.lit(0).alias("side")
    )
    visitors = guests.select(
        *keep, F.lit(2).alias("kind"), F.explode(blocks).alias("i"), own.alias("j"), F.lit(1).alias("side")
    )
    dealt = inside.unionByName(hosts).unionByName(visitors)
    out = by_group(dealt, [*key, "kind", "i", "j"], _compare(cosine), "u long, v long, n long")
    out = materialise(out, "found")
    counted = out.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    found = components(out.where("v is not null").select("u", "v"))

    named = reps.select("k1", "k2", "node", "copies")
    named = named.join(counted.withColumnRenamed("u", "node"), "node", "left").join(found, "node", "left")
    named = materialise(
        named.select(
            "k1", "k2",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "named",
    )
    release(reps, cells, plan, out)
    tidy(vectors.sparkSession)
    met = rows.select("vec_id", "id", "good", "k1", "k2").join(named, ["k1", "k2"], "left")
    met = with_least(met, F.when(F.col("good"), F.col("component_id")), "vec_id")
    component = F.when(F.col("good"), F.col("least")).otherwise(F.col("vec_id"))
    return met.select(
        "vec_id",
        F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def good_of(rows: DataFrame) -> F.Column:
    """Whether vector ``v`` has a direction: not null, finite in every component, not zero."""
    finite = F.forall(rows.v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(rows.v, lambda x: x != 0)
    return F.coalesce(F.size(rows.v) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))
