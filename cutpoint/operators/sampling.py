"""The searches that sample: sgrid, gen, sgd.

How many of k rows drawn without replacement a cut-off gets right is hypergeometric in how
many of all rows it gets right. So rows are counted once, and samples are drawn as numbers:
the results are distributed as if rows had been read, and no row is read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grid_value
from ..plans.running import written
from ..plans.workers import send_package
from .counts import class_counts, grid_counts
from .draws import deal, draw
from .profile import Shape, need_finite
from .search import grid_tallies

#: Distinct scores whose counts may come to the driver (24 bytes each); beyond, they are a
#: table of running sums in which a cut-off is looked up.
DRIVER_SCORES = 1_000_000
#: Blocks that such a table is cut into, unless they would hold fewer scores than FEW.
BLOCKS, FEW = 100_000, 1000
#: Grid places that the driver may deal a sample to, and that one task may; more are dealt in
#: ranges. The driver draws what a task would.
DRIVER_PLACES, ONE_TASK_PLACES = 10_000, 1_000_000


def sample_size(ratio: float, rows: int) -> int:
    """Rows of a sample: the share, cut to a whole number, and one at least."""
    return max(1, min(rows, int(ratio * rows)))


Means = tuple[float, float, float]


class Held:
    """What any cut-off gets right, from running sums in memory."""

    def __init__(self, counts: DataFrame, shape: Shape) -> None:
        got = counts.toPandas().sort_values("score")  # DRIVER_SCORES rows at most
        self.scores, neg, pos = (got[c].to_numpy(k) for c, k in (("score", np.float64), ("neg", np.int64), ("pos", np.int64)))
        self.positives = shape.positives
        self.neg, self.pos = np.append(0, np.cumsum(neg)), np.append(0, np.cumsum(pos))

    def means(self) -> Means:
        """The mean score of negatives, of positives, and of all."""
        neg, pos = np.diff(self.neg), np.diff(self.pos)
        return tuple(float(self.scores @ n / n.sum()) for n in (neg, pos, neg + pos))

    def __call__(self, cuts: list[float]) -> list[int]:
        k = np.searchsorted(self.scores, cuts, "right")
        return (self.neg[k] + self.positives - self.pos[k]).tolist()


class Lookup:
    """What any cut-off gets right, from running sums in a table dealt by ranges of scores.

    A range is cut into blocks of neighbouring scores, BLOCKS in all or of FEW scores each.
    The blocks' least scores and totals are held here, a few numbers each. A cut-off is looked
    up in the one block that it falls in, which is read once and held, DRIVER_SCORES scores in all.
    """

    def __init__(self, counts: DataFrame, shape: Shape, distinct: int) -> None:
        self.positives = shape.positives
        ranged = counts.repartitionByRange("score").sortWithinPartitions("score").withColumn("at", F.monotonically_increasing_id())
        place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        size = max(FEW, -(-distinct // BLOCKS))
        ranged = ranged.select("score", "neg", "pos", F.shiftright("at", 33).alias("part"), F.floor(place / size).alias("block"))
        self.table = written(ranged, "scores", "part")
        weighed = [F.sum(F.col("score") * F.col(c)).alias(f"{c}_sum") for c in ("neg", "pos")]
        ends = self.table.groupBy("part", "block").agg(
            F.min("score").alias("low"), F.max("score").alias("high"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), *weighed
        )
        ends = ends.toPandas().sort_values("low")  # a row for each block
        self.parts, self.lows, self.highs = (ends[c].to_numpy() for c in ("part", "low", "high"))
        self.neg, self.pos = (np.append(0, np.cumsum(ends[c].to_numpy(np.int64))) for c in ("neg", "pos"))
        self.sums = [math.fsum(ends[f"{c}_sum"]) for c in ("neg", "pos")]
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def means(self) -> Means:
        """The mean score of negatives, of positives, and of all."""
        (neg, pos), n, p = self.sums, int(self.neg[-1]), int(self.pos[-1])
        return neg / n, pos / p, (neg + pos) / (n + p)

    def own(self, cuts: list[float]) -> np.ndarray:
        """The block that each cut falls in."""
        return np.maximum(np.searchsorted(self.lows, cuts, "right") - 1, 0)

    def inside(self, cuts: list[float]) -> DataFrame:
        """The rows ``(score, neg, pos)`` of the blocks that cuts fall in."""
        blocks = sorted(set(self.own(cuts).tolist()))
        needed = self.table.where(F.col("part").isin(sorted({int(self.parts[b]) for b in blocks})))
        within = " or ".join(f"score between double('{float(self.lows[b])!r}') and double('{float(self.highs[b])!r}')" for b in blocks)
        return needed.where(within).select("score", "neg", "pos")

    def read(self, blocks: list[int], cuts: list[float]) -> None:
        """Hold the blocks that cuts fall in."""
        if sum(len(scores) for scores, _, _ in self.held.values()) > DRIVER_SCORES:
            self.held.clear()
        rows = sorted(self.inside(cuts).collect())
        scores, neg, pos = (np.array([r[c] for r in rows], k) for c, k in (("score", np.float64), ("neg", np.int64), ("pos", np.int64)))
        for b in blocks:
            at = slice(np.searchsorted(scores, self.lows[b], "left"), np.searchsorted(scores, self.highs[b], "right"))
            self.held[b] = (scores[at], *(np.append(0, np.cumsum(x[at])) for x in (neg, pos)))

    def __call__(self, cuts: list[float]) -> list[int]:
        own = self.own(cuts).tolist()
        if not self.held.keys() >= set(own):
            self.read(own, cuts)
        out = []
        for cut, b in zip(cuts, own, strict=True):
            scores, neg, pos = self.held[b]
            k = np.searchsorted(scores, cut, "right")
            out.append(int(self.neg[b] + neg[k] + self.positives - self.pos[b] - pos[k]))
        return out


def counter(scored: DataFrame, shape: Shape) -> Held | Lookup:
    """From cut-offs to the rows each gets right, after one pass over the rows."""
    counts = class_counts(scored)
    if shape.rows > DRIVER_SCORES:
        counts = written(counts, "counts")  # else they are counted once more
        if (distinct := counts.count()) > DRIVER_SCORES:
            return Lookup(counts, shape, distinct)
    return Held(counts, shape)


def _entropy(seed: int | None) -> int:
    """The seed, or one drawn once, so that a task that is run again draws the same."""
    return int(np.random.SeedSequence(seed).generate_state(1)[0]) if seed is None else seed


def sgrid(scored: DataFrame, shape: Shape, places: int, ratio: float, reshuffle: bool, seed: int | None) -> DataFrame:
    """The best grid point ``(threshold, correct)`` on one sample of rows, or on a fresh one
    for each point; the first of the best. Points stay rows, whatever their number."""
    need_finite(shape, "sgrid")
    send_package(scored.sparkSession)
    k, steps = sample_size(ratio, shape.rows), 10**places if shape.highest > shape.lowest else 1
    if reshuffle:
        seen = resampled(grid_tallies(scored, shape, places), shape.rows, k, steps + 2, _entropy(seed))
        best = seen.agg(F.max(F.struct("seen", (-F.col("pos")).alias("back"), "threshold", "correct")).alias("best"))
        return best.select("best.threshold", "best.correct")
    seen, positive = shared_sample(grid_counts(scored, shape.lowest, shape.highest, steps), shape, k, steps + 1, _entropy(seed))
    # a point whose bucket is empty sees what the point before it does, which comes first
    best = seen.agg(F.max(F.struct("seen", (-F.col("bucket")).alias("back"), "correct")).alias("best")).select("best.*")
    at = -F.col("back")
    cut = grid_value(at, shape.lowest, shape.highest, steps) if shape.highest > shape.lowest else F.lit(shape.lowest)
    outside = F.lit(positive) > F.col("seen")
    return best.select(
        F.when(outside, F.lit(shape.below)).otherwise(cut).alias("threshold"),
        F.when(outside, F.lit(shape.positives)).otherwise(F.col("correct")).alias("correct"),
    )


def resampled(tallies: DataFrame, rows: int, k: int, points: int, seed: int) -> DataFrame:
    """``tallies(pos, threshold, correct)`` with seen: how many rows each point gets right on a
    sample of its own. Each draw is fixed by the seed and the point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, correct = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            seen = [draw(np.random.default_rng([seed, p]), c, rows - c, k) for p, c in zip(pos, correct, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.int64())], ["pos", "threshold", "correct", "seen"])

    tallies = tallies.select(F.col("pos").cast("long").alias("pos"), "threshold", F.col("correct").cast("long").alias("correct"))
    if points <= DRIVER_PLACES:
        return tallies.sparkSession.createDataFrame(pa.Table.from_batches(run(iter(tallies.toArrow().to_batches()))))
    return tallies.mapInArrow(run, "pos long, threshold double, correct long, seen long")


def shared_sample(counts: DataFrame, shape: Shape, k: int, places: int, seed: int) -> tuple[DataFrame, int]:
    """``(bucket, correct, seen)`` for each bucket of ``counts(bucket, neg, pos)`` that has rows:
    what a cut at its upper edge gets right, of all rows and of one sample of ``k``; and the
    sample's positives.

    The sample is dealt down a tree of hypergeometric splits: on the driver to the two
    classes and to ranges of buckets, then in each range to its buckets. Below a split the
    parts are independent, so ranges are dealt by tasks of their own.
    """
    if places <= ONE_TASK_PLACES:
        ranged = counts.withColumn("part", F.lit(0)).repartition(1)
        totals = [(0, shape.negatives, shape.positives)]
    else:
        ranged = counts.repartitionByRange("bucket").sortWithinPartitions("bucket").withColumn("part", F.spark_partition_id())
        ranged = written(ranged, "places", "part")
        sums = ranged.groupBy("part").agg(F.min("bucket").alias("low"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        totals = [(r.part, r.neg, r.pos) for r in sorted(sums.collect(), key=lambda r: r.low)]  # a row for each task
    rng = np.random.default_rng([seed, 0])
    positive = draw(rng, shape.positives, shape.negatives, k)
    neg, pos = (np.array([t[i] for t in totals], np.int64) for i in (1, 2))
    got_neg, got_pos = deal(rng, neg, k - positive), deal(rng, pos, positive)
    up_to = lambda x: np.cumsum(x) - x
    columns = ("part", "want_neg", "want_pos", "base_seen", "base")
    base = up_to(neg) + shape.positives - up_to(pos)
    base_seen = up_to(got_neg) + positive - up_to(got_pos)
    plan = [dict(zip(columns, map(int, r), strict=True)) for r in zip([t[0] for t in totals], got_neg, got_pos, base_seen, base, strict=True)]
    by_part = {p["part"]: p for p in plan}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        own = by_part[table.column("part")[0].as_py()]
        rng = np.random.default_rng([seed, 1, own["part"]])
        neg, pos = (table.column(c).to_numpy() for c in ("neg", "pos"))
        seen_neg, seen_pos = deal(rng, neg, own["want_neg"]), deal(rng, pos, own["want_pos"])
        correct = own["base"] + np.cumsum(neg - pos)
        seen = own["base_seen"] + np.cumsum(seen_neg - seen_pos)
        return pa.table({"bucket": table.column("bucket"), "correct": correct, "seen": seen})

    if places <= DRIVER_PLACES:
        return counts.sparkSession.createDataFrame(run(ranged.toArrow())), positive
    return ranged.groupBy("part").applyInArrow(run, "bucket long, correct long, seen long"), positive


def genetic(scored: DataFrame, shape: Shape, params: dict[str, Any], seed: int | None) -> tuple[float, int]:
    """Cut-offs bred from the fittest of each generation; the fittest ever measured wins.

    Fitness is the mean share of wrong rows over fresh samples. Agents start between the
    means of the classes; children lie between two survivors; now and then one is moved.
    """
    need_finite(shape, "gen")
    rng = np.random.default_rng(seed)
    correct = counter(scored, shape)
    means = correct.means()[:2]
    k = sample_size(params["stoch_ratio"], shape.rows)
    size, rounds = params["population_size"], params["number_of_iterations"]
    kept = size - params["sus_factor"]
    agents = rng.uniform(min(means), max(means), size).tolist()
    best, best_fit, best_correct = agents[0], math.inf, 0
    for generation in range(params["number_of_generations"]):
        if generation:
            parents = rng.choice(survivors, (size, 2))
            agents = (parents[:, 0] + rng.random(size) * (parents[:, 1] - parents[:, 0])).tolist()
            if rng.random() < params["mutation_chance"]:
                agents[rng.integers(size)] += params["mutation_factor"] * rng.uniform(-1, 1)
        right = correct(agents)
        fits = [1 - np.mean([draw(rng, c, shape.rows - c, k) for _ in range(rounds)]) / k for c in right]
        for agent, fit, c in zip(agents, fits, right, strict=True):
            if fit < best_fit:
                best, best_fit, best_correct = agent, fit, c
        survivors = [agents[i] for i in sorted(range(size), key=fits.__getitem__)[:kept]]
    return float(best), best_correct


def descend(scored: DataFrame, shape: Shape, params: dict[str, Any], seed: int | None) -> tuple[float, int]:
    """A walk from the mean score, turning round when a step made things worse; the best
    point visited wins. Steps shrink, stay in the scores' range, and end for want of gain."""
    need_finite(shape, "sgd")
    rng = np.random.default_rng(seed)
    correct = counter(scored, shape)
    point = correct.means()[2]
    k = sample_size(params["stoch_ratio"], shape.rows)

    def wrong(at: float) -> tuple[float, int]:
        c = correct([at])[0]
        return 1 - draw(rng, c, shape.rows - c, k) / k, c

    span = shape.highest - shape.lowest
    step = params["step_ratio"] * span
    error, right = wrong(point)
    best = (error, point, right)
    idle = 0
    for _ in range(params["num_of_iters"]):
        point = min(max(point + step, shape.lowest), shape.highest)
        now, right = wrong(point)
        gain, error = error - now, now
        if now < best[0]:
            best = (now, point, right)
        step = math.copysign(min(abs(step) * (1 - params["alpha"]), span / 2), -1 if gain < 0 else 1)
        idle = idle + 1 if abs(gain) < params["stop_thresh"] else 0
        if idle >= params["stop_patience"]:
            break
    return best[1], best[2]
