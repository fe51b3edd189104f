"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .components import numbered
from .ngrams import buckets, text_chunks
from .runtime import crc_fold, session

SIZES = (4, 5, 6)
BITS = 17
DIM = 4
#: The averaged vector is scaled by this, so that a few telling words in a hundred count.
SCALE = 15.0
#: Subwords weigh their inverse document frequency to this power in the average.
RARITY = 1.5
#: Subwords without a say that every text has besides its own: a few words prove little.
NEUTRAL = 100
#: A subword of fewer sample texts teaches nothing general.
LEAST_TEXTS = 8


@dataclass
class Model:
    """Subword embeddings and their weights in the average, class weights and biases, with
    the shift from the sample's class shares to those of all labelled rows."""

    vectors: np.ndarray
    rarity: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    shift: float

    def table(self) -> np.ndarray:
        """What one subword adds to the difference of the two logits, before averaging."""
        toward = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        return (toward * self.rarity * SCALE).astype(np.float32)

    def intercept(self) -> float:
        return float(self.bias[1] - self.bias[0] + self.shift)


def sparse_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct subword buckets of each text, with their shares."""
    for i, j, stream, at in text_chunks(texts):
        found = [(np.searchsorted(at, p, "right") - 1, b) for p, b in buckets(stream, SIZES, BITS)]
        key = np.sort(np.concatenate([(d.astype(np.int64) << BITS) | b for d, b in found]))
        key, count = np.unique(key, return_counts=True)
        cut = np.searchsorted(key >> BITS, np.arange(j - i + 1))
        for k in range(j - i):
            s = slice(cut[k], cut[k + 1])
            share = count[s] / (count[s].sum() + NEUTRAL)
            yield (key[s] & ((1 << BITS) - 1)).astype(np.int32), share.astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, seed: int) -> tuple:
    """Gradient descent with momentum on the cross-entropy of all sample rows at once.

    Vectors and class weights are learned together. They start small and steps are scaled
    to the largest gradient: telling subwords grow first and few others ever do.
    """
    rng = np.random.default_rng(seed)
    size = np.array([len(b) for b, _ in rows])
    bucket = np.concatenate([b for b, _ in rows])
    share = np.concatenate([s for _, s in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    texts = np.bincount(bucket, minlength=1 << BITS)
    least = min(LEAST_TEXTS, max(2, int((y == 1).sum()) // 4))
    rarity = np.log(np.maximum(1, len(rows) / np.maximum(texts, 1))).astype(np.float32) ** RARITY
    used = np.flatnonzero(texts >= least)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    inner = place[bucket]
    keep = inner >= 0
    inner, doc, share = inner[keep], doc[keep], share[keep] * rarity[bucket[keep]]
    del bucket, keep, place
    by = np.argsort(inner, kind="stable").astype(np.int32)
    by_start = np.searchsorted(inner[by], np.arange(len(used)))
    doc_by, share_by = doc[by], share[by]
    row_start = np.searchsorted(doc, np.arange(len(rows)))
    has = np.diff(np.append(row_start, len(doc))) > 0
    del by
    v = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    m_v, m_w, m_b = np.zeros_like(v), np.zeros_like(w), np.zeros_like(b)
    onehot = np.eye(2, dtype=np.float32)[y]
    for _ in range(epochs if len(used) else 0):
        mean = np.zeros((len(rows), DIM), np.float32)
        for k in range(DIM):
            mean[has, k] = np.add.reduceat(v[inner, k] * share, row_start[has]) * SCALE
        z = mean @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - onehot) / len(rows)
        g_mean = g @ w.T * SCALE
        g_v = np.stack([np.add.reduceat(g_mean[doc_by, k] * share_by, by_start) for k in range(DIM)], 1)
        m_v, m_w, m_b = 0.9 * m_v + g_v, 0.9 * m_w + mean.T @ g, 0.9 * m_b + g.sum(0)
        most = np.abs(m_v).max() + 1e-12
        v -= 0.05 * m_v / most
        w -= 0.01 * m_w / (np.abs(m_w).max() + 1e-12) * min(1.0, 50 * most)
        b -= 0.05 * m_b
    full = np.zeros((1 << BITS, DIM), np.float32)
    full[used] = v
    return full, rarity, w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    per_class: int = 1000,
    epochs: int = 80,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class (the documented bound).

    Taken are those with the least hash of the id among labelled rows whose crc32(id as
    text) mod 4 is not 2; an id with contradictory labels teaches nothing, and of repeated
    rows of an id the least text counts. Shares of the classes are counted over all such rows and set the
    intercept. None if the training rows lack one of the two classes.
    """
    spark = session(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id is not null and y in (0, 1)").where(crc_fold("id") != 2)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(count) < 2:
        return None
    chosen = []
    for y in (0, 1):
        part = known.where(F.col("y") == y)
        chosen += part.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(per_class).collect()
    kind = labels.schema[id_col].dataType
    ids = spark.createDataFrame([(r.id, r.y) for r in chosen], StructType([StructField("id", kind), StructField("y", IntegerType())]))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.join(F.broadcast(ids), "id")  # 2 * per_class ids
    # one row an id, so that repeated rows don't swell the sample
    picked = picked.groupBy("id", "y").agg(F.min("text").alias("text"))
    picked = picked.select(numbered(picked, "id").alias("id"), "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(sparse_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1))],
                ["id", "y", "buckets", "shares"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        got.sort(key=lambda r: (r[0], r[2]))
        y = np.array([r[1] for r in got], np.int64)
        if len(set(y.tolist())) < 2:
            return
        rows = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got]
        del got
        odds = float(np.log((y == 1).sum() / (y == 0).sum()))
        made = [a.astype(np.float32).tobytes() for a in fit(rows, y, epochs, seed)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([m], pa.binary()) for m in made), pa.array([odds])], ["vectors", "rarity", "weights", "bias", "odds"]
        )

    # the sample is bounded, so one task can learn from it; the driver gets the model alone
    sample = picked.mapInArrow(features, "id long, y int, buckets binary, shares binary").repartition(1)
    made = sample.mapInArrow(learn, "vectors binary, rarity binary, weights binary, bias binary, odds double").first()
    if made is None:
        return None
    v, rarity, w, b = (np.frombuffer(m, np.float32) for m in made[:4])
    shift = np.log(count[1] / count[0]) - made.odds
    return Model(v.reshape(-1, DIM), rarity, w.reshape(DIM, 2), b, float(shift))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` per input row; whole texts, null as empty.

    Empty texts have the classes' prior score. Without a model every score is 0. Other
    columns are not read; repeated rows are scored each.
    """
    spark = session(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast((model.table(), model.intercept()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = sent.value
        for batch in batches:
            out = []
            for i, j, stream, at in text_chunks(batch.column(1)):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for places, bucket in buckets(stream, SIZES, BITS):
                    cut = np.searchsorted(places, np.append(at, len(stream)))
                    sums = np.append(0.0, np.cumsum(table[bucket], dtype=np.float64))
                    total += sums[cut[1:]] - sums[cut[:-1]]
                    n += np.diff(cut)
                out.append(total / (n + NEUTRAL) + intercept)
            z = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"]
            )

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
