"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import buckets, text_chunks
from .runtime import crc_fold, session

SIZES = (2, 3)
BITS = 12
WIDTH = 1 << BITS
UNKNOWN = "und"
#: Languages up to which their counts are broadcast.
FEW_LANGUAGES = 10_000
#: Rows that each language gives to the sample at least, if it has them (about).
LEAST_ROWS = 20
#: Share of a centroid's sample rows that are farther from it than its rejection bound.
FAR_SHARE = 0.01


@dataclass
class Model:
    """Inverse document frequencies, unit centroids (a row each), the language of each, and
    the least cosine to each that a text of its language is expected to have."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """n-gram counts, a row for each text, for runs of texts."""
    for i, j, stream, at in text_chunks(texts):
        table = np.zeros((j - i) * WIDTH, np.int64)
        for places, bucket in buckets(stream, SIZES, BITS):
            doc = np.repeat(np.arange(j - i), np.diff(np.searchsorted(places, np.append(at, len(stream)))))
            table += np.bincount(doc * WIDTH + bucket, minlength=len(table))
        yield table.reshape(j - i, WIDTH)


def vectors(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; zero stays zero."""
    v = np.log1p(table.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids, the first chosen by spread."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        far = np.clip(1 - (x @ centres.T).max(1), 0, None)
        if far.sum() <= 1e-9:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm > 0, norm, 1)
    return centres


def train(
    docs: DataFrame,
    sample_rows: int = 3000,
    clusters: int = 4,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """Learn from rows with a language whose crc32(id as text) mod 4 is not 2.

    Document frequencies are counted over all of them. Centroids are clustered from about
    ``sample_rows`` rows (the documented bound, or LEAST_ROWS for each language if that is
    more), shared evenly by the languages and chosen by the hash of the id. The cosine
    that all but FAR_SHARE of a centroid's sample rows have to it is its rejection bound.
    None if there is no training row.
    """
    spark = session(docs)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    rows = rows.where("lang is not null and text is not null").where(crc_fold("id") != 2)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for table in counts(batch.column(0)):
                df += (table > 0).sum(0)
                n += len(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(WIDTH + 1)), pa.array(np.append(df, n))], ["bucket", "n"]
        )

    total = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in total.collect()}  # WIDTH + 1 rows
    n = found.get(WIDTH, 0)
    if not n:
        return None
    df = np.array([found.get(b, 0) for b in range(WIDTH)])
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    by_lang = rows.groupBy("lang").count()
    langs = by_lang.count()
    share = F.lit(max(LEAST_ROWS, sample_rows // max(1, langs))) / F.col("count")
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row per language; with so many that this is no small table, the planner decides
    by_lang = F.broadcast(by_lang) if langs <= FEW_LANGUAGES else by_lang
    sample = rows.join(by_lang, "lang").where(at < share).select("id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(np.flatnonzero(r), r[r > 0]) for table in counts(batch.column(2)) for r in table]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([k[i].astype(np.int32).tobytes() for k in kept], pa.binary()) for i in (0, 1))],
                ["id", "lang", "buckets", "counts"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(features, f"id {id_type}, lang string, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r.lang, str(r.id), r.buckets))
    rng = np.random.default_rng(seed)
    centres, names, least = [], [], []
    for lang in sorted({r.lang for r in got}):
        own = [r for r in got if r.lang == lang]
        table = np.zeros((len(own), WIDTH), np.float32)
        for k, r in enumerate(own):
            table[k, np.frombuffer(r.buckets, np.int32)] = np.frombuffer(r.counts, np.int32)
        x = vectors(table, idf)
        x = x[x.any(1)]
        if len(x):
            made = cluster(x, clusters, rng)
            centres.append(made)
            names += [lang] * len(made)
            cos = x @ made.T
            own = cos.argmax(1)
            least += [np.quantile(cos[own == c, c], FAR_SHARE) if (own == c).any() else 1.0 for c in range(len(made))]
    if not centres:
        return None
    return Model(idf, np.vstack(centres).astype(np.float32), names, np.array(least))


def identify(
    docs: DataFrame, model: Model | None, reject: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score, far)`` per input row from its whole text alone.

    The nearest centroid by cosine gives the language, the cosine the score; far tells
    that the cosine is below the centroid's bound, learned from the training sample. A
    text that is null or has no letter is ``und`` with score 0, and so is a far one, unless
    ``reject`` is false, and any text without a model. Other columns are not read;
    repeated rows are judged each.
    """
    spark = session(docs)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", letter.alias("letter"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("far"))
    sent = spark.sparkContext.broadcast(model)  # WIDTH numbers a centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            near, best = [], []
            for table in counts(batch.column(1)):
                cos = vectors(table, m.idf) @ m.centroids.T
                near.append(cos.argmax(1))
                best.append(cos.max(1))
            near = np.concatenate(near) if near else np.zeros(0, int)
            best = np.clip(np.concatenate(best) if best else np.zeros(0), 0, 1).astype(np.float64)
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            far = ~letter | (best < m.least[near])
            known = ~far if reject else letter
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.langs[c] if k else UNKNOWN for c, k in zip(near, known, strict=True)], pa.string()),
                    pa.array(np.where(known, best, 0.0)),
                    pa.array(far),
                ],
                ["doc_id", "lang_pred", "score", "far"],
            )

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, far boolean")
