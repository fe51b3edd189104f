"""MinHash near-dedup: banded universal-hash minima, verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import numbered, with_least
from .runtime import materialise, release, session, tidy
from .stars import LANES, exact_components, pairs_to_compare
from .words import U, chunks, grams, mix, sequence_hash

#: Six minima a band: two sets of similarity 0.8 share none of 48 bands once in two million.
BANDS, ROWS = 48, 6


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``n`` multiply-add hash functions modulo 2**64."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct hashes of the ``k``-word shingles of each text, for runs of texts."""
    for i, j, w in chunks(texts, "space", True):
        g = grams(w.hashes, k)
        out = []
        for t in range(j - i):
            a, b = int(w.offsets[t]), int(w.offsets[t + 1])
            if b - a >= k:
                out.append(np.unique(g[a : b - k + 1]))
            elif b > a:
                out.append(np.array([sequence_hash(w.hashes[a:b])], U))
            else:
                out.append(np.zeros(0, U))
        yield out


def _signatures(rows: DataFrame, k: int, bands: int, per: int, seed: int) -> DataFrame:
    mult, add = universal(bands * per, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_no = mix(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            size, h1, h2, keys, small = [], [], [], [], []
            for sets in shingle_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets])
                size.append(n)
                full = np.flatnonzero(n)
                one, two = np.zeros(len(sets), U), np.zeros(len(sets), U)
                sig = np.zeros((len(sets), bands * per), U)
                if len(full):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(n) - n)[full]
                    one[full] = np.add.reduceat(mix(flat + U(1)), starts)
                    two[full] = np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), starts)
                    buffer = np.empty_like(flat)
                    for h in range(bands * per):
                        np.multiply(flat, mult[h], out=buffer)
                        buffer += add[h]
                        sig[full, h] = np.minimum.reduceat(buffer, starts)
                h1.append(one)
                h2.append(two)
                band = np.broadcast_to(band_no, (len(sets), bands)).copy()
                for r in range(per):
                    band = mix(band ^ sig[:, r::per][:, :bands]) * U(0x9E3779B97F4A7C15)
                keys.append(band.view(np.int64))
                lanes = (mix(sig[:, :LANES]) & U(3)) << (U(2) * (np.arange(LANES, dtype=U) % U(32)))
                small.append(np.bitwise_or.reduce(lanes.reshape(len(sets), 2, 32), axis=2))
            if not size:
                continue
            band = np.concatenate(keys)
            lists = pa.ListArray.from_arrays(np.arange(len(band) + 1, dtype=np.int32) * bands, band.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(size), pa.int64()),
                    pa.array(np.concatenate(h1).view(np.int64)),
                    pa.array(np.concatenate(h2).view(np.int64)),
                    lists,
                    *(pa.array(np.concatenate(small)[:, i].copy().view(np.int64)) for i in (0, 1)),
                ],
                ["id", "n", "h1", "h2", "bands", "sketch1", "sketch2"],
            )

    return rows.mapInArrow(
        run, "id long, n long, h1 long, h2 long, bands array<long>, sketch1 long, sketch2 long"
    )


def _elements(texts: DataFrame, k: int) -> DataFrame:
    """Full shingle sets ``(node, payload)`` of ``(node, text)``, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for sets in shingle_sets(batch.column(1), k) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "payload"])

    return texts.mapInArrow(run, "node long, payload binary")


def differing(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v, a, b, ...)``, whose a and b are the sets of u and v, with set sizes nu and
    nv, the elements that only u has (more) and those that only v has (less) instead."""

    kept = [c for c in pairs.columns if c not in ("a", "b", "nu", "nv")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv, more, less = [], [], [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = b[at] == a
                only = np.ones(len(b), bool)
                only[at[both]] = False
                nu.append(len(a))
                nv.append(len(b))
                more.append(a[~both].view(np.int64))
                less.append(b[only].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (more, less)]
            cols = [*batch.columns[2:], pa.array(nu, pa.int32()), pa.array(nv, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "nu", "nv", "more", "less"])

    rows = pairs.select("a", "b", *kept)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"{head}, nu int, nv int, more array<long>, less array<long>")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    unlike_texts: bool = True,
) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of ``percent`` or more.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct
    ``shingle``-word runs (of a shorter text, its whole sequence).

    1. Equal sets become one node (the least id), so exact copies cost one row each.
    2. Nodes that share a band are a bucket. Members that look like its pivot, or like
       another member, by sketches of the signatures, are compared with it on full sets.
    3. Nodes that were compared with one pivot and are not in one component are compared
       by how they differ from it. So every pair of a bucket is compared, joined before or
       refused by its sketches, and no bucket's pairs are rows.

    Returns per input row doc_id, n_shingles, component_id (least id reachable) and kept
    (doc_id = component_id). Null, empty and blank texts have an empty set and link with
    nothing. A row with a null id links with nothing: component_id is null and kept true.
    Rows with an equal id are judged each by its own text, unless ``unlike_texts`` is false:
    then it is known that they are equal. Ids may be of any type that can
    be ordered. Other columns are not read.
    """
    session(docs)
    texts = docs.select(F.col(id_col).alias("doc_id"), numbered(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(_signatures(texts.select("id", "text"), shingle, bands, rows, seed), "signatures")
    usable = signed.where("id is not null and n > 0")
    if unlike_texts:
        apart = usable.groupBy("id").agg((F.min("h1") < F.max("h1")).alias("h1"), (F.min("h2") < F.max("h2")).alias("h2"))
        if not apart.where("h1 or h2").isEmpty():
            release(signed)
            return _by_text(docs, shingle, percent, bands, rows, seed, id_col, text_col)
    sets = materialise(usable.groupBy("h1", "h2").agg(F.min("id").alias("node")), "sets", signed.count())

    chosen = usable.join(sets.select("h1", "h2", F.col("node").alias("id")), ["h1", "h2", "id"], "left_semi")
    flat = chosen.select(F.explode("bands").alias("key"), F.col("id").alias("node"), "sketch1", "sketch2")
    pairs = pairs_to_compare(flat, percent)

    near = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # neither side is bounded, so this is one shuffle of the texts at any size
    near = texts.join(near.hint("shuffle_hash"), texts.id == near.node).select("node", "text")
    full = materialise(_elements(near, shingle).where(F.length("payload") > 0).dropDuplicates(["node", "payload"]), "elements", 2 * pairs.count())

    def differ(rows: DataFrame) -> DataFrame:
        met = rows.join(full.select(F.col("node").alias("v"), F.col("payload").alias("b")), "v")
        return differing(met.join(full.select(F.col("node").alias("u"), F.col("payload").alias("a")), "u"))

    sized = differ(pairs).withColumns({"n_more": F.size("more"), "n_less": F.size("less")})
    linked = 100 * (F.col("nu") - F.col("n_more")) >= percent * (F.col("nv") + F.col("n_more"))
    verified = materialise(sized.withColumn("linked", linked).drop("more", "less"), "compared")
    tidy(docs.sparkSession)
    tables = [pairs, full]

    def differ_once(rows: DataFrame) -> DataFrame:
        tables.append(materialise(differ(rows), "differing"))
        return tables[-1]

    found = exact_components(verified, percent, differ_once)
    release(*tables)

    label = sets.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("set_component"))
    label = materialise(label, "labels")
    release(verified, found, sets)
    own = signed.select("id", "n", "h1", "h2")
    if not dict(texts.dtypes)["doc_id"] == "bigint":
        # ids of other types come with their rows' hashed ids
        names = texts.select("doc_id", F.col("id").alias("own")).distinct()
        own = own.join(names, own.id.eqNullSafe(names.own)).drop("own")
    else:
        own = own.withColumn("doc_id", F.col("id"))
    out = own.join(label, ["h1", "h2"], "left")
    out = with_least(out, F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set_component")), "doc_id")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _by_text(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` where one id has unlike texts: rows are named by id and text, and
    the least id is taken at the end."""
    text = F.col(text_col).cast("string")
    named = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    keyed = docs.select(F.when(F.col(id_col).isNotNull(), named).alias("doc_id"), text.alias("text"))
    found = near_duplicates(keyed, shingle, percent, bands, rows, seed, unlike_texts=False)
    return found.select(
        F.col("doc_id.id").alias("doc_id"),
        "n_shingles",
        F.col("component_id.id").alias("component_id"),
        F.coalesce(F.col("component_id.id") == F.col("doc_id.id"), F.lit(True)).alias("kept"),
    )
