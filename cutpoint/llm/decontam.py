"""Benchmark decontamination with suffix arrays over shards of the training words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, release, session
from .substrings import anchors
from .words import U, chunks

#: Words of a shard, about; one longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text that one pass over the documents may broadcast.
PASS_BYTES = 16 << 20

#: Words of the runs whose least hash is a window's anchor, where several passes are needed.
GRAM = 4

OUT = (
    "doc_id {id}, text_key struct<a:long,b:long>, n_words long, starts array<int>, ends array<int>, "
    "items array<string>, longest int, longest_item string, longest_at int"
)


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` in order of the ``depth`` or more words that follow each.

    Prefix doubling: suffixes are ordered by one word, then by 2, 4, 8 and so on, each
    time only those that are still tied.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.ones(n, bool)
    sorted_x = x[order]
    new[1:] = sorted_x[1:] != sorted_x[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while h < depth:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        sub = order[tied]
        key = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[tied] = sub
        new[tied[1:]] = key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(new[tied], tied, 0))
        rank[sub] = group
        h *= 2
    return order


def bound(
    x: np.ndarray, order: np.ndarray, q: np.ndarray, at: np.ndarray, width: np.ndarray, upper: bool
) -> np.ndarray:
    """Binary search, for every test suffix ``q[at:]`` cut to ``width`` words at once.

    The first place in ``order`` whose suffix is not below it (``upper``: is above it).
    ``x`` ends with enough zeros to be read ``width`` words beyond any place.
    """
    low = np.zeros(len(at), np.int64)
    high = np.full(len(at), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        live = np.flatnonzero(open_)
        below = np.zeros(len(at), bool)
        here = order[mid[live]]
        d = 0
        while len(live):
            done = width[live] <= d
            if done.any():
                below[live[done]] = upper
                live, here = live[~done], here[~done]
                continue
            a, b = x[here + d], q[at[live] + d]
            below[live[a < b]] = True
            same = a == b
            live, here = live[same], here[same]
            d += 1
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


@dataclass
class Tests:
    """All test words, each item's followed by a zero, with what is searched for.

    Distinct windows: a place and a width, and the items that hold each (``items`` between
    ``item_cut``). Suffixes: ``order`` sorts the places of all words, ``left`` counts the
    words from a place to its item's end, ``item`` names the item of a place.
    """

    words: np.ndarray
    at: np.ndarray
    width: np.ndarray
    items: np.ndarray
    item_cut: np.ndarray
    order: np.ndarray
    left: np.ndarray
    item: np.ndarray
    ids: list[str | None]

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str | None], window: int) -> Tests:
        words, at, width, item, left, place_item = [], [], [], [], [], []
        total = 0
        for i, j, w in chunks(pa.array(texts, pa.large_string()), "alnum", True):
            for k in range(i, j):
                h = w.hashes[w.offsets[k - i] : w.offsets[k - i + 1]]
                if not len(h):
                    continue
                n = min(window, len(h))
                places = np.arange(len(h) - n + 1)
                at.append(total + places)
                width.append(np.full(len(places), n))
                item.append(np.full(len(places), k))
                words += [h, np.zeros(1, U)]
                left.append(np.arange(len(h), -1, -1))
                place_item.append(np.full(len(h) + 1, k))
                total += len(h) + 1
        cat = lambda x, kind=np.int64: np.concatenate([np.zeros(0, kind), *x])
        words, at, width, item, left = cat(words, U), cat(at), cat(width), cat(item), cat(left)
        order = suffix_array(words, int(left.max(initial=0))) if len(words) else np.zeros(0, np.int64)
        order = order[left[order] > 0]
        longest = int(left.max(initial=0))
        padded = np.append(words, np.zeros(max(longest, window) + 1, U))
        # equal windows stand together in the order: the first of each stands for all
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((rank[at], width)) if len(at) else at
        at, width, item = at[by], width[by], item[by]
        new = np.ones(len(at), bool)
        if len(at):
            same = width[1:] == width[:-1]
            for d in range(window):
                same &= (d >= width[1:]) | (padded[at[1:] + d] == padded[at[:-1] + d])
            new[1:] = ~same
        which = np.cumsum(new) - 1
        held = np.unique(np.stack([which, item], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        cut = np.searchsorted(held[:, 0], np.arange(int(new.sum()) + 1))
        return cls(padded, at[new], width[new], held[:, 1], cut, order, left, cat(place_item), ids)


def _gather(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``count`` of them."""
    return np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def longest_matches(x: np.ndarray, place: np.ndarray, room: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """By place in ``x``: the most words (``room`` at most) that follow in any item too, and
    one test place where they stand. It is next to where the suffix would be inserted."""
    at = bound(tests.words, tests.order, x, place, room, False)
    best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for step in (0, -1):
        near = tests.order[np.clip(at + step, 0, len(tests.order) - 1)]
        most = np.minimum(room, tests.left[near])
        length = np.zeros(len(place), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            live = live[x[place[live] + length[live]] == tests.words[near[live] + length[live]]]
            length[live] += 1
            live = live[length[live] < most[live]]
        more = length > best
        best, where = np.where(more, length, best), np.where(more, near, where)
    return best, where


def search(docs: list[np.ndarray], tests: Tests) -> list[tuple]:
    """For each document's words: merged hit spans, items, and its longest match."""
    sizes = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum())
    longest = int(tests.left.max(initial=0))
    x = np.zeros(n + longest + 1, U)
    for b, d in zip(begin, docs, strict=True):
        x[b : b + len(d)] = d
    out: list[tuple] = [((), (), (), 0, None, None)] * len(docs)
    if not len(tests.at) or not sizes.sum():
        return out
    order = suffix_array(x[:n], int(tests.width.max()))
    low = bound(x, order, tests.words, tests.at, tests.width, False)
    count = bound(x, order, tests.words, tests.at, tests.width, True) - low
    if not count.sum():
        return out
    which = np.repeat(np.arange(len(count)), count)
    place = order[_gather(low, count)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + tests.width[which], -1)
    covered = np.cumsum(step)[:n] > 0
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    span_doc = np.searchsorted(begin, starts, "right") - 1
    spots = np.unique(place)
    doc = np.searchsorted(begin, spots, "right") - 1
    length, where = longest_matches(x, spots, np.minimum(begin[doc] + sizes[doc] - spots, longest), tests)
    best = np.lexsort((spots, -length, doc))
    first = best[np.append(True, doc[best][1:] != doc[best][:-1])]
    # a window that very many items share is found once, and its items are read by document
    pairs = np.unique(np.stack([np.searchsorted(begin, place, "right") - 1, which], 1), axis=0)
    cut = np.searchsorted(span_doc, np.arange(len(docs) + 1))
    pair_cut = np.searchsorted(pairs[:, 0], np.arange(len(docs) + 1))
    for f in first:
        k = doc[f]
        s = slice(cut[k], cut[k + 1])
        own = pairs[pair_cut[k] : pair_cut[k + 1], 1]
        held = np.unique(tests.items[_gather(tests.item_cut[own], tests.item_cut[own + 1] - tests.item_cut[own])])
        found = {tests.ids[i] for i in held} - {None}
        out[k] = (
            (starts[s] - begin[k]).tolist(), (ends[s] - begin[k]).tolist(), sorted(found),
            int(length[f]), tests.ids[tests.item[where[f]]], int(spots[f] - begin[k]),
        )
    return out


def _pass(rows: DataFrame, tests: Tests, out: str, window: int = 0) -> tuple[DataFrame, Broadcast]:
    """What ``tests`` hit in ``rows(doc_id, text_key, text)``; with a ``window``, the anchors of
    each text's windows too."""
    sent = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        words: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            got = search(words, sent.value)
            cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), TYPES, strict=True)]
            n_words = pa.array([len(w) for w in words], pa.int64())
            head = pa.Table.from_batches(ids).combine_chunks()
            names = ["doc_id", "text_key", "n_words", "starts", "ends", "items", "longest", "longest_item", "longest_at"]
            arrays = [*(c.combine_chunks() for c in head.columns), n_words, *cols]
            if window:
                names.append("anchors")
                arrays.append(pa.array([_anchors(w, window) for w in words], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            texts = batch.column(2)
            for i, j, w in chunks(texts, "alnum", True):
                ids.append(batch.select([0, 1]).slice(i, j - i))
                words += np.split(w.hashes, w.offsets[1:-1])
                total += len(w.hashes) + j - i
                if total >= SHARD_WORDS:
                    yield flush()
                    ids, words, total = [], [], 0
        if words:
            yield flush()

    return rows.mapInArrow(run, out + (", anchors array<long>" if window else "")), sent


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    return np.unique(anchors(hashes, window, min(GRAM, window))).view(np.int64)


def _measured(items: DataFrame, window: int) -> DataFrame:
    """``items(id, text)`` with n, their words, and the anchors of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for i, j, w in chunks(batch.column(1), "alnum", True):
                own = np.split(w.hashes, w.offsets[1:-1])[: j - i]
                n += map(len, own)
                found += [_anchors(h, window) for h in own]
            cols = [pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], ["id", "text", "n", "anchors"])

    return items.mapInArrow(run, "id string, text string, n long, anchors array<long>")


TYPES = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """What of each document stands verbatim in benchmark items.

    Documents are cut into shards of about a million words inside tasks; a shard's suffix
    array is searched for every test suffix at once. A window is ``window`` consecutive
    words of an item (all words of a shorter one); an occurrence is extended to the
    longest match from there. Returns, one row per input row: doc_id, n_words, n_hit
    (words inside any window's occurrence), items (ids as text), longest (words of the
    longest match; 0 without hit), longest_item and longest_at (its item, its first word).

    Items are broadcast only up to ``pass_bytes`` of text. Of more items, those shorter than a
    window go first (should they alone be more, the documents are read once for each such
    part); in the same pass each text's windows get anchors, hashes that equal windows share.
    Texts that share an anchor with a longer item, one copy of each, are then searched for
    the parts of the items that they may hold, one part after the other, so that driver and
    workers hold one part's items at a time; the spans are united. So documents are read
    twice, however many the items. Equal windows of items are searched once. Null texts and items have no words; an item with a null id hits
    words but is not listed; items of an equal id count once; an empty benchmark hits
    nothing; other columns are not read. Of several longest matches the first counts.
    """
    session(docs)
    text = F.col(text_col).cast("string")
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), text.alias("text"))
    out = OUT.format(id=docs.schema[id_col].dataType.simpleString())
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.distinct()
    size = _bytes(items)
    if size <= pass_bytes:
        found, _ = _pass(rows, _tests(items, window), out)
        covered = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda acc, s: acc + s["ends"] - s["starts"])
        met = found.withColumn("n_hit", covered)
    else:
        met = _in_parts(rows, items, window, out, pass_bytes)
    return met.select("doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0


def _tests(items: DataFrame, window: int) -> Tests:
    got = items.select("id", "text").collect()  # about one pass's bytes of text
    return Tests.of([r.id for r in got], [r.text for r in got], window)


def _in_parts(rows: DataFrame, items: DataFrame, window: int, out: str, pass_bytes: int) -> DataFrame:
    """What items of any number hit: see ``contamination``."""
    measured = materialise(_measured(items, window).where("n > 0"), "items")
    short, long = measured.where(F.col("n") < window), measured.where(F.col("n") >= window)
    place = F.xxhash64("id", "text")
    several = -(-_bytes(short) // pass_bytes) or 1
    parts = []
    for p in range(several):
        found, sent = _pass(rows, _tests(short.where(F.pmod(place, F.lit(several)) == p), window), out, 0 if p else window)
        # the first pass names all rows, the others those with a hit
        parts.append(materialise(found if not p else found.where(F.size("starts") > 0), "pass"))
        sent.destroy()
    chunks_of = -(-_bytes(long) // pass_bytes) or 1
    chunk = F.pmod(place, F.lit(chunks_of)).alias("chunk")
    marks = long.select(F.explode("anchors").alias("anchor"), chunk).distinct()
    seen = parts[0].select("text_key", F.explode("anchors").alias("anchor"))
    wanted = seen.join(marks, "anchor").groupBy("text_key").agg(F.collect_set("chunk").alias("chunks"))
    texts = rows.join(wanted, "text_key").select("doc_id", "text_key", "text", "chunks").dropDuplicates(["text_key"])
    texts = materialise(texts, "candidates")
    for c in range(chunks_of):
        own = texts.where(F.array_contains("chunks", F.lit(c).cast("long"))).select("doc_id", "text_key", "text")
        found, sent = _pass(own, _tests(long.where(F.pmod(place, F.lit(chunks_of)) == c), window), out)
        parts.append(materialise(found.where(F.size("starts") > 0), "pass"))
        sent.destroy()
    release(texts, measured)
    return _unite([p.drop("anchors") for p in parts])


def _unite(parts: list[DataFrame]) -> DataFrame:
    """One row per row of the first part, from the spans of all; of a text's copies, what one
    hits all do."""
    every = parts[0].where(F.size("starts") > 0)
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    best = F.max_by(F.struct("longest", "longest_item", "longest_at"), F.struct("longest", -F.col("longest_at")))
    one = every.groupBy(F.col("text_key").alias("key")).agg(
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("best"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    union = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(acc["to"], s["starts"]))).alias("n"),
            F.greatest(acc["to"], s["ends"]).alias("to"),
        ),
    )
    one = one.select("key", union["n"].alias("hit"), "items", "best.*")
    rows = parts[0].select("doc_id", "text_key", "n_words")
    met = rows.join(one, F.col("text_key") == F.col("key"), "left")
    return met.withColumns(
        {
            "n_hit": F.coalesce("hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "longest": F.coalesce("longest", F.lit(0)),
        }
    )
