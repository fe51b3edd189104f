"""Substring dedup: recurring word passages, found again by phrase automata and cut out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, release, session, tidy
from .words import U, chunks, grams, joined

#: Windows of the passages of one automaton, about, and texts that one task streams through it:
#: compiling an automaton takes about as long as streaming several thousand texts.
SHARD_WORDS, SHARD_TEXTS = 1 << 19, 16_000

#: Places of blocks that are compared with a text at once, about.
PLACES = 1 << 18


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words, the least hash among its runs of ``gram`` words.

    It depends on the window's words alone, so equal windows have equal anchors, and
    neighbouring windows mostly share one.
    """
    g = grams(hashes, gram)
    width = window - gram + 1
    if len(g) < width:
        return np.zeros(0, U)
    low, step = g, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _digest(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sha, found, times = [], [], [], []
            for i, j, w in chunks(batch.column(3), "space", False):
                for k in range(j - i):
                    a, b = w.offsets[k], w.offsets[k + 1]
                    n_words.append(b - a)
                    sha.append(hashlib.sha256(joined(w, a, b)).hexdigest())
                    picked = np.unique(anchors(w.hashes[a:b], window, gram))
                    g = np.sort(grams(w.hashes[a:b], gram)) if len(picked) else picked
                    count = np.searchsorted(g, picked, "right") - np.searchsorted(g, picked)
                    found.append(picked.view(np.int64))
                    times.append(np.minimum(count, 2).astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(n_words, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(times, pa.list_(pa.int8())),
                ],
                ["doc_id", "k1", "k2", "n_words", "sha", "anchors", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, n_words long, sha string, anchors array<long>, times array<tinyint>"
    )


def _windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Starts and hashes of the windows whose anchor recurs, for one copy of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recurring = batch.column(4)
            starts, hashes = [], []
            for i, j, w in chunks(batch.column(3), "space", False):
                for k in range(j - i):
                    h = w.hashes[w.offsets[k] : w.offsets[k + 1]]
                    known = np.sort(np.array(recurring[i + k].values.to_numpy(), np.int64)).view(U)
                    known.sort()
                    own = anchors(h, window, gram)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    s = np.flatnonzero(known[at] == own)
                    starts.append(s.astype(np.int32))
                    hashes.append(grams(h, window)[s].view(np.int64))
            cols = [pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], ["k1", "k2", "copies", "text", "starts", "hashes"])

    return texts.mapInArrow(run, "k1 long, k2 long, copies long, text string, starts array<int>, hashes array<long>")


def passages(starts: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Word spans of the runs of consecutive recurring windows."""
    starts = np.unique(starts)
    edges = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    for a, b in zip(edges, np.append(edges[1:], len(starts)), strict=True):
        yield int(starts[a]), int(starts[b - 1]) + window


#: Letters that stand for one word, each of an alphabet of its own: matches start at words,
#: and no node of an automaton has more children than an alphabet has letters.
LETTERS, ALPHABET = 4, 64


def spelled(numbers: np.ndarray) -> str:
    """LETTERS characters for each word number (below ALPHABET ** LETTERS)."""
    place = np.arange(LETTERS)
    digits = numbers[:, None] // ALPHABET**place % ALPHABET + ALPHABET * place + 1
    return digits.astype(np.uint32).tobytes().decode("utf-32-le")


class Passages:
    """An Aho-Corasick automaton that locates what stands of recurring passages in a text.

    A text may hold part of a passage, a window or more. Passages are therefore cut into
    blocks of half a window: any window of a passage holds a whole block. The automaton
    finds the blocks. Blocks that follow each other in a passage and in the text alike are
    one match, which is extended word by word at both ends; matches of a window or more
    are what the text has of the passages. What streams through the automaton is the text
    around its runs of ``gram`` words that are anchors of the passages' windows: each
    window of a passage holds its anchor, wherever it stands.
    """

    def __init__(self, found: list[np.ndarray], window: int, gram: int = 8) -> None:
        self.window, self.block, self.gram = window, (window + 1) // 2, gram
        self.anchors = np.unique(np.concatenate([*(anchors(p, window, gram) for p in found), np.zeros(0, U)]))
        self.words = np.unique(np.concatenate([*found, np.zeros(0, U)]))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        size = self.block * LETTERS
        edge = np.full(self.block, -1)
        flat, at, places = [edge], self.block, []
        for p in found:
            numbers = np.searchsorted(self.words, p) + 1
            text = spelled(numbers)
            for start in range(0, len(p) - self.block + 1, self.block):
                key = text[start * LETTERS : start * LETTERS + size]
                known = self.automaton.get(key, len(places))
                if known == len(places):
                    self.automaton.add_word(key, known)
                    places.append([])
                places[known].append(at + start)
            # nothing equals an edge, so no match goes beyond its passage
            flat += [numbers, edge]
            at += len(p) + self.block
        self.flat = np.concatenate(flat)
        self.places = np.array([x for p in places for x in p], np.int64)
        self.first = np.append(0, np.cumsum([len(p) for p in places])).astype(np.int64)
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the word spans that windows of the passages cover."""
        places = self._around_anchors(hashes)
        # no word of the passages is zero, so nothing is found across a gap
        starts, ends = self._matched(np.where(places < 0, U(0), hashes[places]))
        return places[starts], places[ends - 1] + 1

    def _around_anchors(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the words that windows around the passages' anchors hold, with -1 for
        each gap."""
        n, g = len(hashes), grams(hashes, self.gram)
        if not len(self.anchors) or not len(g):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.anchors, g), len(self.anchors) - 1)
        met = np.flatnonzero(self.anchors[at] == g)
        near = np.zeros(n + 1, np.int32)
        np.add.at(near, np.maximum(0, met - (self.window - self.gram)), 1)
        np.add.at(near, np.minimum(n, met + self.window), -1)
        kept = np.flatnonzero(np.cumsum(near[:n]) > 0)
        return np.insert(kept, np.flatnonzero(np.diff(kept) > 1) + 1, -1)

    def _matched(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(hashes), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if n < self.window or not len(self.automaton):
            return none
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        numbers = np.where(self.words[at] == hashes, at + 1, 0)
        met = np.fromiter((x for found in self.automaton.iter(spelled(numbers)) for x in found), np.int64).reshape(-1, 2)
        if not len(met):
            return none
        text = np.concatenate([np.full(self.block, -2), numbers, np.full(self.block, -2)])
        covered = np.zeros(n + 2, np.int32)
        # a common block has many places: so many at once that arrays stay small. A block of a
        # chain that is cut here is extended as far as any window that holds it
        share = np.cumsum(self.first[met[:, 1] + 1] - self.first[met[:, 1]]) // PLACES
        for part in np.split(met, np.flatnonzero(np.diff(share)) + 1):
            self._cover(text, part, covered)
        edge = np.diff((np.cumsum(covered) > 0).view(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def _cover(self, text: np.ndarray, met: np.ndarray, covered: np.ndarray) -> None:
        """Count in ``covered`` where the matches of some blocks begin and end."""
        uses = self.first[met[:, 1] + 1] - self.first[met[:, 1]]
        turn = np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
        there = self.places[np.repeat(self.first[met[:, 1]], uses) + turn]
        here = np.repeat((met[:, 0] + 1) // LETTERS - self.block, uses)
        order = np.lexsort((here, here - there))
        here, there = here[order], there[order]
        apart = (np.diff(here) != self.block) | (np.diff(there) != self.block)
        first, last = np.flatnonzero(np.append(True, apart)), np.flatnonzero(np.append(apart, True))
        # a whole block more would have been found, so fewer words are left to extend by
        starts = here[first] - self._run(text, here[first] + self.block, there[first], -1)
        ends = here[last] + self.block
        ends = ends + self._run(text, ends + self.block - 1, there[last] + self.block - 1, 1)
        long = ends - starts >= self.window
        np.add.at(covered, starts[long] + 1, 1)
        np.add.at(covered, ends[long] + 1, -1)

    def _run(self, text: np.ndarray, here: np.ndarray, there: np.ndarray, step: int) -> np.ndarray:
        """How many words, fewer than a block, are equal on from each pair of places."""
        out = np.zeros(len(here), np.int64)
        going = np.arange(len(here))
        for d in range(1, self.block):
            going = going[text[here[going] + step * d] == self.flat[there[going] + step * d]]
            if not len(going):
                break
            out[going] = d
        return out


def _patterns(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Word hashes of the passages of ``(row, text, starts)``, one row each, with the anchors
    of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words, met = [], [], []
            for i, j, w in chunks(batch.column(1), "space", False):
                for k in range(j - i):
                    h = w.hashes[w.offsets[k] : w.offsets[k + 1]]
                    for a, b in passages(batch.column(2)[i + k].values.to_numpy(), window):
                        row.append(batch.column(0)[i + k].as_py())
                        words.append(h[a:b].tobytes())
                        met.append(np.unique(anchors(h[a:b], window, gram)).view(np.int64))
            cols = [pa.array(row, pa.int64()), pa.array(words, pa.binary()), pa.array(met, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "words", "anchors"])

    return texts.mapInArrow(run, "row long, words binary, anchors array<long>")


def _located(dealt: DataFrame, window: int, gram: int) -> DataFrame:
    """Covered spans of the texts of ``(shard, salt, k1, k2, words, text)``, by shard and salt
    sorted so that its passages (words) come before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, automaton = None, [], None
        for batch in batches:
            k1, k2, starts, ends = [], [], [], []
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            is_text = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if key[i] != own:
                    own, waiting, automaton = key[i], [], None
                if not is_text[i]:
                    waiting.append(np.frombuffer(batch.column(4)[i].as_py(), U))
                    continue
                if automaton is None:
                    automaton, waiting = Passages(waiting, window, gram), []
                for _, _, w in chunks(batch.column(5).slice(i, 1), "space", False):
                    a, b = automaton.spans(w.hashes)
                    k1.append(batch.column(2)[i].as_py())
                    k2.append(batch.column(3)[i].as_py())
                    starts.append(a.astype(np.int32))
                    ends.append(b.astype(np.int32))
            cols = [*(pa.array(c, pa.int64()) for c in (k1, k2)), *(pa.array(c, pa.list_(pa.int32())) for c in (starts, ends))]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "starts", "ends"])

    return dealt.mapInArrow(run, "k1 long, k2 long, starts array<int>, ends array<int>")


def _cut(texts: DataFrame) -> DataFrame:
    """What is left of the texts of ``(k1, k2, text, starts, ends)`` without the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, kept_text = [], [], []
            for i, j, w in chunks(batch.column(2), "space", False):
                for k in range(j - i):
                    a, b = w.offsets[k], w.offsets[k + 1]
                    step = np.zeros(b - a + 1, np.int32)
                    np.add.at(step, batch.column(3)[i + k].values.to_numpy(), 1)
                    np.add.at(step, batch.column(4)[i + k].values.to_numpy(), -1)
                    keep = np.cumsum(step[:-1]) == 0
                    rest = joined(w, a, b, keep)
                    removed.append(int((~keep).sum()))
                    kept_text.append(rest.decode())
                    sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                ["k1", "k2", "n_removed", "kept_sha256", "kept_text"],
            )

    return texts.mapInArrow(run, "k1 long, k2 long, n_removed long, kept_sha256 string, kept_text string")


def cut_passages(
    docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove each word inside a window of ``window`` words that starts anywhere else too.

    1. Every window's anchor is the least hash of its ``gram``-word runs; anchors that
       occur once in the corpus rule their windows out (about one anchor in 14 words).
    2. The other windows are confirmed by counting their hashes over all texts; copies of
       a whole text count with their number but are worked on once. Of each confirmed window
       one place is kept; runs of such places are the passages, each confirmed window in one.
    3. Passages are dealt to shards of about SHARD_WORDS words and compiled to an
       Aho-Corasick automaton a shard. Each text with a recurring anchor streams through the
       shards that hold a window with that anchor, whatever text its passage came from, and
       its words to remove come from the matches alone. A shard that very many texts visit
       is copied to several tasks.

    Returns per input row doc_id, n_words, n_removed, kept_sha256 (of the words kept,
    joined by one space) and kept_text (null where nothing was removed). Null texts have
    no words. Rows with equal texts remove each other, repeated ids too. Texts shorter
    than a window stay. Other columns are not read.
    """
    session(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")
    )
    digests = materialise(_digest(rows, window, gram), "digests")

    one = digests.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("anchors").alias("anchors"), F.first("times").alias("times")
    )
    one = materialise(one.where(F.size("anchors") > 0), "texts")
    each = one.select("k1", "k2", "copies", "rep", F.explode(F.arrays_zip("anchors", "times")).alias("z"))
    each = each.select("k1", "k2", "copies", "rep", F.col("z.anchors").alias("anchor"), F.col("z.times").alias("times"))
    again = each.groupBy("anchor").agg(F.sum(F.col("times") * F.col("copies")).alias("n"))
    again = materialise(again.where("n >= 2").select("anchor"), "anchors")
    seen = each.join(again, "anchor")
    wanted = seen.groupBy("k1", "k2").agg(
        F.first("copies").alias("copies"), F.first("rep").alias("rep"), F.collect_list("anchor").alias("anchors")
    )
    wanted = materialise(wanted, "wanted")
    release(one, again)

    is_rep = F.col("doc_id").eqNullSafe(F.col("rep"))
    texts = rows.join(wanted, ["k1", "k2"]).where(is_rep).select("k1", "k2", "copies", "text", "anchors")
    found = _windows(texts, window, gram).where(F.size("starts") > 0)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "windows")
    tidy(docs.sparkSession)  # the texts' shuffle files

    flat = found.select("row", "copies", F.explode(F.arrays_zip("starts", "hashes")).alias("z"))
    flat = flat.select("row", "copies", F.col("z.starts").alias("start"), F.col("z.hashes").alias("hash"))
    sure = flat.groupBy("hash").agg(F.sum("copies").alias("n"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"))
    sure = materialise(sure.where("n >= 2").select("row", "start"), "confirmed")
    tidy(docs.sparkSession)  # the shuffle of all windows
    shards = max(1, -(-sure.count() // SHARD_WORDS))
    spots = sure.groupBy("row").agg(F.collect_list("start").alias("starts"))
    patterns = _patterns(found.join(spots, "row").select("row", "text", spots["starts"]), window, gram)
    patterns = materialise(patterns, "patterns")

    # passages of texts that share anchors go to one shard, so that a text visits few; where
    # very many share one, their passages are dealt to several shards of about equal size
    each = wanted.select("k1", "k2", F.explode("anchors").alias("anchor"))
    least = patterns.select("row", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("row").alias("least"))
    family = each.join(least, "anchor").groupBy("k1", "k2").agg(F.min("least").alias("family"))
    family = found.select("row", "k1", "k2").join(family, ["k1", "k2"]).select("row", "family")
    named = patterns.join(family, "row", "left").select(F.coalesce("family", "row").alias("family"), "words", "anchors")
    named = materialise(named, "families")
    large = named.groupBy("family").agg(F.ceil(F.sum(F.length("words")) / (8 * SHARD_WORDS)).cast("int").alias("pieces"))
    large = materialise(large.where("pieces > 1"), "large")
    dealt = named.join(large, "family", "left")
    piece = F.pmod(F.xxhash64("words"), F.coalesce("pieces", F.lit(1)))
    # a family of several pieces fills shards of its own
    shard = F.when(F.col("pieces") > 1, -1 - F.pmod(F.xxhash64("family", piece), F.lit(1 << 40)))
    shard = F.coalesce(shard, F.pmod(F.xxhash64("family"), F.lit(shards))).alias("shard")
    dealt = materialise(dealt.select(shard, "words", "anchors"), "shards")
    release(patterns, named, large)
    patterns = dealt

    routes = patterns.select(F.explode("anchors").alias("anchor"), "shard").distinct()
    visits = each.join(routes, "anchor")
    visits = materialise(visits.select("k1", "k2", "shard").distinct(), "visits")
    tidy(docs.sparkSession)
    salts = visits.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_TEXTS).cast("int").alias("salts"))
    salts = materialise(salts, "salts")
    salt = F.pmod(F.xxhash64("k1", "k2"), "salts").cast("int").alias("salt")
    salted = visits.join(salts, "shard").select("k1", "k2", "shard", salt)
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    dealt = patterns.join(salts, "shard").select("shard", every, "words")
    streams = found.select("k1", "k2", "text").join(salted, ["k1", "k2"])
    dealt = dealt.unionByName(streams, allowMissingColumns=True).select("shard", "salt", "k1", "k2", "words", "text")
    dealt = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("words").isNull())
    spans = _located(dealt, window, gram).where(F.size("starts") > 0).groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    spans = materialise(spans, "spans")
    tidy(docs.sparkSession)  # the texts that visited shards
    left = found.select("k1", "k2", "text").join(spans, ["k1", "k2"])
    cut = materialise(_cut(left.select("k1", "k2", "text", "starts", "ends")).dropDuplicates(["k1", "k2"]), "cut")
    release(wanted, found, sure, patterns, visits, salts, spans)
    tidy(docs.sparkSession)
    return digests.select("doc_id", "k1", "k2", "n_words", "sha").join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept_text",
    )
