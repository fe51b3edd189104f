import random
import time
import tracemalloc
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutpoint.llm import embeddings, lines, minhash, queries, runtime, stars, substrings

from . import plain


def check_docs(got, texts, shingle):
    sets = {i: plain.shingles(t, shingle) for i, t in enumerate(texts)}
    root = plain.least_reachable(list(sets), plain.near(sets, 80))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in sets
    }
    return root


def test_minhash_equals_brute_force(docs, texts):
    root = check_docs(minhash.near_duplicates(docs, shingle=2), texts, 2)
    assert len(set(root.values())) < len(texts) - 10


def test_minhash_loses_no_link_at_the_threshold(spark):
    """Copies whose similarities straddle the threshold: many links miss the pivots."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for at in rng.choice(120, rng.integers(0, 16), replace=False):
            copy[at] = f"r{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = check_docs(minhash.near_duplicates(docs, shingle=2), texts, 2)
    assert 1 < len(set(root.values())) < 40


def test_ids_of_other_types(spark):
    same = "a few words that two documents share"
    docs = spark.createDataFrame([("b", same), ("a", same), ("c", "other words"), (None, same), ("d", None)], "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True), "d": ("d", True)}
    rows = [("y", [1.0, 2.0], 1.2), ("x", [1.0, 2.0], 1.2), ("z", [1.0, 2.0], 1.7), ("w", [2.0, 4.1], 1.7), (None, [1.0, 2.0], 1.7)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect()}
    assert got == {"x": (1, "x", True), "y": (1, "x", False), "z": (1, "w", False), "w": (1, "w", True), None: (0, None, True)}


def test_cells_are_trained_in_little_memory():
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.normal(size=(40_000, 16)))
    tracemalloc.start()
    centres = embeddings.spherical_kmeans(x, 4096, seed=2, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (4096, 16) and most < 150 << 20


def test_borders_of_many_cells_take_little_memory():
    rng = np.random.default_rng(6)
    centres, x = (embeddings.unit(rng.normal(size=(n, 768))) for n in (1024, 600))
    tracemalloc.start()
    best, visits = embeddings.borders(x, centres, 0.1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    for i in range(0, 600, 50):
        cos = centres @ x[i]
        gap = (cos.max() - cos) / np.maximum(np.linalg.norm(centres - centres[best[i]], axis=1), 1e-300)
        assert best[i] == cos.argmax() and set(np.flatnonzero(gap <= 0.1)) - {best[i]} <= set(visits[i])


def test_minhash_messy(messy, empty):
    got = {r.doc_id: r for r in minhash.near_duplicates(messy, shingle=5).collect()}
    assert got[None].kept and got[None].component_id is None
    assert (got[2].n_shingles, got[2].component_id, got[2].kept) == (0, 2, True)
    assert (got[5].component_id, got[4].component_id, got[7].component_id) == (4, 4, 6)
    assert minhash.near_duplicates(messy).count() == messy.count()
    assert minhash.near_duplicates(empty).count() == 0


def test_lines_equal_brute_force(docs, texts):
    expected = plain.lines_removed(list(enumerate(texts)))
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert {i: [int(n) for n in r.removed.split(",") if n] for i, r in got.items()} == {i: expected.get(i, []) for i in got}
    kept = {r.doc_id: r.text for r in lines.dedupe_lines(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected.get(i, []))


def test_bands_and_sketches_lose_little():
    bands = (1 - 0.8**lines.ROWS) ** (lines.PARTS * lines.MINIMA // lines.ROWS)
    least, p = stars.least_agreement(80), 0.85  # two bits of a lane
    sketches = sum(comb(stars.LANES, i) * p**i * (1 - p) ** (stars.LANES - i) for i in range(least))
    assert sketches <= stars.LOSS and bands + sketches < 1 / 4100


def removed(got):
    return {r.doc_id: [int(n) for n in r.removed.split(",") if n] for r in got.collect()}


def test_lines_of_fifty_characters_are_forgiven_one_edit(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        own = rng.choice(list("abcdefghij klmnop"), 50)
        copy = own.copy()
        copy[25] = "#"
        texts.append(f"x{''.join(own)}x\nx{''.join(copy)}x")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain.lines_removed(list(enumerate(texts)), 5)
    assert removed(queries.op9_lines(spark, str(tmp_path))) == {i: expected.get(i, []) for i in range(len(texts))}
    assert len(expected) > 30


def test_bands_are_computed_and_shuffled_once(spark):
    """The sum of a bucket and the join with it read one shuffle; else both sign all lines."""
    table = spark.createDataFrame([(i, f"some line number {i}") for i in range(50)], "node long, line string")
    table = runtime.materialise_buckets(table, "x", "node")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = stars.bucket_members(lines.band_keys(table, 5), 43)
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        runtime.release(table)


def test_lines_of_families_at_the_threshold(spark):
    """Copies whose similarities straddle the threshold: many links miss the pivots."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(4):
        base = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(40)]
        for _ in range(120):
            copy = list(base)
            for at in rng.choice(40, rng.integers(0, 7), replace=False):
                copy[at] = "".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(0, 7)))
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), texts[t]) for i, t in enumerate(order)], "doc_id long, text string")
    expected = plain.lines_removed([(i, texts[t]) for i, t in enumerate(order)], 5)
    assert removed(lines.line_report(docs, shingle=5)) == {i: expected.get(i, []) for i in range(len(texts))}
    assert 200 < len(expected) < 470


def test_links_that_the_pivot_hides(spark):
    """Two lines too far from their pivot, but near each other, are linked by their differences."""
    pivot = set(range(200))
    sets = {1: pivot - set(range(30)) | {900 + i for i in range(20)}, 2: pivot - set(range(28)) | {900 + i for i in range(22)}, 3: pivot - set(range(100, 140)), 4: pivot - {5}}
    rows = [(u, 0, 7, 7, len(s), 200, len(s - pivot), len(pivot - s), 10 * len(s & pivot) >= 8 * len(s | pivot)) for u, s in sets.items()]
    schema = "u long, v long, sketch1 long, sketch2 long, nu int, nv int, n_more int, n_less int, linked boolean"
    verified = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([(0, 0), (4, 0), (3, 0)], "node long, component long")
    parts = spark.createDataFrame([(u, sorted(s - pivot), sorted(pivot - s)) for u, s in sets.items()], "u long, more array<long>, less array<long>")
    near = {(a, b) for a, b in plain.near(sets, 80) if not {a, b} <= {0, 3, 4}}
    missed = stars.missed_links(verified, found, 80, lambda rows: rows.join(parts, "u"))
    assert {(r.u, r.v) for r in missed.collect()} == near == {(1, 2)}


def test_members_of_a_hot_pivot_meet_in_many_cells(spark, monkeypatch):
    """op9: all members of one pivot met in one task."""
    monkeypatch.setattr(stars, "SLICE", 4)
    pivot = set(range(100))
    # each is too far from the pivot; two in a row are near each other
    sets = {u: pivot - set(range(26)) | {900 + i for i in range(u, u + 20)} for u in range(1, 40)}
    rows = [(u, 0, 7, 7, len(s), 100, len(s - pivot), len(pivot - s), False) for u, s in sets.items()]
    schema = "u long, v long, sketch1 long, sketch2 long, nu int, nv int, n_more int, n_less int, linked boolean"
    verified, found = spark.createDataFrame(rows, schema), spark.createDataFrame([], "node long, component long")
    parts = spark.createDataFrame([(u, sorted(s - pivot), sorted(pivot - s)) for u, s in sets.items()], "u long, more array<long>, less array<long>")
    cells = []

    def differ(rows):
        cells.extend(stars.spread(rows).collect())
        return rows.join(parts, "u")

    missed = {(r.u, r.v) for r in stars.missed_links(verified, found, 80, differ).collect()}
    assert missed == {tuple(sorted(x)) for x in plain.near(sets, 80)}
    held = Counter((r.row, r.col, r["first"]) for r in cells)
    assert max(held.values()) <= 15 and len(held) > 50
    met = Counter((a.u, b.u) for a in cells for b in cells if a["first"] and not b["first"] and (a.row, a.col) == (b.row, b.col))
    assert set(met.values()) == {1} and len(met) == len(sets) ** 2


def test_rows_grow_with_the_members_of_a_hot_pivot(spark, monkeypatch):
    """op9, pipeline: a member came once for each slice of the others, so rows grew with the square."""
    monkeypatch.setattr(stars, "SLICE", 4)
    found = spark.createDataFrame([], "node long, component long")
    schema = "u long, v long, sketch1 long, sketch2 long, nu int, nv int, n_more int, n_less int, linked boolean"
    made = {}

    def differ(rows):
        met = rows.withColumns({"more": F.array().cast("array<long>"), "less": F.sequence("u", F.col("u") + 29)})
        made[rows.count()] = stars.spread(met).count()
        return met

    for n in (100, 400):
        verified = spark.createDataFrame([(u, 0, 7, 7, 70, 100, 0, 30, False) for u in range(1, n + 1)], schema)
        missed = {(r.u, r.v) for r in stars.missed_links(verified, found, 80, differ).collect()}
        # sets lack 30 of 100 each: two whose numbers are d apart are near if 70 - d is 80 % of 70 + d or more
        assert missed == {(u, v) for u in range(1, n + 1) for v in range(u + 1, n + 1) if 100 * (70 - (v - u)) >= 80 * (70 + v - u)}
    assert set(made) == {100, 400} and made[400] <= 4 * made[100]


def test_only_lines_that_look_like_another_are_read_again(spark):
    """op9: the sets of all members of a pivot with a member outside its component were made twice."""
    # 1 and 2 look alike; 3 and 4 look like no one
    schema = "u long, v long, sketch1 long, sketch2 long, nu int, nv int, n_more int, n_less int, linked boolean"
    verified = spark.createDataFrame([(u, 0, s, s, 9, 9, 2, 2, False) for u, s in [(1, 0), (2, 0), (3, -1), (4, 0x5555555555555555)]], schema)
    found = spark.createDataFrame([], "node long, component long")
    parts = spark.createDataFrame([(u, [8, 9], [1, 2]) for u in range(1, 5)], "u long, more array<long>, less array<long>")
    read = []

    def differ(rows):
        read.extend(r.u for r in rows.collect())
        return rows.join(parts, "u")

    missed = stars.missed_links(verified, found, 80, differ)
    assert {(r.u, r.v) for r in missed.collect()} == {(1, 2)} and sorted(read) == [1, 2]


def test_members_are_read_for_one_pivot_and_only_if_their_sizes_allow_a_link(spark):
    """op9: members of several pivots had their sets made for each, whatever their known sizes."""
    # 1 and 2 were compared with pivots 0 and 9; 3 and 4 with 0 alone, and have too many elements of their own
    own = {1: (9, 2, 2), 2: (9, 2, 2), 3: (20, 11, 0), 4: (99, 90, 0)}
    rows = [(u, v, u // 3, 0, n, 9, more, less, False) for u, (n, more, less) in own.items() for v in ((0, 9) if u < 3 else (0,))]
    schema = "u long, v long, sketch1 long, sketch2 long, nu int, nv int, n_more int, n_less int, linked boolean"
    verified, found = spark.createDataFrame(rows, schema), spark.createDataFrame([], "node long, component long")
    parts = spark.createDataFrame([(u, list(range(100, 100 + more)), list(range(less))) for u, (n, more, less) in own.items()], "u long, more array<long>, less array<long>")
    read = []

    def differ(rows):
        read.extend((r.u, r.v) for r in rows.collect())
        return rows.join(parts, "u")

    missed = stars.missed_links(verified, found, 80, differ)
    assert {(r.u, r.v) for r in missed.collect()} == {(1, 2)} and sorted(read) == [(1, 0), (2, 0)]


def test_bands_are_shuffled_in_passes(spark, monkeypatch):
    """op9: the bands of all lines were on disk at once."""
    passes, compare = [], lines.pairs_to_compare
    monkeypatch.setattr(lines, "pairs_to_compare", lambda keys, percent: passes.append([k.collect() for k in keys]) or compare(keys, percent))
    table = spark.createDataFrame([(i, f"some line with the number {i}") for i in range(30)], "node long, line string")
    lines.line_groups(table)
    assert [len(p) > 0 for p in passes[0]] == [True] * lines.PARTS
    assert sorted(r for p in passes[0] for r in p) == sorted(lines.band_keys(table, lines.SHINGLE).collect())


def test_line_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "one line\nthe other"), ("a", "the other"), ("c", "the other"), (None, "the other")], "doc_id string, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in lines.line_report(docs).collect()}
    assert got == {"a": (1, ""), "b": (2, "1"), "c": (1, "0"), None: (1, "")}
    assert {r.doc_id: r.text for r in lines.dedupe_lines(docs).collect()} == {"a": "the other", "b": "one line", "c": "", None: "the other"}


def test_lines_messy(messy, empty):
    out = lines.dedupe_lines(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[-5] == "line one\n" and got[1] is None and got[2] == "" and got[3] == " \t\n " and got[7] == ""
    assert got[5] == "" and got[None] in (None, "some text of a row without an id")
    assert lines.dedupe_lines(empty).count() == lines.line_report(empty).count() == 0


def test_other_columns_of_line_dedup_may_have_any_name(spark):
    rows = [(1, "a line of some length, here\nb", "p", 5, 6), (2, "a line of some length, here", "q", 7, 8)]
    for names in (("__doc", "__kept", "doc"), ("kept_doc", "kept_lines", "_kept_doc"), ("kept", "line", "KEPT_DOC")):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} string, {names[1]} int, {names[2]} int")
        got = sorted(lines.dedupe_lines(docs).collect())
        assert [tuple(r) for r in got] == [rows[0], (2, "", *rows[1][2:])] and got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


def test_a_text_of_very_many_lines(spark):
    """Each line is looked up by hashing: twice the lines take about twice as long."""
    took = []
    for n in (40_000, 80_000):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
        docs = spark.range(1).select("id", text.alias("text")).persist()
        docs.count()
        kept = F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(2)), lambda i: F.concat_ws(":", i, F.xxhash64(F.concat(F.lit("line "), (i + 1).cast("string")))))
        began = time.perf_counter()
        got = docs.select(lines._without(F.split("text", "\n"), kept).alias("t")).select(F.size(F.split("t", "\n")), F.substring("t", 1, 13)).first()
        took.append(time.perf_counter() - began)
        assert tuple(got) == (n // 2, "line 1\nline 3")
    assert took[1] < 3 * took[0] + 1


def test_rows_of_one_id_are_judged_each(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(near)), (5, " ".join([*near[:-1], "x"])), (5, "something else altogether stands in this row"), (7, "alone here"), (None, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 56, None, True), (1, 56, 1, True), (5, 3, 5, True), (5, 56, 1, False), (7, 1, 7, True)]
    named = docs.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert sorted((r.doc_id or "", r.component_id, r.kept) for r in minhash.near_duplicates(named).collect()) == [
        ("", None, True), ("1", "1", True), ("5", "1", False), ("5", "5", True), ("7", "7", True)]


def test_shingles_are_of_characters(spark):
    rows = ["a", "é你" * 3, "é你" * 5 + "x", "\U0001f600" * 12, "plain ascii line", "abcd", "abcde"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, line string")
    got = {r.i: r.n for r in df.select("i", F.size(lines._shingles("line", 5)).alias("n")).collect()}
    assert got == {i: len({x[k : k + 5] for k in range(max(1, len(x) - 4))}) for i, x in enumerate(rows)}


def test_substrings_equal_brute_force(docs, texts):
    for window, gram in ((35, 8), (10, 4)):
        got = substrings.cut_passages(docs, window, gram).collect()
        expected = dict(enumerate(plain.cut(texts, window)))
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected
        assert any(0 < n < all_ for all_, n, _ in expected.values())


def test_substrings_in_many_shards(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 40)
    monkeypatch.setattr(substrings, "SHARD_TEXTS", 3)
    got = substrings.cut_passages(docs, 10, 4).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(plain.cut(texts, 10)))


def test_passages_are_located_by_the_automaton_alone():
    rng = np.random.default_rng(2)
    found = [rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (35, 90, 300)]
    found.append(np.concatenate([found[0][:20], found[1][:40]]))
    passages = substrings.Passages(found, 35)
    noise = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    windows = {tuple(p[i : i + 35].tolist()) for p in found for i in range(len(p) - 34)}
    hit = 0
    for p in found:
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            other = found[rng.integers(len(found))]
            text = np.concatenate([noise(rng.integers(0, 50)), p[a:b], noise(rng.integers(0, 2)), other[: rng.integers(0, len(other))], p[:b]])
            expected = np.zeros(len(text), bool)
            for i in range(len(text) - 34):
                if tuple(text[i : i + 35].tolist()) in windows:
                    expected[i : i + 35] = True
            got = np.zeros(len(text), bool)
            for i, j in zip(*passages.spans(text)):
                got[i:j] = True
            assert (got == expected).all()
            hit += expected.sum()
    assert hit > 1000

    assert not hasattr(passages, "windows")  # no table of windows decides

    class Nothing:
        iter = staticmethod(lambda text: iter(()))
        __len__ = lambda self: 1

    passages.automaton = Nothing()
    assert not len(passages.spans(found[2])[0])


@pytest.mark.parametrize("places", [1 << 18, 1, 7])
def test_blocks_that_many_passages_share(monkeypatch, places):
    """Passages alike but for their ends, and texts that repeat with a short period."""
    monkeypatch.setattr(substrings, "PLACES", places)
    rng = np.random.default_rng(6)
    word = lambda n, most=1 << 62: rng.integers(1, most, n).astype(np.uint64)
    middle = word(20)
    found = [np.concatenate([word(12), middle, word(12)]) for _ in range(200)] + [np.tile(word(3), 13)[:37], word(60, 3)]
    passages = substrings.Passages(found, 35)
    windows = {tuple(p[i : i + 35].tolist()) for p in found for i in range(len(p) - 34)}
    for text in (*found[:5], np.concatenate(found), np.tile(found[-2][:3], 40), np.concatenate([found[3][:30], found[4][10:]]), middle):
        expected = np.zeros(len(text), bool)
        for i in range(len(text) - 34):
            if tuple(text[i : i + 35].tolist()) in windows:
                expected[i : i + 35] = True
        got = np.zeros(len(text), bool)
        for i, j in zip(*passages.spans(text)):
            got[i:j] = True
        assert (got == expected).all()


def test_one_passage_in_all_texts_leaves_shards_small(spark, monkeypatch):
    """Pairs of texts share a passage of their own, and all texts share another."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    common, rows = words(40), []
    for _ in range(60):
        own = words(80)
        rows += [" ".join([*words(5), *own, *common, *words(5)]), " ".join([*common, *words(9), *own])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 600)
    sizes = []

    def kept(df, name, write=substrings.materialise):
        out = write(df, name)
        if name == "shards":
            sizes.extend(r.n // 8 for r in out.groupBy("shard").agg(F.sum(F.length("words")).alias("n")).collect())
        return out

    monkeypatch.setattr(substrings, "materialise", kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut_passages(docs).collect()}
    assert got == dict(enumerate(plain.cut(rows, 35)))
    assert sum(sizes) > 60 * 80 and max(sizes) < 3 * 600


def test_substrings_inside_one_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [f"a {passage} b {passage} c", "x " * 50, "x " * 34, "lone"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut_passages(docs).collect()}
    assert got == dict(enumerate(plain.cut(rows, 35)))


def test_substrings_messy(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    expected = sorted(zip((-99 if i is None else i for i, _ in rows), plain.cut([t for _, t in rows], 35)))
    got = [(-99 if r.doc_id is None else r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substrings.cut_passages(messy).collect()]
    assert sorted(got) == expected
    assert substrings.cut_passages(empty).count() == 0


@pytest.mark.parametrize("cells", [1024, 20])
def test_vectors_equal_brute_force(spark, monkeypatch, cells):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.09, x[:10], x * 3 + rng.normal(size=x.shape) * 0.2])
    label = np.tile([0, 0, 0, 1], len(x))[: len(x)]
    rows = [(int(i), v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    nothing = [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [1.0] * 8, None), (505, [1.0, None], 0), (506, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + nothing, "vec_id long, embedding array<float>, label int").repartition(3)
    monkeypatch.setattr(embeddings, "CELL_ROWS", cells)
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    u = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = plain.least_reachable([r[0] for r in rows + nothing], list(zip(*np.nonzero(near))))
    n = dict(enumerate(near.sum(1).tolist()))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (n.get(i, 0), int(root[i]), bool(root[i] == i)) for i in root}
    assert near.sum() > 100


def test_vectors_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int, node int, v string")
    assert embeddings.near_vectors(df).count() == 0
    df = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    df = df.withColumn("node", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted(embeddings.near_vectors(df).collect(), key=lambda r: r.vec_id or 0)
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(0, None, True), (1, 1, True), (1, 1, True)]
