import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from cutpoint.llm import periodic, queries
from cutpoint.llm.words import chunks

from . import plain


def brute_runs(words, least, times):
    """By the definition: maximal stretches of each period that no smaller period has."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            smaller = any(all(words[x] == words[x + r] for x in range(start, start + length - r)) for r in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    words, letters = [], rng.choice([1, 2, 2, 3, 5])
    while len(words) < rng.randint(0, 120):
        part = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 9))]
        words += part * rng.choice([1, 1, 2, 3, 5, 9])
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng, found = random.Random(seed), 0
    for _ in range(250):
        words, least, times = random_words(rng), rng.choice([1, 4, 8, 24]), rng.choice([2, 3, 4])
        expected = brute_runs(words, least, times)
        assert periodic.runs_of([int(w[1:]) for w in words], least, times) == expected
        for _, _, w in chunks(pa.array([" ".join(words)]), "space", False):
            assert periodic.text_runs(w, 0, len(words), least, times) == expected
        found += len(expected)
    assert found > 100


def test_ordered_ends(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rng = random.Random(2)
    values = rng.sample(range(500), 200)
    ends, held = periodic.Ends(values[0]), {values[0]}
    for x in values[1:]:
        below, above = [v for v in held if v < x], [v for v in held if v > x]
        assert ends.add(x) == (max(below, default=None), min(above, default=None))
        held.add(x)
    assert list(ends) == sorted(held) and ends.count == 200


def test_only_recurring_parts_reach_an_automaton(monkeypatch):
    """A passage that stands twice far apart is no candidate; a run is, whole."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(50)]
    words = [word() for _ in range(300)] + passage + [word() for _ in range(40)] + passage + ["a", "b", "c"] * 20 + [word() for _ in range(500)]
    for _, _, w in chunks(pa.array([" ".join(words)]), "space", False):
        (a, b), = periodic.stretches(w.hashes, 24, 3)
        assert a <= 440 and b >= 500 and b - a < 80
        assert periodic.text_runs(w, 0, len(words), 24, 3) == [(440, 60, 3)]


def test_operator(spark, messy, empty):
    rows = [(1, "a b " * 40 + "c"), (2, None), (3, ""), (4, "x " * 23), (5, "x " * 24), (5, "p q r s"), (None, "y\n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(periodic.periodic_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 80, 2)], [], [], [], [], [(0, 24, 1)], [(0, 30, 1)]]
    assert [r.collapsed for r in got] == ["a b c", None, None, None, None, "x", "y"]
    assert got[3].collapsed_sha256 == hashlib.sha256(("x " * 23)[:-1].encode()).hexdigest()
    assert periodic.periodic_runs(empty).count() == 0
    assert periodic.periodic_runs(messy).count() == messy.count()
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(docs, times=1)


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    tailed = 0
    for i, text in docs.items():
        words, h = plain.space_words(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            tailed += 1
        runs = brute_runs(words, 24, 3) if len(set(words[k] + words[k + 1] for k in range(n - 1))) < n - 10 else []
        r, best = got[i], min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert tailed > 5


def test_tails_of_odd_rows(spark, messy, empty):
    got = queries.with_tail(messy).where("doc_id is null").collect()
    assert sorted(str(r.text) for r in got) == ["None", "some text of a row without an id"]
    assert queries.with_tail(empty).count() == 0
