import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutpoint.llm import langid, mixing, toxicity
from cutpoint.llm.queries import queries

from . import plain

WORDS = {
    "aa": "the and of that with from this have".split(), "bb": "der die und nicht eine auch werden mit".split(),
    "cc": "les des que pour dans avec une est".split(),
}


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "en", "s"]) for _ in range(rng.randint(15, 60)))
        toxic = i % 5 == 0
        if toxic:
            text += " " + " ".join(rng.choice(["blorfus", "blorfy", "zigblorf"]) for _ in range(3))
        rows.append((i, text, lang, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").persist()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_rows(spark, prose, messy, empty):
    model = langid.train(prose)
    got = {r.doc_id: r for r in langid.identify(prose.drop("lang"), model, reject=False).collect()}
    truth = {r.doc_id: r.lang for r in prose.collect()}
    out = [i for i in truth if held_out(i)]
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(messy, model, reject=False).where("lang_pred = 'und'").count() == 5
    own = max((r.text for r in prose.collect() if r.lang == "aa" and not held_out(r.doc_id)), key=len)
    far = spark.createDataFrame([(1, "qqqq xxxx qxqx"), (2, own)], "doc_id int, text string")
    assert [(r.lang_pred, r.far) for r in langid.identify(far, model).orderBy("doc_id").collect()] == [("und", True), ("aa", False)]
    assert [r.lang_pred != "und" for r in langid.identify(far, model, reject=False).collect()] == [True, True]
    share = sum(r.far for i, r in got.items() if held_out(i)) / len(out)
    assert share <= 0.15
    assert langid.identify(messy, langid.train(messy)).count() == messy.count()
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(messy, None).collect()} == {"und"}


def test_learning_ignores_held_out_rows(spark, prose):
    wrong = prose.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end as lang")
    a, b = langid.train(prose), langid.train(wrong)
    assert (a.idf == b.idf).all() and (a.centroids == b.centroids).all() and a.langs == b.langs


def test_every_language_is_learned(spark):
    """Very many languages, each with few rows beside one with most."""
    rows = [(i, f"w{i % 300}q " * 9, f"l{i % 300}") for i in range(2400)] + [(9000 + i, "plain words of it", "zz") for i in range(3000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=300)
    assert set(model.langs) == {x for _, _, x in rows}


def naive_languages(rows, model):
    """Nearest centroid by n-grams counted in Python, one text at a time."""
    out = {}
    for i, text in rows:
        low = text.translate(plain.LOWER).encode()
        stream = bytes(c if c >= 0x80 or chr(c).isalnum() else 0 for c in b"\0" + low + b"\0")
        count = np.zeros(langid.WIDTH)
        for n in langid.SIZES:
            for k in range(len(stream) - n + 1):
                gram = stream[k : k + n]
                if 0 in gram[1:-1] or not any(gram):
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x100000001B3 + c) & (1 << 64) - 1
                count[((h + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - langid.BITS] += 1
        v = np.log1p(count) * model.idf
        v = v / (np.linalg.norm(v) or 1)
        out[i] = model.langs[int((model.centroids @ v).argmax())], float((model.centroids @ v).max())
    return out


def test_languages_equal_brute_force(spark, prose):
    model = langid.train(prose)
    rows = [(r.doc_id, r.text) for r in prose.collect()] + [(1000, "The élan of ÀÉ 12 über\tdie"), (1001, "a"), (1002, "é")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, reject=False).collect()
    expected = naive_languages(rows, model)
    for r in got:
        assert r.lang_pred == expected[r.doc_id][0] and r.score == pytest.approx(expected[r.doc_id][1], abs=1e-5)


def naive_toxicity(text, model):
    """The score by subwords counted in Python."""
    stream = bytes(c if c >= 0x80 or chr(c).isalnum() else 0 for c in b"\0" + text.translate(plain.LOWER).encode() + b"\0")
    table, total, n_grams = model.table(), 0.0, 0
    for n in toxicity.SIZES:
        for k in range(len(stream) - n + 1):
            gram = stream[k : k + n]
            if 0 in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * 0x100000001B3 + c) & (1 << 64) - 1
            total += float(table[((h + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - toxicity.BITS])
            n_grams += 1
    return 1 / (1 + np.exp(-(total / (n_grams + toxicity.NEUTRAL) + model.intercept())))


def test_toxicity_equals_brute_force(spark, prose):
    model = toxicity.train(prose, prose.select("doc_id", "toxic"))
    rows = [(r.doc_id, r.text) for r in prose.collect()] + [(1000, "Blorfus ÀÉ blorfy"), (1001, ""), (1002, "a b")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    texts = dict(rows)
    assert all(r.score == pytest.approx(naive_toxicity(texts[r.doc_id], model), abs=1e-5) for r in got)


def test_repeated_and_contradictory_labels_teach_once(spark, prose):
    labels = prose.select("doc_id", "toxic")
    once = toxicity.train(prose, labels)
    contrary = spark.createDataFrame([(9999, 1), (9999, 0)], "doc_id long, toxic int")
    again = toxicity.train(prose.unionByName(prose), labels.unionByName(labels).unionByName(contrary))
    assert (once.vectors == again.vectors).all() and once.intercept() == again.intercept()


def test_toxicity_ids_of_other_types(spark, prose):
    named = prose.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    model = toxicity.train(named, named.select("doc_id", "toxic"))
    assert toxicity.score(named, model).schema["doc_id"].dataType.simpleString() == "string"


def test_toxicity_of_held_out_rows_and_misspellings(spark, prose, messy, empty):
    model = toxicity.train(prose, prose.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(prose, model).collect()}
    truth = {r.doc_id: r.toxic for r in prose.collect()}
    out = [i for i in truth if held_out(i)]
    assert sum((got[i] >= 0.3) == bool(truth[i]) for i in out) >= 0.97 * len(out)
    rest = " ".join(WORDS["aa"] * 3)
    new = spark.createDataFrame([(1, f"{rest} blorfuss blorfi blorfied"), (2, rest)], "doc_id int, text string")
    bad, good = (r.score for r in toxicity.score(new, model).orderBy("doc_id").collect())
    assert bad > 0.3 > good
    scored = toxicity.score(messy, model)
    assert scored.count() == messy.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.train(empty, empty.selectExpr("doc_id", "1 as toxic")) is None
    assert toxicity.train(prose, prose.selectExpr("doc_id", "1 as toxic")) is None
    assert toxicity.score(messy, None).where("score != 0").count() == 0


def test_mixing_follows_targets(spark, messy, empty):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice("aaaaab") if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_sources(df).collect()
    assert sorted(got) == sorted(mixing.mix_sources(df.repartition(3)).collect())
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    total = sum(size.values())
    # weights 1, 2, 3 of the total, with b and then others stopped at three times their size
    weight, target, free = {"a": 1, "b": 2, None: 3}, {}, {"a", "b", None}
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * size[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        free -= full
    target |= {s: share * weight[s] for s in free}
    for s in size:
        own = [r for r in got if r.source == s]
        assert {round(r.target, 6) for r in own} == {round(target[s], 6)} and {r.source_size for r in own} == {size[s]}
        assert abs(sum(r.taken for r in own) - target[s]) <= 180
    assert all(r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(messy).count() == messy.count()
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_of_ties_and_repeated_rows_equals_brute_force(spark):
    rows = [(i % 5, "w " * (i % 3), "ab"[i % 2]) for i in range(60)] + [(None, "w", "a"), (None, None, None), (3, "w w w", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.source or "", r.target, r.copies) for r in mixing.mix_sources(df).collect())
    target = {r.source: r.target for r in mixing.mix_sources(df).collect()}
    expected = []
    for s in ("a", "b", None):
        own = sorted((len((t or "").split()), i is not None, i or 0) for i, t, x in rows if x == s)
        rate = target[s] / (sum(n for n, _, _ in own) or 1)
        u = int(hashlib.md5(f"7:{s or chr(0)}".encode()).hexdigest()[:8], 16) / 2**32
        for k, (n, known, i) in enumerate(own):
            expected.append((known, i, n, s or "", target[s], math.floor((k + 1) * rate + u) - math.floor(k * rate + u)))
    assert got == sorted(expected)


def test_hot_source_takes_several_tasks(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "'hot' as source")
    got = mixing.mix_sources(df)
    total = got.selectExpr("sum(taken) as t", "max(target) as target").first()
    assert abs(total.t - total.target) <= 50


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
