"""Queries against their SQL on the smallest tables, and the pipeline against brute force."""

import zlib
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutpoint.llm import langid, secrets, toxicity
from cutpoint.llm.oracles import oracle_sql
from cutpoint.llm.queries import queries
from cutpoint.llm.runtime import shared_dir

from . import plain
from .test_learned import naive_languages, naive_toxicity

SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, tables, name):
    got = queries()[name](spark, sf_dir).toPandas()
    expected = tables.execute(SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = lambda t: sorted(map(repr, t[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql(spark, sf_dir, tables, name):
    got = queries()[name](spark, sf_dir).toPandas()
    ids = [r[0] for r in tables.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    assert sorted(got.doc_id) == ids


def rows_of(tables, columns="doc_id, text"):
    return tables.execute(f"SELECT {columns} FROM documents").fetchall()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_query_equals_brute_force(spark, sf_dir, tables):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    short = {i: t or "" for i, t in rows_of(tables) if len(t or "") <= 4000}
    expected = naive_languages(short.items(), model)
    got = {r.doc_id: r for r in queries()["op3_langid"](spark, sf_dir).collect()}
    for i in short:
        lang, cosine = expected[i]
        assert (got[i].held_out, got[i].lang_pred) == (held_out(i), lang) and got[i].score == pytest.approx(cosine, abs=1e-5)
    truth = dict(rows_of(tables, "doc_id, lang"))
    assert sum(got[i].lang_pred == truth[i] for i in truth if held_out(i)) >= 0.97 * sum(map(held_out, truth))


def test_toxicity_query_equals_brute_force(spark, sf_dir, tables):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = toxicity.train(read("documents"), read("labels"))
    got = {r.doc_id: r for r in queries()["op10_toxicity"](spark, sf_dir).collect()}
    for i, t in rows_of(tables):
        assert (got[i].held_out, got[i].predicted) == (held_out(i), int(got[i].score >= 0.3))
        if len(t or "") <= 4000:
            assert got[i].score == pytest.approx(naive_toxicity(t or "", model), abs=1e-4)


def test_secret_query_gives_the_operators_spans(spark, sf_dir, tables):
    got = {r.doc_id: r for r in queries()["op6_secrets"](spark, sf_dir).collect()}
    order = {k: n for n, k in enumerate((*secrets.KINDS, *(f"decoded-{k}" for k in secrets.KINDS)))}
    for i, t in rows_of(tables):
        base, deep, _ = secrets.scan_deep(t or "")
        listed = sorted([*base, *deep], key=lambda s: (s[1], order[s[0]], s[2]))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in listed)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    source = rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    gone = plain.lines_removed(list(rows.items()))
    cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])) for i, t in rows.items()}
    rows = {i: t for i, t in cut.items() if plain.space_words(t) or not plain.space_words(rows[i])}
    assert len(rows) < len(cut)
    sets = {i: plain.shingles(t, 5) for i, t in rows.items()}
    root = plain.least_reachable(list(sets), plain.near(sets, 80))
    rows = {i: t for i, t in rows.items() if root[i] == i}
    rows = {i: t for i, t in rows.items() if not plain.hits(t, bench)[1]}
    assert {i: r["size"] for i, r in got.items()} == {i: len(plain.space_words(t)) for i, t in rows.items()}
    assert bad and gone and len(rows) < len(sets)
    assert not {i for i, r in got.items() if not r["size"] and plain.space_words(source[i])}
    by_source = {}
    for r in got.values():
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)


def test_stages_keep_columns_and_messy_rows(spark, messy, sf_dir):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.where("doc_id is null").count() == 2


def test_stages_judge_rows_and_not_ids(spark, sf_dir):
    """Two unlike texts of one id: what is wrong with one leaves the other alone."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first().text
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(1, near), (2, f"{near} x"), (2, "a text that has nothing to do with it"), (3, item), (3, "and one more of its own"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("row_key", "bad_key", "had_words")})
    left = lambda name: sorted((r.doc_id or 0, r.text) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).collect())
    assert left("near dedup") == sorted((i or 0, t) for i, t in rows if t != rows[1][1])
    assert left("decontamination") == sorted((i or 0, t) for i, t in rows if i is None or t != item)
    assert len(left("line dedup")) == 5


def test_only_one_stage_is_kept(spark, sf_dir):
    def tables():
        return set(Path(urlparse(shared_dir(spark)).path, "cutpoint").glob("*"))

    before = tables()
    out = corpus_pipeline.run(spark, sf_dir)
    assert {p.name.rpartition("-")[0] for p in tables() - before} & {"toxicity", "line-dedup", "near-dedup", "decontamination"} == {"decontamination"}
    assert out.count() > 0
