import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cutpoint.llm import components as component_module
from cutpoint.llm import runtime
from cutpoint.llm import words as W
from cutpoint.llm.components import components

from . import plain

TEXT = st.text(alphabet="aAzZ09 \t\n\x0b\x1c-_é 你\U0001f600", max_size=40)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_equal_regular_expressions(texts):
    for kind, fold, found in (("space", False, plain.space_words), ("alnum", True, plain.alnum_words)):
        got = []
        for i, j, w in W.chunks(pa.array(texts, pa.string()), kind, fold):
            for k in range(j - i):
                spans = zip(w.starts[w.offsets[k] : w.offsets[k + 1]], w.ends[w.offsets[k] : w.offsets[k + 1]])
                got.append([w.data[a:b].tobytes().decode() for a, b in spans])
        lower = (lambda x: x.translate(plain.LOWER)) if fold else (lambda x: x)
        assert [[lower(x) for x in g] for g in got] == [found(t) for t in texts]


def test_equal_words_have_equal_hashes_only():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abC") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    w = next(W.chunks(pa.array(texts), "space", True))[2]
    assert len(set(w.hashes.tolist())) == len({t.lower() for t in texts})


def test_grams_depend_on_their_words_alone():
    h = np.arange(1, 200, dtype=np.uint64) ** 3
    again = np.concatenate([h[50:90], h])
    for k in (2, 8, 35):
        assert (W.grams(again, k)[: 40 - k + 1] == W.grams(h, k)[50 : 90 - k + 1]).all()
        assert len(set(W.grams(h, k).tolist())) == 199 - k + 1


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(40)] + [(7, 7)],
        "star": [(0, i) for i in range(1, 500)] + [(1000, i) for i in range(1001, 1200)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == plain.least_reachable({n for link in links for n in link}, links)


def session_of(master, folder=None):
    conf = SimpleNamespace(get=lambda key, other: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_no_local_folder_on_a_cluster():
    assert runtime.shared_dir(session_of("spark://far:7077", "hdfs://far/shared")) == "hdfs://far/shared"
    assert runtime.shared_dir(session_of("local[4]")).startswith("file:")
    for master in ("spark://far:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(session_of(master))


def test_released_tables_are_gone(spark):
    rows = spark.range(10)
    plain_table, dealt = runtime.materialise(rows, "t"), runtime.materialise_buckets(rows, "t", "id")
    assert plain_table.count() == dealt.count() == 10
    runtime.release(plain_table, dealt)
    for t in (plain_table, dealt):
        assert not Path(t.cutpoint_path.removeprefix("file:")).exists()
    assert not spark.catalog.tableExists(dealt.cutpoint_table)


def test_a_round_of_components_is_one_table(spark, monkeypatch):
    """op2, op9: a round wrote four tables, each in as many files as a shuffle has partitions."""
    names, write = [], component_module.materialise
    monkeypatch.setattr(component_module, "materialise", lambda df, name, *rows: names.append(name) or write(df, name, *rows))
    links = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(9, 8), (10, 11)], "u long, v long")
    assert {(r.node, r.component) for r in components(links).collect()} == {*((i, 0) for i in range(10)), (10, 10), (11, 10)}
    assert names[0] == "links" and names[-1] == "components" and set(names[1:-1]) == {"edges"} and len(names) <= 4


def test_small_tables_are_few_files(spark):
    rows = spark.range(100).repartition(40, "id")
    few, many = (runtime.materialise(rows, "t", n).inputFiles() for n in (100, None))
    assert len(few) <= spark.sparkContext.defaultParallelism < len(many)
    assert len(runtime.materialise(rows, "t", 20 * runtime.FILE_ROWS).inputFiles()) > len(few)
