import re
from pathlib import Path

import pytest

import cutpoint
from cutpoint.errors import EmptyInputError, SingleClassError
from cutpoint.operators import search
from cutpoint.operators.profile import admit
from cutpoint.sources.frames import scored
from cutpoint.streaming import histogram

from .test_search import awkward, frame


def test_stream_equals_batch(spark, tmp_path):
    rows = [*awkward(1), *awkward(2), (0.0, -1), (1.0, 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("score double, label int").parquet(str(tmp_path / "a"))
    query = histogram.start(histogram.stream_bins(scored(stream), 0.0, 1.0, 16), "bins_of_test")
    query.processAllAvailable()
    query.stop()
    data = scored(frame(spark, rows))
    best = search.hist(data, admit(data), 16).first()
    assert histogram.threshold(spark.table("bins_of_test"), 0.0, 1.0, 16) == (best.threshold, best.correct)


def test_stream_refusals(spark):
    schema = "bin long, neg long, pos long"
    with pytest.raises(EmptyInputError):
        histogram.threshold(spark.createDataFrame([], schema), 0, 1)
    with pytest.raises(SingleClassError):
        histogram.threshold(spark.createDataFrame([(0, 0, 3)], schema), 0, 1)


def test_nothing_imports_the_training_data_operators():
    top = Path(cutpoint.__file__).parent
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", f.read_text()), f
