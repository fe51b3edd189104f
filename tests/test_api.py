import math

import numpy as np
import pandas as pd
import pytest

from cutpoint import Cutpoint, FrameCutpoint, errors, report
from cutpoint.registry import ALGORITHMS, by_name

SCORES, CLASSES = [-1.5, 0.25, 0.75, 2.0, 3.5], [-1, -1, 1, 1, 1]


def test_containers_agree(spark):
    series = pd.Series(SCORES, index=[7, 3, 9, 1, 4])
    for scores in (SCORES, tuple(SCORES), np.array(SCORES), series, (s for s in SCORES), dict.fromkeys(SCORES)):
        got = Cutpoint().optimize_threshold(scores, CLASSES)
        assert got == 0.5 and type(got) is float
    assert Cutpoint(labels=("no", "yes")).optimize_threshold(SCORES, ["no", "no", "yes", "yes", "yes"]) == 0.5


def test_options():
    model = Cutpoint(algorithm="SWEEP")
    current = model.get_current_algorithm()
    assert (current["name"], current["object"].id) == ("exact", "exact")
    assert model.get_current_options() is model.options
    assert model.set_algorithm("grid") is model
    assert list(Cutpoint.get_supported_algorithms(as_dict=True)) == Cutpoint.get_supported_algorithms()
    for a in ALGORITHMS:
        assert all(by_name(s.upper()) is a for s in (a.id, *a.synonyms))
    for bad in ({"algorithm": "x"}, {"algorithm": 3}, {"backend": "x"}, {"alg": 1}, {"verbosity": "loud"}, {"algorithm_params": [1]}):
        with pytest.raises(errors.ConfigurationError):
            Cutpoint(**bad)
    with pytest.raises(errors.ConfigurationError, match="nothing to tune"):
        Cutpoint(algorithm_params={"no_of_bins": 3})
    with pytest.raises(errors.LabelMappingError):
        FrameCutpoint(labels=(1, 2, 3))
    held = Cutpoint(algorithm="hist", algorithm_params={"no_of_bins": 8})
    with pytest.raises(errors.ConfigurationError):
        held.set_algorithm("exact")
    assert held.options["algorithm"].id == "hist"
    for bins in (0, -1):
        with pytest.raises(errors.InsufficientDataError):
            FrameCutpoint(algorithm_params={"no_of_bins": bins})
    for jobs in (0, -2, True, 1.5):
        with pytest.raises(errors.ConfigurationError):
            Cutpoint(algorithm="ls", algorithm_params={"n_jobs": jobs})


# fixed values: refusals of rows in memory, in their order
REFUSALS = [
    ([0.1], [1, -1], errors.LengthMismatchError, ValueError),
    ([0.1, None], [1, 5], errors.UndefinedScoresError, ValueError),
    ([math.nan], [1], errors.UndefinedScoresError, ValueError),
    ([], [], errors.EmptyInputError, ValueError),
    ([0.1, 0.2], [None, 5], errors.MissingLabelsError, ValueError),
    ([0.1, 0.2], [1, 5], errors.UnexpectedLabelsError, ValueError),
    ([0.1, 0.2], [1, 1], errors.SingleClassError, ValueError),
    (3, [1], errors.NotIterableError, AttributeError),
]


@pytest.mark.parametrize(("scores", "classes", "own", "builtin"), REFUSALS)
def test_refusals_in_memory(spark, scores, classes, own, builtin):
    with pytest.raises(own) as e:
        Cutpoint().optimize_threshold(scores, classes)
    assert isinstance(e.value, builtin) and isinstance(e.value, errors.CutpointError)


def test_refusals_of_frames(spark):
    def refused(rows, schema="score double, label int"):
        with pytest.raises(errors.InvalidInputError) as e:
            FrameCutpoint().solve(spark.createDataFrame(rows, schema))
        return e.value

    assert isinstance(refused([]), errors.EmptyInputError)
    assert refused([(None, 1), (math.nan, None), (1.0, 3)]).count == 2
    assert refused([(1.0, None), (2.0, 7)]).count == 1
    assert refused([(1.0, math.nan)], "score double, label double").count == 1
    assert refused([(1.0, 7), (2.0, 7), (3.0, 1)]).unexpected == [7]
    assert refused([(1.0, 1), (2.0, 1)]).only == 1
    assert isinstance(refused([(math.inf, 1), (2.0, -1)]), errors.InsufficientDataError)


@pytest.mark.parametrize("kind", ["int", "string", "double", "boolean"])
def test_label_types(spark, kind):
    df = spark.createDataFrame([(s, (c + 1) // 2) for s, c in zip(SCORES, CLASSES)], "score float, label int")
    df = df.selectExpr("score", f"cast(label AS {kind}) AS label", "'x' AS note")
    assert FrameCutpoint("exact", labels=(False, True) if kind == "boolean" else (0, 1)).optimize_threshold(df) == pytest.approx(0.5)


def test_wide_frame_and_names(spark):
    df = spark.createDataFrame([(i, s, "x", c) for i, (s, c) in enumerate(zip(SCORES, CLASSES))], "id long, p double, y string, out int")
    assert FrameCutpoint("ls").optimize_threshold(df, "p", "out") == 0.5


def test_levels(caplog):
    report.propagate_to_logging()
    with report.verbosity("error"):
        report.say("warning", "no")
        with report.verbosity("info"):
            report.say("info", "yes %d", 1)
            report.say("debug", "no")
        with report.verbosity(None):
            report.say("warning", "no")
    report.set_verbosity("info")
    report.say("info", "now")
    report.set_verbosity("warning")
    assert [r.getMessage() for r in caplog.records] == ["yes 1", "now"]
    assert report.chosen(None, True) == "debug" and report.chosen("INFO", True) == "info"


class Counting:
    """A backend object that counts its calls."""

    def __init__(self, short=0):
        self.calls, self.short = [], short

    def class_counts_by_score(self, scores, classes):
        self.calls.append("counts")
        out = {}
        for s, c in list(zip(scores, classes))[self.short :]:
            n, p = out.get(s, (0, 0))
            out[s] = (n + (c == -1), p + (c == 1))
        return out

    def tally_candidates(self, candidates, scores, classes):
        self.calls.append("tally")
        return [sum((s > t) == (c == 1) for s, c in zip(scores, classes)) for t in candidates][self.short :]


def test_backend_objects(spark, caplog):
    labels, words = ("no", "yes"), ["no", "yes", "no", "yes", "yes"]
    repeated = [0.5, 0.5, 0.25, 0.5, 2.0]
    for algorithm, call in (("exact", "counts"), ("ls", "tally"), ("grid", "tally")):
        for scores in (SCORES, repeated):
            own = Counting()
            got = Cutpoint(algorithm=algorithm, backend=own, labels=labels).optimize_threshold(scores, words)
            assert got == Cutpoint(algorithm=algorithm, labels=labels).optimize_threshold(scores, words), algorithm
            assert own.calls == [call]
        with pytest.raises(errors.ShardMergeError):
            Cutpoint(algorithm=algorithm, backend=Counting(short=1)).optimize_threshold(SCORES, CLASSES)
        with pytest.raises(errors.MissingLabelsError):
            Cutpoint(algorithm=algorithm, backend=own, labels=labels).optimize_threshold(SCORES, [None] * 5)
        kept = Counting()
        Cutpoint(algorithm=algorithm, backend=kept, allow_parallel=False).optimize_threshold(SCORES, CLASSES)
        assert not kept.calls
    own = Counting()
    Cutpoint(algorithm="hist", backend=own).optimize_threshold(SCORES, CLASSES)
    Cutpoint(algorithm="ls", backend=object()).optimize_threshold(SCORES, CLASSES)
    assert not own.calls and caplog.text.count("not used") == 2


def test_progress(spark, capsys, monkeypatch):
    monkeypatch.setattr(report, "LOOK", 0.001)
    with report.progress(spark.sparkContext, True):
        spark.range(200_000).repartition(40).selectExpr("sum(hash(id))").collect()
    assert "tasks in" in capsys.readouterr().err
    assert Cutpoint(progress_bar=True).optimize_threshold(SCORES, CLASSES) == 0.5
