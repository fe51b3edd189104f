import io
import tracemalloc

import pytest

from cutpoint import FrameCutpoint, cli
from cutpoint.sources import files

ROWS = "chance,outcome\n2.5,1\n-1.0,-1\n0.5,-1\n1.5,1\n0.25,-1\n"


@pytest.fixture
def path(tmp_path):
    f = tmp_path / "rows.csv"
    f.write_text(ROWS)
    return f


def call(capsys, *args):
    code = cli.main([str(a) for a in args])
    out = capsys.readouterr()
    return code, out.out.strip(), out.err


def test_prints_the_bare_number(spark, path, capsys, monkeypatch):
    assert call(capsys, path)[:2] == (0, "1.0")
    assert call(capsys, path, "--score-column", "chance", "--label-column", "1", "-q")[:2] == (0, "1.0")
    monkeypatch.setattr("sys.stdin", io.StringIO(ROWS))
    assert call(capsys, "-")[:2] == (0, "1.0")


def test_other_files(spark, tmp_path, capsys):
    f = tmp_path / "rows.tsv"
    f.write_text("0.25\tno\n0.5\tno\n1.5\tyes\n2.0\tyes\n")
    assert call(capsys, f, "--sep", "\t", "--no-header", "--labels", "no,yes")[:2] == (0, "1.0")


def test_exit_codes(spark, path, tmp_path, capsys):
    assert call(capsys, path, "-a", "nothing")[0] == 2
    assert call(capsys, path, "-p", "oops")[0] == 2
    assert call(capsys, path, "--labels", "1")[0] == 2
    assert call(capsys, path, "--score-column", "none")[0] == 2
    code, _, said = call(capsys, path, "--labels", "0,1")
    assert code == 1 and "--labels 0,1" in said
    assert "--list-algorithms" in call(capsys, path, "-a", "nothing")[2]
    assert "-p KEY=VALUE" in call(capsys, path, "-p", "no_of_bins=3")[2]
    empty = tmp_path / "empty.csv"
    empty.write_text("chance,outcome\n")
    assert call(capsys, empty)[0] == 1
    assert call(capsys, "--list-algorithms")[1].count("\n") == 6


def test_pieces():
    assert cli.parse_params(["a=1", "b=0.5", "c=true", "d=x"]) == {"a": 1, "b": 0.5, "c": True, "d": "x"}
    assert cli.parse_labels("0, yes") == (0, "yes")
    args = cli.parser().parse_args(["f", "-vv", "--verbosity", "info"])
    assert cli.level(args) == "info"


def test_standard_input_is_spooled_in_blocks(spark, monkeypatch):
    """More input than blocks, never more than a block or so in memory."""
    monkeypatch.setattr(files, "BLOCK_BYTES", 1 << 16)
    row, rows = b"0.5,1,some other column that nobody asks for\n", 200_000

    class Endless(io.RawIOBase):
        left = len(row) * rows

        def read(self, n=-1):
            n = min(n, self.left) // len(row) * len(row)
            self.left -= n
            return row * (n // len(row))

    tracemalloc.start()
    path = files.spooled(spark, Endless())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20
    assert spark.read.csv(path).count() == rows


def test_a_file_is_read_once_and_two_columns_of_it(spark, tmp_path):
    f = tmp_path / "wide.csv"
    f.write_text("id,note,chance,outcome\n" + "".join(f"{i},x{i},{i / 100},{int(i > 40)}\n" for i in range(100)))
    seen = []

    def jobs():
        tracker = spark.sparkContext.statusTracker()
        return len(tracker.getJobIdsForGroup("read"))

    spark.sparkContext.setJobGroup("read", "a test")
    df = files.read_delimited(spark, str(f))
    assert jobs() <= 1  # the header's line
    pair = files.delimited_pair(df, "chance", "outcome")
    plan = pair._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chance:string,outcome:string>" in plan and not seen
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert FrameCutpoint("exact", labels=(0, 1)).optimize_threshold(pair) == pytest.approx(0.405)


# fixed values: labels in files, as text and as they are known
LABELS = [("1", "1"), ("1.0", "1"), ("+1", "1"), (" -1 ", "-1"), ("1e0", "1"), ("0.5", "0.5"), ("yes", "yes"), ("NaN", None), ("", None), (None, None), ("inf", "inf")]


def test_labels_in_plain_form(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELS)], "i int, t string")
    got = {r.i: r.plain for r in df.select("i", files.plain_label(df.t).alias("plain")).collect()}
    assert [got[i] for i in range(len(LABELS))] == [p for _, p in LABELS]


def test_scores_that_are_no_numbers(spark, tmp_path, capsys):
    f = tmp_path / "rows.csv"
    f.write_text("chance,outcome\n2.5,1\nmany,-1\n,1\n")
    code, _, err = call(capsys, f)
    assert code == 1 and "2 rows have no score" in err
    f.write_text("chance,a.`b\n2.5,1.0\n0.5,-1.0\n")
    assert call(capsys, f)[:2] == (0, "1.5")
