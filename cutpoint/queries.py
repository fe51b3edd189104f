"""The registered queries of the cut-off operators, over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import FrameCutpoint
from .functions.columns import granular, map_labels
from .operators import counts, evaluate, search
from .operators.profile import Shape, admit, profile, unexpected_labels
from .sources.frames import scored
from .streaming import histogram

Query = Callable[[SparkSession, str], DataFrame]
#: A fixed cut-off and fixed candidates for the evaluation queries.
CUT = 50000.0
CANDIDATES = (20000.0, 50000.0, 49999.5, 80000.0, -1.0, 50000.0)


def _labelled(score: str, positive: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(F.col(score).alias("score"), F.when(F.expr(positive), 1).otherwise(-1).alias("label"))


#: Source name to its table, its rows, and its pair of labels.
SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame], tuple | None]] = {
    "noisy": ("lineitem", _labelled("l_extendedprice", "(l_extendedprice > 50000) != (l_orderkey % 7 = 0)"), None),
    "ties": ("lineitem", _labelled("l_discount", "(l_discount > 0.05) != (l_partkey % 5 = 0)"), None),
    "imbalanced": ("events", _labelled("value", "value > 115"), None),
    "contrary": ("events", _labelled("value", "value < 200"), None),
    "whole": ("lineitem", _labelled("l_quantity", "(l_quantity > 37) != (l_orderkey % 7 = 0)"), None),
    "gaps": ("lineitem", lambda d: d.select(
        F.expr("CASE WHEN l_orderkey % 11 = 0 THEN double('NaN') WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END").alias("score"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN 1 WHEN l_partkey % 5 < 4 THEN -1 END").alias("label")), None),
    "eighths": ("lineitem", lambda d: d.select((F.col("l_quantity").cast("double") / 8).alias("score"), F.lit(1).alias("label")), None),
    "words": ("lineitem", lambda d: d.select(F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("label")), ("F", "O")),
    "bad3": ("orders", lambda d: d.select(F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("label")), ("F", "O")),
}


def source(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, tuple | None]:
    """Rows (score, label) of a named source and its labels."""
    if name == "docs01":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
        met = docs.join(labels.where("quality is not null"), "doc_id")
        return met.select(F.col("n_chars").alias("score"), F.col("quality").alias("label")), (0, 1)
    table, rows, labels = SOURCES[name]
    return rows(spark.read.parquet(f"{sf_dir}/{table}.parquet")), labels


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, labels = source(spark, sf_dir, name)
    return scored(df, labels=labels)


def _admitted(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, Shape]:
    rows = _rows(spark, sf_dir, name)
    return rows, admit(rows)


def _solve(algorithm: str, name: str, seed: int | None = None, **params: object) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, labels = source(spark, sf_dir, name)
        return FrameCutpoint(algorithm, params, labels=labels, seed=seed).solve(df)

    return query


def _over(name: str, plan: Callable[[DataFrame, Shape], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(*_admitted(spark, sf_dir, name))


def _of(name: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(_rows(spark, sf_dir, name))


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, labels = source(spark, sf_dir, "words")
    return df.select(F.col("label"), map_labels(df, labels=labels).alias("y")).groupBy("label", "y").agg(F.count("*").alias("rows"))


def _granular(rows: DataFrame) -> DataFrame:
    return rows.select(granular(F.col("score"), 2).alias("granular")).groupBy("granular").agg(F.count("*").alias("rows"))


def _by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.when(F.expr("(l_extendedprice > 50000) != (l_orderkey % 7 = 0)"), 1).otherwise(-1)
    return evaluate.exact_by(df.select("l_returnflag", F.col("l_extendedprice").alias("score"), y.alias("y")), ["l_returnflag"])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{{lineitem}}.parquet")
    bins = histogram.stream_bins(scored(SOURCES["noisy"][1](stream)), 0.0, 110000.0, 64)
    run = histogram.start(bins, "cutpoint_stream_bins")
    run.processAllAvailable()
    run.stop()
    return spark.table("cutpoint_stream_bins")


def _table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each retail price, fifty times over, is right as a cut-off."""
    rows, _ = _admitted(spark, sf_dir, "noisy")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    cuts = parts.select(F.col("p_partkey").alias("pos"), (F.col("p_retailprice") * 50).alias("threshold"))
    return counts.tally(rows, cuts, None)


def _recounted(algorithm: str, **params: object) -> Query:
    """What a search that samples says of its cut-off, held against all rows: whether
    ``correct`` is what a count of the rows gives, and is near the most of any cut-off."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _solve(algorithm, "noisy", seed=1, **params)(spark, sf_dir).first()
        rows, shape = _admitted(spark, sf_dir, "noisy")
        best = evaluate.ceiling(rows, shape).select(F.col("correct").alias("ceiling"))
        counted = evaluate.accuracy(rows, found.threshold).crossJoin(F.broadcast(best))  # one row
        inside = F.lit(shape.below <= found.threshold <= shape.highest)
        near = F.col("correct").between(F.col("ceiling") * 0.9, F.col("ceiling"))
        return counted.select("rows", "ceiling", (F.col("correct") == found.correct).alias("recounted"), near.alias("near"), inside.alias("inside"))

    return query


def queries() -> dict[str, Query]:
    """Name to query."""
    return {
        "label_profile": _of("noisy", profile),
        "class_counts_by_score": _of("ties", counts.class_counts),
        "exact_threshold": _solve("exact", "noisy"),
        "exact_ties": _solve("exact", "ties"),
        "exact_contrary": _solve("exact", "contrary"),
        "exact_imbalanced": _solve("exact", "imbalanced"),
        "exact_string_labels": _solve("exact", "words"),
        "exact_integer_scores": _solve("exact", "docs01"),
        "exact_two_level": _two_level,
        "hist_bins": _over("noisy", lambda r, s: counts.bin_counts(r, s.lowest, s.highest, 1024)),
        "hist_threshold": _solve("hist", "noisy"),
        "hist_threshold_16": _solve("hist", "noisy", no_of_bins=16),
        "hist_contrary": _solve("hist", "contrary"),
        "linear_threshold": _solve("ls", "noisy"),
        "linear_ties": _solve("ls", "ties"),
        "grid_tallies": _over("noisy", search.grid_tallies),
        "grid_threshold": _solve("grid", "noisy"),
        "tally_literal_candidates": _over("noisy", lambda r, s: counts.tally(r, CANDIDATES, s.rows)),
        "threshold_curve": _over("ties", evaluate.threshold_curve),
        "pairwise": _over("ties", evaluate.pairwise),
        "confusion_at_threshold": _of("noisy", lambda r: evaluate.confusion(r, CUT)),
        "accuracy_at_threshold": _of("noisy", lambda r: evaluate.accuracy(r, CUT)),
        "miss_ratio_at_threshold": _of("noisy", lambda r: evaluate.accuracy(r, CUT, miss=True)),
        "accuracy_ceiling": _over("noisy", evaluate.ceiling),
        "class_means": _of("noisy", lambda r: evaluate.class_means(r).select(*map(_six, ("neg_mean", "pos_mean", "all_mean")))),
        "granularity": _of("eighths", _granular),
        "label_profile_gaps": _of("gaps", profile),
        "map_labels": _mapped,
        "predict": _of("noisy", lambda r: evaluate.predictions(r, CUT).groupBy("y", "predicted").agg(F.count("*").alias("rows"))),
        "unexpected_labels": _of("bad3", unexpected_labels),
        "sgrid_full_sample": _solve("sgrid", "noisy", seed=1, stoch_ratio=1.0),
        "sgrid_threshold": _solve("sgrid", "noisy", seed=1),
        "sgrid_reshuffled": _solve("sgrid", "noisy", seed=1, reshuffle=True),
        "genetic_threshold": _solve("gen", "noisy", seed=1),
        "sgd_threshold": _solve("sgd", "noisy", seed=1),
        "sgd_full_sample": _solve("sgd", "whole", seed=1, stoch_ratio=1.0),
        "sgrid_recount": _recounted("sgrid"),
        "sgrid_reshuffled_recount": _recounted("sgrid", reshuffle=True),
        "genetic_recount": _recounted("gen"),
        "sgd_recount": _recounted("sgd"),
        "tally_table_candidates": _table_candidates,
        "exact_by_group": _by_flag,
        "stream_hist_bins": _stream,
    }


def _two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search by the plan for any number of distinct scores."""
    rows, shape = _admitted(spark, sf_dir, "noisy")
    return search.exact(rows, shape, one_task=False)
