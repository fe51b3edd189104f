"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutpoint.llm import decontam, lines, minhash, mixing, toxicity
from cutpoint.llm.runtime import fresh, materialise, release

#: A document with this score or more is rejected as toxic.
TOXIC = 0.3
#: The stages are tested against brute force: SQL cannot train the first one's model.
ORACLE_SQL = None


def _key() -> Column:
    """Names a row by its id and its text, so that rows of one id are judged each; null for a
    null id, which is never rejected."""
    named = F.struct("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return F.when(F.col("doc_id").isNotNull(), named).alias("doc_id")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``rejected``."""
    key, bad = fresh(docs, "row_key"), fresh(docs, "bad_key")
    bad_keys = rejected.select(F.col("doc_id").alias(bad)).where(F.col(bad).isNotNull()).distinct()
    return docs.withColumn(key, _key()).join(bad_keys, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.3 or more; the model learns from labelled rows of ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score(docs.select(_key(), "text"), model).where(F.col("score") >= TOXIC))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one line kept of each group of near-equal lines; n_chars is counted anew.

    A document that loses all its words goes: each of its lines stays in another one. One
    that had none before stays."""
    words = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    had = fresh(docs, "had_words")
    cut = lines.dedupe_lines(docs.withColumn(had, words)).where(words | ~F.col(had))
    count = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))
    return cut.withColumn("n_chars", F.coalesce(count, F.col("n_chars"))).select(*docs.columns)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document (the least id) kept of each group of near-equal ones: five-word
    shingles, similarity 0.8 or more. Rows equal in id and text are one."""
    found = minhash.near_duplicates(docs.select(_key(), "text"), shingle=5, percent=80, unlike_texts=False)
    return _without(docs, found.where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which ten consecutive words of a benchmark item stand."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.contamination(docs.select(_key(), "text"), benchmark).where("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document goes into the mix."""
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedupe_lines),
    ("near dedup", dedupe_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once
    the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
