"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, embeddings, langid, licenses, lines, minhash, mixing, periodic, secrets, substrings, toxicity, urls
from .runtime import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(crc_fold(id_col) == 2, F.lit(False)).alias("held_out")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # every text with a letter gets a learned language here, however far it is
    found = langid.identify(docs, langid.train(docs), reject=False)
    return found.select("doc_id", _held_out(), "lang_pred", "score", "far")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    one = lambda n: F.concat_ws(":", n["label"], n["start"], n["end"], n["edits"])
    return found.withColumn("notices", F.concat_ws(",", F.transform("notices", one)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    rank = F.array(*[F.lit(k) for k in (*secrets.KINDS, *(f"decoded-{k}" for k in secrets.KINDS))])
    placed = F.transform(
        F.concat("spans", "decoded"),
        lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("kind")),
    )
    listed = F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["kind"], s["a"], s["e"]))
    return found.select(
        "doc_id",
        *[count(k) for k in secrets.KINDS],
        F.sha2(F.concat_ws(",", F.transform("spans", one)), 256).alias("base_sha256"),
        F.concat_ws(",", listed).alias("spans"),
        "n_oversize",
    )


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that SQL can express, with -1 where no phrase stands."""
    place = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_secrets that SQL can express."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_passages(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


#: Host, path and verdict of the rules that op12_urls judges by.
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda r: F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)])
    rules = spark.range(1).select(F.inline(F.array(*map(rule, URL_RULES))))
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules)


def with_tail(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the periodic tails that op13_periodic asks for: of one
    document in ten by crc32(doc_id), the words from a place on are repeated over and over. A
    row with a null id gets none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tailed(words: F.Column) -> F.Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    # the lambda holds the words, which are else looked for again for each place
    made = F.transform(F.array(words), tailed)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_tail(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = lambda c: F.col(f"strongest.{c}").alias(c)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *map(best, ("start", "length", "period")),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def periodic_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_periodic with -1 where no run is, so that its columns compare with those of SQL."""
    return op13_periodic(spark, sf_dir).na.fill(-1, ["start", "length", "period", "exponent_milli"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query: one for each operator, and three that compare base columns with SQL."""
    return {
        f.__name__: f
        for f in (
            op1_mixing, op2_minhash, op3_langid, op4_embeddings, op5_licenses,
            op6_secrets, op7_decontam, op8_substrings, op9_lines, op10_toxicity,
            op11_centroids, op12_urls, op13_periodic, licenses_base, secrets_base, periodic_base,
        )
    }
