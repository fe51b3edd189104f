"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise, release

#: Words as the mix counts them.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets by source from ``sizes(source, source_size)``, one row per source.

    Sources by code point, null last, weigh ``cycle`` repeating and share the total size;
    none gets more than ``cap`` times its own, the excess being reshared by weight among
    the others. The level of sharing rises round by round until no source is above its
    bound; each round is one aggregate of two sums, so nothing per source reaches the driver.
    One task sorts the sources: a row each, whatever the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    table = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("at") % len(cycle) + 1).cast("int"))
    )
    table = materialise(table.select("source", "source_size", "weight"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    bound = F.col("source_size") * cap
    level = -1.0
    while True:
        full = bound <= F.lit(level) * F.col("weight")
        capped, free = table.agg(
            F.sum(F.when(full, bound).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        rise = (total - capped) / free
        if rise == level:
            break
        level = rise
    share = F.lit(float(level)) * F.col("weight")
    return table.withColumn("target", F.least(bound.cast("double"), share))


def offset(seed: int, source: F.Column) -> F.Column:
    """One offset in [0, 1) per source, fixed by the seed and the source's name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    digits = F.substring(F.md5(name.cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296


def mix_sources(
    docs: DataFrame,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
) -> DataFrame:
    """How often each document goes into the mix.

    Within a source every document is expected ``target / source_size`` times. Documents
    stand in order of size (then id), expectations are summed up along that order, the
    source's random offset is added, and a document is taken once for each integer it
    crosses. Order by size makes the words taken follow the target closely.

    The order spans partitions: rows are range-partitioned by (source, size, id), ranks
    are counted inside partitions and moved by the counts of those before, so a source
    with a third of all rows takes many tasks. Returns doc_id, source, size, source_size,
    target, copies, taken (= copies * size), one row per input row. Null or empty texts
    have size 0 and are taken like others (0 words); a null source is a source of its
    own; a null id orders first; repeated rows are separate rows; a source without words
    has target 0 and gives no copies; other columns are not read.
    """
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(text_col, F.lit(WORD)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.cast("long").alias("size"),
    )
    # the range partitioner reads its input twice: sizes, not texts
    counted = materialise(rows, "counted")
    rows = counted.repartitionByRange("source", "size", "doc_id")
    rows = rows.sortWithinPartitions("source", "size", "doc_id")
    at = F.monotonically_increasing_id()
    rows = materialise(rows.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "sizes")
    release(counted)

    parts = rows.groupBy("source", "part").agg(
        F.sum("size").alias("words"), F.count("*").alias("n"), F.min("at").alias("first")
    )
    parts = materialise(parts, "parts")
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, cycle, cap)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = materialise(
        parts.join(targets, parts.source.eqNullSafe(targets.source)).select(
            parts.part, parts.source, "first", "before", "source_size", "target", offset(seed, parts.source).alias("u")
        ),
        "plan",
    )
    same = (rows.part == parts.part) & rows.source.eqNullSafe(parts.source)
    met = rows.join(parts, same).select(rows["*"], "first", "before", "source_size", "target", "u")
    rank = F.col("at") - F.col("first") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda n: F.floor(n.cast("double") * rate + F.col("u"))
    copies = (crossed(rank + 1) - crossed(rank)).cast("long")
    return met.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))

