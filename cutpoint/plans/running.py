"""Running sums over a total order, in one window or in two levels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigurationError

#: Rows up to which one task may sort and sum them all.
ONE_TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, gone when the application ends; with a
    folder for each value of ``by``, if given, so that a filter on it reads no other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cutpoint/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], rows: int | None, lead: str | None = None) -> DataFrame:
    """``df`` with ``cum_<c>`` for each of ``sums`` and, for ``lead``, ``next_<c>`` of the
    next row, all in the order of ``order``.

    ``rows`` bounds the row count, None is unknown. Up to ONE_TASK_ROWS a single window
    does it. Beyond, rows are range-partitioned, summed inside partitions, and moved by
    the totals of the partitions before: what is in one task is one row per partition.
    """
    if rows is not None and rows <= ONE_TASK_ROWS:
        over = Window.orderBy(*order)
        out = {f"cum_{c}": F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, 0)) for c in sums}
        if lead:
            out[f"next_{lead}"] = F.lead(lead).over(over)
        return df.withColumns(out)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranged")
    parts = ranged.groupBy("_part").agg(
        *[F.sum(c).alias(f"_{c}") for c in sums], *([F.min_by(lead, "_at").alias("_first")] if lead else [])
    )
    by_part = Window.orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums],
        *([F.lead("_first").over(by_part).alias("_first")] if lead else []),
    )
    inside = Window.partitionBy("_part").orderBy("_at")
    out = {f"cum_{c}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_{c}") for c in sums}
    if lead:
        out[f"next_{lead}"] = F.coalesce(F.lead(lead).over(inside), F.col("_first"))
    keep = [*df.columns, *[f"cum_{c}" for c in sums], *([f"next_{lead}"] if lead else [])]
    return ranged.join(parts, "_part").withColumns(out).select(*keep)
