"""Session helpers shared by the training-data operators.

Lineage is cut with Parquet tables in the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs the running stage only.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workers import send_package

#: Rows in one Arrow batch that goes to Python; whole texts of a batch are in memory together.
BATCH_ROWS = 512
#: Rows of one file of a table whose size is known beforehand.
FILE_ROWS = 10_000


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only on a local master, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.gettempdir()}/checkpoints"


def _new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, deleted at the latest when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/cutpoint/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and return that table.

    The table goes by ``release`` or when the application ends. Its rows are fixed from
    then on, whatever executors are lost later.

    If ``rows`` is given, ``df`` is known to have no more rows: then neighbouring
    partitions are written together, a file for each FILE_ROWS and one for each core at
    least. A small table is else as many tiny files as a shuffle has partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = _new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cutpoint_path = path
    return table


def materialise_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialise``, dealt to as many buckets by ``key`` as a shuffle has partitions:
    joins and sums by ``key`` then need no shuffle of this table."""
    spark = df.sparkSession
    path, table = _new_path(spark, name), f"cutpoint_{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.cutpoint_path, out.cutpoint_table = path, table
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        if name := getattr(t, "cutpoint_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        where = context._jvm.org.apache.hadoop.fs.Path(t.cutpoint_path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone, which it else does when
    the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_fold(id_col: str) -> F.Column:
    """crc32 of the id as text modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def by_group(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[dict[str, pa.ChunkedArray], np.ndarray], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """Deal rows by integer ``keys`` and hand whole groups to ``fn``.

    ``fn`` gets the columns of one or more complete groups and the offsets where each
    group starts (with the end added). Callers bound the size of a group beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows < 4096 and size < 8 << 20:
                continue
            table = pa.Table.from_batches(held)
            starts = bounds(table)
            cut = int(starts[-2])
            if cut:
                done = table.slice(0, cut)
                yield fn({c: done.column(c) for c in done.column_names}, starts[:-1])
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
            size = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            yield fn({c: table.column(c) for c in table.column_names}, bounds(table))

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)
