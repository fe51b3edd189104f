"""Delimited files, Parquet, and standard input."""

from __future__ import annotations

import sys
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..plans.running import shared_dir

#: Bytes of standard input that the driver holds at once.
BLOCK_BYTES = 8 << 20
# fixed values: what stands for a missing value in delimited text
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file, every column as text; only its first line is read here.

    "-" is standard input, which goes to a file in the shared folder block by block.
    ``delimited_pair`` makes scores and labels of two columns, and the scan then parses no
    other.
    """
    return spark.read.csv(spooled(spark) if path == "-" else path, sep=sep, header=header)


def delimited_pair(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(score, label)``: numbers, null for text that is none; and labels, whole numbers in
    their plain form ("1" for "1.0" and "+1")."""
    quoted = lambda name: F.col("`{}`".format(name.replace("`", "``")))
    return df.select(quoted(score).try_cast("double").alias("score"), plain_label(quoted(label)).alias("label"))


def plain_label(text: Column) -> Column:
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    whole = (F.abs(number) < float(1 << 53)) & (number == F.floor(number).cast("double"))
    plain = F.when(whole, number.cast("long").cast("string")).otherwise(trimmed)
    return F.when(~trimmed.isin(*MISSING), plain)


def spooled(spark: SparkSession, stream: Any = None) -> str:
    """The path of a file with what a stream holds (standard input unless given), in the
    shared folder, gone when the application ends. One block at a time is in memory."""
    stream = stream or getattr(sys.stdin, "buffer", sys.stdin)
    path = f"{shared_dir(spark).rstrip('/')}/cutpoint/stdin-{uuid.uuid4().hex}/rows.csv"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(where.getParent())
    out = system.create(where)
    try:
        while block := stream.read(BLOCK_BYTES):
            out.write(bytearray(block.encode() if isinstance(block, str) else block))
    finally:
        out.close()
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pick_column(df: DataFrame, wanted: str | None, position: int, role: str) -> str:
    """A column by name, else by a number that is a position, else the one at ``position``."""
    names = df.columns
    if wanted is None:
        if position >= len(names):
            raise ConfigurationError(f"the input has {len(names)} columns, so none at {position} for {role}")
        return names[position]
    if wanted in names:
        return wanted
    if wanted.isdigit() and int(wanted) < len(names):
        return names[int(wanted)]
    raise ConfigurationError(f"no column {wanted!r} for {role}; there are {', '.join(names)}")
