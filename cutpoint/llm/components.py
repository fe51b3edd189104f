"""Connected components by alternating large-star and small-star, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .runtime import materialise, release


def _least(directed: DataFrame) -> DataFrame:
    """``(u, m)``: the least of each u and all its v.

    Summed by a struct of u: a join by u then deals these rows anew, so that both its sides
    are plain exchanges and a node with very many links is split by adaptive execution.
    """
    least = directed.groupBy(F.struct("u").alias("at")).agg(F.min("v").alias("m"))
    return least.select(F.col("at.u").alias("u"), F.least("at.u", "m").alias("m"))


def _pair(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(_pair("u", "v"), _pair("v", "u"))))
    met = both.join(_least(both), "u").where("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here every edge runs from the larger node u to the smaller v
    met = edges.join(_least(edges), "u")
    return met.select(F.inline(F.array(_pair("v", "m"), _pair("u", "m")))).where("u != v").distinct()


def stars(links: DataFrame, rows: int) -> DataFrame:
    """A table of edges ``(u, v)`` from each linked node u to its component's least node v,
    which has none. ``links(u, v)`` is a table, of ``rows`` rows at most.

    One round of large-star and small-star is one plan and one table, which has no more rows
    than the links. Rounds end when the edges are stars.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    last = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges", rows)
        if last is not None:
            release(last)
        last = edges
        up, down = F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))
        ends = edges.select(F.inline(F.array(up, down))).groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        # up: edges to smaller nodes; all the others come from larger ones
        if ends.where("up > 1 or up = 1 and all > 1").isEmpty():
            return edges


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; component is its least node.

    Self-links name a node without linking it; rows with a null are ignored. An empty
    table gives an empty result. Each round's table is deleted once the next is written.
    """
    links = links.select("u", "v").where("u is not null and v is not null")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialise(links, "links")
    rows = links.count()
    edges = stars(links, rows)
    # a node's own name is never less than that of its component
    named = F.inline(F.array(_pair("u", "u"), _pair("v", "v")))
    found = links.select(named).unionByName(edges).groupBy("u").agg(F.min("v").alias("component"))
    out = materialise(found.withColumnRenamed("u", "node"), "components", 2 * rows)
    release(links, edges)
    return out


def _whole(df: DataFrame, id_col: str) -> bool:
    return isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType))


def numbered(df: DataFrame, id_col: str) -> Column:
    """The id as a long: itself if it is a whole number, else its 64-bit hash; null for null."""
    col = F.col(id_col)
    return col.cast("long") if _whole(df, id_col) else F.when(col.isNotNull(), F.xxhash64(col))


def with_least(rows: DataFrame, component: Column, id_col: str) -> DataFrame:
    """``rows`` with ``least``, the least id of the rows of each ``component``, which is named
    by the least of ``numbered`` ids: for whole numbers, that id itself."""
    if _whole(rows, id_col):
        return rows.withColumn("least", component.cast(rows.schema[id_col].dataType))
    rows = rows.withColumn("part", component)
    least = rows.where("part is not null").groupBy("part").agg(F.min(id_col).alias("least"))
    return rows.join(least, "part", "left")
