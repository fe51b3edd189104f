"""Links between the members of buckets, without rows for all pairs of a bucket.

Members that look like their bucket's pivot, or like another member, are compared with
the pivot on full sets. Two members are then compared by how both differ from it, inside
a join that gives out links alone. So every pair of a bucket is compared, joined before
or refused by its sketches, and rows grow with members.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stars
from .runtime import materialise, release, tidy

#: Lanes of a sketch: two numbers of 32 lanes of two bits, each from another hash minimum.
LANES = 64
#: A pair is not compared if its sketches agree on fewer lanes than two sets at the
#: threshold do but with this probability.
LOSS = 2e-5
#: Members of one pivot that meet each other in one cell, on either side, up to MOST_SLICES
#: slices; the slices of a larger pivot grow instead of their number.
SLICE, MOST_SLICES = 512, 8

Differ = Callable[[DataFrame], DataFrame]


def least_agreement(percent: int) -> int:
    """Lanes on which sketches of two sets at the threshold agree at least, but for LOSS."""
    p = percent / 100 + (1 - percent / 100) / 4
    total, t = 0.0, 0
    while (total := total + comb(LANES, t) * p**t * (1 - p) ** (LANES - t)) <= LOSS:
        t += 1
    return t


def agreement(a: str, b: str) -> Column:
    """Lanes on which two sketches ``{a}1, {a}2`` and ``{b}1, {b}2`` agree."""
    apart = F.lit(0)
    for i in (1, 2):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(LANES) - apart


def bucket_members(keys: DataFrame, least: int) -> DataFrame:
    """Members of the buckets that several nodes of ``keys(key, node, sketch1, sketch2)`` share:
    (key, node, sketch1, sketch2, pivot, size, near).

    pivot is the bucket's least node; near tells whether the sketches of both agree. Left out
    are pivots, and members that look unlike the pivot and have no one else to look like.
    """
    # the sum and the join read one shuffle
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    shared = dealt.groupBy("key").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("size"),
        F.min_by("sketch1", "node").alias("first1"), F.min_by("sketch2", "node").alias("first2"),
    )
    shared = shared.where("pivot < last").drop("last")
    met = dealt.join(shared.hint("shuffle_hash"), "key")
    near = agreement("sketch", "first") >= least
    # null-safe, or a filter for nulls goes below the join and its side is another shuffle
    met = met.withColumn("near", near).where("not node <=> pivot and (near or size > 2)")
    return met.select("key", "node", "sketch1", "sketch2", "pivot", "size", "near")


def candidates(members: DataFrame, least: int) -> DataFrame:
    """Pairs ``(u, v, sketch1, sketch2, near)`` to compare: a member (with its sketch) and its
    pivot, and whether both look alike.

    Left out are members that look neither like the pivot nor like any other member.
    """
    near = members.where("near")
    a, b = members.where("not near").alias("a"), members.where("size > 2").alias("b")
    alike = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node"))
    rest = a.join(b, alike & (agreement("a.sketch", "b.sketch") >= least), "left_semi")
    return _once(near.unionByName(rest).select(F.col("node").alias("u"), F.col("pivot").alias("v"), "sketch1", "sketch2", "near"))


def _once(pairs: DataFrame) -> DataFrame:
    first = [F.first(c).alias(c) for c in ("sketch1", "sketch2")]
    return pairs.groupBy("u", "v").agg(*first, F.max("near").alias("near"))


def pairs_to_compare(passes: DataFrame | list[DataFrame], percent: int) -> DataFrame:
    """``candidates`` of keys, as a table; what led to it is deleted. Several ``passes`` of
    keys are shuffled one after the other, so that the disk holds the bands of one."""
    least, tables = least_agreement(percent), []
    for keys in passes if isinstance(passes, list) else [passes]:
        members = materialise(bucket_members(keys, least), "members")
        tidy(keys.sparkSession)  # the shuffle of these bands
        tables.append(materialise(candidates(members, least), "pairs", members.count()))
        release(members)
        tidy(keys.sparkSession)
    if len(tables) == 1:
        return tables[0]
    pairs = materialise(_once(reduce(DataFrame.unionByName, tables)), "pairs", sum(t.count() for t in tables))
    release(*tables)
    return pairs


def spread(near: DataFrame) -> DataFrame:
    """``near(u, v, out, down, across, ...)`` once or more for each side of the comparison of
    a pivot's members: ``first`` tells the side, and rows meet by v, ``row`` and ``col``.

    The members of one pivot are a grid of ``down`` times ``across`` cells, so that several
    tasks share the comparisons of a hot one. The first side holds members with ``out``
    alone, in one row of cells; the other holds all, in one column. Most pivots have one
    cell, and none has more than MOST_SLICES either way: rows grow with members.
    """
    at = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    cell = lambda row, col, first: F.struct(row.alias("row"), col.alias("col"), F.lit(first).alias("first"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(upto("across"), lambda j: cell(at("down"), j, True))
    other = F.transform(upto("down"), lambda i: cell(i, at("across"), False))
    cells = F.when(F.col("out"), F.concat(own, other)).otherwise(other)
    return near.select("*", F.inline(cells)).drop("down", "across")


def missed_links(verified: DataFrame, found: DataFrame, percent: int, differ: Differ) -> DataFrame:
    """Pairs ``(u, v)`` of components of ``found(node, component)``, between which there are
    links that ``verified`` hides: between nodes compared with one pivot, at least one of them
    not in the pivot's component. A node that is not in ``found`` is a component of its own.

    Both sets are known by how they differ from the pivot's, so the overlap is exact:
    the pivot's elements without those that either lacks, and what both have besides.
    Only links come out of the join; sketches and sizes alone refuse most pairs.
    """
    part = found.select("node", "component")
    of = lambda side: part.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    star = verified.join(of("u"), "u", "left").join(of("v"), "v", "left").drop("linked")
    star = star.withColumn("u_part", F.coalesce("u_part", "u")).withColumn("v_part", F.coalesce("v_part", "v"))
    star = table = materialise(star.withColumn("out", F.col("u_part") != F.col("v_part")), "stars")
    star = star.join(star.groupBy("u").agg(F.collect_set("v").alias("pivots")), "u")
    col = F.col
    base = col("a.nv") - col("a.n_less") - col("b.n_less")

    def enough(shared: Column) -> Column:
        # named once: a condition computes a column again for each place where it stands
        return (100 + percent) * (base + shared) >= percent * (col("a.nu") + col("b.nu"))

    most = F.least("a.n_more", "b.n_more") + F.least("a.n_less", "b.n_less")
    meet = (col("a.v") == col("b.v")) & (col("a.u_part") != col("b.u_part"))
    meet = meet & (agreement("a.sketch", "b.sketch") >= least_agreement(percent))
    # of several pivots that both were compared with, one is enough
    once = F.array_min(F.array_intersect("a.pivots", "b.pivots")) == col("a.v")
    # differences are made of those alone that look like another one of the same pivot, and
    # whose sizes, where they are known, allow a link
    a, b = star.alias("a"), star.alias("b")
    near = a.join(b, meet & (col("a.out") | col("b.out")) & F.coalesce(enough(most), F.lit(True)) & once, "left_semi")
    # by a struct of v, so that the join with it can be split
    many = star.groupBy(F.struct("v").alias("at")).agg(F.count_if("out").alias("n_out"), F.count("*").alias("n_all"))
    many = many.where(f"n_all > {SLICE}").select(col("at.v").alias("v"), "n_out", "n_all")
    slices = lambda n: F.least(F.lit(MOST_SLICES), F.lit(1) + F.floor(F.coalesce(F.col(n), F.lit(0)) / SLICE)).cast("int")
    near = near.join(many, "v", "left")
    near = near.withColumns({"down": slices("n_out"), "across": slices("n_all")}).drop("n_out", "n_all")
    full = differ(near)
    full = (full if "first" in full.columns else spread(full)).withColumns({"n_more": F.size("more"), "n_less": F.size("less")})
    a, b = full.where("first").alias("a"), full.where("not first").alias("b")
    # what both lack refuses most of the rest; only then is compared what both have besides
    lacked = F.size(F.array_intersect("a.less", "b.less"))
    shared = lacked + F.size(F.array_intersect("a.more", "b.more"))
    on = (col("a.row") == col("b.row")) & (col("a.col") == col("b.col"))
    on = on & meet & (~col("b.out") | (col("a.u") < col("b.u")))
    on = on & enough(most) & once & enough(lacked + F.least("a.n_more", "b.n_more")) & enough(shared)
    links = materialise(a.join(b, on).select(col("a.u_part").alias("u"), col("b.u_part").alias("v")).distinct(), "missed")
    release(table)
    return links


def exact_components(verified: DataFrame, percent: int, differ: Differ) -> DataFrame:
    """Components ``(node, component)`` from compared pairs ``(u, v, sketch1, sketch2, nu, nv,
    n_more, n_less, linked)``: v is a pivot, the sketch is u's, nu and nv are sizes of the
    sets, n_more and n_less count the elements that only u or only v has. ``differ`` adds
    these elements (more, less) to such rows, and sizes where they are null; it is called once,
    and what it returns is read twice. It may ``spread`` the rows before it makes sets."""
    links = verified.where("linked").select("u", "v")
    rows = links.count()
    edges = stars(links, rows)
    missed = missed_links(verified, edges.select(F.col("u").alias("node"), F.col("v").alias("component")), percent, differ)
    own = lambda c: F.struct(F.col(c).alias("node"), F.col(c).alias("component"))
    nodes = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), own("v"))))
    if further := missed.count():
        # only the components that hidden links join are linked again
        nodes = nodes.unionByName(missed.select(F.inline(F.array(own("u"), own("v")))))
    # a node's own name is never less than that of its component
    found = nodes.groupBy("node").agg(F.min("component").alias("component"))
    tables = [edges, missed]
    if further:
        tables.append(stars(missed, further))
        joined = tables[-1].select(F.col("u").alias("component"), F.col("v").alias("least"))
        found = found.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    out = materialise(found, "components", 2 * (rows + further))
    release(*tables)
    return out
