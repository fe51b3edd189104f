"""URL filters: a sorted sweep of pages over nested rules, by DataFrame functions alone.

A key is a host's labels, last first, then a slash and the path, so what a rule fits at one
of a url's domains is what starts with the rule's key: an interval of keys. Intervals of
prefixes are nested or apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise, release

#: Rules, or cells of pages, that one task may sweep; more are swept in ranges of keys.
ONE_TASK_ROWS = 100_000
#: Judged cells that are broadcast at most: each holds CELL_CHARS characters or fewer.
BROADCAST_CELLS, CELL_CHARS = 50_000, 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    """The labels of a host, last first."""
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.concat_ws(".", labels), F.lit("/"), path), "UTF-8")


def carried(df: DataFrame, order: list[str], value: str, rows: int) -> DataFrame:
    """``df`` with ``value`` filled from the last row before, in ``order``, that has one.

    Up to ONE_TASK_ROWS one task does it. Beyond, rows are dealt by ranges of ``order`` and
    filled within them; what a range begins with comes from the ranges before.
    """
    if rows <= ONE_TASK_ROWS:
        return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.orderBy(*order)))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    ends = ranged.where(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, "_at").alias("_last"))
    ends = ranged.select("_range").distinct().join(ends, "_range", "left")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = ends.select("_range", before.alias("_before"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_range").orderBy("_at"))
    return ranged.join(begins, "_range").withColumn(value, F.coalesce(inside, "_before")).select(*df.columns)


def summed(df: DataFrame, order: list[str], value: str, rows: int) -> DataFrame:
    """``df`` with ``value`` summed up to each row in ``order``, in one task or in ranges."""
    if rows <= ONE_TASK_ROWS:
        return df.withColumn(value, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(totals, "_range").withColumn(value, inside + F.col("_before")).select(*df.columns)


def segments(rules: DataFrame) -> DataFrame:
    """``(key, top)``: from each key on, up to the next, the innermost rule that is open, as a
    struct (rule, verdict, long); its fields are null where none is.

    A sweep over where rules open and close. The stack's height is a running sum, and its
    top is the rule that last opened at that height.
    """
    opens = rules.groupBy(_key(_labels(F.col("host")), F.col("path")).alias("key")).agg(
        F.max(F.struct(F.col("verdict"), F.concat("host", "path").alias("rule"), F.char_length(F.concat("host", "path")).alias("long"))).alias("r")
    )
    opens = materialise(opens.select("key", F.struct("r.rule", "r.verdict", "r.long").alias("top")), "rules")
    count = 2 * opens.count()
    # no byte of UTF-8 text is 0xFF, so this sorts after all that starts with the key
    closes = opens.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(None).cast(dict(opens.dtypes)["top"]).alias("top"))
    events = opens.withColumn("height", F.lit(1)).unionByName(closes.withColumn("height", F.lit(-1)))
    events = summed(events.withColumn("height", F.col("height").cast("long")), ["key"], "height", count)
    tops = carried(events, ["height", "key"], "top", count)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(-1).alias("long"))
    out = materialise(tops.select("key", F.when(F.col("height") > 0, F.col("top")).otherwise(none).alias("top")), "segments")
    release(opens)
    return out


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """The rule that fits each url, and its verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains, if the
    url's path starts with its path. The longest (of host and path together) wins; of
    equally long ones that with the longer host. Of rules with one host and path the one
    with the last verdict (block before allow) counts. A rule with a null is left out; its
    host is lower-cased.

    1. Urls are cut to what rules can tell apart: as many labels as the longest host of a
       rule has, as many characters as its longest path. Each such cell is judged once.
    2. A cell is probed at each of its domains: the sorted keys of probes sweep over those
       where rules open and close, and the rule on top of the stack is the longest that
       fits that domain.
    3. Verdicts go back to the pages: broadcast if the cells are few and short, else by a
       join that adaptive execution splits where a cell is hot.

    Returns per input row: page_id, host, path, rule (host and path; null if none fits) and
    verdict (the rule's, else ``default``). A null url, or one without ``://``, has an empty
    host and path, which only a rule of an empty host fits. Repeated rows are judged each;
    an empty table stays empty; without rules all get ``default``. Other columns are not read.
    """
    spark = pages.sparkSession
    lower = F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host")
    rules = rules.select(lower, F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict"))
    rules = rules.where("host is not null and path is not null and verdict is not null")
    widest = rules.agg(
        F.coalesce(F.max(F.size(_labels(F.col("host")))), F.lit(0)), F.coalesce(F.max(F.char_length("path")), F.lit(0)), F.coalesce(F.max(F.char_length("host")), F.lit(0))
    ).first()
    labels, chars, host_chars = widest
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not labels:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # a label longer than any rule's host fits none, so its cell needs no more of it
    domain = F.transform(F.slice(_labels(F.col("host")), 1, labels), lambda x: F.substring(x, 1, host_chars + 1))
    cell = lambda df: df.withColumns({"c_host": F.concat_ws(".", domain), "c_path": F.substring("path", 1, chars)})
    cells = materialise(cell(rows).groupBy("c_host", "c_path").agg(F.count("*").alias("n")), "cells")
    tops = segments(rules)
    own = F.split("c_host", r"\.", -1)
    probes = cells.select("c_host", "c_path", F.explode(F.sequence(F.lit(1), F.size(own))).alias("depth"))
    probes = probes.select(
        _key(F.slice(own, F.lit(1), F.col("depth")), F.col("c_path")).alias("key"), "c_host", "c_path", "depth",
        F.lit(1).alias("kind"), F.lit(None).cast(dict(tops.dtypes)["top"]).alias("top"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    marks = tops.select(
        "key", null("string").alias("c_host"), null("string").alias("c_path"), F.lit(0).alias("depth"), F.lit(0).alias("kind"), "top"
    )
    n_cells = cells.count()
    swept = carried(marks.unionByName(probes), ["key", "kind", "c_host"], "top", n_cells * labels + tops.count())
    found = F.max(F.struct(F.col("top.long").alias("long"), "depth", "top")).alias("best")
    judged = swept.where("kind = 1 and top.long >= 0").groupBy("c_host", "c_path").agg(found)
    judged = materialise(judged.select("c_host", "c_path", "best.top.rule", "best.top.verdict"), "judged")
    release(cells, tops)

    size = judged.agg(F.count("*"), F.coalesce(F.max(F.char_length(F.concat("c_host", "c_path", "rule", "verdict"))), F.lit(0))).first()
    if size[0] <= BROADCAST_CELLS and size[1] <= CELL_CHARS:
        judged = F.broadcast(judged)
    out = cell(rows).join(judged, ["c_host", "c_path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
