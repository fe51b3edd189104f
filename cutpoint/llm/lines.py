"""Line dedup: fuzzy lines by MinHash over character shingles, by DataFrame functions alone.

Shingles become rows of a whole-stage-codegen aggregate (two hashes each, sixteen minima),
not elements of arrays under lambdas, which take ten times as long.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, materialise, materialise_buckets, release, tidy
from .stars import exact_components, pairs_to_compare

#: Characters of a shingle, unless a caller names another number. With 9, about 90 characters
#: of a line are needed to forgive it one edit; with 5, about 50.
SHINGLE = 5
#: Shingles are dealt to PARTS by their hash; each part has MINIMA minima, which make bands
#: of ROWS: 16 bands in all. Two lines of similarity 0.8 share no band once in 4600.
PARTS, MINIMA, ROWS = 4, 16, 4


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that are not blank, without outer blanks: (doc, pos, line, node); node is the
    line's 64-bit hash, by which lines are known."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc is not null and text is not null")
    each = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", _trimmed(F.col("line"))).where("line != ''")
    return each.withColumn("node", F.xxhash64("line"))


def _starts(chars: Column, shingle: int) -> Column:
    """Places (from 1) of the shingles in UTF-32 bytes; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(chars) - F.lit(4 * shingle - 1)), F.lit(4))


def signatures(lines: DataFrame, shingle: int, seed: int = 2) -> DataFrame:
    """``(node, sketch1, sketch2, k<part>_<band>...)``, a row for each of ``lines(node, line)``.

    The functions are rotations of two 64-bit hashes xor a random mask: an order by a
    number's first bits, and each rotation brings other bits to the front. A part without
    shingles gives no band. If ``lines`` is dealt by node, nothing here is shuffled.
    """
    masks = np.random.default_rng(seed).integers(0, 1 << 62, MINIMA).tolist()
    chars = lines.select("node", F.encode("line", "UTF-32").alias("chars"))
    each = chars.select("node", "chars", F.explode(_starts(F.col("chars"), shingle)).alias("at"))
    each = each.select("node", F.xxhash64(F.substring("chars", F.col("at"), F.lit(4 * shingle))).alias("h0"))
    each = each.select("node", "h0", F.xxhash64("h0").alias("h1"))
    half, step = MINIMA // 2, 128 // MINIMA

    def order(i: int) -> Column:
        h, turn = F.col(f"h{i // half}"), step * (i % half)
        turned = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h
        return turned.bitwiseXOR(F.lit(masks[i]))

    part = F.col("h0").bitwiseAND(F.lit(PARTS - 1)).alias("part")
    least = each.groupBy("node", part).agg(*[F.min(order(i)).alias(f"m{i}") for i in range(MINIMA)])

    def lanes(first: int) -> Column:
        """Two middle bits (not those that name the part) of half of the minima, at the part's place."""
        out = F.lit(0).cast("long")
        for i in range(half):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(f"m{first + i}", 28).bitwiseAND(F.lit(3)), 2 * i))
        place = F.lit(0).cast("long")
        for p in range(PARTS):
            place = F.when(F.col("part") == p, F.shiftleft(out, 2 * half * p)).otherwise(place)
        return place

    bands = MINIMA // ROWS
    keys = [F.xxhash64("part", F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]).alias(f"k{b}") for b in range(bands)]
    least = least.select("node", "part", lanes(0).alias("s1"), lanes(half).alias("s2"), *keys)
    named = [F.max(F.when(F.col("part") == p, F.col(f"k{b}"))).alias(f"k{p}_{b}") for p in range(PARTS) for b in range(bands)]
    return least.groupBy("node").agg(F.bit_or("s1").alias("sketch1"), F.bit_or("s2").alias("sketch2"), *named)


def _bands(signed: DataFrame, parts: Iterable[int]) -> DataFrame:
    """``(key, node, sketch1, sketch2)``, a row for each band of some parts of ``signatures``."""
    every = F.array(*[f"k{p}_{b}" for p in parts for b in range(MINIMA // ROWS)])
    return signed.select(F.explode(every).alias("key"), "node", "sketch1", "sketch2").where("key is not null")


def band_keys(lines: DataFrame, shingle: int, seed: int = 2) -> DataFrame:
    """``(key, node, sketch1, sketch2)``, a row for each band of each of ``lines(node, line)``."""
    return _bands(signatures(lines, shingle, seed), range(PARTS))


def _shingles(line: str, shingle: int) -> Column:
    """Hashes of the line's distinct shingles."""
    one = lambda chars: F.transform(
        _starts(chars, shingle), lambda at: F.xxhash64(F.substring(chars, at, F.lit(4 * shingle)))
    )
    # the outer lambda holds the encoded line, which is else encoded for every shingle
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), one)))


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs(u, v, ...)`` with the lines of u (left) and v (right)."""
    # both sides of each join are shuffled, so that a pivot of very many pairs is split
    met = pairs.join(lines.select(F.col("node").alias("v"), F.col("line").alias("right")), "v")
    return met.join(lines.select(F.col("node").alias("u"), F.col("line").alias("left")), "u")


def _sized(pairs: DataFrame, lines: DataFrame, shingle: int) -> DataFrame:
    """``pairs(u, v, ...)`` with set sizes nu and nv, and how many shingles only u has (n_more)
    and only v (n_less); dealt by u, so that the pairs of a hot pivot take many tasks."""
    met = _texts(pairs, lines).select(*pairs.columns, _shingles("left", shingle).alias("a"), _shingles("right", shingle).alias("b"))
    both = F.size(F.array_intersect("a", "b")).alias("n_both")
    met = met.select(*pairs.columns, F.size("a").alias("nu"), F.size("b").alias("nv"), both)
    return met.withColumns({"n_more": F.col("nu") - F.col("n_both"), "n_less": F.col("nv") - F.col("n_both")}).drop("n_both")


def _differing(pairs: DataFrame, lines: DataFrame, shingle: int) -> DataFrame:
    """``pairs(u, v, ...)`` with set sizes nu and nv, the shingles that only u has (more) and
    those that only v has (less); dealt as in ``_sized``."""
    kept = [c for c in pairs.columns if c not in ("nu", "nv")]
    met = _texts(pairs, lines).select(*kept, _shingles("left", shingle).alias("a"), _shingles("right", shingle).alias("b"))
    sizes = [F.size("a").alias("nu"), F.size("b").alias("nv")]
    return met.select(*kept, *sizes, F.array_except("a", "b").alias("more"), F.array_except("b", "a").alias("less"))


def line_groups(lines: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """Components ``(node, component)`` of linked ``lines(node, line)``, one row a line,
    dealt by node.

    Lines that share a band are a bucket. Those whose sketch agrees with that of the
    bucket's pivot, or of another member, are compared with the pivot, and with each other
    by how they differ from it: no more pairs than members are rows.
    """
    signed = materialise(signatures(lines, shingle), "signed")
    pairs = pairs_to_compare([_bands(signed, [p]) for p in range(PARTS)], percent)
    release(signed)
    # of all lines, those that are compared are read once, and hashing them spares sorting all
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().hint("shuffle_hash")
    compared = materialise(lines.join(nodes, "node").select("node", "line"), "compared-lines")
    sized = _sized(pairs.where("near").drop("near"), compared, shingle)
    linked = 100 * (F.col("nu") - F.col("n_more")) >= percent * (F.col("nv") + F.col("n_more"))
    # sketches refuse the link to a pivot that looks unlike; its members may be linked with each other
    sized = sized.withColumn("linked", linked).unionByName(
        pairs.where("not near").drop("near").withColumn("linked", F.lit(False)), allowMissingColumns=True
    )
    verified = materialise(sized, "verified")
    tidy(lines.sparkSession)
    tables = [pairs, compared, verified]

    def differ(rows: DataFrame) -> DataFrame:
        # both sides of the comparison read this table, so that each set is made once
        tables.append(materialise(_differing(rows, compared, shingle), "differing"))
        return tables[-1]

    found = exact_components(verified, percent, differ)
    release(*tables)
    return found


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE
) -> DataFrame:
    """(doc, kept): by document, the lines that stay, named ``number:hash``."""
    lines = _lines(docs, id_col, text_col)
    # summed in each task before the shuffle, so a very common line is moved once a task
    lines = lines.groupBy("node").agg(F.min(F.struct("doc", "pos")).alias("first"), F.min("line").alias("line"))
    lines = materialise_buckets(lines, "lines", "node")
    tidy(docs.sparkSession)  # the texts' shuffle files
    found = line_groups(lines.select("node", "line"), percent, shingle)
    firsts = lines.select("node", "first").join(found.hint("shuffle_hash"), "node", "left")
    place = F.struct(F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"), "node")
    grouped = firsts.where("component is not null").groupBy("component").agg(F.min(place).alias("place")).select("place.*")
    alone = firsts.where("component is null").select(place.alias("place")).select("place.*")
    names = F.collect_list(F.concat_ws(":", "pos", "node"))
    kept = materialise(alone.unionByName(grouped).groupBy("doc").agg(names.alias("kept")), "kept")
    release(lines)
    tidy(docs.sparkSession)
    return kept


def _names(lines: Column) -> Column:
    """By line of an array, ``number:hash``, and ``number:`` for a blank one."""
    return F.transform(
        lines, lambda x, i: F.concat_ws(":", i, F.when(_trimmed(x) != "", F.xxhash64(_trimmed(x)).cast("string")).otherwise(F.lit("")))
    )


def _written(names: Column) -> Column:
    """The names of lines that are not blank."""
    return F.filter(names, lambda x: ~x.endswith(":"))


def _without(lines: Column, kept: Column) -> Column:
    """A text's lines that stay, with a line feed between. Whole arrays of names are compared
    by hashing, so the work is in proportion to the lines."""

    def rest(lines: Column, names: Column) -> Column:
        stay = F.array_except(names, F.array_except(_written(names), kept))
        return F.array_join(F.transform(stay, lambda x: F.get(lines, F.substring_index(x, ":", 1).cast("int"))), "\n")

    # lambdas hold the lines and their names, which are else made anew for every line
    named = F.transform(F.array(F.struct(lines.alias("lines"))), lambda x: F.struct(x["lines"].alias("lines"), _names(x["lines"]).alias("names")))
    return F.transform(named, lambda x: rest(x["lines"], x["names"]))[0]


def dedupe_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE
) -> DataFrame:
    """``docs`` with one line kept of each group of near-equal lines; all columns stay.

    Lines are parts between line feeds, compared without outer blanks; two are linked if
    the sets of their ``shingle``-character shingles have a similarity of ``percent`` or
    more, and of each connected component the first line (least id, then number) stays.
    Blank lines stay. A document may lose all its lines: its text is then empty. Rows with
    a null text or a null id stay as they are and take no part. Rows with an equal id
    count as one document: a line is removed from each where it is not the first. Ids may
    be of any type that can be ordered. An empty table stays empty; a text without line
    feeds is one line, however long. Lines are known by 64-bit hashes.
    """
    kept = kept_lines(docs, id_col, text_col, percent, shingle)
    own, stays = fresh(docs, "kept_doc"), fresh(docs, "kept_lines")
    met = docs.join(kept.select(F.col("doc").alias(own), F.col("kept").alias(stays)), F.col(id_col) == F.col(own), "left")
    text = F.col(text_col).cast("string")
    new = _without(F.split(text, "\n"), F.coalesce(F.col(stays), F.array().cast("array<string>")))
    new = F.when(F.col(id_col).isNull() | text.isNull(), text).otherwise(new)
    return met.withColumn(text_col, new).select(*docs.columns)


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE
) -> DataFrame:
    """Per input row: doc_id, n_lines, n_removed and removed (line numbers, comma-joined).

    Groups and odd rows are as in ``dedupe_lines``; a null text has no lines, and of a row
    with a null id none is removed."""
    kept = kept_lines(docs, id_col, text_col, percent, shingle)
    text = F.col(text_col).cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), n_lines.alias("n_lines"), _written(_names(F.split(text, "\n"))).alias("names"))
    met = rows.join(kept, rows.doc_id == kept.doc, "left")
    gone = F.array_except("names", F.coalesce("kept", F.array().cast("array<string>")))
    gone = F.when(F.col("doc_id").isNotNull() & F.col("names").isNotNull(), gone).otherwise(F.array().cast("array<string>"))
    numbers = F.transform("gone", lambda x: F.substring_index(x, ":", 1))
    return met.withColumn("gone", gone).select(
        "doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(numbers, ",").alias("removed")
    )
