"""Near-duplicate lines by deletion neighbourhoods, with DataFrame operations only.

A line that differs by at most one character (added, removed or replaced) from a line that comes earlier, in the order
(doc_id, position), is removed; so is every later copy of a line. Lines shorter than ``min_chars`` characters, where one
character is much of the text, are compared for equality only; blank lines are dropped.

Two lines within one edit agree on what stands before it and after it. A variant of a line is the line without one block
of ``c`` or so characters, known by a hash of what is left and by the block's place; lines that share a variant differ
within the block only. The blocks shrink in three rounds: one half of the line, then cells of about an eighth of that
block, then single characters, where equal variants mean one edit at most. Lines that share no variant leave after
each round, so only lines with close partners pay for the full neighbourhood, and nothing is compared pair by pair: the
earliest line of each variant of the last round is the only partner that each line needs. Each such partner is
verified with ``levenshtein``.

Defined cases: a NULL or blank text has no lines and stays as it is; repeated rows (same doc_id and text) count as one
occurrence, so all of them keep the same lines; a NULL doc_id comes before all others; an empty table gives an empty
result; other columns are not read (``drop_lines`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import SPACE, Scratch, small

MIN_CHARS = 20


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, line for each line that is not blank."""
    # Outer forms of explode keep Spark from testing an array's size, and so computing it, ahead of the explode.
    return (docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
            .where(F.btrim("line", F.lit(SPACE)) != "").withColumns({"h": F.xxhash64("line"), "len": F.length("line")}))


def _half_sizes(n: Column) -> tuple[Column, Column]:
    """Of two lines within one edit, the shorter of length n or n - 1, the first or the last so many characters agree."""
    return F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")


def _half_keys(line: Column, n: Column) -> Column:
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(side), h, part(line, h)) for h in _half_sizes(n)
                                      for side, part in ((0, F.left), (1, F.right))]))


def _halves(line: Column, n: Column) -> Column:
    """Variants without one half: the hash of the half that is left, and the other half."""
    return F.array_distinct(F.array(*[
        F.struct(F.xxhash64(F.lit(side), h, part(line, h)).alias("key"), rest(line, n - h).alias("rest"))
        for h in _half_sizes(n) for side, part, rest in ((0, F.left, F.right), (1, F.right, F.left))]))


def _cell(n: Column) -> Column:
    """A power of two near n / 8."""
    return F.when(n < 16, 1).otherwise(F.pow(F.lit(2), F.floor(F.log2(n / 8.0)))).cast("int")


def _blocks(group: Column, rest: Column, n: Column, cell: Column) -> Column:
    """Variants without one block: p characters stand before it and s after it, both multiples of the cell.

    An edit behind p0 characters leaves n - p0 or n - p0 - 1 behind it; with p the multiple below p0, s is one of the two
    multiples below n - p. A block has fewer than three cells; for a cell of 1, equal variants mean one edit at most.
    """
    def at(a: Column) -> Column:
        p = a * cell
        s = F.floor((n - p) / cell).cast("int") * cell

        def variant(s: Column) -> Column:
            left = F.when(s > 0, F.right(rest, s)).otherwise("")
            return F.struct(F.xxhash64(group, cell, p, s, F.left(rest, p), left).alias("key"),
                            F.substring(rest, p + 1, n - p - s).alias("rest"))
        return F.array(variant(s), F.when(s >= cell, variant(s - cell)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / cell).cast("int")), at)))


def _rounds(rows: DataFrame, cells: Column) -> DataFrame:
    """One row for each variant of each row's rest, for each distinct cell."""
    rows = rows.withColumn("n", F.length("rest")).withColumn("cell", F.explode(F.array_distinct(cells)))
    blocks = _blocks(F.col("key"), F.col("rest"), F.col("n"), F.col("cell"))
    return rows.select("h", "len", "first", F.explode_outer(blocks).alias("v")).select("h", "len", "first", "v.key", "v.rest")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shared(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose variant another line has too. The variants are written once and read twice."""
    rows = scratch.save(rows, name)
    return rows.join(rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"),
                     "key", "left_semi")


def kept_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, kept): the positions of the lines that stay. ``docs`` has the columns doc_id and text."""
    lines = _lines(docs)
    first = F.min(F.struct("doc_id", "th", "pos")).alias("first")
    keys = F.when(F.col("len") >= min_chars, _half_keys(F.col("line"), F.col("len")))
    distinct = scratch.save(lines.withColumn("keys", keys).select("h", "len", "doc_id", "th", "pos", "keys")
                            .groupBy("h", "len").agg(first, F.first("keys").alias("keys")), "distinct")
    halves = distinct.select("h", F.explode("keys").alias("key")).groupBy("key").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    # A half that two lines share names both; only halves with more lines are looked up again.
    more = distinct.select("h", F.explode("keys").alias("key")).join(halves.where("c > 2").select("key"), "key", "left_semi").select("h")
    near = scratch.save(halves.select(F.explode(F.array("lo", "hi")).alias("h")).union(more).distinct(), "near")

    # The text of one occurrence of each line that shares a half with another.
    wanted = distinct.join(small(near), "h", "left_semi").select("h", "len", "first")
    place = F.struct("doc_id", "th", "pos")
    texts = lines.where(F.col("len") >= min_chars).join(small(near), "h", "left_semi").select("h", "len", place.alias("first"), "line")
    texts = scratch.save(texts.join(wanted, ["h", "len", "first"], "left_semi").dropDuplicates(["h", "len"]), "texts")
    rows = (texts.select("h", "len", "first", F.explode_outer(_halves(F.col("line"), F.col("len"))).alias("v"))
            .select("h", "len", "first", "v.key", "v.rest"))
    rows = _shared(rows, scratch, "halves")
    n = F.length("rest")
    rows = _shared(_rounds(rows, F.array(_cell(n), _cell(F.greatest(n - 1, F.lit(0))))), scratch, "cells")
    rows = scratch.save(_rounds(rows, F.array(F.lit(1))).drop("rest"), "chars")
    earliest = rows.groupBy("key").agg(F.min(F.struct("first", "h", "len")).alias("e"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = rows.join(earliest, "key").where("e.h <> h AND e.first < first").select("h", "len", F.col("e.h").alias("h2"), F.col("e.len").alias("len2")).distinct()
    text = texts.select("h", "len", "line")
    checked = (pairs.join(text, ["h", "len"]).join(text.toDF("h2", "len2", "line2"), ["h2", "len2"])
               .where(F.levenshtein("line", "line2", 1) == 1))
    removed = scratch.save(checked.select("h", "len").distinct(), "removed")
    scratch.drop("near", "texts", "halves", "cells", "chars")
    stay = distinct.select("h", "len", "first").join(small(removed), ["h", "len"], "left_anti")
    return stay.groupBy("first.doc_id", "first.th").agg(F.sort_array(F.collect_list("first.pos")).alias("kept"))


def _with_kept(docs: DataFrame, min_chars: int) -> DataFrame:
    """Add th, all (the lines) and kept (the positions that stay) to a frame with doc_id and text."""
    scratch = Scratch(docs.sparkSession)
    kept = kept_lines(docs.select("doc_id", "text"), scratch, min_chars).toDF("__id", "__th", "kept")
    left = docs.withColumn("th", F.xxhash64("text"))
    return left.join(kept, left["doc_id"].eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").drop("__id", "__th")


def _text() -> Column:
    """The kept lines, joined by a line feed."""
    return F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda p: F.get("__lines", p)), "\n")


def _split(rows: DataFrame) -> DataFrame:
    """Add __lines and the number of lines that are not blank; both read one split of the text."""
    rows = rows.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    return rows.withColumns({"__n": F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACE)) != "")).cast("long"), "__left": _text()})


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (what is left; empty for a NULL text), n_lines and n_removed for each row."""
    rows = _split(_with_kept(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), min_chars))
    return rows.select("doc_id", F.col("__left").alias("text"), F.col("__n").alias("n_lines"),
                       (F.col("__n") - F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias("n_removed"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text",
               n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with only the kept lines in the text; rows that had lines and lose all of them go."""
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row"))
    rows = _split(_with_kept(packed, min_chars)).where((F.col("__n") == 0) | F.col("kept").isNotNull())
    left = F.when(F.col("__n") == 0, F.col("text")).otherwise(F.col("__left"))
    return rows.select(*[(left if c == text else F.length(left).cast("long") if c == n_chars
                          else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
