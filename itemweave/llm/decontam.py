"""Benchmark decontamination by templates, with DataFrame operations only.

Words are brought to a canonical form: numbers, units behind a number, and names (capitals inside a sentence) become typed
placeholders, other words lose punctuation and case. Every WINDOW consecutive canonical words of a benchmark item with at
least LITERALS ordinary words are a template. Windows of documents meet templates by an equality join on their hash.
Matches are grouped by document, item and alignment (place in the document minus place in the item, in words). In an
alignment each slot value of the item stands for one value in the document, that of most windows (of equals the least);
windows with another value do not count, so the same question with other numbers or names is found and a chance mixture
is not. Which words are names depends on their case and on full stops, so
the place of a template is also found by the WINDOW words as they are, without case and punctuation, wherever they stand
in the document. An item leaks into a document if consistent windows and literal windows cover at least ``percent`` of
its templates; of an item without templates (all capitals, say) every literal window counts instead.

Each window of the benchmark has an anchor, that of its ordinary words which the fewest items hold, the longest of those. A document
can hold the window only where it holds the anchor, so words of documents meet the broadcast anchors first, and forms and
hashes are computed for the windows round a hit alone. If a window has no anchor, or there are more than BROADCAST_ROWS
of them, all windows of the documents are hashed instead; both ways give the same rows. Tables written on the way hold the
words of windows, never all words of a document: Spark's reader holds 4096 rows of a table at once.

The benchmark side is broadcast only when its counted templates are within BROADCAST_ROWS; beyond it the join shuffles.
Slot values travel only with matching windows.

Defined cases: a NULL, empty or short text has no window; an item with fewer than WINDOW words has no window and cannot
leak; repeated documents are reported once for each doc_id, repeated items once for each item_id; NULL ids group
together; empty tables give empty results; other columns are not read (``drop_leaks`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import BROADCAST_ROWS, Scratch, small, words

WINDOW, LITERALS, PERCENT = 8, 4, 50

# Units of measure that may follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hours days weeks months years miles meters metres "
         "kilometers grams kilograms liters litres dollars euros cents percent usd eur mph kmh kb mb gb tb hz w kw v a k c f").split()

#: Ends of sentences become this character, other punctuation goes.
_STOP, _MARKS = "\x01", ".!?,;:\"()[]{}“”„«»"


def canonical(df: DataFrame, text: str) -> DataFrame:
    """Add __m (words with ends of sentences marked) and __c (canonical words)."""
    return _forms(_marked(df, text))


def _marked(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__m", words(F.translate(F.col(text), _MARKS, _STOP * 3)))


def _bare(w: Column) -> Column:
    return F.replace(w, F.lit(_STOP), F.lit(""))


def _forms(df: DataFrame) -> DataFrame:
    """Add __c for __m; where __m starts inside a text, the first form may be another, as it depends on the word before."""
    def number(w: Column) -> Column:
        return (w >= "0") & (w < ":") & F.regexp_like(w, F.lit("^[0-9]+([-/%][0-9]*)*$"))

    def form(m: Column, i: Column) -> Column:
        w = _bare(m)
        low = F.lower(w)
        # Lower-case words, by far the most, need no look at the word before unless they may be units.
        return (F.when(number(w), "<n>")
                .when(low.isin(UNITS) & number(_bare(F.get("__m", i - 1))), "<u>")
                .when((low != w) & (i > 0) & ~F.endswith(F.get("__m", i - 1), F.lit(_STOP)), "<a>")
                .otherwise(low))

    return df.withColumn("__c", F.transform("__m", form))


def literal(df: DataFrame, text: str) -> DataFrame:
    """Add __l: the words without case and punctuation; those of punctuation alone go."""
    return df.withColumn("__l", words(F.lower(F.translate(F.col(text), _MARKS, ""))))


def _hashes(df: DataFrame, of: str = "__c", to: str = "__h") -> DataFrame:
    """Add the hash of each window, by place."""
    return df.withColumn(to, F.when(F.size(of) >= WINDOW, F.slice(
        F.transform(of, lambda w, i: F.xxhash64(w, *[F.get(of, i + k) for k in range(1, WINDOW)])),
        1, F.greatest(F.size(of) - (WINDOW - 1), F.lit(1)))))


def _slots(place: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.when(
        F.get("__c", place + k).isin("<n>", "<u>", "<a>"), F.lower(F.replace(F.get("__m", place + k), F.lit(_STOP), F.lit(""))))), lambda x: x.isNotNull())


def templates(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, n_windows, place, h and the slot values of each template, and g, the hash of its literal window; also the words of both.

    Items without templates have their literal windows only, with no h.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("__text")).distinct()
    rows = _hashes(_hashes(literal(canonical(items, "__text"), "__text")), "__l", "__g")
    # The place among the literal words; the two differ only if some words are punctuation alone.
    rows = rows.withColumn("__p", F.filter(F.transform("__m", lambda w, i: F.when(w != _STOP, i)), lambda i: i.isNotNull()))
    rows = rows.select("item_id", "__m", "__c", "__g", "__l", "__p", F.posexplode_outer("__h").alias("place", "h")).where("h IS NOT NULL")
    at = F.when(F.size("__p") == F.size("__m"), F.col("place")).otherwise((F.array_position("__p", F.col("place")) - 1).cast("int"))
    count = F.size(F.filter(F.slice("__c", F.col("place") + 1, WINDOW), lambda w: ~w.isin("<n>", "<u>", "<a>")))
    rows = rows.select("item_id", "place", "h", _slots(F.col("place")).alias("slots"), F.get("__g", at).alias("g"), (count >= LITERALS).alias("typed"),
                       F.slice("__c", F.col("place") + 1, WINDOW).alias("h_words"), F.when(F.get("__g", at).isNotNull(), F.slice("__l", at + 1, WINDOW)).alias("g_words"))
    counts = rows.groupBy(F.col("item_id").alias("__i")).agg(
        F.max("typed").alias("__typed"), F.countDistinct(F.when(F.col("typed"), F.col("place"))).alias("__n"),
        F.countDistinct(F.when(F.col("g").isNotNull(), F.col("place"))).alias("__literal"))
    rows = rows.join(counts, F.col("item_id").eqNullSafe(F.col("__i"))).where("typed OR NOT __typed AND g IS NOT NULL")
    return rows.select("item_id", F.when(F.col("__typed"), F.col("__n")).otherwise(F.col("__literal")).alias("n_windows"), "place",
                       F.when(F.col("typed"), F.col("h")).alias("h"), "slots", "g", "h_words", "g_words")


def _anchors(known: DataFrame, window: str) -> DataFrame | None:
    """key, the hash of a word, and its offsets in the windows that it stands for; None if not every window has one, or for many."""
    windows = known.where(F.col(window).isNotNull()).select("item_id", F.col(window).alias("window"), F.col(f"{window}_words").alias("words")).distinct()
    each = windows.select("item_id", "window", F.posexplode("words").alias("o", "w")).where(~F.col("w").isin("", "<n>", "<u>", "<a>"))
    shared = each.groupBy("w").agg(F.countDistinct("item_id").alias("n"))
    least = each.join(shared, "w").groupBy("window").agg(F.min(F.struct("n", -F.length("w"), "w", "o")).alias("a"))
    counts = windows.select("window").distinct().join(least.select("window", F.lit(1).alias("has")), "window", "left").agg(F.count("*"), F.count("has")).first()
    if counts[1] < counts[0] or counts[0] > BROADCAST_ROWS:
        return None
    return least.groupBy(F.xxhash64("a.w").alias("key")).agg(F.collect_set("a.o").alias("offsets"))


def _near(scratch: Scratch, rows: DataFrame, of: str, word: Column, anchors: DataFrame, name: str) -> DataFrame:
    """Each hit of an anchor among the words ``of``, with the words from WINDOW before to WINDOW behind it; these start at ``lo``."""
    rows = rows.select("doc_id", of, F.posexplode_outer(of).alias("at", "w")).select("doc_id", of, "at", F.xxhash64(word).alias("key"))
    lo = F.greatest(F.col("at") - WINDOW, F.lit(0))
    rows = rows.join(F.broadcast(anchors), "key").select(
        "doc_id", lo.alias("lo"), (F.col("at") - lo).alias("hit"), "offsets", F.slice(of, lo + 1, 2 * WINDOW).alias(of))
    return scratch.save(rows, name)


def _round(near: DataFrame, of: str, to: str, *keep: str) -> DataFrame:
    """doc_id, place and hash of the windows that hold a hit at one of its anchor's offsets, and p, their place among the words of ``near``."""
    rows = near.select("doc_id", "lo", "hit", of, *keep, F.explode("offsets").alias("o")).withColumn("p", F.col("hit") - F.col("o"))
    rows = rows.where((F.col("p") >= 0) & (F.col("p") + WINDOW <= F.size(of)))
    return rows.select("doc_id", (F.col("lo") + F.col("p")).alias("at"), F.xxhash64(*[F.get(of, F.col("p") + k) for k in range(WINDOW)]).alias(to), "p", of, *keep)


def _found(scratch: Scratch, rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, place, hash and slot values of the windows of documents that are those of a template."""
    side = small(items.select("h").where("h IS NOT NULL").distinct())
    if (anchors := _anchors(items, "h")) is not None:
        near = _near(scratch, _marked(rows, "__text"), "__m", F.lower(_bare(F.col("w"))), anchors, "near")
        # Words that matter for a form lie inside ``near``, so its few words give the slot values of a match too.
        near = _round(_forms(near), "__c", "h", "__m").join(side, "h", "left_semi")
        return scratch.save(near.select("doc_id", "at", "h", _slots(F.col("p")).alias("values")).distinct(), "found")
    # Only ids, places and hashes are laid out by window; the texts of the documents that match are read again.
    # The outer form keeps Spark from testing the size of the array, and so computing it, ahead of the explode.
    places = _hashes(canonical(rows, "__text")).select("doc_id", F.posexplode_outer("__h").alias("at", "h")).join(side, "h", "left_semi")
    places = scratch.save(places.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("at").alias("__at")), "places")
    rows = rows.join(small(places.select("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").distinct()
    rows = _hashes(canonical(rows.join(places, F.col("doc_id").eqNullSafe(F.col("__id"))), "__text"))
    each = F.transform("__at", lambda at: F.struct(at.alias("at"), F.get("__h", at).alias("h"), _slots(at).alias("values")))
    rows = rows.select("doc_id", F.explode_outer(each).alias("w")).select("doc_id", "w.*").where("h IS NOT NULL")
    return scratch.save(rows.distinct(), "found")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched (templates found) and n_changed (slot values that differ in them)."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.save(templates(benchmark, item_id, item_text), "templates")
    known = items.drop("h_words", "g_words")
    found = _found(scratch, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), items)
    met = found.join(known, "h").withColumn("shift", F.col("at") - F.col("place"))
    # The windows of an alignment are bounded by the item, so its slots fit a row.
    same = ["doc_id", "item_id", "shift"]
    most = (met.select(*same, F.explode(F.arrays_zip("slots", "values")).alias("v"), "place").distinct()
            .groupBy(*same, "v").agg(F.count("*").alias("n"))
            .groupBy(*same, "v.slots").agg(F.min(F.struct(-F.col("n"), "v.values"))["values"].alias("value"))
            .groupBy(*same).agg(F.map_from_entries(F.collect_list(F.struct("slots", "value"))).alias("most")))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    met = met.alias("a").join(most.alias("b"), on[0] & on[1] & on[2], "left").where(
        F.forall(F.arrays_zip("slots", "values"), lambda v: F.element_at("most", v["slots"]) == v["values"]))
    changed = F.transform(F.filter(F.arrays_zip("slots", "values"), lambda v: v["slots"] != v["values"]), lambda v: v["slots"])
    met = met.select("a.doc_id", "a.item_id", "n_windows", "a.shift", "place", changed.alias("changed")).groupBy("doc_id", "item_id", "n_windows", "shift").agg(
        F.collect_set("place").alias("places"), F.size(F.array_distinct(F.flatten(F.collect_list("changed")))).cast("long").alias("n_changed"))
    met = met.select("doc_id", "item_id", "n_windows", F.explode("places").alias("place"), "n_changed")
    out = met.union(_verbatim(docs, items, scratch, doc_id, text)).groupBy("doc_id", "item_id", "n_windows").agg(
        F.countDistinct("place").alias("n_matched"), F.max("n_changed").alias("n_changed"))
    return out.where(100 * F.col("n_matched") >= percent * F.col("n_windows"))


def _verbatim(docs: DataFrame, items: DataFrame, scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    """doc_id, item_id, n_windows and place of each literal window of an item in a document; nothing is changed in them."""
    side = small(items.select("g").where("g IS NOT NULL").distinct())
    rows = literal(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text")
    if (anchors := _anchors(items, "g")) is not None:
        rows = _round(_near(scratch, rows, "__l", F.col("w"), anchors, "near_literal"), "__l", "g").select("doc_id", "g")
    else:
        rows = _hashes(rows, "__l", "__g").select("doc_id", F.explode_outer("__g").alias("g"))
    found = scratch.save(rows.join(side, "g", "left_semi").distinct(), "verbatim")
    return found.join(items, "g").select("doc_id", "item_id", "n_windows", "place", F.lit(0).cast("long").alias("n_changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks; rows that share a doc_id go together."""
    scratch = Scratch(docs.sparkSession)
    bad = scratch.save(leaks(docs, benchmark, percent, doc_id, text).select(F.col("doc_id").alias("__drop")).distinct(), "bad")
    return docs.join(small(bad), F.col(f"`{doc_id}`").eqNullSafe(F.col("__drop")), "left_anti")
