"""Benchmark decontamination by winnowing, with DataFrame functions only.

The fingerprint of a window is the least hash of its word ``GRAM``-grams. A window of ten
words holds six grams of five, so every shared stretch of ten words or more leaves a
common fingerprint on both sides. Fingerprints of documents and items are joined first,
with no text beside them; in documents that share one, each match is extended to its
window and verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import staged

WINDOW = 10  # words
GRAM = 5
PER_FILE = 200_000  # item windows in a file
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of the text with A-Z lower-cased: runs of ASCII digits, letters and all else
    beyond ASCII."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() is the faster way where there is nothing beyond ASCII that it could change.
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_hashes(w: Column, k: int) -> Column:
    """A hash of every ``k`` consecutive words."""
    heads = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))


def fingerprints(w: Column) -> Column:
    """The fingerprint of each window of ``WINDOW`` words, by its start."""
    width = WINDOW - GRAM + 1

    def least(h: Column) -> Column:
        heads = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, width)]))

    return let(gram_hashes(w, GRAM), least)


def _windows(w: Column, size: int) -> Column:
    """The windows of ``size`` words, as text, by their start."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.array_join(F.slice(w, i + 1, size), " "))


def _placed(w: Column, size: int) -> Column:
    def place(t, i):
        return F.struct(i.alias("at"), F.lit(size).alias("size"), t.alias("window"))

    return F.transform(_windows(w, size), place)


def _item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, size, window, print``: the windows of items, short items being one window.

    Only windows of full size have a fingerprint.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), F.explode(F.array(words(text_col))).alias("w"))
    full = F.transform(
        _windows(F.col("w"), WINDOW),
        lambda t, i: F.struct(F.lit(WINDOW).alias("size"), t.alias("window"), F.get("prints", i).alias("print")),
    )
    short = F.array(F.struct(F.size("w").alias("size"), F.array_join("w", " ").alias("window"), F.lit(None).cast("long").alias("print")))
    return (
        w.where(F.size("w") > 0)
        .withColumn("prints", fingerprints(F.col("w")))
        .select("item", F.inline(F.when(F.size("w") >= WINDOW, full).otherwise(short)))
        .distinct()
    )


def occurrences(docs: DataFrame, items: DataFrame, doc_text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """``doc, at, size, window``: item windows in ``docs(doc, text)``; and the item windows."""
    known = staged(_item_windows(items, item_id, item_text), "item_windows")
    # Written to as few files as they fill, so that the planner knows their true size: it
    # sends them to all tasks below its own threshold, and beyond it the joins have plain
    # inputs whose hot keys can be split.
    files = max(1, -(-known.count() // PER_FILE))
    full = known.where(F.col("size") == WINDOW).select("print", "window").distinct()
    full = staged(full.coalesce(files), "full")
    prints = staged(full.select("print").distinct().coalesce(files), "prints")

    # Fingerprints alone, without repeats in a document.
    marks = docs.select("doc", F.explode(let(words(doc_text), lambda w: F.array_distinct(fingerprints(w)))).alias("print"))
    shared = staged(marks.join(prints, "print", "left_semi").select("doc").distinct(), "sharing")

    # Extension: each match, with the words of its window, against the item windows.
    suspects = docs.join(shared, "doc", "left_semi").select("doc", F.explode(F.array(words(doc_text))).alias("w"))
    places = F.transform(
        _windows(F.col("w"), WINDOW),
        lambda t, i: F.struct(i.alias("at"), F.get("prints", i).alias("print"), t.alias("window")),
    )
    found = (
        suspects.withColumn("prints", fingerprints(F.col("w")))
        .select("doc", F.inline(places))
        .join(full, ["print", "window"], "left_semi")
        .select("doc", "at", F.lit(WINDOW).alias("size"), "window")
    )
    # Items shorter than a window: at most WINDOW - 1 sizes, each looked up as it is.
    sizes = [r["size"] for r in known.where(F.col("size") < WINDOW).select("size").distinct().collect()]
    if sizes:
        short = let(
            words(doc_text), lambda w: F.flatten(F.array(*[_placed(w, k) for k in sorted(sizes)]))
        )
        wanted = known.where(F.col("size") < WINDOW).select("size", "window").distinct()
        brief = docs.select("doc", F.inline(short)).join(wanted, ["size", "window"], "left_semi")
        found = found.unionByName(brief.select("doc", "at", "size", "window"))
    return found, known


def row_name(id_col: str, text_col: str) -> Column:
    """Names a row by its content; equal rows share their name and what is found in them."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``.

    A word is hit if it lies in an occurrence of an item window: ten consecutive words of
    an item, or all of a shorter one. ``items`` holds the ids of items with an occurring
    window as sorted strings; items without an id count their hits but are not listed.
    Null texts have no words; items without words have no window; repeated rows each
    give their row; an empty table on either side gives no hits. Other columns are not
    read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_name(id_col, text_col).alias("doc"))
    hits, known = occurrences(named, items, "text", item_id, item_text)
    hits = staged(hits.distinct(), "hits")
    words_hit = (
        hits.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word"))
        .distinct()
        .groupBy("doc")
        .agg(F.count("*").alias("n_hit"))
    )
    listed = (
        hits.select("doc", "window").distinct()
        .join(known.select("window", "item").distinct(), "window")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = staged(words_hit.join(listed, "doc", "left"), "contaminated")
    pieces = F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        named.select("id", "doc", F.size(F.array_remove(pieces, "")).cast("long").alias("n_words"))
        .join(found, "doc", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            items_of.alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without an item window in them; all columns are kept."""
    named = docs.select(F.col(text_col).alias("text"), row_name(id_col, text_col).alias("doc"))
    hits, _ = occurrences(named, items, "text", item_id, item_text)
    bad = staged(hits.select(F.col("doc").alias("_hit")).distinct(), "contaminated")
    # An anti join keeps the columns of docs alone, so names cannot clash.
    return docs.join(bad, F.xxhash64(docs[id_col], docs[text_col]) == bad["_hit"], "left_anti")
