"""Removal of repeated substrings by relative Lempel-Ziv parsing of word sequences.

A window is ``WINDOW`` consecutive words. A document is parsed into factors: stretches
copied from an indexed reference block, followed greedily, checked again window by
window where a factor ends. Words of factors that are long enough, that is of windows
which also start elsewhere, are removed.

1. Index: words are cut into reference blocks by content. The key of a window is the
   least hash of the ``GRAM`` word grams in it, so equal windows have equal keys, and one
   key serves about ``WINDOW - GRAM`` windows in a row. Only keys are shuffled, at most
   once a document each. A block whose key lies at one place in the corpus can't be
   copied and leaves the index.
2. Factors: a document reads its words against the keys that remain. Where a key is in
   the index, the hashes of the windows it serves are looked up; the rest of the
   document, most of a clean corpus, makes no rows.
3. Removal: the windows found are joined to factors and cut out.

Hot blocks: keys and windows are counted with partial aggregation, and lookups are plain
joins with nothing bound to the key above, so one that lies in a third of all documents
can be split. Positions are gathered per document only. Equality is that of 64-bit
hashes, the windows of one document or of equal keys only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.hashing import WordHashes, grams, greatest, least, words
from hushframe.llm.tables import Batches, free_name, set_aside, sliced, staged

WINDOW = 35  # words
GRAM = 10
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ADDED = ["n_words", "n_removed", "factors"]


def keys_of(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window; the keys of all places that are the least of some window."""
    g = grams(h, gram)
    key = least(g, window - gram + 1)
    if not len(key):
        return key, key
    pad = np.zeros(window - gram, np.uint64)
    served = greatest(np.concatenate((pad, key, pad)), window - gram + 1)
    return key, g[g == served]


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its content; equal rows share their name and their factors."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc, key``: keys of each document that lie at two places or more."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in sliced(batches):
            doc, key, places = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if len(found) < window:
                    continue
                one, n = np.unique(keys_of(seen.of(found), window, gram)[1], return_counts=True)
                doc.append(np.full(len(one), name, np.int64))
                key.append(one.view(np.int64))
                places.append(n.astype(np.int32))
            if doc:
                columns = [pa.array(np.concatenate(c)) for c in (doc, key, places)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "places"])

    blocks = staged(docs.mapInArrow(run, "doc long, key long, places int"), "blocks")
    shared = blocks.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    # Written, so that the join has plain inputs and a hot key of either can be split.
    shared = staged(shared, "shared")
    return blocks.join(shared, "key").select("doc", "key")


def _lookups(docs: DataFrame, index: DataFrame, window: int, gram: int) -> DataFrame:
    """``window, doc, at``: the windows whose key is in the index."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in sliced(batches):
            doc, window_hash, at = [], [], []
            rows = zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2))
            for name, text, keys in rows:
                h = seen.of(words(text))
                known = np.unique(keys.values.to_numpy().view(np.uint64))
                own = keys_of(h, window, gram)[0]
                place = np.searchsorted(known, own).clip(max=len(known) - 1)
                starts = np.flatnonzero(known[place] == own)
                doc.append(np.full(len(starts), name, np.int64))
                window_hash.append(grams(h, window)[starts].view(np.int64))
                at.append(starts.astype(np.int32))
            if doc:
                columns = [pa.array(np.concatenate(c)) for c in (window_hash, doc, at)]
                yield pa.RecordBatch.from_arrays(columns, ["window", "doc", "at"])

    indexed = index.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    read = docs.join(indexed, "doc").select("doc", "text", "keys")
    return read.mapInArrow(run, "window long, doc long, at int")


def factors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """``doc, starts``: by row name, the starts of its windows that also start elsewhere."""
    named = docs.select(_row_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    found = staged(_lookups(named, _index(named, window, gram), window, gram), "windows")
    copied = found.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    copied = staged(copied, "copied")
    return (
        found.join(copied, "window")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("at")).alias("starts"))
    )


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1  # starts are distinct
    edge[starts + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut(text: str, gone: np.ndarray) -> str:
    """``text`` without its words marked as gone; what stays keeps its white space."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate(([1], gone.astype(np.int8), [1]))))
    parts = [raw[spans[a][0] : spans[b - 1][1]] for a, b in edges.reshape(-1, 2).tolist()]
    return b"\n".join(parts).decode("utf-8", "surrogatepass")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """``docs`` with repeated words cut out of the text, and ``n_words, n_removed, factors``.

    A word goes if it lies in a window of ``window`` words that also starts anywhere
    else, in the same document or another, as the documents came in; so all copies go.
    Kept stretches keep their white space and are joined by line feeds; a text that
    loses nothing stays as it is. ``factors`` holds the removed stretches, ``begin`` and
    ``end`` in words. A null text stays null with no words; shorter texts than a window
    lose nothing; repeated rows count as copies of each other; a null id is an id like
    others; an empty table gives an empty result. Other columns are kept; one with the
    name of a new column is kept as ``<name>_input``.
    """
    return _parsed(set_aside(docs, ADDED), ADDED, id_col, text_col, window, gram)


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """As ``remove_repeats``, with the columns of ``docs`` alone, whatever their names.

    ``length_col``, if ``docs`` has it, is set to the characters of texts that were cut.
    """
    added = [free_name(docs.columns, name) for name in ADDED]
    done = _parsed(docs, added, id_col, text_col, window, gram)
    if length_col in docs.columns:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        done = done.withColumn(length_col, F.when(F.col(added[1]) > 0, length).otherwise(F.col(length_col)))
    return done.select([f"`{c}`" for c in docs.columns])


def _parsed(docs: DataFrame, added: list[str], id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """``docs`` with repeats cut out, and the columns of ``ADDED`` under the names given."""
    starts = staged(factors(docs, id_col, text_col, window, gram), "factors")
    doc, found = free_name(docs.columns, "doc"), free_name(docs.columns, "starts")
    marks = starts.select(F.col("doc").alias(doc), F.col("starts").alias(found))
    joined = docs.withColumn(doc, _row_key(id_col, text_col)).join(marks, doc, "left")
    place = docs.columns.index(text_col)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, counts, removed, spans = [], [], [], []
            for text, at in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1)):
                n = len(words(text))
                counts.append(n)
                if not at.is_valid:
                    texts.append(text)
                    removed.append(0)
                    spans.append([])
                    continue
                gone = covered(at.values.to_numpy(), n, window)
                texts.append(cut(text, gone))
                removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans.append([{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *added])

    kinds = T.StructType.fromDDL(
        "n_words long, n_removed long, factors array<struct<begin: int, end: int>>"
    )
    fields = [T.StructField(name, f.dataType) for name, f in zip(added, kinds.fields)]
    schema = T.StructType(docs.schema.fields + fields)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], found).mapInArrow(run, schema)
