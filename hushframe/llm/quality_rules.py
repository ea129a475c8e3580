"""Quality rules: counts over a text, and a logistic regression on hashed n-grams.

The base rules are counts. The verdict of the method comes from a logistic regression on
hashed word 1- and 2-grams and character (byte) 2- to 4-grams, fitted to a bounded sample
of rows with a quality label, calibrated on a part of it that isn't fitted, and scored
over whole texts in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm import linear
from hushframe.llm.hashing import WordHashes, grams, words
from hushframe.llm.tables import Batches, named_apart, sliced

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
KEEP = 0.5  # probability of good quality from which a text is kept
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SCALE = 20.0  # of the relative frequencies, so that one learning rate suits all
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(h: np.ndarray) -> int:
    """Words in windows of three words that are found twice or more."""
    g = grams(h, 3)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[j : j + len(g)] |= twice
    return int(covered.sum())


def counts(text: str | None, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of a text whose words have the hashes ``h``."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(h),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated(h),
    )


def ngrams(raw: bytes, h: np.ndarray, bits: int = linear.BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams with the weight of each occurrence; both kinds sum to ``SCALE``."""
    parts, weights = [], []
    down = np.uint64(64 - bits)
    spread = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        word = [h] + ([grams(h, 2)] if len(h) > 1 else [])
        n = sum(map(len, word))
        if n:
            parts += [(w * spread) >> down for w in word]
            weights.append(np.full(n, SCALE / n, np.float32))
        b = np.frombuffer(raw, np.uint8).astype(np.uint64)
        code, chars = b, []
        for size in (2, 3, 4):
            if len(b) < size:
                break
            code = (code[:-1] << np.uint64(8)) | b[size - 1 :]
            chars.append(((code + np.uint64(size << 40)) * spread) >> down)
        n = sum(map(len, chars))
        if n:
            parts += chars
            weights.append(np.full(n, SCALE / n, np.float32))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    return np.concatenate(parts).astype(np.int64), np.concatenate(weights)


def summed(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same features with each index once."""
    total = np.bincount(index, weights=value)
    at = np.flatnonzero(total)
    return at, total[at]


def _features():
    seen = WordHashes()

    def of(text: str | None):
        return summed(*ngrams((text or "").encode("utf-8", "surrogatepass"), seen.of(words(text))))

    return of


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = linear.SAMPLE) -> linear.Model:
    labelled = linear.sample(docs, labels, id_col, text_col, label, rows)
    return linear.fit(labelled, _features(), 1 << linear.BITS)


def judge(docs: DataFrame, model: linear.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts, ``base_failed, score, kept`` for every row of ``docs``.

    ``score`` is the calibrated probability of good quality. ``base_failed``: fewer than
    ``MIN_WORDS`` words or too many in repeated windows; such a text isn't kept. A null
    text has no words. Repeated rows and null ids each give their row, an empty table an
    empty result. Other columns are not read.
    """
    named_apart(id_col, [*COUNTS, "base_failed", "score", "kept"])
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # 2 ** BITS weights

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model, seen = linear.Model(*sent.value), WordHashes()
        for batch in sliced(batches):
            rows, scores = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                h = seen.of(raw.split())
                rows.append(counts(text, h))
                scores.append(model.logit(*ngrams(raw, h)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            score = pa.array(linear.sigmoid(np.array(scores)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, score], ["id", *COUNTS, "score"])

    schema = f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.select(
        F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= KEEP)).alias("kept"),
    )
