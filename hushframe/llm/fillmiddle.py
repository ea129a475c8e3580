"""Fill-in-the-middle: texts cut at token boundaries and put into a new order.

The boundaries of a text, the offsets behind its tokens, are kept as a compressed set: one
container for each 65,536 code points, which is a sorted array, a bitmap or a list of runs,
whichever is smallest, under the cumulative cardinalities of the containers before it. The
offset of boundary k is found by a search among the cardinalities and a select in one
container. A text is read container by container, so no copy of it is made as a whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import Batches, named_apart, sliced

SEED = 42
RATE = 50  # of 100 texts are cut
SPM = 80  # of 100 cut texts have the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16  # offsets of a container
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


class Array:
    """Sorted offsets."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """A bit for each offset, with the ones before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right"))
        left = k - (int(self.before[word - 1]) if word else 0)
        bits = int(self.words[word])
        for _ in range(left):
            bits &= bits - 1  # clears the lowest one
        return word * 64 + (bits & -bits).bit_length() - 1


class Runs:
    """First offsets of runs of consecutive offsets, with the members before each run."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.first, self.before = low[starts], starts

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of sorted offsets below ``SPAN``."""
    starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(low), SPAN // 8):
        return Runs(low, starts)
    return Array(low) if 2 * len(low) <= SPAN // 8 else Bitmap(low)


class Boundaries:
    """The offsets behind the tokens of a text, as a set that is searched by rank.

    A token is white space (space, 0x09 to 0x0D) with the other characters behind it, or the
    white space at the end.
    """

    def __init__(self, text: str):
        self.containers: list[Array | Bitmap | Runs] = []
        self.keys: list[int] = []
        self.cumulative: list[int] = []  # members up to and with each container
        total, word = 0, False  # the character before is not white space
        for key, at in enumerate(range(0, len(text) + 1, SPAN)):
            # An offset is a boundary if a word ends there; offset at + i lies behind character i - 1.
            points = np.array(memoryview(text[at : at + SPAN].encode("utf-32-le", "surrogatepass")).cast("I"), np.uint32)
            solid = ~((points == 32) | ((points >= 9) & (points <= 13)))
            ends = np.empty(len(solid) + (len(points) < SPAN), bool)
            before = np.empty(len(ends), bool)
            before[:1], before[1:] = word, solid[: len(ends) - 1]
            ends[: len(solid)] = ~solid
            if len(points) < SPAN:
                ends[-1] = True
            ends &= before
            if len(points) < SPAN and len(text):
                ends[-1] = True  # white space at the end is a token too
            word = bool(solid[-1]) if len(solid) else word
            low = np.flatnonzero(ends).astype(np.uint16)
            if len(low):
                total += len(low)
                self.containers.append(container(low))
                self.keys.append(key)
                self.cumulative.append(total)
        self.n = total

    def offset(self, k: int) -> int:
        """The offset behind the first ``k`` tokens."""
        if k == 0:
            return 0
        c = bisect_left(self.cumulative, k)
        before = self.cumulative[c - 1] if c else 0
        return self.keys[c] * SPAN + self.containers[c].select(k - 1 - before)


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    seed: int = SEED, rate: int = RATE, spm: int = SPM,
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output``, a row for each row.

    ``n`` counts the tokens. Cuts, and whether a text is cut, come from the SHA-256 of seed
    and id alone, so rows that share an id and a text come out alike, in any order and
    partitioning. A null id draws as the empty string. A null or empty text, and one that
    holds a marker, stays as it is (``plain``, lengths null). Texts are taken whole, however
    long. An empty table gives none. Other columns are not read.
    """
    named_apart(id_col, ADDED)
    id_type = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        bounds = Boundaries(text)
        n = bounds.n
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
            return n, "plain", None, None, text
        a, b = sorted((bounds.offset(h1 % (n + 1)), bounds.offset(h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            if batch.num_rows:
                rows = [one(t or "", *h) for t, *h in zip(*(c.to_pylist() for c in batch.columns[1:]))]
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *ADDED])

    schema = f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *draws).mapInArrow(run, schema)
    return cut.withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, from output and form alone.

    No part of a cut text holds a marker, and none can arise where a part meets a marker, so
    the markers in an output are those that were put there.
    """
    part = F.split(F.col(output), "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm_ = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm_).otherwise(F.col(output))
