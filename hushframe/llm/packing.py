"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

Every task reads its documents once, turns them into token ids and packs them where
they are: no ids are shuffled and no group outgrows ``WINDOWS`` windows. Whole windows
of a long document stand alone. What is left of a document is cut into pieces, pieces
are gathered until they fill ``WINDOWS`` windows, and these are divided into near-equal
windows. If the fullest of them is over the capacity, the number of windows rises by
one and they are divided again.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import Batches, named_apart, sliced

CAPACITY = 2048
END = 1  # id that ends a document
WINDOWS = 128  # of a group that is divided together
SLACK = 2  # tokens a window that a group is filled short of its capacity
PIECE = 128  # one document in EVERY is cut to pieces of this size, to even out the rest
EVERY = 4
ADDED = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def tokenizer(path: str, *, added: bool = False):
    """Text -> uint32 ids, as the tokenizer file at ``path`` gives without special tokens.

    The file's byte-level vocabulary is run by tiktoken, whose ids are the same (a test
    compares them) at a quarter of the time. Its pattern engine fails on a million or more
    white-space characters in a row; such a text is encoded by the tokenizers library.
    With ``added`` the file's added tokens are found in a text, as in the library's
    default settings, and the library encodes such texts too; else they are plain text.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {t["content"] for t in vocabulary["added_tokens"] if t["special"]}
    byte_of = _bytes_of_symbols()
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in vocabulary["model"]["vocab"].items()
        if token not in special
    }
    coder = tiktoken.Encoding(
        "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    @functools.cache
    def library():
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = not added
        return loaded

    marks = [t["content"] for t in vocabulary["added_tokens"]] if added else []

    def encode(text: str) -> np.ndarray:
        if not any(m in text for m in marks):
            try:
                return coder.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _bytes_of_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def divide(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Divides items into ``k`` sets of near-equal sum: the set of each item, the sums.

    Partial partitions lie in a heap by the spread of their sums. The two of largest
    spread are merged with imbalances opposed, the fullest set of one onto the emptiest
    of the other, until one is left.
    """
    if k == 1 or not sizes:
        return np.zeros(len(sizes), np.int64), np.array([sum(sizes)] + [0] * (k - 1))
    # A set is a node of a binary forest; leaves are items, children hold merged sets.
    left: list[int] = [-1] * len(sizes)
    right: list[int] = [-1] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        # Sums are kept ascending, less the smallest: only differences matter.
        heap.append((-size, i, np.array([size]), np.array([i])))
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        # A partition names its non-empty tail of at most k sets; the others are empty.
        n, m = len(a[2]), len(b[2])
        width = min(k, n + m)
        sums = np.zeros(width, np.int64)
        nodes = np.full(width, -1, np.int64)
        sums[width - n :] = a[2]
        nodes[width - n :] = a[3]
        # b's fullest set meets the emptiest: position 0 takes b's last.
        meets = nodes[:m] >= 0
        both = np.flatnonzero(meets)
        new = nodes[:m].copy()
        reverse = b[3][::-1]
        if len(both):
            first = len(left)
            left.extend(nodes[both].tolist())
            right.extend(reverse[both].tolist())
            new[both] = np.arange(first, first + len(both))
        new[~meets] = reverse[~meets]
        nodes[:m] = new
        sums[:m] += b[2][::-1]
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if width == k:
            sums = sums - sums[0]
        spread = int(sums[-1] - (sums[0] if width == k else 0))
        heapq.heappush(heap, (-spread, ticket, sums, nodes))
        ticket += 1
    chosen = np.zeros(len(sizes), np.int64)
    for at, root in enumerate(heap[0][3].tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < len(sizes):
                chosen[node] = at
            else:
                stack += (left[node], right[node])
    return chosen, np.bincount(chosen, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; as few windows as divide the pieces within capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        chosen, sums = divide(sizes, k)
        if sums.max() <= capacity:
            return chosen
        k += 1


class _Packer:
    """Pieces of one task, packed group by group; holds one group at a time."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.limit = WINDOWS * (capacity - min(SLACK, capacity - 1))
        self.piece = max(1, min(PIECE, capacity))
        self.group: list[tuple] = []
        self.total = self.seen = 0

    def add(self, row: int, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Takes a document; yields (row, start, ids, doc_tokens, sequence, offset)."""
        n = len(ids)
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            yield [(row, at, ids[at : at + self.capacity], n, self.sequence, 0)]
            self.sequence += 1
        self.seen += 1
        step = self.piece if self.seen % EVERY == 1 else self.capacity
        at = whole
        while at < n:
            size = min(step, n - at, self.limit - self.total)
            self.group.append((row, at, ids[at : at + size].copy(), n))
            at += size
            self.total += size
            if self.total == self.limit:
                yield self.flush()

    def flush(self) -> list[tuple]:
        out = []
        if self.group:
            chosen = windows([len(p[2]) for p in self.group], self.capacity)
            offsets = [0] * (int(chosen.max()) + 1)
            numbers: dict[int, int] = {}
            for piece, at in zip(self.group, chosen.tolist()):
                number = numbers.setdefault(at, len(numbers))
                out.append((*piece, self.sequence + number, offsets[at]))
                offsets[at] += len(piece[2])
            self.sequence += len(numbers)
        self.group, self.total = [], 0
        return out


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers, with
    the ids of the file's added tokens where a text holds them.
    Pieces of a sequence lie gapless from offset 0. A null or empty text is its end
    token alone. Rows are packed as they come: repeated rows and null ids each give
    pieces of their own, and an empty table gives none. Other columns are not read.
    Sequence ids number the windows of a partition, whose number is in the upper bits.
    """
    named_apart(id_col, ADDED)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", *ADDED]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, added=True)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0
        end = np.array([END], np.uint32)
        for batch in sliced(batches, 256):
            keys = batch.column(0)
            for key, text in zip(keys.to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((encode(text or ""), end)).astype("<u4", copy=False)
                for done in packer.add(key, ids):
                    rows += done
                    held += sum(len(r[2]) for r in done)
                    if held > 1_000_000:
                        yield batch_of(rows, keys.type)
                        rows, held = [], 0
        rows += packer.flush()
        if rows:
            yield batch_of(rows, keys.type)

    def batch_of(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        key, start, ids, n, sequence, offset = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key, key_type),
                pa.array(start, pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([i.tobytes() for i in ids], pa.binary()),
                pa.array(n, pa.int64()),
                pa.array(sequence, pa.int64()),
                pa.array(offset, pa.int64()),
            ],
            names,
        )

    schema = (
        f"id {id_type}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return packed.withColumnRenamed("id", id_col)
