"""Near duplicates by SimHash, found through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of
their eight bytes. The index lists fingerprints under the bytes they hold at given
positions. A list of one byte alone would hold 1/256 of the corpus, so lists are
keyed by three positional bytes: whichever five bytes two fingerprints share, three
of them lie in the same half, so the four triples of each half, eight lists a
fingerprint, meet every pair. Within a list the shared positional bytes of a pair
are tallied, pairs with fewer than five drop out, and the rest are verified bit by
bit. Of a list only a spanning forest of its links is emitted, never all pairs.

Lists longer than ``LIST`` are cut up without loss: two of the other five bytes agree
as well, so their members move to lists keyed by five bytes, and what is still too
long there is compared in blocks of ``LIST`` members, one cell per pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.components import components
from hushframe.llm.hashing import words
from hushframe.llm.tables import Batches, groups, named_apart, sliced, staged

SHINGLE = 3  # words
SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
LIST = 2048  # members of a list that one task compares


def fingerprint(text: str | None) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' hashes have it.

    A text with one or two words has one shingle, a text without words is zero.
    """
    found = words(text)
    if not found:
        return 0
    # bytes.lower() changes A to Z only; it cannot change where words end.
    found = b" ".join(found).lower().split(b" ")
    k = min(SHINGLE, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    h = np.fromiter((hash_of(joined[a:b], SEED) for a, b in spans), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of every row, as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [fingerprint(t) for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(run, f"id {id_type}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def _lists(members: DataFrame, masks: list[int]) -> DataFrame:
    """``mask, bytes, fp``: the members under their bytes at the masked positions."""
    keys = F.explode(
        F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(m).alias("bytes")) for m in masks])
    )
    return members.select("fp", keys.alias("k")).select("k.mask", "k.bytes", "fp")


def _sized(lists: DataFrame) -> DataFrame:
    """Lists of two members or more, with their length."""
    sizes = lists.groupBy("mask", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    return lists.join(sizes, ["mask", "bytes"])


def _cells(sized: DataFrame) -> DataFrame:
    """Each list as cells of at most two blocks; short lists are one cell."""
    blocks = F.ceil(F.col("n") / LIST).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    return (
        sized.select("mask", "bytes", "fp", blocks.alias("blocks"), own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "mask", "bytes",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp",
        )
    )


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect all within
    ``MAX_BITS`` bits of each other; at least a spanning forest of that graph."""
    sized = staged(_sized(_lists(distinct, [_mask(t) for t in TRIPLES])), "lists")
    short = sized.where(F.col("n") <= LIST)
    long = sized.where(F.col("n") > LIST)
    # The five-byte lists that continue a triple: the triple and two of the others.
    finer = {
        _mask(t): [_mask(tuple({*t, *more})) for more in combinations({*range(8)} - {*t}, 2)]
        for t in TRIPLES
    }
    continued = F.create_map(*[c for m, to in finer.items() for c in (F.lit(m), F.array(*map(F.lit, to)))])
    fine = (
        long.select("fp", F.explode(continued[F.col("mask")]).alias("mask"))
        .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")
        .distinct()
    )
    cells = _cells(short).union(_cells(_sized(fine)))
    key = ["mask", "bytes", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "a long, b long")


def _compare(batches: Batches) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for _, rows in groups(batches, ["mask", "bytes", "i", "j"]):
        members = np.unique(rows.column("fp").to_numpy())
        if len(members) > 1:
            for x, y in forest(members.view(np.uint64)):
                a.append(x)
                b.append(y)
        if len(a) > 50_000:
            yield _link_batch(a, b)
            a, b = [], []
    if a:
        yield _link_batch(a, b)


def _link_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"])


def forest(members: np.ndarray, at_once: int = 32) -> Iterator[tuple[int, int]]:
    """Links that connect members like all pairs within ``MAX_BITS`` bits would."""
    rest = members
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:at_once], front[at_once:]
            differ = now[:, None] ^ rest[None, :]
            shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1)
            near = (shared >= MIN_BYTES) & (np.bitwise_count(differ) <= MAX_BITS)
            found = near.any(axis=0)
            if found.any():
                first = near[:, found].argmax(axis=0)
                new = rest[found]
                yield from zip(now[first].tolist(), new.tolist())
                front, rest = np.concatenate((front, new)), rest[~found]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the least id that links reach, its own included. Null and
    empty texts have fingerprint zero, linked like any other; repeated rows and rows
    with equal ids each keep their row. A null id is kept and is never the least
    (a component of null ids has a null ``component_id``). An empty table gives an
    empty result; other columns are not read.
    """
    named_apart(id_col, ["fingerprint", "component_id"])
    return _labelled(staged(fingerprints(docs, id_col, text_col), "fingerprints")).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _labelled(prints: DataFrame) -> DataFrame:
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the least id.

    Rows that share an id stay or go together, but of those with equal texts one stays.
    A row without an id cannot stand for a group: it goes if its group has an id and
    stays otherwise. All columns are kept, whatever their names.
    """
    found = staged(near_duplicates(docs, id_col, text_col), "groups")
    same = F.col(id_col).eqNullSafe(F.col("component_id"))
    ids = staged(found.where(same).groupBy(F.col(id_col).alias("kept")).agg(F.count("*").alias("n")), "kept")
    # The kept ids grow with the corpus: merged at every size, never broadcast. Repeated
    # ids are few, if any, and left to the planner.
    once, often = ids.where("n = 1").hint("merge"), ids.where("n > 1")
    # A left semi join keeps the columns of docs alone, so names cannot clash.
    single = docs.join(once, docs[id_col].eqNullSafe(once["kept"]), "left_semi")
    several = docs.join(often, docs[id_col].eqNullSafe(often["kept"]), "left_semi")
    return single.unionByName(several.dropDuplicates([id_col, text_col]))
