"""Audit of how the sources of a language differ in their words.

The first pass counts in how many documents of its language a term occurs, over all
documents, and keeps those with at least ``MIN_DOCS``. The kept terms are cut into shards
and every shard gets a minimal perfect hash with its terms stored by number, so a term of a
language has a slot from 0. The second pass reads the documents again with the hashes
broadcast and increments slots: each (language, source) has dense pages of ``PAGE`` slots.

What is broadcast is bounded by ``BROADCAST``. If all hashes together are larger, those of
the terms in the most documents are sent, and occurrences of other terms are summed and
joined to their slots by a shuffle.

All numbers are integers: shares in parts of 10^9, each product below the range of a long
or in decimals of 38 digits. A sum of f over the terms of a language stays below
(10^9 + V)^2, so it fits a long up to two thousand million terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.perfecthash import PerfectHash, build, hashes, shard_of
from hushframe.llm.tables import Batches, staged

MIN_DOCS = 3
UNIT = 1_000_000_000
TERM_RANKS = 200
LARGE = 9_000_000_000  # times UNIT is just below the range of a long
SHARD = 16_384  # terms of a shard, on average
SHARD_BYTES = 4 << 20
BROADCAST = 32 << 20  # bytes of the broadcast hashes, as a Python worker holds them
TERM_BYTES = 48  # of a term beside its text
PAGE = 4096  # slots of a page, and of a block of sums
PAGES = 2048  # that a task holds before it hands on its counts
HELD = 300_000  # terms that a task holds before it hands on its counts
NUMBERED = 400_000  # words that a task numbers before it begins anew
BATCH_ROWS = 1024  # documents that Spark hands to Python at a time
PART_BYTES = 4 << 20  # of text that a task splits at a time
OCCURRENCES = 2_000_000  # that a task holds by number before it counts them
TILE = 64  # sources compared in one task are at most two tiles

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows meanwhile: texts of a batch are held by the
    JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)  # 0 or less: no limit
    spark.conf.set(name, min(most, BATCH_ROWS) if most > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _parts(batches: Batches) -> Batches:
    """The batches in parts of at most ``PART_BYTES`` of text, the last column, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
        pa.default_memory_pool().release_unused()  # else a reused worker keeps the most it ever had


def _split(texts: pa.Array) -> pa.Array:
    """The terms of each text: runs of letters and non-ASCII characters, A-Z lower-cased."""
    raw = texts.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = memoryview(raw.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(_LETTERS)
    # Bytes are mapped one to one, so each text keeps its place.
    letters = pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends - ends[0]), pa.py_buffer(data))
    return pc.ascii_split_whitespace(letters)


def occurrences(batches: Batches) -> Iterator[tuple[str, list[int], pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """For each part and language: the rows, their part, how many terms each has, the places
    of these, row by row, in a list of distinct terms, and that list.

    ``lang`` is the first column, the text the last; neither holds nulls.
    """
    for part in _parts(batches):
        split = _split(part.columns[-1])
        found, ends = split.flatten(), split.offsets.to_numpy()
        filled = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # white space at an end gives an empty one
        ends = np.concatenate([[0], np.cumsum(filled)])[ends - ends[0]]
        coded = found.filter(pa.array(filled)).dictionary_encode()
        places = coded.indices.to_numpy()
        rows_of = defaultdict(list)
        for i, lang in enumerate(part.columns[0].to_pylist()):
            rows_of[lang].append(i)
        for lang, rows in rows_of.items():
            here = np.concatenate([places[ends[i] : ends[i + 1]] for i in rows])
            yield lang, rows, part, np.diff(ends)[rows], here, coded.dictionary


def _inputs(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


# --- first pass: frequency filter ---------------------------------------------


class _Words:
    """Numbers, from 0, of the words of one language as they come."""

    def __init__(self) -> None:
        # A new word gets the next number. The counter does not refer to the dict: in a cycle the
        # words would outlive the task in a reused worker.
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)

    def of(self, places: np.ndarray, listed: pa.Array) -> np.ndarray:
        """The numbers of listed words at distinct places."""
        words = listed.take(pa.array(places)).cast(pa.binary()).to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))


def _document_counts(batches: Batches) -> Iterator[pa.RecordBatch]:
    words: dict[str, _Words] = defaultdict(_Words)
    docs: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            found = _strings(list(own.numbers))
            n = pa.array(docs[lang][: len(found)])
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), found, n], ["lang", "term", "docs"])
        words.clear()
        docs.clear()

    for lang, rows, _, sizes, places, listed in occurrences(batches):
        if not len(places):
            continue
        # Each term once a row.
        once = np.repeat(np.arange(len(rows)) * len(listed), sizes) + places
        once.sort()
        places, n = np.unique(once[np.diff(once, prepend=-1) > 0] % len(listed), return_counts=True)
        number = words[lang].of(places, listed)
        counts = docs.get(lang, np.empty(0, np.int64))
        if len(counts) < len(words[lang].numbers):
            counts = docs[lang] = np.concatenate([counts, np.zeros(len(words[lang].numbers), np.int64)])
        counts[number] += n
        if sum(len(w.numbers) for w in words.values()) > HELD:
            yield from flush()
    yield from flush()


def kept_terms(inputs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, docs``: terms in at least ``min_docs`` documents of their language."""
    counted = inputs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


# --- perfect hashes -----------------------------------------------------------


def _cost():
    return F.octet_length("term") + TERM_BYTES


def least_docs(kept: DataFrame, bound: int) -> int:
    """The least power of two such that hashes of the terms in so many documents fit ``bound``."""
    doubled = F.length(F.bin("docs")) - 1  # at most 63 groups
    sizes = kept.groupBy(doubled.alias("e")).agg(F.sum(_cost()).alias("bytes")).collect()
    total, cut = 0, 64
    for row in sorted(sizes, key=lambda r: -r.e):
        total += row.bytes
        if total > bound:
            break
        cut = row.e
    return 1 << min(cut, 62)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    lang, dense, shard, shards = (k.as_py() for k in key)
    words = table.column("term").cast(pa.binary()).to_pylist()
    bits, sizes, order = build(words)
    row = {
        "lang": [lang], "dense": [dense], "shard": [shard], "shards": [shards], "n": [len(words)],
        "bits": [bits], "sizes": [sizes], "terms": [[words[i].decode() for i in order]],
    }
    return pa.table(row).cast(_HASHES)


_HASHES = pa.schema([
    ("lang", pa.string()), ("dense", pa.bool_()), ("shard", pa.int64()), ("shards", pa.int64()),
    ("n", pa.int64()), ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
])


def perfect_hashes(kept: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """A row per shard: its hash, its terms by number, and the slot of its first term.

    ``dense`` shards hold the terms in the most documents, together at most ``bound`` bytes.
    """
    marked = kept.withColumn("dense", F.col("docs") >= least_docs(kept, bound))
    most = F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum(_cost()) / SHARD_BYTES))
    # Written first, so that the planner knows whether it is small enough to broadcast.
    sizes = staged(marked.groupBy("lang", "dense").agg(most.cast("long").alias("shards")), "sizes")
    cut = marked.join(sizes, ["lang", "dense"]).withColumn(
        "shard", F.shiftrightunsigned(F.xxhash64("term"), 1) % F.col("shards")
    )
    schema = (
        "lang string, dense boolean, shard long, shards long, n long, bits binary, "
        "sizes array<long>, terms array<string>"
    )
    built = staged(
        cut.select("lang", "dense", "shard", "shards", "term")
        .groupBy("lang", "dense", "shard", "shards").applyInArrow(_build, schema),
        "hashes",
    )
    before = Window.partitionBy("lang").orderBy(F.desc("dense"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = built.select(
        "lang", "dense", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    return built.join(first, ["lang", "dense", "shard"])


def _broadcast(found: DataFrame) -> Broadcast:
    """The dense hashes: lang -> [(first, hash arguments)] in shard order; at most BROADCAST bytes."""
    shards = defaultdict(list)
    for r in found.where("dense").orderBy("lang", "shard").toLocalIterator():
        shards[r.lang].append((r.shard, r.shards, r.first, bytes(r.bits), list(r.sizes), [t.encode() for t in r.terms]))
    return found.sparkSession.sparkContext.broadcast(dict(shards))


# --- second pass: recount -----------------------------------------------------


class _Slots:
    """Slots of the terms of one language by its sharded hashes."""

    def __init__(self, shards: list[tuple]):
        self.shards = shards[0][1]
        self.hashes = {shard: (first, PerfectHash(*rest)) for shard, _, first, *rest in shards}

    def of(self, found: list[bytes]) -> np.ndarray:
        """The slot of each word, -1 for words that are no term."""
        h = hashes(found)
        own = shard_of(h, self.shards)
        out = np.full(len(found), -1, np.int64)
        for shard, (first, perfect) in self.hashes.items():
            here = np.flatnonzero(own == np.uint64(shard))
            numbers = perfect.numbers([found[i] for i in here.tolist()], h[here])
            out[here] = np.where(numbers >= 0, numbers + first, -1)
        return out


class _SlotWords(_Words):
    """Numbered words and their slots."""

    def __init__(self, hashes: _Slots | None):
        super().__init__()
        self.slots, self.hashes = np.empty(0, np.int64), hashes

    def resolve(self) -> np.ndarray:
        """The slot by number, -1 for words that have none."""
        new = list(islice(self.numbers, len(self.slots), None))
        found = self.hashes.of(new) if self.hashes else np.full(len(new), -1, np.int64)
        self.slots = np.concatenate([self.slots, found])
        return self.slots


_COUNTS = "lang string, source string, slot long, term string, n long"


def recount(inputs: DataFrame, dense: Broadcast, others: bool) -> DataFrame:
    """``lang, source, slot, term, n``: partial counts by slot and, with ``others``, by term
    for the words that the broadcast hashes do not hold."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        slots = {lang: _Slots(shards) for lang, shards in dense.value.items()}
        words: dict[str, _SlotWords] = {}
        held: dict[str, dict[str, list[np.ndarray]]] = {}
        pages: dict[tuple[str, str], dict[int, np.ndarray]] = defaultdict(dict)

        def batch_of(lang: str, source: str, slot: pa.Array, term: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), slot, term, pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "slot", "term", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), of_group in pages.items():
                found = [(np.flatnonzero(counts), page, counts) for page, counts in of_group.items()]
                slot = np.concatenate([at + page * PAGE for at, page, _ in found])
                n = np.concatenate([counts[at] for at, _, counts in found])
                yield batch_of(lang, source, pa.array(slot), pa.nulls(len(n), pa.string()), n)
            pages.clear()

        def add(lang: str, source: str, at: np.ndarray, n: np.ndarray) -> None:
            order = np.argsort(at)
            at, n = at[order], n[order]
            edges = np.flatnonzero(np.diff(at // PAGE, prepend=-1))
            own = pages[lang, source] if len(at) else {}
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                page = int(at[a]) // PAGE
                if page not in own:
                    own[page] = np.zeros(PAGE, np.int64)
                own[page][at[a:b] % PAGE] += n[a:b]

        def resolve() -> Iterator[pa.RecordBatch]:
            """Adds what is held to the pages, and hands on the counts of words without a slot."""
            for lang, sources in held.items():
                slot_of = words[lang].resolve()
                names = list(words[lang].numbers) if others else []
                for source, parts in sources.items():
                    number, n = np.unique(np.concatenate(parts), return_counts=True)
                    at = slot_of[number]
                    known = at >= 0
                    add(lang, source, at[known], n[known])
                    if others and not known.all():
                        named = _strings([names[i] for i in number[~known].tolist()])
                        yield batch_of(lang, source, pa.nulls(len(named), pa.int64()), named, n[~known])
            held.clear()
            if sum(len(w.numbers) for w in words.values()) > NUMBERED:
                words.clear()
            if sum(map(len, pages.values())) > PAGES:
                yield from flush()

        n_held = 0  # occurrences, each row counted as some more for what its array takes
        for lang, rows, part, sizes, places, listed in occurrences(batches):
            if not len(places):
                continue
            if lang not in words:
                words[lang] = _SlotWords(slots.get(lang))
            distinct = np.unique(places)
            number = np.empty(len(listed), np.int32)
            number[distinct] = words[lang].of(distinct, listed)
            sources = part.column(1).take(pa.array(rows)).to_pylist()
            for source, own in zip(sources, np.split(number[places], np.cumsum(sizes)[:-1])):
                if len(own):
                    held.setdefault(lang, {}).setdefault(source, []).append(own)
            n_held += len(places) + 32 * len(rows)
            if n_held > OCCURRENCES or sum(len(w.numbers) for w in words.values()) > NUMBERED:
                yield from resolve()
                n_held = 0
        yield from resolve()
        yield from flush()

    return inputs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def term_counts(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """``lang, source, slot, n``: occurrences of each kept term in each group, where there are any."""
    others = bool(found.where("NOT dense").limit(1).count())
    counted = recount(inputs, _broadcast(found), others)
    summed = F.sum("n").alias("n")
    if not others:
        return counted.groupBy("lang", "source", "slot").agg(summed)
    counted = staged(counted.groupBy("lang", "source", "slot", "term").agg(summed), "recount")
    sent = counted.where("slot IS NOT NULL").select("lang", "source", "slot", "n")
    rest = counted.where("slot IS NULL").drop("slot").join(slot_terms(found.where("NOT dense")), ["lang", "term"])
    return sent.unionByName(rest.select("lang", "source", "slot", "n"))


def slot_terms(found: DataFrame) -> DataFrame:
    """``lang, slot, term``."""
    each = found.select("lang", "first", F.posexplode("terms").alias("i", "term"))
    return each.select("lang", (F.col("first") + F.col("i")).alias("slot"), "term")


# --- divergence ---------------------------------------------------------------


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + V)); in decimals where the product could leave a long."""
    return F.expr(
        f"1 + CASE WHEN {n} < {LARGE} THEN ({UNIT}L * ({n} + 1)) div ({total} + kept) "
        f"ELSE (CAST({UNIT} AS DECIMAL(38,0)) * ({n} + 1)) div ({total} + kept) END"
    )


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same on arrays; in Python integers where a product could leave the range of a long."""
    if counts.size and int(counts.max()) >= LARGE:
        exact = 1 + UNIT * (counts.astype(object) + 1) // totals.astype(object)
        return exact.astype(np.int64)
    return 1 + UNIT * (counts + 1) // totals


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over one block of slots, for all pairs of sources of two tiles, both ways."""
    lang, block, i, j = (k.as_py() for k in key)
    idx, slot, n, terms_ = (table.column(c).to_numpy() for c in ("idx", "slot", "n", "kept"))
    head = slot < 0
    sources, at = np.unique(idx[head], return_index=True)
    v = int(terms_[0])
    totals = n[head][at] + v
    width = max(0, min(PAGE, v - block * PAGE))
    p = np.empty((len(sources), width), np.int64)
    a, b, value = [], [], []
    if width:
        p[:] = _shares(np.zeros(len(totals), np.int64), totals)[:, None]
        row = np.searchsorted(sources, idx[~head])
        p[row, slot[~head] - block * PAGE] = _shares(n[~head], totals[row])
    for x, own in enumerate(sources.tolist()):
        if own // TILE != i:
            continue
        others = np.flatnonzero((sources // TILE == j) & (sources > own))
        squares = (p[x] - p[others]) ** 2
        a += [np.full(len(others), own), sources[others]]
        b += [sources[others], np.full(len(others), own)]
        value += [(squares // p[others]).sum(axis=1), (squares // p[x]).sum(axis=1)]
    none = [np.empty(0, np.int64)]
    columns = {"a": a, "b": b, "value": value}
    out = {c: np.concatenate(parts + none).astype(np.int64) for c, parts in columns.items()}
    return pa.table({"lang": pa.repeat(lang, len(out["a"])), **out})


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the summed f of source ``a`` against source ``b``, by their numbers."""
    blocks = F.greatest(F.ceil(F.col("kept") / PAGE), F.lit(1)).cast("long")
    heads = groups.select(
        "lang", "idx", "kept", "sources", F.col("total").alias("n"), F.lit(-1).cast("long").alias("slot"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
    )
    cells = counts.join(groups.drop("total"), ["lang", "source"]).withColumn("block", F.floor(F.col("slot") / PAGE))
    own, other = F.floor(F.col("idx") / TILE), F.col("tile")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE)))
    return (
        heads.unionByName(cells.select(*heads.columns))
        .withColumn("tile", tiles)
        .select(
            "lang", "block", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"),
            "idx", "slot", "n", "kept",
        )
        .groupBy("lang", "block", "i", "j")
        .applyInArrow(_pair_sums, "lang string, a long, b long, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, bound: int = BROADCAST,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source departs from the others.

    Part ``pair`` has each other source of the language with the divergence summed over all
    kept terms, part ``term`` the ``ranks`` kept terms by which a source exceeds its language
    most. Ranks go by falling value, then by item in byte order.

    Nulls in any of the three columns are read as empty; the empty string is a language or
    source like any other. A group without terms counts with zeros, and a language without
    kept terms has pairs of value 0. Repeated rows count as often as they are there. An empty
    table gives no rows. Other columns are not read.
    """
    inputs = _inputs(docs, lang_col, source_col, text_col)
    with _small_batches(docs.sparkSession):
        kept = staged(kept_terms(inputs, min_docs), "terms")
    found = staged(perfect_hashes(kept, bound), "slots")
    with _small_batches(docs.sparkSession):
        counts = staged(term_counts(inputs, found), "counts")
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = found.groupBy("lang").agg(F.sum("n").alias("kept"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = staged(
        inputs.select("lang", "source").distinct()
        .join(total, ["lang", "source"], "left")
        .join(size, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
            (F.row_number().over(by_name) - 1).cast("long").alias("idx"),
            F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        ),
        "groups",
    )
    names = groups.select("lang", F.col("idx").alias("a"), "source")
    items = groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"))
    pairs = _pairs(counts, groups).join(names, ["lang", "a"]).join(items, ["lang", "b"])

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    in_lang = F.sum("n").over(Window.partitionBy("lang", "slot"))
    shares = (
        counts.withColumn("lang_n", in_lang)
        .join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
        .join(of_lang, "lang")
        .select("lang", "source", "slot", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    )
    value = F.expr("((p - q) * (p - q)) div q").alias("value")
    # Only terms that may rank get their texts; all that share the last value may.
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    above = (
        shares.where("p > q").select("lang", "source", "slot", value)
        .withColumn("place", place).where(F.col("place") <= ranks).drop("place")
        .join(slot_terms(found).withColumnRenamed("term", "item"), ["lang", "slot"])
    )

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(part: DataFrame, name: str) -> DataFrame:
        row = part.withColumn("rank", F.row_number().over(best))
        return row.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= ranks))
