"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. Their terms are all their words, and those
five-letter parts of words that a label hangs on (by a confidence bound on the toxic share
of the examples that hold them). Words that no label hangs on are scaled down but kept: so
the few words that matter in a long text aren't lost among thousands that don't, and texts
without any such word still find their copies and neighbours.

The index keeps examples in blocks. Rare terms have inverted lists, which give their part
of every similarity. For the terms that many examples hold a block keeps the greatest
weight of each and the greatest norm; with the lists' part these bound every similarity
in the block. The blocks of the greatest bounds are finished first, and of the others only
those whose bound reaches the last neighbour found. Neighbours vote with the square of
their similarity against a prior, and the vote is calibrated on the examples, each without
itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import linear
from hushframe.llm.tables import Batches, named_apart, sliced, staged

EXAMPLES = 12_000  # labelled rows in the index, at most
PART = 5  # letters
Z = 3.0  # of the confidence bound
SHARE = 0.5  # least bound of a toxic share that a label hangs on
REST = 0.05  # scale of the other terms
COMMON = 16  # a term that more than one example in so many holds is common
BLOCK = 64  # examples
FIRST = 8  # blocks finished before any is left out
TEXTS = 64  # compared at once
NEIGHBOURS = 16
PRIOR = 0.1  # votes of the prior against those of neighbours
_WORD = re.compile(r"[^\W\d_]+")
_APART = {c: " " for c in range(128) if not chr(c).isalpha()}
RESULT = ["held_out", "score", "predicted", "evidence"]


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_list(text: str | None) -> list[str]:
    """Runs of letters in the lower-cased text."""
    if not text:
        return []
    # The same words either way; ASCII texts are split without the slower pattern.
    return text.lower().translate(_APART).split() if text.isascii() else _WORD.findall(text.lower())


def terms(word: str) -> set[str]:
    """The word, marked as whole, and its parts."""
    return {f"={word}"} | {word[i : i + PART] for i in range(len(word) - PART + 1)}


class Terms:
    """Counts of the terms of a vocabulary in texts, word by distinct word."""

    def __init__(self, names: Iterable[str]):
        self.whole: dict[str, int] = {}
        self.parts = ahocorasick.Automaton()
        for number, name in enumerate(names):
            if name[0] == "=":
                self.whole[name[1:]] = number
            else:
                self.parts.add_word(name, number)
        self.any_parts = len(self.parts) > 0
        if self.any_parts:
            self.parts.make_automaton()

    def counted(self, text: str | None) -> dict[int, int]:
        """Numbers of the text's terms and how often it holds each; a word holds a part once."""
        found = Counter(word_list(text))
        counts = dict(zip(map(self.whole.get, found), found.values()))
        counts.pop(None, None)
        if self.any_parts and found:
            words = list(found)
            parts = list(self.parts.iter(" ".join(words)))
            # Most texts hold no such part: the ends of the words are summed only for the others.
            ends = list(accumulate(len(w) + 1 for w in words)) if parts else []
            for word, number in {(bisect_right(ends, end), number) for end, number in parts}:
                counts[number] = counts.get(number, 0) + found[words[word]]
        return counts


def _vocabulary(examples: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of the examples, the examples that hold each, and the scale of each."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set().union(*map(terms, set(word_list(text))))
                held.update(own)
                if label:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64()),
                 pa.array([toxic[t] for t in held], pa.int64())],
                ["term", "n", "toxic"],
            )

    n, p, zz = F.col("n"), F.col("toxic") / F.col("n"), Z * Z
    bound = (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    counted = (
        examples.select("text", "label")
        .mapInArrow(run, "term string, n long, toxic long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .select("term", "n", (bound >= SHARE).alias("hangs"))
        .where(F.col("hangs") | F.startswith("term", F.lit("=")))
        .toArrow()
        .sort_by("term")
    )
    hangs = counted.column("hangs").to_numpy()
    return (
        counted.column("term").combine_chunks(),
        counted.column("n").to_numpy().astype(np.float64),
        np.where(hangs, 1.0, REST),
    )


def inverted(term: np.ndarray, weight: np.ndarray, sizes: np.ndarray, width: int) -> tuple:
    """Starts of the terms' lists, and the examples and weights (or counts) in them.

    ``term`` and ``weight`` hold the vectors of the examples one behind the other.
    """
    by = np.argsort(term, kind="stable")
    start = np.searchsorted(term, np.arange(width + 1, dtype=np.int32), sorter=by)
    return start, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by], weight[by]


class Index:
    """Weights of the examples: blocks of the common terms, inverted lists of the others."""

    def __init__(self, ids: list, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        term = np.concatenate([t for t, _ in rows] + [np.empty(0, np.int32)]).astype(np.int32)
        weight = np.concatenate([w for _, w in rows] + [np.empty(0)])
        self._hold(ids, labels, *inverted(term, weight, np.array([len(t) for t, _ in rows], np.int64), width))

    @classmethod
    def of(cls, idf: np.ndarray, ids: list, labels: np.ndarray, start: np.ndarray, example: np.ndarray, count: np.ndarray) -> Index:
        """The index of the counts of terms in examples, as ``inverted`` lists them."""
        weight = (1 + np.log(count, dtype=np.float64)) * np.repeat(idf, np.diff(start))
        weight /= np.sqrt(np.bincount(example, weights=weight * weight, minlength=len(ids)))[example]
        self = cls.__new__(cls)
        self._hold(ids, labels, start, example, weight)
        return self

    def _hold(self, ids: list, labels: np.ndarray, start: np.ndarray, example: np.ndarray, weight: np.ndarray):
        self.ids, self.labels = ids, labels
        n, width = len(ids), len(start) - 1
        # The vectors one behind the other, for exact sums over one example.
        by = np.argsort(example, kind="stable")
        self.sizes = np.bincount(example, minlength=n)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.term = np.repeat(np.arange(width, dtype=np.int32), np.diff(start))[by]
        self.exact = weight[by]
        self.same = self._first_equal()
        common = np.flatnonzero(np.diff(start) > n / COMMON)
        self.row = np.full(width, -1, np.int32)  # of a common term in the blocks
        self.row[common] = np.arange(len(common))
        dense = np.zeros((len(common), n), np.float32)
        for i, t in enumerate(common.tolist()):
            a, b = start[t], start[t + 1]
            dense[i, example[a:b]] = weight[a:b]
        # Alike examples into one block: those of one heaviest common term, by their norm.
        norm = np.sqrt(np.einsum("ij,ij->j", dense, dense))
        self.order = np.lexsort((norm, dense.argmax(0) if len(common) else norm))
        self.blocks = -(-n // BLOCK)
        at = np.empty(n, np.int32)
        at[self.order] = np.arange(n)
        padded = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        padded[:, at] = dense
        by_block = padded.reshape(len(common), self.blocks, BLOCK)
        self.most = by_block.max(2, initial=0)  # the greatest weight of a term in a block
        self.norms = np.zeros(self.blocks * BLOCK, np.float32)
        self.norms[at] = norm
        self.norms = self.norms.reshape(self.blocks, BLOCK).max(1, initial=0)
        self.matrix = np.ascontiguousarray(by_block.transpose(1, 0, 2))
        # No float32 sum of products of unit vectors is further off than this: a rounding of
        # at most 2**-24 for each product added, and a few of what goes in and comes out.
        self.slack = (len(common) + 16) * 2.0**-24
        # As bincount takes them, without a copy for each text.
        self.start, self.place, self.weight = start, at[example].astype(np.intp), np.asarray(weight, np.float64)
        self.query = np.zeros(width)
        self.finished = self.searched = 0  # blocks, of so many

    def _first_equal(self) -> np.ndarray:
        """For each example the first of the same vector."""
        first: dict[bytes, int] = {}
        found = np.empty(len(self.ids), np.int64)
        for i, (a, size) in enumerate(zip(self.begins.tolist(), self.sizes.tolist())):
            own = self.term[a : a + size].tobytes() + self.exact[a : a + size].tobytes()
            found[i] = first.setdefault(hashlib.blake2b(own, digest_size=16).digest(), i)
        return found

    def _rare(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the rare terms give to the similarity with every example, by block place."""
        rare = self.row[term] < 0
        begin = self.start[term[rare]]
        sizes = self.start[term[rare] + 1] - begin
        ends = np.cumsum(sizes)
        # Numbers of all postings of these lists, one list behind the other.
        at = np.repeat(begin - ends + sizes, sizes)
        at += np.arange(len(at))
        found = self.weight[at]
        found *= np.repeat(weight[rare], sizes)
        return np.bincount(self.place[at], found, self.blocks * BLOCK).reshape(self.blocks, BLOCK)

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the ``k`` most similar examples as (similarity, -position), best
        first; exact. ``without`` names an example that each may not find.

        Examples of similarity 0 aren't neighbours; equal ones go by position.
        """
        if not self.ids:
            return [[] for _ in vectors]
        n, want = len(vectors), k + (without is not None)
        sums = np.zeros((n, self.blocks, BLOCK), np.float32)
        common = np.zeros((n, len(self.most)), np.float32)
        for i, (term, weight) in enumerate(vectors):
            row = self.row[term]
            common[i, row[row >= 0]] = weight[row >= 0]
            sums[i] = self._rare(term, weight)
        norm = np.sqrt(np.einsum("ij,ij->i", common, common))
        bound = np.minimum(common @ self.most, norm[:, None] * self.norms)
        bound += sums.max(2) + self.slack
        first = min(max(FIRST, -(-want // BLOCK)), self.blocks)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        done = np.zeros((n, self.blocks), bool)
        np.put_along_axis(done, best, True, axis=1)
        self._finish(sums, common, done)
        seen = np.take_along_axis(sums, best[:, :, None], axis=1).reshape(n, -1)
        least = np.zeros(n)
        if seen.shape[1] >= want:
            least = np.partition(seen, -want, axis=1)[:, -want].astype(np.float64)
        more = ~done & (bound >= least[:, None] - self.slack)
        self._finish(sums, common, more)
        done |= more
        self.finished += int(done.sum())
        self.searched += done.size
        sums[~done] = 0
        out = []
        for i, (term, weight) in enumerate(vectors):
            near = self._ranked(sums[i].ravel(), float(least[i]), term, weight, want)
            if without is not None:
                near = [x for x in near if x[1] != -without[i]][:k]
            out.append(near)
        return out

    def _finish(self, sums: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """Adds what the common terms give, in the wanted blocks of each vector."""
        for b in np.flatnonzero(wanted.any(0)).tolist():
            rows = np.flatnonzero(wanted[:, b])
            sums[rows, b] += common[rows] @ self.matrix[b]

    def _ranked(self, sums: np.ndarray, least: float, term: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The best of the places whose sums may be among the ``k`` greatest, by exact sums."""
        places = np.flatnonzero((sums > 0) & (sums >= least - self.slack))
        if len(places) > k:
            found = sums[places]
            places = places[found >= np.partition(found, -k)[-k] - 2 * self.slack]
        if not len(places):
            return []
        examples = np.sort(self.order[places])
        same, back = np.unique(self.same[examples], return_inverse=True)
        sizes = self.sizes[same]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[same] - ends + sizes, sizes) + np.arange(ends[-1])
        self.query[term] = weight
        similarity = np.add.reduceat(self.exact[at] * self.query[self.term[at]], ends - sizes)[back]
        self.query[term] = 0.0
        by = np.argsort(-similarity, kind="stable")[:k]
        return [(float(similarity[j]), -int(examples[j])) for j in by.tolist()]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """``search`` for one vector."""
        return self.search([(term, weight)], k, [without] if without >= 0 else None)[0]

    def vote(self, near: list[tuple[float, int]], prior: float) -> float:
        """The log odds of the votes for label 1."""
        if not near:
            return math.log(prior / (1 - prior))
        weight = np.array([s * s for s, _ in near])
        y = self.labels[[-p for _, p in near]]
        share = (weight @ y + PRIOR * prior) / (weight.sum() + PRIOR)
        return math.log(share / (1 - share))


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and TF-IDF weights of unit length."""
    term = np.fromiter(counts.keys(), np.int64, len(counts))
    if not len(term):
        return term, np.empty(0)
    by = np.argsort(term)
    term = term[by]
    weight = (1 + np.log(np.fromiter(counts.values(), np.int64, len(counts))[by])) * idf[term]
    return term, weight / np.sqrt(weight @ weight)


class Model:
    """Plain values of a model: vocabulary, scaled idf, prior, ids and labels of the
    examples and their inverted lists. The driver holds them as arrays only."""

    def __init__(self, names: pa.Array, idf: np.ndarray, prior: float, ids: list, labels: np.ndarray, lists: tuple):
        self.names, self.idf, self.prior = names, idf, prior
        self.ids, self.labels, self.lists = ids, labels, lists
        self.made: tuple[Index, Terms] | None = None

    def ready(self) -> tuple[Index, Terms]:
        """What a task searches with. A Python worker keeps the value of a broadcast from
        one task to the next, so it makes them once."""
        if self.made is None:
            self.made = Index.of(self.idf, self.ids, self.labels, *self.lists), Terms(self.names.to_pylist())
        return self.made


def _learn(examples: DataFrame) -> Model:
    names, n, scale = _vocabulary(examples)
    sent = examples.sparkSession.sparkContext.broadcast(names)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value.to_pylist())
        for batch in sliced(batches, TEXTS):
            counted = [sorted(known.counted(t).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([np.array([t for t, _ in c], np.int32).tobytes() for c in counted], pa.binary()),
                 pa.array([np.array([m for _, m in c], np.int32).tobytes() for c in counted], pa.binary())],
                ["id", "label", "term", "n"],
            )

    rows = (
        examples.select(F.col("id").cast("string"), "text", "label")
        .mapInArrow(run, "id string, label int, term binary, n binary")
        .orderBy("id", "label", "term", "n")
        .toArrow()
    )
    sent.destroy()
    ids, labels = rows.column("id").to_pylist(), rows.column("label").to_numpy().astype(np.float64)
    idf = np.log(1 + len(ids) / n) * scale
    sizes = np.array([len(b.as_py()) // 4 for b in rows.column("term")], np.int64)
    term = np.frombuffer(b"".join(rows.column("term").to_pylist()), np.int32)
    count = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.int32)
    del rows
    start, example, count = inverted(term, count, sizes, len(idf))
    del term
    # Small numbers, from which a task makes the weights: they are sent to every executor.
    lists = start, example.astype(np.min_scalar_type(len(ids))), count.astype(np.min_scalar_type(count.max(initial=0)))
    # A text without any term has the odds of the examples without any.
    bare = sizes == 0
    prior = float((labels[bare].sum() + 0.5) / (bare.sum() + 10.0)) if ids else 0.5
    return Model(names, idf, prior, ids, labels, lists)


def _calibrated(examples: DataFrame, sent) -> tuple[float, float]:
    """Slope and shift of the votes, fitted to the examples, each without itself."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index, known = model.ready()
        place = {i: p for p, i in enumerate(index.ids)}
        for batch in sliced(batches, TEXTS):
            vectors = [vector(known.counted(t), model.idf) for t in batch.column(1).to_pylist()]
            own = [place[i] for i in batch.column(0).to_pylist()]
            raw = [index.vote(near, model.prior) for near in index.search(vectors, NEIGHBOURS, own)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column(2)], ["raw", "label"])

    votes = (
        examples.select(F.col("id").cast("string"), "text", "label")
        .mapInArrow(run, "raw double, label int")
        .toArrow()
        .sort_by([("raw", "ascending"), ("label", "ascending")])
    )
    return linear.calibrate(votes.column("raw").to_numpy(), votes.column("label").to_numpy().astype(np.float64))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    rows: int = EXAMPLES,
) -> DataFrame:
    """``id_col, held_out, score, predicted, evidence`` for every row of ``docs``.

    ``score`` is the calibrated probability of label 1, ``predicted`` 1 from 0.5 on.
    ``evidence`` lists the neighbours: id, similarity, label. Labels are learnt from rows
    that aren't held out only; ids with both labels teach nothing. Null and empty texts
    have no neighbours and the odds of such examples; without labels the score is 0.5
    or the share of the one label; repeated rows each give their row; null ids are kept
    and not held out; an empty table gives an empty result. Other columns are not read.
    """
    named_apart(id_col, RESULT)
    taught = labels.where(~held_out(F.col(id_col)))
    # Read several times: at most ``rows`` texts, written once.
    examples = staged(linear.sample(docs, taught, id_col, text_col, label, rows), "examples")
    sent = docs.sparkSession.sparkContext.broadcast(_learn(examples))
    both = len(set(sent.value.labels.tolist())) == 2
    slope, shift = _calibrated(examples, sent) if both else (1.0, 0.0)
    id_type = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index, known = model.ready()
        for batch in sliced(batches, TEXTS):
            logits, evidence = [], []
            vectors = [vector(known.counted(t), model.idf) for t in batch.column(1).to_pylist()]
            for near in index.search(vectors, NEIGHBOURS):
                logits.append(slope * index.vote(near, model.prior) + shift)
                evidence.append(
                    [{"id": index.ids[-p], "similarity": s, "label": int(index.labels[-p])} for s, p in near]
                )
            p = linear.sigmoid(np.array(logits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array(evidence, near_type)], ["id", "score", "evidence"]
            )

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, score double, evidence array<struct<id: string, similarity: double, label: int>>"
    )
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )
