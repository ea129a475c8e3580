"""Logistic regression on hashed features: a bounded sample is fitted, every text scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import Batches, sliced

BITS = 17  # of the hashed feature space
SAMPLE = 2500  # labelled rows that are fitted, at most

Features = Callable[[str | None], tuple[np.ndarray, np.ndarray]]  # indices, values


@dataclass
class Model:
    weights: np.ndarray  # of features
    bias: float
    slope: float = 1.0  # calibration of the logit
    shift: float = 0.0

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        raw = float(value @ self.weights[index]) + self.bias
        return self.slope * raw + self.shift

    def parts(self) -> tuple:
        """Plain values for a broadcast, from which a worker makes the model again."""
        return self.weights.astype(np.float32), self.bias, self.slope, self.shift


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, rows: int = SAMPLE) -> DataFrame:
    """``id, text, label``: one row for each of at most ``rows`` labelled ids of ``docs``.

    Ids are chosen by their hash among those that ``docs`` holds. Ids without a label of
    0 or 1, or with both, are left out; of an id's rows the one of the least text stands.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Distinct ids before the join: an id of many rows meets it as one.
    present = (
        known.join(texts.select("id").distinct(), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
        .select("id", F.col("label").cast("int").alias("label"))
    )
    # Broadcast: at most ``rows`` ids.
    found = texts.join(F.broadcast(present), "id")
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit(labelled: DataFrame, features: Features, dims: int, passes: int = 80) -> Model:
    """A model of ``labelled(id, text, label)``, a bounded sample, with calibrated logits.

    Rows whose id has crc32 mod 5 of 0 aren't fitted; the logit is calibrated on them.
    Without rows of both labels the model is the constant share of label 1.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2),
                    pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()),
                ],
                ["held", "label", "index", "value"],
            )

    held = (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held")
    rows = (
        labelled.select(held, "text", "label")
        .mapInArrow(run, "held boolean, label int, index binary, value binary")
        .toArrow()
    )
    y = rows.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-3, 1 - 1e-3))
        return Model(np.zeros(dims), float(np.log(share / (1 - share))))
    index = [np.frombuffer(b.as_py(), np.int32) for b in rows.column("index")]
    value = [np.frombuffer(b.as_py(), np.float32) for b in rows.column("value")]
    # Rows come in any order; sums of floats would follow it.
    order = np.lexsort(([v.sum() for v in value], [len(i) for i in index], y))
    held_rows = rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
    train = [r for r in order if not held_rows[r]]
    rest = [r for r in order if held_rows[r]]
    if len({y[r] for r in train}) < 2:
        train, rest = list(order), []
    weights, bias = _descend([index[r] for r in train], [value[r] for r in train], y[train], dims, passes)
    model = Model(weights, bias)
    if len({y[r] for r in rest}) == 2:
        raw = np.array([model.logit(index[r], value[r]) for r in rest])
        model.slope, model.shift = calibrate(raw, y[rest])
    return model


def _descend(index, value, y, dims: int, passes: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the log loss with a small ridge."""
    size = np.array([len(i) for i in index])
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)
    index, value = np.concatenate(index), np.concatenate(value)
    w, b = np.zeros(dims), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, passes + 1):
        z = np.bincount(row, weights=value * w[index], minlength=len(y)) + b
        miss = (sigmoid(z) - y) / len(y)
        g = np.append(np.bincount(index, weights=value * miss[row], minlength=dims) + 1e-6 * w, miss.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def calibrate(raw: np.ndarray, y: np.ndarray, passes: int = 50) -> tuple[float, float]:
    """Slope and shift of the logit by Newton's method on smoothed labels."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, c = 1.0, 0.0
    for _ in range(passes):
        p = sigmoid(a * raw + c)
        g = np.array([((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 1.0
        a, c = a - step[0], c - step[1]
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)
