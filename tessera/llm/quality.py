"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of bytes (1 to 4) and of word shapes (1 to 3), hashed into 2**BITS places. The
indicators are scaled by the log-count ratio of the classes, and a linear hinge-loss model is fitted on them by
dual coordinate descent; its margin is calibrated to a probability.

The fit uses a bounded sample of labelled rows (``most``), taken from the folds that may train; scoring is one narrow
pass over all documents with a weight vector of fixed size. A null or empty text has no n-grams and gets the score of
the bias alone. Without labels of both classes every score is 0.5. Repeated rows are scored one by one; columns other
than identifier and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, bounded, tidy, word_bounds
from .training import calibrate, dual_coordinate_descent, fold, labelled_sample

BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """Classes of bytes as bits: upper, lower, digit, symbol, other punctuation."""
    kind = np.zeros(256, np.uint8)
    for bit, members in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>!=~^_+@", b".,;:?\"'()-/")):
        kind[list(members)] |= 1 << bit
    kind[128:] |= 2  # letters beyond ASCII go with the lower ones
    return kind


class Indicators:
    """Hashed n-gram indicators of a text."""

    def __init__(self) -> None:
        self.roll, self.kind = Roller(), _kinds()

    def shapes(self, text: bytes, raw: np.ndarray) -> np.ndarray:
        start, end = word_bounds(raw)
        if not len(start):
            return np.zeros(0, np.uint64)
        out = np.zeros(len(start), np.uint64)
        kind = self.kind[raw]
        for bit in range(5):
            total = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(kind >> bit & 1, out=total[1:])
            out |= (total[end] > total[start]).astype(np.uint64) << np.uint64(bit)
        out |= (kind[start] & 1).astype(np.uint64) << np.uint64(5)
        out |= np.digitize(end - start, (2, 4, 8, 16)).astype(np.uint64) << np.uint64(6)
        words = self.roll.slices(self.roll.prefix(self.roll.byte[raw]), start, end)
        for back in (1, 2):  # the word before, or the one before that, again
            out[back:] |= (words[back:] == words[:-back]).astype(np.uint64) << np.uint64(8 + back)
        return out

    def __call__(self, text: bytes) -> np.ndarray:
        seen = np.zeros(1 << BITS, bool)
        raw = np.frombuffer(text, np.uint8)
        code = np.zeros(len(raw), np.uint64)
        for n in range(1, 5):
            if len(raw) < n:
                break
            code = (code[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :].astype(np.uint64)
            seen[((code + np.uint64(n << 40)) * MIX) >> np.uint64(64 - BITS)] = True
        shape = self.shapes(text, raw)
        code = np.zeros(len(shape), np.uint64)
        for n in range(1, 4):
            if len(shape) < n:
                break
            code = (code[: len(shape) - n + 1] << np.uint64(12)) | shape[n - 1 :]
            seen[((code + np.uint64((16 + n) << 40)) * MIX) >> np.uint64(64 - BITS)] = True
        return np.flatnonzero(seen).astype(np.int32)


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Indicators()
    for b in batches:
        found = [of(x or b"").tobytes() for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(found, pa.binary())], names=["id", "y", "at"])


def fit(rows: list[tuple[np.ndarray, int]], totals: dict[int, int], mix: float = 0.5) -> tuple[np.ndarray, float, float]:
    """Weights of the indicators, and a, b of the calibration: score = sigmoid(a * sum / sqrt(count) + b)."""
    y = np.array([1 if label else -1 for _, label in rows])
    if len(set(y)) < 2:
        return np.zeros(1 << BITS), 1.0, 0.0
    counts = np.ones((2, 1 << BITS))
    for at, label in rows:
        counts[label, at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    weight = np.where(y > 0, totals[1] / (y > 0).sum(), totals[0] / (y < 0).sum())
    weight /= weight.mean()
    cost = np.where(y > 0, 1 / (y > 0).mean(), 1 / (y < 0).mean()) / 2

    def model(which: np.ndarray) -> np.ndarray:
        scaled = [(rows[i][0], ratio[rows[i][0]] / np.sqrt(max(1, len(rows[i][0])))) for i in which]
        w = dual_coordinate_descent(scaled, y[which], 1 << BITS, cost[which])
        w = (1 - mix) * np.abs(w).mean() + mix * w
        return w * ratio

    def margin(w: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.array([w[rows[i][0]].sum() / np.sqrt(max(1, len(rows[i][0]))) for i in which])

    part = np.arange(len(rows)) % 4  # the calibration sees margins of models that did not see the row
    out_of = np.zeros(len(rows))
    for k in range(4):
        if len(set(y[part != k])) == 2:
            out_of[part == k] = margin(model(np.flatnonzero(part != k)), np.flatnonzero(part == k))
    a, b = calibrate(out_of, y, weight)
    return model(np.arange(len(rows))), a, b


def _scores(model) -> Callable:  # noqa: ANN001 (a broadcast)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, a, b0 = model.value
        of = Indicators()
        for b in batches:
            out = []
            for x in b.column("text").cast(pa.binary()).to_pylist():
                at = of(x or b"")
                z = a * float(weight[at].sum()) / max(1, len(at)) ** 0.5 + b0
                out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.float64())], names=[*(n for n in b.schema.names if n != "text"), "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float, float]:
    sample, totals = labelled_sample(docs, labels, label, fold(F.col(id_col), folds) != held_out, most, id_col, text_col)
    rows = sorted((r.id, r.y, r.at) for r in sample.mapInArrow(_indices, "id long, y int, at binary").collect())  # ``most`` rows at most
    weight, a, b = fit([(np.frombuffer(at, np.int32), y) for _, y, at in rows], totals)
    return weight.astype(np.float32), a, b


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held_out, most, id_col, text_col))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(tidy(_scores(model)), "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below 0.5, all columns as they were.

    A row that scores 0.5 exactly stays, so without labels of both classes all do. Repeated rows and rows without
    identifier are judged one by one; an empty table gives an empty one. Other columns of ``labels`` are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held_out, most, id_col, text_col))
    rows = bounded(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(tidy(_scores(model)), rows.select("row").schema.add("score", "double")).where("score >= 0.5")
    return scored.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
