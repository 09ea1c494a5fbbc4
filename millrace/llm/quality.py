"""Quality classifier: Naive Bayes support vectors.

A document's features are indicators of hashed n-grams: its words, and runs of one to three word shapes (letter case,
marks around the word, whether it was said just before). Each indicator is scaled by its log-count ratio between the
classes, counted over all labelled rows in training. A linear model is fitted to the scaled indicators by dual
coordinate descent on the hinge loss, and a logistic curve over its margins turns them into scores.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize, small
from millrace.llm.mixing import draw

BITS = 18
#: Words looked back over for a repetition.
LOOK_BACK = 6
#: Labelled rows the linear model is fitted to, at most; the log-count ratios use all of them.
SAMPLE = 12_000
EPOCHS = 15
COST = 1.0
MEMO = 300_000
LABELS_BROADCAST = 1_000_000


class Features:
    """Hashed n-gram indicators of a text."""

    def __init__(self):
        self.words: dict[bytes, tuple[int, int]] = {}

    def _word(self, word: bytes) -> tuple[int, int]:
        if len(self.words) >= MEMO:
            self.words.clear()
        text = word.decode()
        core = text.strip("".join({c for c in (*text[:3], *text[-3:]) if not c.isalnum()})) if not text.isalnum() else text
        case = 0 if not core else 1 if core.isdigit() else 2 if core.islower() else 3 if core.isupper() and len(core) > 1 else 4 if core[:1].isupper() else 5
        tail = text[-1]
        mark = 0 if tail.isalnum() else 1 + b".,;:!?|#*$%&<>\"'()[]{}=@/".find(tail.encode()[:1]) % 30
        runs = min(3, len(text) - len(text.rstrip(tail))) if mark else 0
        found = self.words[word] = (xxhash.xxh32_intdigest(word.lower()), (case * 32 + mark) * 4 + runs)
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Sorted feature numbers, each once. A text without words has none."""
        words = text.split()
        if not words:
            return np.empty(0, dtype=np.int64)
        get, make = self.words.get, self._word
        pairs = np.array([get(w) or make(w) for w in words], dtype=np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1]
        said = np.zeros(len(word), dtype=bool)
        for k in range(1, min(LOOK_BACK, len(word) - 1) + 1):
            said[k:] |= word[k:] == word[:-k]
        shape = shape * np.uint64(2) + said + np.uint64(1)
        grams = [word * np.uint64(0x9E3779B97F4A7C15)]
        run = shape
        for n in range(1, 4):
            grams.append((run * np.uint64(8) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F))
            run = run[: len(shape) - n] * np.uint64(4096) + shape[n:]
        return np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


_features: dict[int, Features] = {}


def features() -> Features:
    return _features.setdefault(os.getpid(), Features())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, of good rows, of others) summed over the task's labelled rows (text, label)."""
    seen, make = np.zeros((2, 1 << BITS), dtype=np.int64), features()
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for i, label in enumerate(batch.column(1).to_pylist()):
            seen[0 if label == 1 else 1, make.of(texts[i].as_py() or b"")] += 1
    some = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["feature", "good", "bad"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = features()
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        found = [make.of(texts[i].as_py() or b"").astype(np.int32) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["features", "label"])


def ratios(counts: list[tuple[int, int, int]], smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each feature; features never seen have none."""
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, g, b in counts:
        good[f], bad[f] = g, b
    seen = good + bad > 0
    p, q = (good + smooth) / (good + smooth).sum(), (bad + smooth) / (bad + smooth).sum()
    return np.where(seen, np.log(p / q), 0.0)


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias over the indicators, by dual coordinate descent on the hinge loss.

    Rows are scaled by ``scale`` and to unit length. Each class counts alike in sum, so that a rare one is not lost.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    w, bias = np.zeros(len(scale)), 0.0
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(1e-12, float(np.sqrt((v * v).sum()))))
    share = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    top = np.array([cost * len(y) / (2 * share[s]) for s in y])
    alpha, square = np.zeros(len(y)), np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            slope = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton steps on smoothed labels."""
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = goal - p, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum(), g.sum()])
        hess = np.array([[(h * margins * margins).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class Model:
    """Scaled weights, bias, and the curve over margins. With no labels of either class every score is the same."""

    def __init__(self, scale: np.ndarray, w: np.ndarray, bias: float, a: float, b: float):
        self.scale, self.joint, self.bias, self.a, self.b = scale.astype(np.float32), (w * scale).astype(np.float32), bias, a, b

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.scale[found]).sum()))
        return self.bias + (float(self.joint[found].sum()) / length if length else 0.0)

    def score(self, text: bytes) -> float:
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, self.a * self.margin(features().of(text)) + self.b)))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows given. Rows with a null label or id teach nothing; each label of a document counts."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label is not null")
    marks = materialize(marks)
    n = marks.count()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(small(marks, LABELS_BROADCAST), "_id")
    counts = map_arrow(rows.select("text", "label"), _counts, "feature long, good long, bad long").groupBy("feature").agg(F.sum("good"), F.sum("bad"))
    scale = ratios([tuple(r) for r in counts.collect()])  # at most two to the BITS features
    drawn = rows.where(draw(F.col("_id"), seed="fit") < F.lit(min(1.0, 0.95 * sample / max(n, 1)) if n > sample else 1.0))
    held = map_arrow(drawn.select("text", "label"), _extract, "features array<int>, label int").limit(sample).toArrow()
    found = [np.array(x, dtype=np.int64) for x in held.column("features").to_pylist()]
    y = held.column("label").to_numpy()
    if len(set((y == 1).tolist())) < 2:
        share = (float((y == 1).sum()) + 1) / (len(y) + 2)
        return Model(scale, np.zeros(len(scale)), 0.0, 1.0, float(np.log(share / (1 - share))))
    w, bias = descend(found, y, scale)
    model = Model(scale, w, bias, 1.0, 0.0)
    # The curve is fitted to margins of rows that the weights were not fitted to.
    part = np.arange(len(y)) % 5 == 0
    w_part, bias_part = descend([r for r, p in zip(found, part) if not p], y[~part], scale, epochs=5)
    partial = Model(scale, w_part, bias_part, 1.0, 0.0)
    model.a, model.b = curve(np.array([partial.margin(r) for r, p in zip(found, part) if p]), y[part])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): between 0 and 1, higher where label 1 is likelier. Null and empty texts get the curve's value at the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            scores = [shared.value.score(texts[i].as_py() or b"") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double")
