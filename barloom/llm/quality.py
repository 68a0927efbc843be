"""Quality classifier: Naive Bayes support vectors.

Indicators of byte n-grams, and of words said n times in a row, are scaled by the log ratio of their smoothed class counts,
counted over all labelled training rows on the executors. A linear hinge-loss model on
the scaled indicators is fitted by dual coordinate descent on a bounded sample of those
rows, and a logistic curve fitted to margins of rows left out of it turns margins into
scores. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, thinned
from .ngrams import ALL_SLOTS, SLOTS, present_with_repeats

#: Labelled rows that the linear model is fitted on at most.
SAMPLE_ROWS = 6000
#: Labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weight[slots].sum() / np.sqrt(max(1, len(slots)))) + self.bias


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SLOTS, bool)
    counts = np.zeros((2, ALL_SLOTS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("quality").to_pylist()):
            counts[label][present_with_repeats(text or b"", seen)] += 1
            rows[label] += 1
    if rows.any():
        slot = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slot, -1)), pa.array(np.append(counts[0][slot], rows[0])), pa.array(np.append(counts[1][slot], rows[1]))],
            ["slot", "n0", "n1"],
        )


def descend(rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-loss linear support vector machine, with a bias feature.

    rows: (slots, values) of the training rows; cost: the penalty of each row.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(ALL_SLOTS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    half = 0.5 / cost
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            slots, values = rows[i]
            g = y[i] * (w[slots] @ values + bias) - 1 + alpha[i] * half[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(0.0, alpha[i] - g / (square[i] + half[i]))
            step = (new - alpha[i]) * y[i]
            w[slots] += step * values
            bias += step
            most = max(most, abs(g))
            alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, y), Newton steps with a little damping."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = target - p, p * (1 - p) + 1e-9
        g = np.array([d @ margin, d.sum()])
        m = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cost: float = 1.0) -> Model:
    """docs (doc_id, text) and labels (doc_id, quality 0/1) of the training rows.

    Counts cover all of them; the sample of at most `sample_rows` is taken in equal parts
    from both classes by a hash of the doc_id, then the doc_id. A document with both labels counts
    in both classes, as do the rows of a doc_id that has several texts; a label said twice counts once. If such rows
    make the sample larger, the first `2 * sample_rows` by that hash stay. Labels other than 0 and 1, and those without a doc_id, count
    nothing. One class only, or no rows: the score is the smoothed share of class 1.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = known.count() <= BROADCAST_LABELS
    rows = texts.join(F.broadcast(known) if small else known, "doc_id")
    # Each task sends at most one row a slot, and the sum has ALL_SLOTS rows.
    counts = rows.select("text", "quality").mapInArrow(_count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    total = counts[counts["slot"] == -1]
    n0, n1 = (int(total[c].iloc[0]) if len(total) else 0 for c in ("n0", "n1"))
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(np.zeros(ALL_SLOTS), 0.0, 0.0, float(np.log(prior / (1 - prior))), prior)
    p, q = np.ones(ALL_SLOTS), np.ones(ALL_SLOTS)
    counts = counts[counts["slot"] >= 0]
    at = counts["slot"].to_numpy(np.int64)
    q[at] += counts["n0"].to_numpy(np.float64)
    p[at] += counts["n1"].to_numpy(np.float64)
    ratio = np.log((p / (n1 + 2)) / (q / (n0 + 2)))
    half = sample_rows // 2
    h = F.xxhash64(F.lit(3), "doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    chosen = [
        known.where((F.col("quality") == label) & (h <= thinned(n, half))).orderBy(h, "doc_id").limit(half) for label, n in ((0, n0), (1, n1))
    ]
    sample = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").orderBy(h, "doc_id", "quality", "text").limit(2 * sample_rows)
    pulled = sample.mapInArrow(_slots_only, "doc_id long, quality int, slots binary").toPandas()
    feats = []
    for raw in pulled["slots"]:
        slots = np.frombuffer(raw, np.int32)
        feats.append((slots, ratio[slots] / np.sqrt(max(1, len(slots)))))
    y = np.where(pulled["quality"].to_numpy() > 0, 1.0, -1.0)
    apart = np.arange(len(y)) % 5 == 4
    weight_of = {1.0: len(y) / (2 * max(1, (y > 0).sum())), -1.0: len(y) / (2 * max(1, (y < 0).sum()))}
    costs = np.array([cost * weight_of[v] for v in y])
    w, bias = descend([f for f, out in zip(feats, apart) if not out], y[~apart], costs[~apart])
    margins = np.array([w[s] @ v + bias for (s, v), out in zip(feats, apart) if out])
    slope, shift = calibrate(margins, y[apart]) if len(margins) > 10 else (1.0, 0.0)
    # the sample holds the classes in equal parts: move the curve back to their share
    share = (y > 0).mean()
    shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model(w * ratio, bias, slope, shift, prior)


def _slots_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SLOTS, bool)
    for batch in batches:
        rows = [present_with_repeats(t or b"", seen).astype(np.int32).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "slots"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row for each row of docs, 0 to 1, higher for likelier class 1.

    Null and empty texts have no n-grams and the score of the bias alone. A null doc_id
    stays null. Repeated rows each get theirs. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            z = np.array([m.margin(present_with_repeats(t or b"", seen)) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -40, 40))))], ["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
