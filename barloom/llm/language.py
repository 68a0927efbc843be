"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct byte n-grams
of length 1 to 3 that both hold, over the geometric mean of their own numbers. Landmark
texts give the Nyström map: K_nm times the inverse square root of K_mm. One-versus-rest
kernel ridge regression on the mapped rows gives a weight vector for each language.
Texts are scored in batches: n-gram incidence times landmark incidence, then the kernel
rows times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, released, thinned
from .ngrams import SLOTS, batches_of, has_letter, present

#: Training texts and landmarks of each language at most, and of all languages, which share them; each has a text, however many there are.
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 32
TRAIN_TEXTS, LANDMARKS = 6_400, 1_024
#: Cells of the incidence matrix that are added up at once, and landmarks up to which they are stored as what they are added as.
CELLS, FEW_LANDMARKS = 1 << 22, 256

#: Least norm of the Nyström map; least lead of a claim if the norm is under WELL_KNOWN. Held-out rows of sf0.1 have
#: norms from 0.284 on; low leads with high norms are texts of two learned languages. Texts under SHORT
#: characters have low norms in any language and go by LEAST_KNOWN alone.
LEAST_KNOWN, WELL_KNOWN, LEAST_LEAD, SHORT = 0.2, 0.45, 0.2, 20


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of SLOTS: the row of `incidence`, or the last, empty one
    incidence: np.ndarray  # landmark n-grams x landmarks
    own: np.ndarray  # square root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages
    root: np.ndarray  # landmarks x rank: kernel rows times it are the Nyström map

    def kernel(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, m = self.column[slots], self.incidence.shape[1]
        out = np.zeros((len(at) - 1, m), np.float64)
        full = np.flatnonzero(np.diff(at))
        lo = 0
        while lo < len(full):  # as many texts at once as have CELLS cells, or one
            begin = at[full[lo]]
            hi = max(lo + 1, int(np.searchsorted(at[full + 1], begin + CELLS // max(1, m), side="right")))
            part = full[lo:hi]
            out[part] = np.add.reduceat(self.incidence[rows[begin : at[part[-1] + 1]]], at[part] - begin, axis=0, dtype=np.float32)
            lo = hi
        size = np.sqrt(np.maximum(1, np.diff(at)))
        return out / size[:, None] / self.own[None, :]


def _landmarks(languages: np.ndarray, per_language: int, most: int) -> np.ndarray:
    """The first rows of each language, in order of the languages' names; where they are more than `most`, the very first ones of the first languages."""
    names, of, count = np.unique(languages, return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)  # of a row in its language
    some = np.flatnonzero(place < per_language)
    some = some[np.lexsort((of[some], place[some]))][:most]
    return some[np.lexsort((place[some], of[some]))]


def train(rows: list[np.ndarray], languages: list[str], per_language: int | None = None, ridge: float = 1e-2) -> Model:
    """rows: the slots of each text's n-grams. The first `per_language` texts of each language are its landmarks, LANDMARKS in all at most.

    The kernel rows of the texts are never held together: sums of their outer products, and of the rows of each language,
    are all that the regression needs."""
    said = np.array(languages, dtype=object).astype(str)
    names, of = np.unique(said, return_inverse=True)
    landmarks = _landmarks(said, per_language or min(LANDMARKS_PER_LANGUAGE, max(1, LANDMARKS // max(1, len(names)))), LANDMARKS)
    known = np.unique(np.concatenate([rows[i] for i in landmarks])) if len(landmarks) else np.zeros(0, np.int64)
    column = np.full(SLOTS, len(known), np.int64)
    column[known] = np.arange(len(known))
    incidence = np.zeros((len(known) + 1, len(landmarks)), np.float32 if len(landmarks) <= FEW_LANDMARKS else np.uint8)
    for k, i in enumerate(landmarks):
        incidence[column[rows[i]], k] = 1
    own = np.sqrt(np.array([max(1, len(rows[i])) for i in landmarks], np.float64))
    model = Model(names.tolist(), column, incidence, own, np.zeros((len(landmarks), len(names))), np.zeros((len(landmarks), 0)))
    if not len(names):
        return model
    mapped = lambda some: np.concatenate([model.kernel(*batches_of(rows[i] for i in some[lo : lo + 64])) for lo in range(0, len(some), 64)])
    k_mm = mapped(landmarks)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    model.root = root
    # rows weigh the same for each language in sum
    weight = len(rows) / (len(names) * np.bincount(of))[of]
    gram, sums = ridge * np.eye(root.shape[1]), np.zeros((len(names), root.shape[1]))
    for lo in range(0, len(rows), 512):
        z = mapped(np.arange(lo, min(lo + 512, len(rows)))) @ root
        weighed = z * weight[lo : lo + 512, None]
        gram += weighed.T @ z
        np.add.at(sums, of[lo : lo + 512], weighed)
    # targets are 1 for the row's language and -1 for the others
    model.weights = root @ np.linalg.solve(gram, 2 * sums.T - sums.sum(axis=0)[:, None])
    return model


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of texts that have a letter; no text leaves the executors."""
    seen = np.zeros(SLOTS, bool)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows = [present(t.encode(), True, seen).astype(np.int32).tobytes() if has_letter(t) else None for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("lang"), pa.array(rows, pa.binary())], ["k", "lang", "slots"])


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """docs (doc_id, text, lang): every language is learned, from at most `per_language` of its rows, and its share of TRAIN_TEXTS, by a hash of the
    doc_id, then doc_id and text; their n-grams reach the driver. Rows without language or letters are no examples; rows
    that share a doc_id are rows like others. The model holds a number for each landmark and language, and a byte (4 up to
    FEW_LANDMARKS) for each landmark and n-gram that a landmark has: 134 MB if LANDMARKS texts had all n-grams there are."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language, as the model has
    per_language = min(per_language, max(1, TRAIN_TEXTS // max(1, len(counts))))
    # few rows of each language reach the sort, see thinned(), and of all columns only their texts
    below = spark.createDataFrame([(r["lang"], thinned(r["n"], per_language)) for r in counts], "lang string, below long")
    hashed = rows.select("doc_id", "lang", F.xxhash64(F.lit(9), "doc_id").bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    thin = hashed.join(F.broadcast(below), "lang").where(F.col("h") <= F.col("below"))
    chosen = thin.withColumn("k", first("h", "doc_id")).where(F.col("k") <= per_language)
    # at most per_language rows a language
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("k").alias("at"))
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("k", first("at", "doc_id", "text")).where(F.col("k") <= per_language)
    pulled = texts.select("k", "lang", "text").mapInArrow(released(_slots_of), "k int, lang string, slots binary").where("slots is not null").toPandas()
    pulled = pulled.sort_values(["k", "lang"])
    return train([np.frombuffer(x, np.int32).astype(np.int64) for x in pulled["slots"]], list(pulled["lang"]))


def _kernel(m: Model, texts: list[str | None], seen: np.ndarray) -> np.ndarray:
    return m.kernel(*batches_of(present((t or "").encode(), True, seen) for t in texts))


def _claims(m: Model, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, known) of each text: the winner's regression value over the next one (over 0 if there is
    one language), and the norm of the Nyström map, the share of the text that landmarks explain."""
    if not m.languages:
        return np.zeros(len(kernel)), np.zeros(len(kernel))
    f = np.sort(kernel @ m.weights, axis=1)
    return f[:, -1] - (f[:, -2] if f.shape[1] > 1 else 0.0), np.linalg.norm(kernel @ m.root, axis=1)


def _judge(m: Model, texts: list[str | None], kernel: np.ndarray) -> tuple[list[str], list[float]]:
    good = np.array([has_letter(t) for t in texts], bool) & bool(m.languages)
    if not good.any():
        return ["und"] * len(texts), [0.0] * len(texts)
    f = kernel @ m.weights
    best = f.argmax(axis=1)
    value = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
    return [m.languages[b] if ok else "und" for ok, b in zip(good, best)], np.where(good, value, 0.0).tolist()


def accepted(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """The rows of docs whose text has a known language with a score of at least `least`; all columns stay.

    A text that no language claims scores near 0.5, so the landmarks must also explain it, see
    _claims(): other scripts and random characters go by the norm, most other languages by a low
    norm without a lead. One that is close to a learned language, as Polish is here, may stay.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = part.column("text").to_pylist()
                kernel = _kernel(shared.value, texts, seen)
                names, score = _judge(shared.value, texts, kernel)
                ahead, share = _claims(shared.value, kernel)
                brief = np.array([len(t or "") < SHORT for t in texts])
                good = (np.array(names) != "und") & (np.array(score) >= least) & (share >= LEAST_KNOWN) & ((share >= WELL_KNOWN) | (ahead >= LEAST_LEAD) | brief)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of docs, from its whole text.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or nothing was
    learned; score is the winner's regression value, from -1..1 to 0..1. Ties go to the
    first language by name. A null doc_id stays null; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = part.column("text").to_pylist()
                names, score = _judge(m, texts, _kernel(m, texts, seen))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")
