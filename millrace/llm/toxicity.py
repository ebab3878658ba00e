"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the 3- to 5-grams of a text's characters (code points, in lower case, runs of white
space as one blank), hashed to 22 bits. A feature is the presence of an n-gram, scaled by the log of
its smoothed share among toxic against clean training documents. A logistic regression over
all features that the training rows hold, rare ones included, weighs them; its L2 penalty shrinks those that say
little. Two cross-fitted halves of the training rows calibrate the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise

ORDERS = (3, 4, 5)
#: Bounds of the fit: so many labelled documents, of so many characters together.
MAX_DOCS, MAX_CHARS = 4_000, 16_000_000
#: Bits of a hashed n-gram; a model is one number for each, 16 MB.
BITS = 22
#: Pseudo-documents behind each ratio, spread over the classes by their size, and the L2 penalty.
SMOOTHING, STRENGTH = 100.0, 1e-5
#: Strength of the belief that scores need no other slope than 1 and no shift, in calibration.
PRIOR = (4.0, 0.1)
#: Texts are read in blocks of this many characters, which overlap by the longest n-gram.
BLOCK = 1 << 20


def hashed(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes, of BITS bits, of the n-grams of a sequence of code points."""
    code = s[: len(s) - n + 1] * np.uint32(0x9E3779B1)
    for k in range(1, n):
        code = (code ^ s[k: len(s) - n + 1 + k]) * np.uint32(0x85EBCA6B + 2 * n)
        code ^= code >> np.uint32(15)
    return (code * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


class Reader:
    """Finds the distinct features of one text after another."""

    def __init__(self) -> None:
        self.seen, self.last = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)

    def present(self, text: str | None) -> np.ndarray:
        """The distinct hashed n-grams of a text with a blank on either side."""
        data = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        found = []
        for at in range(0, len(data), BLOCK):
            s = data[at: at + BLOCK + max(ORDERS) - 1]
            grams = np.concatenate([hashed(s, n) for n in ORDERS if len(s) >= n] or [np.empty(0, np.uint32)])
            order = np.arange(len(grams), dtype=np.int32)
            self.last[grams] = order  # of equal ones the last stays
            new = grams[(self.last[grams] == order) & ~self.seen[grams]]
            self.seen[new] = True
            found.append(new)
        out = np.concatenate(found)
        self.seen[out] = False
        return out


@dataclass(frozen=True)
class Model:
    """Weight of each feature (already scaled by its ratio) and the bias of a fitted classifier."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None, reader: Reader) -> float:
        z = self.bias + float(self.weights[reader.present(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """text, toxic and order (a hash) of at most `most` labels' documents that aren't held out.

    The labels of smallest hash are taken, so that the choice is random but fixed. They are few
    enough to broadcast, and no text is shuffled. Null and contradictory labels are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("_low")).filter("toxic = _low")
    chosen = known.select(F.col("doc_id").alias("_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("order")).orderBy("order", "_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "order")


def log_ratios(rows: list[np.ndarray], toxic: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """Log of each feature's share among toxic documents against its share among clean ones.

    `smoothing` pseudo-documents, spread over the classes by their size, pull rare features to zero.
    """
    t, c = np.zeros(size), np.zeros(size)
    for row, y in zip(rows, toxic, strict=True):
        (t if y else c)[row] += 1
    n_toxic = toxic.sum()
    added = smoothing / len(toxic)
    return np.log((t / max(n_toxic, 1) + added) / (c / max(len(toxic) - n_toxic, 1) + added))


def logistic(rows: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray, strength: float, epochs: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (times scale) and bias of the logistic regression on presence times scale.

    Minimises the mean logistic loss plus strength / 2 times the squared norm of weights and bias, by
    dual coordinate ascent: document by document, the dual variable that is best given all others is found by
    Newton's method, until they move by `tolerance` on average.
    """
    n, square = len(rows), scale * scale
    sign, dual = 2.0 * toxic - 1, np.zeros(len(rows))
    curve = np.array([square[r].sum() + 1 for r in rows]) / (strength * n)
    weights, bias, rng = np.zeros(len(scale)), 0.0, np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            row, before, q = rows[i], dual[i], curve[i]
            margin = sign[i] * (weights[row].sum() + bias)
            low, high, a = 0.0, 1.0, min(max(before, 1e-6), 1 - 1e-6)
            for _ in range(60):
                slope = np.log(a / (1 - a)) + margin + (a - before) * q
                low, high = (low, a) if slope > 0 else (a, high)
                step = a - slope / (1 / (a * (1 - a)) + q)
                after = step if low < step < high else (low + high) / 2
                done = abs(after - a) <= 1e-12 + 1e-9 * a
                a = after
                if done:
                    break
            gain = (a - before) * sign[i] / (strength * n)
            dual[i] = a
            moved += abs(a - before)
            weights[row] += gain * square[row]
            bias += gain
        if moved / n < tolerance:
            break
    return weights, bias


def calibrate(z: np.ndarray, toxic: np.ndarray, prior: tuple[float, float] = PRIOR, steps: int = 100) -> tuple[float, float]:
    """Slope (positive) and shift of the logistic curve through (z, toxic), by Newton's method.

    `prior` weighs the belief in slope 1 and shift 0: few scores leave them about there, many settle them.
    """
    x, w, mean, penalty = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array(prior)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - toxic) + penalty * (w - mean))
        w -= step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return max(w[0], 1e-6), w[1]


def learn(rows: list[np.ndarray], toxic: np.ndarray, smoothing: float = SMOOTHING, strength: float = STRENGTH, prior: tuple[float, float] = PRIOR, **options: float) -> Model:
    """The model of feature lists and their labels: ratios, regression and calibration.

    Without toxic or without clean documents the model is a constant. Calibration takes the scores that each half
    gets from a fit on the other, whatever their number, and shrinks to none as they get fewer.
    """
    n, n_toxic = len(rows), int(toxic.sum())
    if not 0 < n_toxic < n:
        share = (n_toxic + 0.5) / (n + 1) if n else 0.0
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    held = np.zeros(1 << BITS, bool)
    for row in rows:
        held[row] = True
    features, number = np.flatnonzero(held), np.cumsum(held, dtype=np.int32) - 1  # numbered without gaps: faster to reach
    rows = [number[row] for row in rows]

    def fitted(which: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in which]
        return logistic(own, toxic[which], log_ratios(own, toxic[which], len(features), smoothing), strength, **options)

    half, z = np.empty(n, bool), np.zeros(n)
    for y in (0, 1):  # every other document of each class
        members = np.flatnonzero(toxic == y)
        half[members] = np.arange(len(members)) % 2 == 0
    for side in (True, False):
        if (other := np.flatnonzero(half != side)).size:
            weights, bias = fitted(other)
            for i in np.flatnonzero(half == side):
                z[i] = weights[rows[i]].sum() + bias
    slope, shift = calibrate(z, toxic.astype(float), prior)
    weights, bias = fitted(np.arange(n))
    full = np.zeros(1 << BITS, np.float32)
    full[features] = weights * slope
    return Model(full, bias * slope + shift)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS, most_chars: int = MAX_CHARS, **options: float) -> Model:
    """Fit on a bounded sample: at most `most` labelled documents with at most `most_chars` characters together.

    Documents are taken whole, in the order of a hash, if they still fit in. Tasks turn texts into lists of features and write them; the driver reads
    the lists of those taken, three numbers a character at most, so its memory depends on the bounds alone. Labels without a document, and an empty
    table, leave a constant model.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [np.sort(reader.present(x)).tobytes() for x in texts]
            yield pa.record_batch([b.column("order"), pa.array(list(map(len, texts)), pa.int64()), b.column("toxic"), pa.array(found, pa.binary())], ["order", "chars", "toxic", "features"])

    held = materialise(sample(docs, labels, most).mapInArrow(read, "order long, chars long, toxic int, features binary"), "features")
    room, taken = most_chars, []
    for r in held.groupBy("order").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")).orderBy("order").collect():  # `most` at most
        if r["chars"] <= room:
            room -= r["chars"]
            taken.append((r["order"],))
    spark = docs.sparkSession
    chosen = held.join(F.broadcast(spark.createDataFrame(taken, "order long")), "order", "left_semi")
    found = sorted(((np.frombuffer(r["features"], np.uint32), r["toxic"]) for r in chosen.select("features", "toxic").toLocalIterator()), key=lambda p: (len(p[0]), p[0].tobytes(), p[1]))  # the same order in every run
    discard(held)
    return learn([f for f, _ in found], np.array([y for _, y in found], np.int64), **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= threshold) of each row of docs(doc_id, text).

    Null texts count as empty. Whole texts are read, however long. Repeated rows and null doc_ids
    are each scored; columns beside doc_id and text are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Reader()
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([model.score(t.as_py(), reader) for t in b.column("text")], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns.

    Null texts count as empty; repeated rows are each judged; an empty table stays empty.
    """
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Reader()
        for b in batches:
            clean = [model.score(t.as_py(), reader) < threshold for t in b.column(column)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
