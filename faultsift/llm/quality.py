"""Quality classifier: a linear support vector machine on n-gram indicators scaled by Naive Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import NONBLANK, ODD, Words, bounded_batches, carried, free_name, made_batch, raw_bytes, text_slices

SINGLES, PAIRS, TRIPLES = 256, 1 << 16, 1 << 16
RUNS = (2, 3, 4, 6, 8)  # n-grams of one repeated word, whichever it is
FEATURES = SINGLES + PAIRS + TRIPLES + len(RUNS)
ROWS_AT_ONCE = 128


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row bounds, features) for blocks of rows: which runs of one, two and three bytes
    each text has, and how long the runs of one word are. Singles and pairs have a feature of their own,
    triples share 65,536 by hash."""
    words = Words(data, offsets, NONBLANK)
    hashes = words.hashes()
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    starts = np.flatnonzero(~again)
    length = np.diff(np.append(starts, len(words)))
    runs = [words.row[starts[length >= n]] for n in RUNS]
    for at in range(0, len(offsets) - 1, ROWS_AT_ONCE):
        bounds = offsets[at:at + ROWS_AT_ONCE + 1]
        text = data[bounds[0]:bounds[-1]].astype(np.uint32)
        rows = len(bounds) - 1
        owner = np.repeat(np.arange(rows), np.diff(bounds))
        there = np.zeros(rows * FEATURES, bool)
        there[owner * FEATURES + text] = True
        code = text
        for size, base in ((2, SINGLES), (3, SINGLES + PAIRS)):
            if len(text) < size:
                break
            code = code[:-1] << np.uint32(8) | text[size - 1:]
            own = owner[:-(size - 1)] == owner[size - 1:]
            feature = code if size == 2 else (
                code.astype(np.uint64) * ODD >> np.uint64(48)).astype(np.int64)
            there[(owner[:len(code)] * FEATURES + base + feature)[own]] = True
        for i, own in enumerate(runs):
            there[(own[(own >= at) & (own < at + rows)] - at) * FEATURES + SINGLES + PAIRS + TRIPLES + i] = True
        found = np.flatnonzero(there)
        upto = np.searchsorted(found, np.arange(rows + 1) * FEATURES)
        yield at, upto, found - np.repeat(np.arange(rows) * FEATURES, np.diff(upto))


def class_counts(labelled: DataFrame, text_column: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """(documents with each feature, by class; documents by class) over all labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES + 1), np.int64)
        for batch in batches:
            for rows, texts in text_slices(batch, "__text"):
                labels = rows.column(1).to_numpy()
                for at, upto, feature in indicators(*raw_bytes(texts)):
                    own = labels[at:at + len(upto) - 1]
                    spread = np.repeat(own, np.diff(upto))
                    for c in (0, 1):
                        counts[c, :-1] += np.bincount(feature[spread == c], minlength=FEATURES)
                        counts[c, -1] += int((own == c).sum())
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["feature", "n0", "n1"])

    rows = (labelled.select(F.col(text_column).alias("__text"), F.col(label).cast("int"))
            .mapInArrow(run, "feature long, n0 long, n1 long")
            .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    counts = np.zeros((2, FEATURES + 1), np.int64)
    for c in (0, 1):
        counts[c, rows["feature"].to_numpy()] = rows[f"n{c}"].to_numpy()
    return counts[:, :-1], counts[:, -1]


@dataclass
class QualityModel:
    weights: np.ndarray  # of an indicator, its ratio included
    squares: np.ndarray  # squared ratios, for the length of a document's vector
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for at, upto, feature in indicators(data, offsets):
            w = np.concatenate([[0.0], np.cumsum(self.weights[feature])])
            s = np.concatenate([[0.0], np.cumsum(self.squares[feature])])
            norm = np.sqrt(np.maximum(s[upto[1:]] - s[upto[:-1]], 1e-12))
            margin = (w[upto[1:]] - w[upto[:-1]]) / norm + self.bias
            out[at:at + len(margin)] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))
        return out


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float, features: int,
                 rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss: one dual variable at a time is set to its best value."""
    weights, bias = np.zeros(features), 0.0
    alpha = np.zeros(len(rows))
    curve = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        steepest = 0.0
        for i in random.permutation(len(rows)):
            at, value = rows[i]
            slope = sign[i] * (float(weights[at] @ value) + bias) - 1.0
            new = min(max(alpha[i] - slope / curve[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weights[at] += step * value
                bias += step
                steepest = max(steepest, abs(step))
        if steepest < 1e-4:
            break
    return weights, bias


def _calibrated(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton's method, slightly smoothed."""
    if not len(good) or good.all() or not good.any():
        return 1.0, 0.0
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x, beta = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality", max_train: int = 6000, cost: float = 1.0, rounds: int = 12,
        seed: int = 7) -> QualityModel:
    """Learns from the labelled documents for which `train`, an expression on the id, holds.

    The log-count ratios come from all of them, counted by Spark; labels are joined by a sort-merge join
    at every size, as they grow with the documents. The support vector machine is fitted
    to `max_train` rows of them at most (those of least hash of the id, repeated ids and all; this bound is the memory and time
    of the fit, which runs in the driver), calibrated on every fifth. Labels other than 0 and 1
    and null ids are left out; a document with several labels counts once for each. If a class has no
    example, every score is the share of the other.
    """
    bounded_batches(docs.sparkSession)
    labelled = (labels.where(F.col(label_column).isin(0, 1))
                .select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("__label")))
    texts = docs.select(F.col(id_column).alias(id_column), F.coalesce(text_column, F.lit("")).alias("__text")).where(train)
    joined = lambda side: texts.join(side, texts[id_column] == F.col("__id"))
    counts, classes = class_counts(joined(labelled.hint("merge")), "__text", "__label")
    if not classes.all():
        known = max(classes.sum(), 1)
        share = min(max(classes[1] / known, 1e-6), 1 - 1e-6) if classes.sum() else 0.5
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = (counts[1] + 1.0) / (classes[1] + 2.0), (counts[0] + 1.0) / (classes[0] + 2.0)
    ratio = np.log(p / q)
    ratio[counts.sum(axis=0) == 0] = 0.0
    chosen = (labels.where(F.col(label_column).isin(0, 1)).where(train)
              .select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("__label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_train))
    sample = (joined(F.broadcast(chosen)).orderBy(F.xxhash64("__id"), "__id", "__label", F.xxhash64("__text"))
              .limit(max_train).select("__text", "__label", id_column).toArrow().combine_chunks())  # ids may repeat
    sample = sample.sort_by([(id_column, "ascending"), ("__label", "ascending"), ("__text", "ascending")])
    rows = []
    for _, part in text_slices(sample.to_batches()[0], "__text"):
        for _, upto, feature in indicators(*raw_bytes(part)):
            for a, b in zip(upto[:-1], upto[1:], strict=True):
                at = feature[a:b].astype(np.int32)
                value = ratio[at]
                rows.append((at, (value / max(np.sqrt(value @ value), 1e-6)).astype(np.float32)))
    good = sample["__label"].to_numpy() == 1
    sign = np.where(good, 1.0, -1.0)
    fitted = np.arange(len(rows)) % 5 != 0
    if good[fitted].all() or not good[fitted].any():
        fitted[:] = True
    pick = np.flatnonzero(fitted)
    weights, bias = dual_descent([rows[i] for i in pick], sign[pick], cost, FEATURES, rounds, seed)
    aside = np.flatnonzero(~fitted) if not fitted.all() else pick
    margin = np.array([float(weights[rows[i][0]] @ rows[i][1]) + bias for i in aside])
    slope, shift = _calibrated(margin, good[aside])
    return QualityModel(weights * ratio, ratio ** 2, bias, slope, shift)


def score(docs: DataFrame, model: QualityModel, *, text_column: str = "text",
          carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, `score` (0 to 1, the probability of label 1) and `predicted` (1 from 0.5 on).

    Whole texts are scored by their bytes alone; null counts as empty, and an empty text gets the
    score of the model's bias. Repeated rows stay; an empty table gives no rows; a carried column named
    `score` or `predicted` is left out.
    """
    bounded_batches(docs.sparkSession)
    made = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])
    kept = carried(docs, carry, made)
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = free_name(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, own):
                scores = sent.value.scores(*raw_bytes(texts))
                yield made_batch(rows, names, {"score": pa.array(scores),
                                               "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    return docs.select(*[docs[n] for n in names], docs[text_column].alias(own)).mapInArrow(
        run, T.StructType(kept + made.fields))
