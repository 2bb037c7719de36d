"""Quality classifier: a support vector machine over n-gram indicators scaled by naive-Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from repo_signals.llm.fit import by_id, labelled_sample, lists_of
from repo_signals.llm.text import FOLDED_CODE, chunks, id_and_text, python_ready, span_hashes, window_hashes, words

# Labelled documents of each class the model is fitted on.
FIT_PER_CLASS = 2500
BUCKET_BITS = 18
KEEP_FROM = 0.3

U32 = np.uint32


def bucket(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * U32(0x9E3779B1)) >> U32(32 - BUCKET_BITS)


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each row.

    Byte trigrams and four-grams as written, folded word bigrams, and five-grams
    over whether a word repeats the one before it.
    """
    b = np.zeros(len(data) + 3, U32)
    b[:-3] = data
    three = b[:-3] | b[1:-2] << U32(8) | b[2:-1] << U32(16)
    four = three | b[3:] << U32(24)
    grams = bucket(three ^ U32(0xA5000000)), bucket(four)
    found = words(data, offsets)
    hashes = span_hashes(data, found.start, found.end, FOLDED_CODE)
    pairs = bucket((window_hashes(hashes, 2) >> np.uint64(32)).astype(U32))
    same = (hashes[1:] == hashes[:-1]).astype(U32)
    echoes = np.zeros(max(0, len(same) - 4), U32)
    for k in range(5):
        echoes |= same[k : k + len(echoes)] << U32(k)
    echoes = bucket(echoes ^ U32(0x3C000000))
    mark = np.empty(1 << BUCKET_BITS, np.int32)
    for row in range(len(offsets) - 1):
        low, high = offsets[row], offsets[row + 1]
        ids = np.concatenate(
            [
                grams[0][low : max(low, high - 2)],
                grams[1][low : max(low, high - 3)],
                pairs[found.first[row] : max(found.first[row], found.first[row + 1] - 1)],
                echoes[found.first[row] : max(found.first[row], found.first[row + 1] - 5)],
            ]
        )
        # Of equal ids the last writer's mark stands, so one of them finds its own.
        own = np.arange(len(ids), dtype=np.int32)
        mark[ids] = own
        yield ids[mark[ids] == own]


@dataclass(frozen=True)
class LinearModel:
    """A margin per document, from unit vectors of scaled indicators, and its calibration to a probability."""

    ratio: np.ndarray
    weight: np.ndarray  # already times the ratio
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        r = self.ratio[ids]
        norm = float(np.sqrt((r * r).sum()))
        return float(self.weight[ids].sum()) / norm + self.bias if norm else self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_count_ratios(docs: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """For each bucket the log of its share among the indicators of class 1 over that of class 0."""
    shares = []
    for wanted in (1, 0):
        count = np.full(1 << BUCKET_BITS, smooth)
        for ids, label in zip(docs, y):
            if label == wanted:
                count[ids] += 1
        shares.append(np.log(count / count.sum()))
    return (shares[0] - shares[1]).astype(np.float32)


def dual_coordinate_descent(
    docs: list[np.ndarray], y: np.ndarray, cost: np.ndarray, ratio: np.ndarray, rounds: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss machine; one dual variable per document, boxed by its cost, is solved at a time."""
    w, bias = np.zeros(len(ratio), np.float32), 0.0
    # Unit vectors are made anew each time; holding them would double the memory of the sample.
    length = np.array([float(np.sqrt((ratio[ids] ** 2).sum())) or 1.0 for ids in docs])
    square = np.array([float((ratio[ids] ** 2).sum()) for ids in docs]) / length**2 + 1
    alpha, sign = np.zeros(len(docs)), 2.0 * y - 1
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(docs)):
            ids = docs[i]
            v = ratio[ids] / np.float32(length[i])
            gradient = sign[i] * (float(w[ids] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[ids] += np.float32(step) * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins of documents left out of the fit, by Newton's method."""
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    # Targets a little inside 0 and 1 keep the curve finite where the classes do not overlap.
    ones, zeros = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * (beta - [1.0, 0.0])
        hessian = (design.T * (weight * p * (1 - p))) @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit_linear(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, cost: float = 2.0, keep_mean: float = 0.25) -> LinearModel:
    """Fit on four fifths, calibrate on the rest, which stands for the true class sizes through ``weight``."""
    fold = np.arange(len(docs)) % 5 == 0
    own, left_out = np.flatnonzero(~fold), np.flatnonzero(fold)
    ratio = log_count_ratios([docs[i] for i in own], y[own])
    share = {c: len(own) / 2 / max(1, (y[own] == c).sum()) for c in (0, 1)}
    costs = cost * np.array([share[c] for c in y[own]])
    w, bias = dual_coordinate_descent([docs[i] for i in own], y[own], costs, ratio)
    # Between naive Bayes and the machine, as the ratios carry rare n-grams better.
    w = (1 - keep_mean) * w + keep_mean * np.abs(w).mean() * np.sign(ratio)
    model = LinearModel(ratio, (w * ratio).astype(np.float32), bias)
    margins = np.array([model.margin(docs[i]) for i in left_out])
    slope, shift = calibrate(margins, y[left_out], weight[left_out])
    return LinearModel(model.ratio, model.weight, bias, slope, shift)


def fit_quality_model(
    docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", per_class: int = FIT_PER_CLASS
) -> LinearModel | None:
    """The model for P(label = 1), or None where the labels do not hold both classes.

    Fitted on at most ``per_class`` labelled documents of each class among the
    label rows that satisfy ``where``; texts become hashed indicators before they
    leave their tasks.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                ids = [np.sort(x).astype(np.int32) for x in indicators(data, offsets)]
                y = pc.equal(batch.column("label").slice(low, high - low), 1).cast(pa.int32())
                doc = batch.column("doc_id").slice(low, high - low)
                w = batch.column("weight").slice(low, high - low)
                yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32())), y, w], ["doc_id", "ids", "y", "w"])

    known = labels if where is None else labels.where(where)
    rows = (
        labelled_sample(docs, known, label, per_class)
        .mapInArrow(hashed, "doc_id long, ids array<int>, y int, w double")
        .toArrow()
    )
    order = by_id(rows)
    y = rows["y"].to_numpy()[order]
    if len(set(y.tolist())) < 2:
        return None
    model = fit_linear([ids for (ids,) in lists_of(rows, "ids")], y, rows["w"].to_numpy()[order])
    # The sample is the largest thing on the driver; its memory goes back before the next step.
    del rows
    pa.default_memory_pool().release_unused()
    return model


def score_of(docs: DataFrame, model: LinearModel | None) -> Column:
    """P(label = 1) of the column ``text``; only the texts go to Python, the other columns stay where they are."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^18 numbers

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        fitted, out = shared.value, [np.zeros(0)]
        for low, high, data, offsets in chunks(text):
            if fitted is None:
                out.append(np.full(high - low, 0.5))
            else:
                out.append(fitted.probability(np.array([fitted.margin(ids) for ids in indicators(data, offsets)])))
        return pa.array(np.concatenate(out))

    return score(F.col("text").cast("string"))


def quality_scores(docs: DataFrame, model: LinearModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id, score, predicted`` for every row: P(label = 1) in 0 to 1, and 1 where it is ``keep_from`` or more.

    Null text counts as empty; an empty text has the score of the model's bias.
    Without a model every score is 0.5. One row per input row; only ``doc_id``
    and ``text`` are read; an empty table gives an empty result.
    """
    scored = id_and_text(docs).select("doc_id", score_of(docs, model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, model: LinearModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose score is ``keep_from`` or more, with all their columns."""
    return docs.where(score_of(docs, model) >= keep_from)
