"""Quality rules: document statistics judged by gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from repo_signals.llm.fit import labelled_sample
from repo_signals.llm.text import (
    IS_SPACE,
    U64,
    chunks,
    id_and_text,
    mix,
    row_sums,
    span_hashes,
    window_hashes,
    words,
)

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Labelled documents of each class the trees are fitted on.
FIT_PER_CLASS = 4000
KEEP_FROM = 0.3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Features of the trees, and +1 / -1 where the verdict may only rise / fall with them.
FEATURES = {
    "log_words": 0,
    "chars_per_word": 0,
    "symbols_per_char": -1,
    "dup_lines_per_line": -1,
    "repeat_words_per_word": -1,
    "upper_per_char": 0,
    "digits_per_char": 0,
    "marks_per_word": 0,
    "bare_marks_per_word": -1,
    "distinct_per_word": 0,
    "words_per_line": 0,
    "longest_word": 0,
}

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[0x41:0x5B] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[0x30:0x3A] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def first_of_kind(keys: np.ndarray) -> np.ndarray:
    """Marks one of each kind of key."""
    order = np.argsort(keys)
    out = np.ones(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = False
    return out


def line_counts(body: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen, n, again = set(), 0, 0
    for line in body.split(b"\n"):
        if line and not line.isspace():
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the features of the trees, one row per document."""
    found = words(data, offsets)
    row, first = found.row, found.first
    n = np.diff(first)
    # Bytes of a document that are not the first of a character start with the bits 10.
    text_chars = row_sums(~IS_SPACE[data] & (data & 0xC0 != 0x80), offsets)
    symbols = row_sums(IS_SYMBOL[data], offsets)
    lines = np.array([line_counts(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], np.int64).reshape(-1, 2)
    hashes = span_hashes(data, found.start, found.end)
    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, len(n) + 1, dtype=U64))
        covered = np.zeros(len(hashes), bool)
        if len(hashes) > 2:
            whole = np.flatnonzero(row[2:] == row[:-2])
            twice = whole[repeated(window_hashes(hashes, 3)[whole] + salt[row[whole]])]
            for k in range(3):
                covered[twice + k] = True
        distinct = row_sums(first_of_kind(hashes + salt[row]), first)
    repeats = row_sums(covered, first)
    has_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_LETTER[data], out=has_letter[1:])
    bare = row_sums(has_letter[found.end] == has_letter[found.start], first)
    marks = row_sums(~IS_LETTER[data] & ~IS_SPACE[data] & ~IS_DIGIT[data], offsets)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, row, found.end - found.start)
    counts = np.stack([n, text_chars, symbols, lines[:, 1], repeats], axis=1)
    per_char, per_word = np.maximum(text_chars, 1), np.maximum(n, 1)
    features = np.stack(
        [
            np.log1p(n),
            text_chars / per_word,
            symbols / per_char,
            lines[:, 1] / np.maximum(lines[:, 0], 1),
            repeats / per_word,
            row_sums(IS_UPPER[data], offsets) / per_char,
            row_sums(IS_DIGIT[data], offsets) / per_char,
            marks / per_word,
            bare / per_word,
            distinct / per_word,
            n / np.maximum(lines[:, 0], 1),
            np.log1p(longest),
        ],
        axis=1,
    )
    return counts, features


@dataclass(frozen=True)
class Forest:
    """Boosted trees in flat arrays: an inner node sends rows at or under its threshold to ``left``, others to ``left + 1``.

    Leaves have feature -1 and point at themselves.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(feature < 0, at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    monotone: list[int],
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    least: float = 1.0,
) -> Forest:
    """Second-order boosting of the logistic loss over quantile bins.

    A split on a constrained feature must order its children's values; the mean
    of the two then bounds everything below them, so the order holds for the
    whole tree and, as a sum of trees, for the whole forest.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    weight = weight / weight.mean()
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        value.append(0.0)
        return len(feature) - 1

    def best_split(rows, grad, hess, low, high):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
            vl = np.clip(-gl / (hl + penalty), low, high)
            vr = np.clip(-(g - gl) / (h - hl + penalty), low, high)
            gain = -(gl * vl + 0.5 * (hl + penalty) * vl**2) - ((g - gl) * vr + 0.5 * (h - hl + penalty) * vr**2)
            v = np.clip(-g / (h + penalty), low, high)
            gain += g * v + 0.5 * (h + penalty) * v**2
            allowed = (hl >= least) & (h - hl >= least) & (monotone[f] * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
        return best[1]

    def grow(at, rows, grad, hess, low, high, levels):
        found = best_split(rows, grad, hess, low, high) if levels else None
        if found is None:
            v = -grad[rows].sum() / (hess[rows].sum() + penalty)
            value[at] = rate * float(np.clip(v, low, high))
            left[at] = at
            score[rows] += value[at]
            return
        f, k, vl, vr = found
        a, b = node(), node()
        feature[at], threshold[at], left[at] = f, float(edges[f][k]), a
        goes_right = binned[rows, f] > k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}
        for child, part, limit in zip((a, b), (rows[~goes_right], rows[goes_right]), bounds[monotone[f]]):
            grow(child, part, grad, hess, *limit, levels - 1)

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(node())
        grow(roots[-1], everything, weight * (p - y), weight * p * (1 - p), -4.0, 4.0, depth)
    arrays = [np.array(a) for a in (feature, threshold, left, value, roots)]
    return Forest(*arrays, base, depth)


def fit_quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = FIT_PER_CLASS):
    """The forest for P(label = 1), or None where the labels do not hold both classes.

    Fitted on at most ``per_class`` labelled documents of each class; whole
    texts are reduced to a row of statistics before they leave their tasks.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                x = statistics(data, offsets)[1]
                y = pc.equal(batch.column("label").slice(low, high - low), 1).cast(pa.float64())
                w = batch.column("weight").slice(low, high - low)
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64())), y, w], ["doc_id", "x", "y", "w"])

    sample = labelled_sample(docs, labels, label, per_class)
    rows = sample.mapInArrow(measure, "doc_id long, x array<double>, y double, w double").toPandas().sort_values("doc_id")
    if rows["y"].nunique() < 2:
        return None
    x = np.array(rows["x"].tolist())
    return fit_forest(x, rows["y"].to_numpy(), rows["w"].to_numpy(), list(FEATURES.values()))


def quality_rules(docs: DataFrame, forest: Forest | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts and verdict for every document.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score``: the base rule fails texts with fewer than 50
    words or with more than half of them in repeated 3-word windows; others stay
    if the forest gives ``keep_from`` or more. Null text has no words and fails.
    Without a forest the base rule alone decides and ``score`` is null. One row
    per input row; only ``doc_id`` and ``text`` are read; an empty table gives
    an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                counts, x = statistics(data, offsets)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                score = None if forest is None else forest.probability(x)
                kept = ~failed if score is None else ~failed & (score >= keep_from)
                scores = pa.nulls(len(kept), pa.float64()) if score is None else pa.array(score)
                columns = [batch.column(0).slice(low, high - low), *map(pa.array, counts.T), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*columns, scores], names)

    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]
    ddl = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, score double"])
    return id_and_text(docs).mapInArrow(judge, ddl)
