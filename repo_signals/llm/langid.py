"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from repo_signals.llm.fit import by_id, labelled_sample, lists_of
from repo_signals.llm.text import chunks, id_and_text

# Documents of each language the model is fitted on.
FIT_PER_LANGUAGE = 1200
BUCKET_BITS = 15
DIMENSIONS = 12
UNKNOWN = "und"

U32 = np.uint32

# Letters of the ASCII range in lower case, bytes of other characters as they are, all else a blank.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams and four-grams of all rows, and the offset of each row's.

    Each row is framed by blanks, so n-grams also say where words begin and end.
    Windows with a blank inside, which would span two words, are left out.
    """
    n = len(offsets) - 1
    framed = np.full(len(data) + 5 * n + 4, 0x20, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(data)) + 5 * rows + 1] = FOLD[data]
    b = framed.astype(U32)
    size = len(framed) - 4
    blank = framed == 0x20
    three = b[:size] | b[1 : size + 1] << U32(8) | b[2 : size + 2] << U32(16)
    four = three | b[3 : size + 3] << U32(24)
    with np.errstate(over="ignore"):
        ids = np.stack([(x * U32(0x9E3779B1)) >> U32(32 - BUCKET_BITS) for x in (three ^ U32(0x5C000000), four)], axis=1)
    inner = ~blank[1 : size + 1]
    keep = np.stack([inner, inner & ~blank[2 : size + 2]], axis=1)
    starts = offsets + 5 * np.arange(n + 1)
    total = np.zeros(size + 1, np.int64)
    np.cumsum(keep.sum(axis=1), out=total[1:])
    return ids[keep].astype(np.int32), total[np.minimum(starts, size)]


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script; only rows without ASCII letters are decoded."""
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum((FOLD[data] != 0x20) & (data < 0x80), out=ascii_letter[1:])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for row in np.flatnonzero(~out):
        body = data[offsets[row] : offsets[row + 1]]
        out[row] = bool((body >= 0x80).any()) and any(map(str.isalpha, body.tobytes().decode("utf-8", "replace")))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Embeddings times softmax weights, one row per bucket: a document's logits are the mean of its rows."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    sharpness: float = 1.0
    accept_from: float = 0.0

    def probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        logits = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            logits[some] = np.add.reduceat(self.table[ids], at[some], axis=0)
        logits = logits / np.maximum(n, 1)[:, None] + self.bias
        return softmax(self.sharpness * logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_language_model(
    docs: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    languages: list[str],
    rounds: int = 6,
    rate: float = 0.5,
    seed: int = 11,
) -> LanguageModel:
    """Fitted on the distinct subwords of each document and their counts.

    Stochastic gradient descent over documents, one fifth of which is left out to calibrate.

    The sharpness makes the stated probabilities of the left-out documents as
    likely as possible; a prediction below ``accept_from``, the score that all
    but one in a hundred of their right answers reach, counts as rejected.
    """
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    own = np.flatnonzero((np.arange(len(docs)) % 5 != 0) & np.array([len(d[0]) > 0 for d in docs], bool))
    steps, done = rounds * max(1, len(own)), 0
    for _ in range(rounds):
        for i in rng.permutation(own):
            at, count = docs[i]
            share = (count / count.sum()).astype(np.float32)
            hidden = share @ embed[at]
            p = softmax(hidden @ weight + bias)
            p[y[i]] -= 1
            now = np.float32(rate * (1 - done / steps))
            back = weight @ p
            weight -= now * np.outer(hidden, p)
            bias -= now * p * np.float32(0.1)
            # Mean gradients are tiny per row; scaling by the number of rows keeps the steps of embeddings and weights alike.
            embed[at] -= (now * np.minimum(share * len(at), 4))[:, None] * back
            done += 1
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias)
    held = np.flatnonzero((np.arange(len(docs)) % 5 == 0) & np.array([len(d[0]) > 0 for d in docs], bool))
    if not len(held):
        return model
    logits = np.array([(docs[i][1] / docs[i][1].sum()) @ model.table[docs[i][0]] + bias for i in held])
    grid = 2.0 ** np.arange(-3, 6.1, 0.25)
    loss = [-np.log(softmax(s * logits)[np.arange(len(held)), y[held]] + 1e-12).mean() + 1e-4 * np.log(s) ** 2 for s in grid]
    sharp = float(grid[int(np.argmin(loss))])
    p = softmax(sharp * logits)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return LanguageModel(languages, model.table, bias, sharp, float(np.quantile(right, 0.01)) if len(right) else 0.0)


def train_langid(docs: DataFrame, where: Column | None = None, per_language: int = FIT_PER_LANGUAGE) -> LanguageModel | None:
    """The model, learned from text and non-null ``lang`` of rows that satisfy ``where``; None if there are none.

    Fitted on at most ``per_language`` documents of each language; whole texts
    become hashed subwords before they leave their tasks.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                ids, at = subwords(data, offsets)
                doc, label = (batch.column(c).slice(low, high - low) for c in ("doc_id", "label"))
                distinct = [np.unique(ids[a:b], return_counts=True) for a, b in zip(at, at[1:])]
                lists = [pa.array([x[k].astype(np.int32) for x in distinct], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([doc, *lists, label], ["doc_id", "ids", "counts", "label"])

    known = docs if where is None else docs.where(where)
    rows = (
        labelled_sample(known, None, "lang", per_language)
        .mapInArrow(hashed, "doc_id long, ids array<int>, counts array<int>, label string")
        .toArrow()
    )
    languages = sorted(set(rows["label"].to_pylist()))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in rows["label"].to_pylist()])[by_id(rows)]
    return fit_language_model(lists_of(rows, "ids", "counts"), y, languages)


def identify_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row; only ``text`` decides.

    ``score`` is the calibrated probability of the predicted language;
    ``rejected`` marks predictions the calibration does not trust. Text that is
    null or has no letters, and any text where nothing was learned, gives
    ``und`` with score 0, rejected. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 rows of one number per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                known = has_letters(data, offsets) & (fitted is not None)
                names, score = np.full(high - low, UNKNOWN, object), np.zeros(high - low)
                if known.any():
                    p = fitted.probabilities(*subwords(data, offsets))
                    names[known] = np.array(fitted.languages, object)[p.argmax(axis=1)[known]]
                    score[known] = p.max(axis=1)[known]
                rejected = ~known | (score < (fitted.accept_from if fitted else 0))
                doc = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return id_and_text(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
