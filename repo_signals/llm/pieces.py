"""SentencePiece encoding and decoding: the best segmentation of whole texts, by batched Viterbi in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from repo_signals.llm.text import U64, chunks, id_and_text, mix, powers

BLANK = 0x2581  # the character that stands for a blank in pieces
CHUNK_BYTES = 1 << 21
# Positions times words for which piece scores are held at once.
CELLS = 1 << 15
FILTER_BITS = 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def char_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running totals from which every stretch's hash follows, and the factors that make it independent of its place."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(codes.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return total, down


class Pieces:
    """Sorted hashes of a model's pieces with their scores and identifiers."""

    def __init__(self, path: str, ranked: bool):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        spelled = [model.id_to_piece(i) for i in plain]
        self.longest = max(map(len, spelled))
        keys = []
        for piece in spelled:
            total, _ = char_hashes(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
            keys.append(total[-1])
        order = np.argsort(np.array(keys, U64))
        self.keys = np.array(keys, U64)[order]
        self.ids = np.array(plain, np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        if ranked:
            # A merge model numbers its pieces by frequency, from 0 down; by Zipf's law the n-th has a share of about 1 / n.
            self.scores = -np.log(1 - self.scores)
        # A character that no piece covers costs more than any piece and is spelled in bytes.
        self.unknown = float(self.scores.min()) - 10
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.keys >> U64(64 - FILTER_BITS)] = True
        self.spelled = [b""] * len(ids)
        for i, piece in zip(plain, spelled):
            self.spelled[i] = piece.encode()
        for byte, i in self.byte_id.items():
            self.spelled[i] = bytes([byte])

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and identifier of the piece with each hash; minus infinity and -1 where there is none."""
        score, found = np.full(hashes.shape, -np.inf), np.full(hashes.shape, -1, np.int32)
        open_ = np.flatnonzero(self.maybe[hashes >> U64(64 - FILTER_BITS)].ravel())
        asked = hashes.ravel()[open_]
        place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[place] == asked
        score.ravel()[open_[hit]] = self.scores[place[hit]]
        found.ravel()[open_[hit]] = self.ids[place[hit]]
        return score, found


@lru_cache(maxsize=2)
def pieces(path: str, ranked: bool) -> Pieces:
    return Pieces(path, ranked)


def best_cuts(table: Pieces, total: np.ndarray, down: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of words of one length, all advanced together.

    Returns the identifiers of all words' pieces behind each other (-1 minus the
    character's place for characters without a piece) and their number per word.
    Of equally good segmentations the one with the longest last piece wins.
    """
    n, widest = len(start), min(table.longest, length)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    width = np.zeros((n, length + 1), np.int64)
    chosen = np.zeros((n, length + 1), np.int64)
    widths = np.arange(widest, 0, -1)
    rows = np.arange(n)
    step = max(1, CELLS // max(1, n))
    for low in range(0, length, step):
        ends = np.arange(low + 1, min(low + step, length) + 1)
        begins = ends[:, None] - widths
        valid = begins >= 0
        at = start[:, None, None] + np.maximum(begins, 0)
        with np.errstate(over="ignore"):
            hashes = (total[start[:, None] + ends][:, :, None] - total[at]) * down[at]
        score, found = table.probe(hashes)
        score[:, ~valid] = -np.inf
        single = score[:, :, -1] == -np.inf
        score[:, :, -1][single] = table.unknown
        for k, end in enumerate(ends.tolist()):
            reach = best[:, np.maximum(begins[k], 0)] + score[:, k]
            pick = reach.argmax(axis=1)
            best[:, end] = reach[rows, pick]
            width[:, end] = widths[pick]
            ids = found[rows, k, pick]
            chosen[:, end] = np.where(ids >= 0, ids, -1 - (start + end - 1))
    on_path = np.zeros((n, length + 1), bool)
    on_path[:, length] = True
    for end in range(length, 0, -1):
        here = np.flatnonzero(on_path[:, end])
        on_path[here, end - width[here, end]] = True
    used = on_path[:, 1:]
    return chosen[:, 1:][used], used.sum(axis=1)


def encode_rows(table: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Piece identifiers of each text."""
    codes = [np.frombuffer((" " + t if t else "").encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    row_at = np.append(0, np.cumsum(sizes))
    every = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    if not len(every):
        return [np.zeros(0, np.int32) for _ in texts]
    every = np.where(every == 0x20, np.uint32(BLANK), every)
    # No piece has a blank after another character, so a segmentation always cuts there.
    blank = every == BLANK
    begins = blank & ~np.append(False, blank[:-1])
    begins[row_at[:-1][sizes > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(every))
    total, down = char_hashes(every)
    with np.errstate(over="ignore"):
        names = (total[end] - total[start]) * down[start]
    _, sample, which = np.unique(names, return_index=True, return_inverse=True)
    lengths = (end - start)[sample]
    order = np.argsort(lengths, kind="stable")
    parts, counts = [], np.zeros(len(sample), np.int64)
    for low, high in stretches(lengths[order]):
        mine = order[low:high]
        length = int(lengths[mine[0]])
        group = max(1, (8 * CELLS) // length)
        for k in range(0, len(mine), group):
            some = mine[k : k + group]
            ids, n = best_cuts(table, total, down, start[sample[some]], length)
            parts.append(ids)
            counts[some] = n
    flat = np.concatenate(parts)
    place = np.zeros(len(sample), np.int64)
    place[order] = np.cumsum(counts[order]) - counts[order]
    n = counts[which]
    run = np.cumsum(n) - n
    ids = flat[np.repeat(place[which] - run, n) + np.arange(n.sum())]
    # Places in `flat` name characters of a word's first occurrence, which are the same everywhere.
    row_first = np.append(run, n.sum())[np.searchsorted(start, row_at)]
    if (ids < 0).any():
        ids, row_first = with_bytes(table, ids, row_first, every)
    ids = ids.astype(np.int32)
    return [ids[a:b] for a, b in zip(row_first, row_first[1:])]


def with_bytes(table: Pieces, ids: np.ndarray, row_first: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spell characters without a piece in bytes."""
    spelled = [[table.byte_id[b] for b in chr(every[-1 - i]).encode()] for i in ids[ids < 0].tolist()]
    times = np.ones(len(ids), np.int64)
    times[ids < 0] = [len(s) for s in spelled]
    out = np.repeat(ids, times)
    out[out < 0] = np.concatenate(spelled)
    moved = np.append(0, np.cumsum(times))
    return out, moved[row_first]


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return zip(cuts, cuts[1:])


def decode(table: Pieces, ids: list[int]) -> str:
    """The text of piece identifiers, without the blank that encoding puts before it."""
    body = b"".join([table.spelled[i] for i in ids]).decode("utf-8", "replace").replace(chr(BLANK), " ")
    return body[1:] if body[:1] == " " else body


def encode_pieces(docs: DataFrame, model: str | None = None, ranked: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids, ids_crc32, round_trip`` of every whole text.

    The segmentation with the greatest sum of piece scores, as a unigram model
    reads them: blanks become U+2581, one is put before a text that is not
    empty, characters without a piece are spelled in bytes. With ``ranked`` the
    model's scores are ranks, as in a merge model, and are turned into
    logarithms of frequencies; its merge order is not followed. ``round_trip`` tells whether
    decoding gives the text back, U+2581 counting as a blank. Null text counts
    as empty and has no pieces. One row per input row; only ``doc_id`` and
    ``text`` are read; an empty table gives an empty result.
    """
    path = model or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path, ranked)
        for batch in batches:
            for low, high, _, _ in chunks(batch.column(1), CHUNK_BYTES):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                ids = encode_rows(table, texts)
                back = [decode(table, x.tolist()) == t.replace(chr(BLANK), " ") for x, t in zip(ids, texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids))
                )
                crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                doc = batch.column(0).slice(low, high - low)
                yield pa.RecordBatch.from_arrays([doc, pa.array(sizes), lists, crc, pa.array(back, pa.bool_())], names)

    names = ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"]
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null identifiers give a null text."""
    path = model or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path, False)
        for batch in batches:
            texts = [None if ids is None else decode(table, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
