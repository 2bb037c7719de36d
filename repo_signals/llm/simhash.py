"""Near duplicates by SimHash: Hamming neighbours found through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals.llm.components import connected_components
from repo_signals.llm.importance import LOWER
from repo_signals.llm.text import U64, chunks, id_and_text, mix, python_ready, spaced, words
from repo_signals.session import materialize

WIDTH = 3
DISTANCE = 3
SEED = 42
BITS = 64

# Fingerprints that are compared with each other in one task; a larger group is divided further.
CROWD = 1024
# Rows of small groups taken together, and pairs looked at in one go.
BLOCK_ROWS = 1 << 16
BLOCK_PAIRS = 1 << 21
SHINGLES_HELD = 1 << 15
# The reference from which the chains start.
ORIGIN = U64(0x9E3779B97F4A7C15)

# --- fixed values: the multipliers of XXH64 ------------------------------------------------------

P1, P2, P3, P4, P5 = (
    U64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << U64(by) | x >> U64(64 - by)


def xxh64_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each span of bytes; all spans that still have a stripe, word or byte take it together."""
    size = end - start
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    at = start.copy()
    with np.errstate(over="ignore"):
        begin = [U64(seed) + P1 + P2, U64(seed) + P2, U64(seed), U64(seed) - P1]
        h = np.full(len(at), U64(seed) + P5, U64)
        own = np.flatnonzero(size >= 32)
        if len(own):
            lanes = np.repeat(np.array(begin, U64)[:, None], len(own), axis=1)
            for step in range(int(size.max()) // 32):
                on = np.flatnonzero(size[own] // 32 > step)
                for k in range(4):
                    read = eight[at[own[on]] + 8 * k]
                    lanes[k, on] = turned(lanes[k, on] + read * P2, 31) * P1
                at[own[on]] += 32
            joined = sum(turned(lanes[k], by) for k, by in enumerate((1, 7, 12, 18)))
            for k in range(4):
                joined = (joined ^ turned(lanes[k] * P2, 31) * P1) * P1 + P4
            h[own] = joined
        h += size.astype(U64)
        for step in range(3):
            on = np.flatnonzero(size % 32 // 8 > step)
            h[on] = turned(h[on] ^ turned(eight[at[on]] * P2, 31) * P1, 27) * P1 + P4
            at[on] += 8
        on = np.flatnonzero(size % 8 >= 4)
        h[on] = turned(h[on] ^ four[at[on]].astype(U64) * P1, 23) * P2 + P3
        at[on] += 4
        for step in range(3):
            on = np.flatnonzero(size % 4 > step)
            h[on] = turned(h[on] ^ data[at[on]].astype(U64) * P5, 11) * P1
            at[on] += 1
        h = (h ^ h >> U64(33)) * P2
        h = (h ^ h >> U64(29)) * P3
    return h ^ h >> U64(32)


def majorities(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The bits that are set in over half the hashes of each row, as one number; 0 for rows without any."""
    ones, n = np.zeros((rows, BITS), np.int64), np.bincount(row, minlength=rows)
    for low in range(0, len(hashes), SHINGLES_HELD):
        part = hashes[low : low + SHINGLES_HELD].astype("<u8").view(np.uint8).reshape(-1, 8)
        of = row[low : low + SHINGLES_HELD]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bits = np.unpackbits(part, axis=1, bitorder="little")
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8").astype(U64)


def simhashes(column: pa.Array, width: int = WIDTH, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows: first row, row after the last, fingerprints.

    Words are lower-cased in A-Z. A text with fewer than ``width`` words has its
    whole sequence as one shingle.
    """
    for low, high, data, offsets in chunks(column):
        found = words(data, offsets)
        body, start, end = spaced(LOWER[data], found)
        row, n = found.row, np.diff(found.first)
        # The last word of every shingle; short texts have one, with all their words.
        place = np.arange(len(row)) - found.first[row]
        last = np.flatnonzero((place >= width - 1) | ((n[row] < width) & (place == n[row] - 1)))
        first = np.maximum(last - width + 1, found.first[row[last]])
        yield low, high, majorities(xxh64_spans(body, start[first], end[last], seed), row[last], high - low)


def fingerprints(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """``doc_id, node``: the fingerprint of every row as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in simhashes(batch.column(1), width, seed):
                ids = batch.column(0).slice(low, high - low)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], ["doc_id", "node"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, node long")


# --- pivot distance tables ----------------------------------------------------------------------


def references(bits: np.ndarray) -> np.ndarray:
    """A chain of reference fingerprints: each flips one more of the given bits of ``ORIGIN``."""
    return ORIGIN ^ np.append(U64(0), np.bitwise_or.accumulate(U64(1) << bits.astype(U64)))


def distance_table(nodes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(nodes[:, None] ^ pivots)


@lru_cache(1 << 16)
def chain_of(path: int, stretches: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bits in play after the stretches chosen so far, in the order in which the next chain flips them, and its stretches.

    ``path`` holds one digit per choice behind a leading 1, so it is the same for every task.
    """
    bits = np.arange(BITS)
    if path >= BITS:
        before, digit = divmod(path, BITS)
        bits, parts = chain_of(before, stretches)
        bits = np.delete(bits, parts[digit])
    return bits, np.array_split(np.arange(len(bits)), stretches)


# One pseudo-random factor per step of a chain.
STEPS = mix(np.arange(1, BITS + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def meeting_keys(nodes: np.ndarray, keys: np.ndarray, path: int, stretches: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of a chain and each fingerprint the longer path and a key of the distances' course along it.

    The key takes in the one under which the fingerprint met others so far.

    From one reference to the next a distance moves by one, and the distances of
    two fingerprints move apart only at a bit in which they differ. Two with
    fewer differing bits than there are stretches therefore keep the same
    difference along one whole stretch: there their keys are equal.
    """
    bits, parts = chain_of(path, stretches)
    moves = np.diff(distance_table(nodes, references(bits)).astype(np.int64), axis=1).view(U64)
    first = np.array([x[0] if len(x) else 0 for x in parts])
    longer = path * BITS + np.arange(stretches)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(moves * STEPS[: len(bits)], first, axis=1)
        keys = mix(total + mix(longer.astype(U64)) + mix(keys)[:, None])
    return np.repeat(longer, len(nodes)), keys.T.reshape(-1)


def dealt(rows: DataFrame, stretches: int) -> DataFrame:
    """``(path, key, node)``: every fingerprint of a group once per stretch of its chain."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_numpy()
            keys, nodes = (batch.column(c).to_numpy().view(U64) for c in ("key", "node"))
            order = np.argsort(paths, kind="stable")
            each = np.split(order, np.flatnonzero(np.diff(paths[order])) + 1) if len(order) else []
            out = [(*meeting_keys(nodes[k], keys[k], int(paths[k[0]]), stretches), np.tile(nodes[k], stretches)) for k in each]
            columns = [np.concatenate(x).view(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["path", "key", "node"])

    return rows.mapInArrow(deal, "path long, key long, node long")


def close_pairs(nodes: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of neighbouring groups' members that differ in ``distance`` bits or fewer.

    A pair is discarded where its distances to the first reference differ by more
    than that, then where those to any reference do, and the survivors are verified.
    """
    table = distance_table(nodes, references(np.arange(BITS)))
    end = np.repeat(np.cumsum(sizes), sizes)
    at, found = np.arange(len(nodes)), []
    first = table[:, 0].astype(np.int16)
    for lag in range(1, int(sizes.max(initial=0))):
        at = at[at + lag < end[at]]
        some = at[np.abs(first[at] - first[at + lag]) <= distance]
        apart = np.abs(table[some].astype(np.int16) - table[some + lag]).max(axis=1, initial=0)
        some = some[apart <= distance]
        some = some[np.bitwise_count(nodes[some] ^ nodes[some + lag]) <= distance]
        found.append((some, some + lag))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(side) for side in zip(*found))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that links lead to, for each of ``n``: fewer than ``n`` links tell the same as all."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def group_links(groups: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: what joins the linked fingerprints within each group of equal ``key``, at most one row per member."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, nodes = (np.append(x, batch.column(c).to_numpy()) for x, c in ((keys, "key"), (nodes, "node")))
            if len(keys) >= BLOCK_ROWS:
                whole = int(np.searchsorted(keys, keys[-1]))
                yield from linked(keys[:whole], nodes[:whole])
                keys, nodes = keys[whole:], nodes[whole:]
        yield from linked(keys, nodes)

    def linked(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.append(first, len(keys)))
        several = np.repeat(sizes > 1, sizes)
        nodes, sizes = nodes[several], sizes[sizes > 1]
        # Blocks of groups with a bounded number of pairs.
        block = np.cumsum(sizes * (sizes - 1) // 2) // BLOCK_PAIRS
        start = np.append(0, np.cumsum(sizes))
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for k, low in enumerate(edges):
            high = edges[k + 1] if k + 1 < len(edges) else len(sizes)
            part = nodes[start[low] : start[high]]
            root = forest(len(part), *close_pairs(part.view(U64), sizes[low:high], distance))
            own = np.flatnonzero(root != np.arange(len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array(part[root[own]])], ["a", "b"])

    return groups.select("key", "node").repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def hamming_links(nodes: DataFrame, distance: int = DISTANCE, crowd: int | None = None) -> DataFrame:
    """``(a, b)``: pairs of the distinct fingerprints ``node`` whose links join all that differ in ``distance`` bits or fewer.

    Every pair within the distance meets under the key of a stretch. Groups of
    more than ``crowd`` members are not compared: the bits of their stretch are
    equal, so the rest of the bits makes a new chain, which divides them further.
    As no fingerprint occurs twice, a group that is equal in all but ten bits has
    at most 1024 members, so this ends, and no group is cut short. Groups give
    fewer links than they have members, and a fingerprint is in ``stretches``
    groups, in as many again for each division where its group is large, and
    there are six divisions at most: whatever the size of a group, its rows are
    a bounded number per member and not one per pair.
    """
    # A chain needs a bit per stretch, and a group with fewer bits left has no more members than this.
    crowd, stretches = max(crowd or CROWD, 1 << distance), distance + 1
    python_ready(nodes.sparkSession)
    rows, links = nodes.select(F.lit(1).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), "node"), None
    while True:
        rows = materialize(dealt(rows, stretches), "dealt")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(sizes.where(F.col("n") > crowd).select("key"), "large")
        found = materialize(group_links(rows.join(large, "key", "left_anti"), distance), "links")
        links = found if links is None else links.union(found)
        if large.isEmpty():
            return links
        rows = rows.join(large, "key", "left_semi").select("path", "key", "node")


def simhash_groups(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in at most ``distance`` of 64 bits, directly or through others.

    A bit of a fingerprint is set if it is in over half of the XXH64 hashes
    (``seed``) of the text's ``width``-word shingles, repeats included; words are
    lower-cased in A-Z and joined by one space. A text with fewer words is one
    shingle; null, empty and blank texts have the fingerprint zero and link like
    any other. Returns one row per input row: ``doc_id, fingerprint`` (16
    hexadecimal digits), ``component_id``: the smallest ``doc_id`` reachable, its
    own included. A null ``doc_id`` has no say in it; it is null where all ids of
    a group are. Only ``doc_id`` and ``text`` are read; an empty table gives an
    empty result.

    Documents with one fingerprint are one node, so copies cost nothing further.
    """
    known = materialize(fingerprints(docs, width, seed), "fingerprints")
    nodes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("doc")), "nodes")
    links = hamming_links(nodes, distance)
    components = materialize(connected_components(links), "components")
    named = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = materialize(named.join(smallest, "component").select("node", "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return known.join(named, "node").select("doc_id", digits.alias("fingerprint"), "component_id")
