"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

The n-grams of all documents stand in one global order, their 64-bit hashes.
That order is cut into fragments of neighbouring n-grams, and every document
into the segments that fall into them. Fragments are worked on separately: they
count in how many documents each n-gram occurs, find the documents that share
one, and count the partial overlap of each candidate pair; a pair's overlap is
the sum over its fragments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log2
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.llm.bitmaps import BUCKET, bitmap_rows, bits_of, is_set, slot_bitmap
from repo_signals.llm.components import with_more_links
from repo_signals.llm.text import FOLDED_CODE, U64, chunks, id_and_text, mix, span_hashes, window_hashes, words
from repo_signals.operators.bitmap import asked_slots, is_asked
from repo_signals.session import materialize

WIDTH = 5
PERCENT = 80

# N-grams gathered before a task hands them to their fragments, and n-grams in a fragment.
FLUSH = 1 << 21
FRAGMENT_NGRAMS = 1 << 20
# Fragments a document's segments are cut into for counting a pair's overlap.
SEGMENTS = 4
# Slots of the table of frequent n-grams: a fixed size, so that what is broadcast does not grow with the corpus. Where
# two n-grams share a slot, the order is a little worse.
LEVEL_BITS = 22
# N-grams in fewer documents are not told apart by frequency.
FREQUENT = 8
# Bits of the smallest sketch, as a power of two.
SKETCH_BITS = 6
# So many nodes are sent to every task as they are.
SENT_WHOLE = 1 << 15
# A round of hubs that leaves more than this share of the possible pairs is the last.
LEFT_BY_A_ROUND = 0.75
# Pairs are no longer narrowed down by hubs once there are at most so many for each row of an n-gram, or of all prefixes.
PAIRS_PER_ROW = 4
# Stands for a missing identifier in joins.
NO_ID = -(1 << 63)


def ngram_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row.

    Words are lower-cased in A-Z. A text with fewer than ``width`` words has its
    whole sequence as one n-gram; a text without words has none.
    """
    for low, high, data, offsets in chunks(column):
        found = words(data, offsets)
        hashes = span_hashes(data, found.start, found.end, FOLDED_CODE)
        grams = window_hashes(hashes, width)
        for a, b in zip(found.first.tolist(), found.first[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield window_hashes(hashes[a:b], b - a) ^ U64(b - a)
            else:
                yield np.zeros(0, U64)


def node_of(grams: np.ndarray) -> int | None:
    """The 64-bit fingerprint of a set: the same for all documents with the same n-grams."""
    if not len(grams):
        return None
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams ^ U64(0x5851F42D4C957F2D)).sum() + U64(len(grams))], U64)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """A bit for each stretch of the global order in which the set has an n-gram: two to four stretches for each of its n-grams."""
    bits = max(SKETCH_BITS, (len(grams) - 1).bit_length() + 1)
    found = np.zeros(1 << bits, bool)
    found[grams >> U64(64 - bits)] = True
    return np.packbits(found).tobytes()


def most_shared(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """No fewer n-grams than two sets of ``n_x`` and ``n_y`` share: where only one has any in a stretch, one at least is its own."""
    if len(x) < len(y):
        x, n_x, y, n_y = y, n_y, x, n_x
    if len(x) > len(y):
        x = np.packbits(np.unpackbits(np.frombuffer(x, np.uint8)).reshape(8 * len(y), -1).any(axis=1)).tobytes()
    p, q = int.from_bytes(x), int.from_bytes(y)
    both = (p & q).bit_count()
    return min(n_x - p.bit_count(), n_y - q.bit_count()) + both


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, node`` of every row; rows without n-grams have no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(ngram_sets(batch.column(1), width))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, nodes], ["doc_id", "n_shingles", "node"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, node long")


def pieces_by(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal keys in a sorted array."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        if b > a:
            yield int(key[a]), slice(a, b)


def by_fragment(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Apply ``work(fragment, lists of blobs)`` to every fragment; the rows of one come together, one fragment at a time."""
    names = [c for c in rows.columns if c != "fragment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = batch.column("fragment").to_pylist()
            blobs = [batch.column(c).to_pylist() for c in names]
            for k, key in enumerate(keys):
                if key != at and held:
                    yield from work(at, held)
                    held = []
                at = key
                held.append([b[k] for b in blobs])
        if held:
            yield from work(at, held)

    return rows.repartition("fragment").sortWithinPartitions("fragment").mapInArrow(run, schema)


def joined(held: list[list[bytes]], k: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(row[k] for row in held), kind)


def frequent_ngrams(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """``(slot, level)`` of n-grams in ``FREQUENT`` or more rows; the level is the binary logarithm of their number.

    Counted over all rows. A task sums up what it has read before it hands it
    over, so an n-gram of every document comes once per ``FLUSH`` n-grams.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for grams in ngram_sets(batch.column(1), width):
                held.append(grams)
                size += len(grams)
                if size >= FLUSH:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        fragment, rest = cut(grams, bits)
        out = []
        for key, part in pieces_by(fragment):
            again = np.flatnonzero(times[part] > 1).astype(np.uint32)
            more = (times[part][again] - 1).astype(np.uint32)
            out.append((key, rest[part].tobytes(), again.tobytes(), more.tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 3)]
        return pa.RecordBatch.from_arrays(columns, ["fragment", "ngrams", "again", "more"])

    def sums(fragment: int, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        grams, times = joined(held, 0, np.uint32), []
        for row in held:
            n = np.ones(len(row[0]) // 4, np.int64)
            n[np.frombuffer(row[1], np.uint32)] += np.frombuffer(row[2], np.uint32)
            times.append(n)
        order = np.argsort(grams)
        grams, times = grams[order], np.concatenate(times)[order]
        start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        total = np.add.reduceat(times, start)
        often = total >= FREQUENT
        slot = (np.int64(fragment) << np.int64(32) | grams[start[often]].astype(np.int64)) >> (32 + bits - LEVEL_BITS)
        level = np.log2(total[often]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(level)], ["slot", "level"])

    blobs = id_and_text(docs).mapInArrow(count, "fragment int, ngrams binary, again binary, more binary")
    return by_fragment(blobs, sums, "slot long, level int")


def cut(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragment (the leading bits) and the 32 bits after them, for each n-gram."""
    return (grams >> U64(64 - bits)).astype(np.int64), (grams >> U64(32 - bits)).astype(np.uint32)


def level_table(frequent: DataFrame) -> np.ndarray:
    """One byte per slot: how frequent its n-grams are, 0 for all that are not.

    Only the highest levels that fill at most a quarter of the slots count, so
    the table tells n-grams apart at any size of corpus. At most one bitmap of
    fixed size per level reaches the driver.
    """
    slots = frequent.groupBy("slot").agg(F.max("level").alias("level"))
    per_level = slots.groupBy("level").count().orderBy(F.desc("level")).collect()
    kept, total = [], 0
    for row in per_level:
        total += row["count"]
        if total > 1 << (LEVEL_BITS - 2):
            break
        kept.append(row["level"])
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    if kept:
        values = slots.where(F.col("level") >= min(kept)).withColumnRenamed("slot", "value")
        for row in bitmap_rows(values, "level").toLocalIterator():
            part = table[row["bucket"] * BUCKET : (row["bucket"] + 1) * BUCKET]
            part[bits_of(row)] = row["level"]
    return table


def prefix_length(n: int, percent: int) -> int:
    """A pair that reaches the similarity shares one of so many first n-grams of its larger document."""
    return n - -(-percent * n // 100) + 1


def with_partner(ids: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The rows, sorted by n-gram, that another row of their n-gram may be ``reachable`` from, by its size.

    With an n-gram at its place ``at``, a document of ``n`` can only be similar to
    documents of ``percent * n / 100`` up to a size that falls with ``at``. Rows
    without any other of such a size are dropped, and then those that are left
    without one. Both rows of a reachable pair always stay.
    """
    left = np.arange(len(ids))
    for _ in range(2):
        order = np.lexsort((n[left], ids[left]))
        left = left[order]
        size, place = n[left].astype(np.int64), at[left].astype(np.int64)
        group = np.cumsum(np.append(True, np.diff(ids[left]) != 0)[: len(left)]) << np.int64(33)
        least = -(-percent * size // 100)
        most = np.minimum(100 * size // percent, np.maximum((100 + percent) * (size - place) // percent - size, 0))
        keys = group | size
        others = np.searchsorted(keys, group | most, "right") - np.searchsorted(keys, group | least) - (most >= size)
        left = left[others > 0]
    return left


def postings(docs: DataFrame, width: int, percent: int, bits: int, levels: np.ndarray) -> DataFrame:
    """``(ngram, node, n, at)``: n-grams that lie in the prefix of two or more nodes.

    A document's n-grams are ordered from rare to frequent and by hash; ``at`` is
    the place in that order. N-grams that are not frequent go to their fragment,
    where rows that no other can be similar to are dropped. The frequent ones,
    which may have very many nodes, are dealt out evenly as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2^22 bytes
    first_spare = 1 << bits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        held, size, seen, flushes = [], 0, set(), 0
        for batch in batches:
            for grams in ngram_sets(batch.column(1), width):
                node = node_of(grams)
                if node is None or node in seen:
                    continue
                seen.add(node)
                level = table[grams >> U64(64 - LEVEL_BITS)]
                take = prefix_length(len(grams), percent)
                first = np.argsort(level, kind="stable")[:take] if level.any() else np.arange(take)
                held.append((grams[first], level[first] > 0, node, len(grams)))
                size += take
                if size >= FLUSH:
                    flushes += 1
                    yield dealt(held, flushes)
                    held, size, seen = [], 0, set()
        if held:
            yield dealt(held, flushes + 1)

    def dealt(held: list[tuple], flushes: int) -> pa.RecordBatch:
        sizes = np.array([len(x[0]) for x in held])
        doc = np.repeat(np.arange(len(held)), sizes)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        fragment, rest = cut(np.concatenate([x[0] for x in held]), bits)
        often = np.concatenate([x[1] for x in held])
        nodes, ns = np.array([x[2] for x in held], np.int64), np.array([x[3] for x in held], np.uint32)
        # Frequent n-grams go to fragments beyond the others, another one each time.
        target = np.where(often, first_spare + (doc * 2654435761 + flushes * 40503) % first_spare, fragment)
        order = np.argsort(target, kind="stable")
        out = []
        for key, part in pieces_by(target[order]):
            mine = order[part]
            starts = np.flatnonzero(np.append(True, np.diff(doc[mine]) != 0))
            of = doc[mine][starts]
            ids = (fragment[mine] << 32 | rest[mine].astype(np.int64)).tobytes() if key >= first_spare else rest[mine].tobytes()
            times = np.diff(np.append(starts, len(mine))).astype(np.uint32)
            out.append((key, ids, at[mine].tobytes(), nodes[of].tobytes(), ns[of].tobytes(), times.tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 5)]
        return pa.RecordBatch.from_arrays(columns, ["fragment", "ngrams", "at", "nodes", "ns", "times"])

    def shared_ngrams(fragment: int, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        if fragment >= first_spare:
            ids = joined(held, 0, np.int64)
        else:
            ids = np.int64(fragment) << np.int64(32) | joined(held, 0, np.uint32).astype(np.int64)
        times = joined(held, 4, np.uint32)
        node, n = np.repeat(joined(held, 2, np.int64), times), np.repeat(joined(held, 3, np.uint32), times)
        at = joined(held, 1, np.uint32)
        order = np.lexsort((node, ids)) if fragment < first_spare else np.argsort(ids)
        ids, node, n, at = ids[order], node[order], n[order], at[order]
        if fragment < first_spare:
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (node[1:] != node[:-1]))
            ids, node, n, at = ids[fresh], node[fresh], n[fresh], at[fresh]
            met = with_partner(ids, n, at, percent)
            ids, node, n, at = ids[met], node[met], n[met], at[met]
        for low in range(0, len(ids), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[part]), pa.array(node[part]), pa.array(n[part].astype(np.int64)), pa.array(at[part].astype(np.int64))],
                ["ngram", "node", "n", "at"],
            )

    ddl = "fragment int, ngrams binary, at binary, nodes binary, ns binary, times binary"
    return by_fragment(id_and_text(docs).mapInArrow(gather, ddl), shared_ngrams, "ngram long, node long, n long, at long")


def segments(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``(node, segment, grams, n, sketch)`` of the asked ``(node, doc)``, one row per segment that is not empty.

    The first row of a node has its number of n-grams and its sketch. A bitmap of
    fixed size says which are asked for. The few others that share a bit do no
    harm, as equal nodes have equal n-grams.
    """
    key = F.col("node").bitwiseXOR(F.coalesce("doc", F.lit(NO_ID)))
    shared = docs.sparkSession.sparkContext.broadcast(slot_bitmap(asked.select(key.alias("key")), "key"))  # 2^20 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            out = []
            for doc, grams in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1), width)):
                node = node_of(grams)
                if node is None:
                    continue
                if is_set(bits, np.int64(node) ^ np.int64(NO_ID if doc is None else doc)):
                    segment = (grams >> U64(64 - int(log2(SEGMENTS)))).astype(np.int64)
                    known = (len(grams), sketch(grams))
                    for key, part in pieces_by(segment):
                        out.append((node, key, grams[part].tobytes(), *known))
                        known = (None, None)
            columns = zip(*out) if out else ([] for _ in range(5))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            names = ["node", "segment", "grams", "n", "sketch"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return id_and_text(docs).mapInArrow(run, "node long, segment int, grams binary, n long, sketch binary")


def sketches(held: DataFrame) -> DataFrame:
    """``(node, n, sketch)``, each node once."""
    return held.where("sketch is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """``(a, b, a_n, b_n)`` of the pairs whose sketches do not rule out the similarity, as a written table.

    A sketch has a thirtieth of the size of the n-grams, and most pairs that meet
    in a common passage end here. No pair that reaches the similarity does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_sketch", "a_n", "b_sketch", "b_n")))
            most = [most_shared(*row) for row in rows]
            sizes = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(pa.array((100 + percent) * np.array(most, np.int64) >= percent * sizes))

    def side(name: str) -> DataFrame:
        return sketched.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))

    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return materialize(rows.mapInArrow(run, "a long, b long, a_n long, b_n long"), "likely")


def linked(held: DataFrame, pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs ``(a, b)`` of nodes that reach the similarity, ``(a, b, both)``, as a written table.

    For every pair and segment that the sketches leave, the two nodes' n-grams
    meet and are counted; the sum of these partial overlaps decides.
    """
    pairs = likely(pairs, sketched, percent)
    n = pairs.count()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    if 2 * n <= SENT_WHOLE:
        found = held.join(F.broadcast(asked), "node", "left_semi")
    else:
        slots = asked_slots(asked, "node", 2 * n)
        found = held.where(F.coalesce(is_asked(held, slots, F.col("node")), F.lit(False)))
    wide = pairs.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))

    def with_grams(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(found.select(F.col("node").alias(name), "segment", F.col("grams").alias(f"{name}_grams")), [name, "segment"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(c).to_pylist() for c in ("a_grams", "b_grams")]
            partial = [
                len(x) + len(y) - len(np.union1d(x, y))
                for x, y in ((np.frombuffer(p, U64), np.frombuffer(q, U64)) for p, q in zip(*both))
            ]
            kept = [batch.column(c) for c in ("a", "b", "a_n", "b_n", "segment")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(partial, pa.int64())], ["a", "b", "a_n", "b_n", "segment", "partial"])

    partials = with_grams(with_grams(wide, "a"), "b").mapInArrow(
        overlap, "a long, b long, a_n long, b_n long, segment int, partial long"
    )
    # A repeated row gives the same partial overlap again; only the places of four segments are summed.
    sums = [F.coalesce(F.max(F.when(F.col("segment") == k, F.col("partial"))), F.lit(0)) for k in range(SEGMENTS)]
    total = partials.groupBy("a", "b", "a_n", "b_n").agg(reduce(add, sums).alias("both"))
    enough = 100 * F.col("both") >= percent * (F.col("a_n") + F.col("b_n") - F.col("both"))
    return materialize(total.where(enough).select("a", "b", "both"), "links")


def with_component(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def with_centrality(prefixes: DataFrame) -> DataFrame:
    """The prefix n-grams with the number that its node shares with others, in thousandths of its size: how close it is to its group's core.

    N-grams of one node alone are not there, so a text that was changed in few places has more of them than one changed in many.
    """
    shared = prefixes.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    return prefixes.join(shared, "node").withColumn("central", F.call_function("div", F.col("rows") * 1000, F.col("n"))).drop("rows")


def mixed_ngrams(members: DataFrame, turn: int = 0) -> DataFrame:
    """``ngram, main, hub, hub_n, hub_at`` of n-grams whose nodes lie in several components: the largest and its most central node.

    ``nodes`` is their number, and ``meetings`` bounds the pairs that the nodes outside the largest would make with all others. In every later ``turn`` another half of the nodes comes first, so that further hubs have their turn.
    """
    first = F.lit(0) if not turn else F.xxhash64("node", F.lit(turn)).bitwiseAND(1).cast("int")
    hub = F.max(F.struct(first.alias("first"), "central", "node", "n", "at")).alias("hub")
    parts = members.groupBy("ngram", "component").agg(F.count(F.lit(1)).alias("size"), hub)
    largest = F.max(F.struct("size", "component", "hub")).alias("main")
    several = parts.groupBy("ngram").agg(largest, F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    meetings = ((F.col("nodes") - F.col("main.size")) * F.col("nodes")).cast("double").alias("meetings")
    columns = [F.col(f"main.hub.{c}").alias(f"hub{'_' + c if c != 'node' else ''}") for c in ("node", "n", "at")]
    return several.select("ngram", F.col("main.component").alias("main"), *columns, "nodes", meetings)


def reachable(percent: int, n: str, at: str, other_n: str, other_at: str) -> Column:
    """Whether two documents that share an n-gram at these places of theirs can be similar enough.

    Were it the first that they share, they could still share what follows it in
    both. Of all n-grams of a similar pair the first shared one passes.
    """
    n, at, other_n, other_at = (F.col(c) for c in (n, at, other_n, other_at))
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    return sizes & (F.lit(100 + percent) * F.least(n - at, other_n - other_at) >= F.lit(percent) * (n + other_n))


def ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def hub_pairs(mixed: DataFrame, percent: int, tried: DataFrame | None, turn: int = 0) -> DataFrame:
    """For each node the hubs that it meets in the most n-grams where its own component is not the main one.

    ``mixed`` are the prefixes with what ``mixed_ngrams`` says of their n-gram.
    One hub in the first two turns, then 2, 4, 8 ... as fewer nodes are left.
    Pairs that were tried before are not tried again.
    """
    met = mixed.where((F.col("component") != F.col("main")) & reachable(percent, "n", "at", "hub_n", "hub_at"))
    counts = met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    counts = counts.select("node", "hub", "shared", *ordered("node", "hub"))
    if tried is not None:
        counts = counts.join(tried, ["a", "b"], "left_anti")
    # A node has as many hubs as n-grams in its prefix, at most.
    best = W.partitionBy("node").orderBy(F.desc("shared"), "hub")
    picked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 1 << max(0, turn - 1))
    return picked.select("a", "b").distinct()


def open_pairs(mixed: DataFrame, percent: int, tried: DataFrame | None) -> DataFrame:
    """All pairs of nodes from different components that share an n-gram and can still reach the similarity.

    Of an n-gram only the nodes outside its main component are paired with all
    others, so a group of copies that is one component already costs nothing.
    """
    left = mixed.where(F.col("component") != F.col("main")).select(
        "ngram", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("component").alias("x_part")
    )
    right = mixed.select(
        "ngram", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("at").alias("y_at"), F.col("component").alias("y_part")
    )
    met = left.join(right, "ngram").where(
        (F.col("x_part") != F.col("y_part")) & reachable(percent, "x_n", "x_at", "y_n", "y_at")
    )
    pairs = met.select(*ordered("x", "y")).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


class Join(NamedTuple):
    """What a self-join leaves, as written tables."""

    known: DataFrame  # doc_id, n_shingles, node, of every row
    classes: DataFrame  # node, doc (its smallest doc_id), n (its number of n-grams)
    links: DataFrame | None  # a, b (nodes), both (n-grams that they share)
    components: DataFrame | None  # node, component, of linked nodes


def self_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> Join:
    """Link documents, as nodes of equal n-gram sets, until no further pair could join two components.

    Every link between nodes shows as an n-gram in the prefixes of both. Rounds
    pair each node with a few hubs, members of the largest component that it
    shares an n-gram with, and go on as long as that joins components, takes a
    quarter off the pairs that the rest could make, and these are more than four
    times the rows of the prefixes: groups of near copies are joined without
    pairing their members, in rounds whose number grows with the logarithm of the
    pairs. A round reads only crowded n-grams, those that could make more than four
    pairs a row; all others wait for the end, where they make four a row at most.
    Then every n-gram is read with its final components, and every pair that
    shares one across what are still different components is counted. No pair is
    left out by a cap.
    """
    docs = id_and_text(docs)
    known = materialize(fingerprints(docs, width), "fingerprints")
    classes = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    bits = min(31, max(4, ceil(log2(max(total, 1) / FRAGMENT_NGRAMS + 1))))
    levels = level_table(materialize(frequent_ngrams(docs, width, bits), "frequent"))
    prefixes = materialize(postings(docs, width, percent, bits, levels), "postings")
    prefixes = materialize(with_centrality(prefixes), "prefixes")
    few = PAIRS_PER_ROW * prefixes.count()
    asked = classes.join(prefixes.select("node").distinct(), "node", "left_semi").select("node", "doc")
    held = materialize(segments(docs, asked, width), "segments")
    sketched = materialize(sketches(held), "sketches")
    links, components, tried = None, None, None

    def count(pairs: DataFrame) -> bool:
        """Count the overlaps of these pairs; whether any of them links."""
        nonlocal links, components, tried
        pairs = materialize(pairs, "candidates")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.union(pairs)
        found = linked(held, pairs, sketched, percent)
        if found.isEmpty():
            return False
        links = found if links is None else links.union(found)
        components = with_more_links(components, found)
        return True

    columns = prefixes.columns

    def told_of(members: DataFrame, turn: int = 0) -> tuple[DataFrame, DataFrame]:
        return members, materialize(mixed_ngrams(members, turn), "told")

    def parted(rows: DataFrame, turn: int = 0) -> tuple[DataFrame, DataFrame]:
        """The rows with their components, and what ``mixed_ngrams`` says of them."""
        return told_of(materialize(with_component(rows.select(columns), components), "members"), turn)

    def with_main(members: DataFrame, told: DataFrame, name: str) -> DataFrame:
        return materialize(members.join(told.drop("nodes", "meetings"), "ngram"), name)

    # Each node is a component of its own as yet.
    first = members, told = told_of(prefixes.withColumn("component", F.col("node")))
    turn, before = 0, None
    while True:
        told = told.where(F.col("meetings") > PAIRS_PER_ROW * F.col("nodes"))
        meetings = told.agg(F.sum("meetings").alias("n")).first()["n"] or 0
        # The first two turns have other hubs, so that the second is always tried.
        if not (meetings > few and (turn < 2 or meetings <= LEFT_BY_A_ROUND * before)):
            break
        # Components only grow, so a crowded n-gram that is left out here can never become one again.
        crowded = with_main(members, told, "crowded")
        if not count(hub_pairs(crowded, percent, tried, turn)):
            break
        turn, before = turn + 1, meetings
        members, told = parted(crowded, turn)
    count(open_pairs(with_main(*(first if components is None else parted(prefixes)), "mixed"), percent, tried))
    return Join(known, classes, links, components)


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their word n-grams.

    Two documents link when ``100 * intersection >= percent * union`` of their
    distinct ``width``-word n-grams (words lower-cased in A-Z). Returns one row
    per input row: ``doc_id, n_shingles, component_id``, the smallest ``doc_id``
    that links lead to, its own included. Texts that are null or without words
    link with nothing; equal sets always link; a null id has no say in
    ``component_id``, which is null where all ids of a group are. Only
    ``doc_id`` and ``text`` are read; an empty table gives an empty result.

    Documents with equal sets are one node; see :func:`self_join`. N-grams and
    nodes are known by 64-bit hashes: two different n-grams, or two different
    sets, are taken for one with probability 2^-64 each.
    """
    found = self_join(docs, width, percent)
    return labelled(docs.sparkSession, found.known, found.classes, found.components)


def similar_pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The links that join the groups of ``similar_documents``, and what they stand for.

    First ``a, b, n_both, similarity``: pairs of class representatives (the
    smallest ``doc_id`` of equal n-gram sets) whose overlap was counted and
    suffices; enough of them to join every group, not all within one. Then
    ``doc_id, representative, component_id`` for every row with an identifier
    and words.
    """
    found = self_join(docs, width, percent)
    rows = labelled(docs.sparkSession, found.known, found.classes, found.components)
    named = found.known.join(found.classes.select("node", F.col("doc").alias("representative")), "node")
    members = (
        named.where("doc_id is not null")
        .select("doc_id", "representative")
        .join(rows.select("doc_id", "n_shingles", "component_id").where("n_shingles > 0").distinct(), "doc_id")
        .select("doc_id", "representative", "component_id")
    )
    if found.links is None:
        return docs.sparkSession.createDataFrame([], "a long, b long, n_both long, similarity double"), members
    side = found.classes.select("node", "doc", "n")
    pairs = found.links.join(side.select(F.col("node").alias("a"), F.col("doc").alias("a_doc"), F.col("n").alias("a_n")), "a")
    pairs = pairs.join(side.select(F.col("node").alias("b"), F.col("doc").alias("b_doc"), F.col("n").alias("b_n")), "b")
    share = F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))
    low, high = F.least("a_doc", "b_doc"), F.greatest("a_doc", "b_doc")
    return pairs.select(low.alias("a"), high.alias("b"), F.col("both").alias("n_both"), share.alias("similarity")), members


def labelled(spark: SparkSession, known: DataFrame, classes: DataFrame, components: DataFrame | None) -> DataFrame:
    nodes = with_component(classes.select("node", "doc"), components)
    smallest = nodes.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = nodes.join(smallest, "component").select("node", "component_id")
    rows = known.join(named, "node", "left")
    own: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each group of ``similar_documents`` the one with the smallest ``doc_id`` stays.

    All columns stay. Documents without words belong to no group and stay, as do
    rows without an identifier, which no group can name. Rows that repeat both
    identifier and text stay once.
    """
    groups = similar_documents(docs, width, percent)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    found = named.join(kept, "doc_id").select("row", "times")
    # Pre-aggregated, so an identifier that repeats very often does not gather.
    text = F.col("row").getField("text").cast("string").alias("text")
    repeated = found.where("times > 1").select("row", text, F.col("row").getField("doc_id").alias("id"))
    once = repeated.groupBy("id", "text").agg(F.first("row").alias("row")).select("row")
    nameless = named.where("doc_id is null").select("row")
    return found.where("times = 1").select("row").union(once).union(nameless).select("row.*")
