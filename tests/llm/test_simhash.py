"""SimHash groups against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from repo_signals.llm import simhash
from repo_signals.llm.simhash import (
    chain_of,
    close_pairs,
    dealt,
    distance_table,
    forest,
    group_links,
    hamming_links,
    meeting_keys,
    references,
    simhash_groups,
    simhashes,
    xxh64_spans,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(FOLD))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, distance=3):
    """The component of each distinct value, by comparing all with all."""
    values = sorted(set(values))
    array = np.array(values, np.uint64)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[:k] ^ array[k]) <= distance).tolist():
            parent[find(v)] = find(values[j])
    return {v: find(v) for v in values}


def plain_groups(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    root = roots(prints)
    members = defaultdict(list)
    for (doc, _), p in zip(rows, prints):
        members[root[p]].append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return Counter((doc, "%016x" % p, least[root[p]]) for (doc, _), p in zip(rows, prints))


def test_groups(docs, rows, nothing):
    got = Counter(tuple(r) for r in simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == plain_groups(rows)
    assert simhash_groups(nothing).collect() == []


def test_missing_identifiers(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "A b  c d"), (3, None), (4, " ")], "doc_id long, text string")
    got = Counter(tuple(r) for r in simhash_groups(df).collect())
    print_of = "%016x" % plain_fingerprint("a b c d")
    assert got == Counter({(None, print_of, None): 2, (3, "0" * 16, 3): 1, (4, "0" * 16, 3): 1})


def test_xxh64_spans():
    rng = random.Random(3)
    spans = [rng.randbytes(n) for n in [*range(0, 100), 255, 1000]]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(s) for s in spans])
    start = end - [len(s) for s in spans]
    for seed in (42, 0):
        assert xxh64_spans(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(s, seed) for s in spans]


def test_fingerprints_over_blocks():
    """A text with more shingles than are held at once, between others, in a sliced column."""
    rng = random.Random(4)
    long = " ".join(rng.choices(["w%d" % k for k in range(500)], k=simhash.SHINGLES_HELD * 2 + 77))
    texts = ["dropped", "one two", long, "", None, "One TWO three\tfour"]
    got = np.concatenate([f for _, _, f in simhashes(pa.array(texts)[1:])]).tolist()
    assert got == [plain_fingerprint(t) for t in texts[1:]]


def clustered(n, seed):
    """Groups of fingerprints close to each other, and some far from all."""
    rng, out = random.Random(seed), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 8):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 9)):
                value ^= 1 << bit
            out.add(value)
    out |= {rng.getrandbits(64) for _ in range(n // 4)}
    return sorted(out)


def as_nodes(spark, values):
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    return spark.createDataFrame(rows, "node long").repartition(3)


@pytest.mark.parametrize("distance,crowd", [(3, 1024), (3, 8), (1, 8), (0, 4)])
def test_all_links_are_found(spark, distance, crowd):
    """Also where groups are so small that they are divided several times."""
    values = clustered(600, distance + crowd)
    edges = hamming_links(as_nodes(spark, values), distance, crowd).collect()
    number = {v: k for k, v in enumerate(values)}
    a = np.array([number[r.a % (1 << 64)] for r in edges], int)
    b = np.array([number[r.b % (1 << 64)] for r in edges], int)
    got = forest(len(values), a, b)
    want = roots(values, distance)
    assert len({(values[g], want[v]) for v, g in zip(values, got)}) == len(set(want.values())) == len(set(got.tolist()))


def test_rows_of_a_dense_group(spark):
    """Fingerprints three bits off one centre: all in one component, with a few rows for each and not one per pair."""
    rng, values = random.Random(6), {0}
    while len(values) < 4000:
        values.add(sum(1 << b for b in rng.sample(range(64), 3)))
    links = hamming_links(as_nodes(spark, sorted(values))).select("a", "b").distinct().collect()
    assert len(links) < 16 * len(values)
    number = {v - (1 << 64) if v >> 63 else v: k for k, v in enumerate(sorted(values))}
    a, b = (np.array([number[r[k]] for r in links]) for k in (0, 1))
    assert set(forest(len(values), a, b).tolist()) == {0}


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, False)) for _ in x], np.uint64)
    y = x ^ flips
    for path in (1, 64 + 2, (64 + 1) * 64 + 3):
        bits, _ = chain_of(path, 4)
        inside = sum(np.uint64(1) << np.uint64(b) for b in bits)
        near = x ^ (flips & inside)
        before = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        (paths, p), (_, q) = meeting_keys(x, before, path, 4), meeting_keys(near, before, path, 4)
        assert (p == q).reshape(4, -1).any(axis=0).all()
        assert paths.reshape(4, -1)[:, 0].tolist() == [path * 64 + k for k in range(4)]
    table = [distance_table(v, references(np.arange(64))).astype(int) for v in (x, y)]
    assert (np.abs(table[0] - table[1]).max(axis=1) <= 3).all()


def test_pairs_within_groups():
    values = np.array(clustered(300, 9), np.uint64)
    sizes = np.array([100, 1, 37, len(values) - 138])
    a, b = close_pairs(values, sizes, 3)
    group = np.repeat(np.arange(4), sizes)
    want = {
        (i, j)
        for i in range(len(values))
        for j in range(i + 1, len(values))
        if group[i] == group[j] and int(np.bitwise_count(values[i] ^ values[j])) <= 3
    }
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_links_of_blocks(spark, monkeypatch):
    """Groups that end and go on at the edges of the blocks in which they are read."""
    rows = [(k // 7, k % 7) for k in range(700)]
    groups = spark.createDataFrame(rows, "key long, node long")
    got = {(r.a, r.b) for r in group_links(groups, 3).collect()}
    assert got == {(k, 0) for k in range(1, 7)}
    assert dealt(as_nodes(spark, [1, 2]).selectExpr("1L as path", "0L as key", "node"), 4).count() == 8
