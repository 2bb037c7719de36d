"""Conversation repair against plain Python: every audit tried, a full chart, and rows repaired by hand."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from repo_signals.llm import conversation_repair as cr
from repo_signals.llm.conversation_repair import cheapest, damaged, joined, of_row, repair_report, repaired_turns

SHAPE = re.compile(r"(s?(ua)+)?\Z")
CODES = [i + m for i in "sua?" for m in ("", "!", "-")]


def tried(codes):
    """The best audit among all with up to two insertions at each place."""
    best = None
    options = []
    for code in codes:
        initial, mark = code[:1], code[1:]
        extra = 5 if mark == "!" else 0
        row = [(2, "D", "")]
        if mark != "-":
            row += [(extra, "K", initial)] + [(1 + extra, "R", x) for x in "ua"]
        options.append(row)
    puts = [(0, "", "")] + [(5 * n, "I" * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    steps = [puts]
    for row in options:
        steps += [row, puts]
    for choice in itertools.product(*steps):
        if SHAPE.match("".join(c[2] for c in choice)):
            cell = sum(c[0] for c in choice), "".join(c[1] for c in choice)
            best = cell if best is None else min(best, cell)
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_cheapest_of_all_audits(n):
    for codes in itertools.product(CODES, repeat=n):
        assert cheapest(list(codes)) == tried(codes), codes


def test_cheapest_of_three():
    rng = random.Random(1)
    for _ in range(40):
        codes = rng.choices(CODES, k=3)
        assert cheapest(codes) == tried(codes), codes


def full_chart(codes):
    """All spans and all splits."""
    n = len(codes)
    chart = {(k, k + 1): of_row(c) for k, c in enumerate(codes)}
    for size in range(2, n + 1):
        for low in range(n - size + 1):
            cells = {}
            for mid in range(low + 1, low + size):
                for span, cell in joined(chart[low, mid], chart[mid, low + size]).items():
                    cr.best(cells, span, cell)
            chart[low, low + size] = cells
    return min(chart[0, n][0, q] for q in (0, 3) if (0, q) in chart[0, n])


def test_one_split_per_span_is_enough():
    rng = random.Random(2)
    for n in (4, 7, 12, 23):
        for _ in range(6):
            codes = rng.choices(CODES, k=n)
            assert cheapest(codes) == full_chart(codes)


def plain_step(states, code):
    """The best audit up to each place after one more row: a pass from left to right."""
    out = {}

    def offer(q, cell):
        if q not in out or cell < out[q]:
            out[q] = cell

    initial, mark = code[:1], code[1:]
    extra = 5 if mark == "!" else 0
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    for p, (cost, audit) in states.items():
        offer(p, (cost + 2, audit + "D"))
        if mark != "-":
            for label, q in follow[p].items():
                if label == initial:
                    offer(q, (cost + extra, audit + "K"))
                if label != "s":
                    offer(q, (cost + extra + 1, audit + "R"))
    return put_in(out)


def put_in(states):
    states = dict(states)
    for _ in range(3):
        for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if p in states:
                cell = states[p][0] + 5, states[p][1] + "I"
                if q not in states or cell < states[q]:
                    states[q] = cell
    return states


def plain_cheapest(codes):
    states = put_in({0: (0, "")})
    for code in codes:
        states = plain_step(states, code)
    return min(states[q] for q in (0, 3) if q in states)


def test_long_conversations():
    rng = random.Random(3)
    for n in (100, 1000, 3333):
        codes = rng.choices(CODES, k=n)
        assert cheapest(codes) == plain_cheapest(codes)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if case == 3 else 1)


def plain_report(rows, every):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        groups[conv].append((turn, role, text))
    out, lines_of = [], {}
    for conv in {*every, *groups}:
        mine = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed_hash(r[2])))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts, codes, seen = Counter(), [], set()
        for _, role, text in mine:
            chars = re.sub(r"[\x20\x09-\x0D]", "", text)
            if not chars:
                fault, mark = "blank", "-"
            elif (role, text) in seen:
                fault, mark = "duplicate", "-"
            elif chars[-1] not in ".!?":
                fault, mark = "truncated", "!"
            else:
                fault, mark = None, ""
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "?") + mark)
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_cheapest(codes)
        lines, left, last = [], iter(mine), ""
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append((role, text, edit))
        lines_of[conv] = lines
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return Counter(out), lines_of


def signed_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


ODD = [
    (900, None, None, None),
    (900, 0, "system", "Be brief."),
    (900, 0, "system", "Be brief."),
    (901, 3, "user", "Hi."),
    (901, 9, "assistant", "Well \t\n"),
    (901, 9, "assistant", "Well? \t\n"),
    (901, 11, "server", "é。"),
    (902, 1, "tool", "x."),
    (902, 2, "", "y!"),
    (None, 1, "user", "nameless."),
    (None, None, "assistant", "too."),
    *[(903, k // 2, ("user", "assistant")[k % 2], "Turn %d%s" % (k // 3, "." * (k % 5 > 0))) for k in range(700)],
    *[(904, 5, "user", "Again and again.")] * 300,
    (905, -(1 << 62), "user", "a long " * 20000 + "."),
]


@pytest.fixture(scope="module")
def conversations(spark, sf_dir):
    ddl = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame(ODD, ddl).repartition(3)
    # Names that the operator uses itself.
    extra = odd.selectExpr("*", "'x' as hash", "1 as n", "2 as head", "'K' as audit", "3 as copy", "4 as case")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(extra, allowMissingColumns=True).cache()


def test_damage(conversations):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, damaged(conversations).collect())) == Counter(plain_damage(rows))


@pytest.mark.parametrize("modulus", [20, 6])
def test_report(conversations, modulus):
    rows = damaged(conversations, modulus)
    plain = [tuple(r) for r in rows.collect()]
    every = {r.conv_id for r in conversations.select("conv_id").distinct().collect()}
    got = Counter(tuple(r) for r in repair_report(rows, conversations).collect())
    want, lines = plain_report(plain, every)
    assert got == want
    if modulus == 20:
        found = defaultdict(list)
        for r in sorted(repaired_turns(rows).collect(), key=lambda r: r.turn):
            found[r.conv_id].append((r.role, r.text, r.edit))
        assert dict(found) == {c: x for c, x in lines.items() if x}


def test_nothing_left_and_empty_tables(spark, conversations):
    none = conversations.limit(0)
    assert repair_report(none).collect() == []
    assert repaired_turns(none).collect() == []
    kept = repair_report(none, spark.createDataFrame([(3,), (3,)], "conv_id long")).collect()
    assert [tuple(r) for r in kept] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
