"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, which are then rendered as turns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repo_signals.llm.text import python_ready
from repo_signals.session import materialize

ROLES = ["system", "user", "assistant"]
# A role's first line in a turn, and the lines that follow it.
STATES = [(role, first) for role in ROLES for first in (True, False)]
K = len(STATES)

# Speaker markers at the start of a line, in any letter case, and the role each speaks for.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "q"],
    "assistant": ["assistant", "ai", "bot", "answer", "a"],
}
OPENING = r"^\s*(?:#{1,3}\s*|\*\*|\[|<\|?)?(?i:%s)(?:\*\*|\]|\|?>)?\s*[:>\]|]+(?:\*\*)?\s*"
LENGTHS = [0, 40, 120, 300]
SYMBOLS = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 4

TURN, END = "<|%s|>\n", "\n<|end|>"

# Sorted lines that are worked on together. Only numbers are gathered, one byte and one index per line.
BLOCK_BITS = 16


def marker(line: Column) -> Column:
    """0 for a line without a marker, else 1 + the role's place."""
    found = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES))):
        found = F.when(line.rlike(OPENING % "|".join(MARKERS[role])), k + 1).otherwise(found)
    return found


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, OPENING % "|".join(w for words in MARKERS.values() for w in words), "")


def symbol(line: Column, opens: Column) -> Column:
    """What the model sees of a line: its marker, a class of length, whether it ends in ``?``, whether it is the first."""
    size = F.lit(0)
    for k, least in enumerate(LENGTHS):
        size = F.when(F.length(line) > least, k + 1).otherwise(size)
    asks = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
    return (((marker(line) * (len(LENGTHS) + 1) + size) * 2 + asks) * 2 + F.when(opens, 1).otherwise(0)).cast("int")


@dataclass(frozen=True)
class Model:
    """Logarithms of start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def state_of(role: Column, first: Column) -> Column:
    place = F.lit(None).cast("int")
    for k, name in enumerate(ROLES):
        place = F.when(role == name, k).otherwise(place)
    return place * 2 + F.when(first, 0).otherwise(1)


def fit_roles(lines: DataFrame) -> Model:
    """Counts over all labelled lines ``(conv_id, turn, at, role, symbol)``, with one added everywhere.

    ``at`` counts the lines of a turn from 0. Nothing but tables of counts is
    gathered; a turn meets the next one in a join that Spark can split.
    """
    known = lines.where(F.col("role").isin(ROLES)).select(
        "conv_id", "turn", "at", "symbol", state_of(F.col("role"), F.col("at") == 0).alias("state")
    )
    emitted = known.groupBy("state", "symbol").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = known.groupBy("conv_id", "turn").agg(F.max(F.struct("at", "state")).alias("last"), F.min(F.struct("at", "state")).alias("first"))
    ends = ends.select("conv_id", "turn", F.col("last.at").alias("n"), F.col("last.state").alias("last"), F.col("first.state").alias("first"))
    after = ends.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("first").alias("state"))
    between = ends.join(after, ["conv_id", "turn"]).groupBy("last", "state").agg(F.count(F.lit(1)).alias("n")).collect()
    within = ends.groupBy("first").agg(F.sum((F.col("n") > 0).cast("long")).alias("one"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("more")).collect()
    openings = ends.where("turn = 0").groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()
    start, move, emit = np.ones(K), np.ones((K, K)), np.ones((K, SYMBOLS))
    for row in emitted:
        emit[row["state"], row["symbol"]] += row["n"]
    for row in between:
        move[row["last"], row["state"]] += row["n"]
    for row in within:
        move[row["first"], row["first"] + 1] += row["one"]
        move[row["first"] + 1, row["first"] + 1] += row["more"]
    for row in openings:
        start[row["first"]] += row["n"]
    # A role's later lines follow only its own.
    for k in range(1, K, 2):
        start[k] = 1e-9
        for before in range(K):
            if before // 2 != k // 2:
                move[before, k] = 1e-9
    logs = [np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, emit)]
    return Model(*logs)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


def stretch_matrix(model: Model, symbols: np.ndarray) -> np.ndarray:
    """For each state of the first and of the last line, the best score of a way between them, emissions included."""
    best = np.where(np.eye(K, dtype=bool), 0.0, -np.inf) + model.emit[:, symbols[0]]
    for s in symbols[1:].tolist():
        best = (best[:, :, None] + model.move[None]).max(axis=1) + model.emit[:, s]
    return best


def viterbi(model: Model, symbols: np.ndarray, start: np.ndarray, last: int | None = None) -> np.ndarray:
    """The best states of a stretch, given scores for its first line's state and, if known, its last line's state."""
    score = start + model.emit[:, symbols[0]]
    back = np.zeros((len(symbols), K), np.int8)
    for k, s in enumerate(symbols[1:].tolist(), 1):
        reach = score[:, None] + model.move
        back[k] = reach.argmax(axis=0)
        score = reach.max(axis=0) + model.emit[:, s]
    out = np.empty(len(symbols), np.int8)
    out[-1] = score.argmax() if last is None else last
    for k in range(len(symbols) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def only(state: int) -> np.ndarray:
    return np.where(np.arange(K) == state, 0.0, -np.inf)


def recover_roles(lines: DataFrame, model: Model) -> DataFrame:
    """``mid, state, next_state`` of sorted lines ``(mid, conv_id, symbol)``: the most likely states of every transcript.

    ``mid`` is partition and row of the sorted table. Lines are gathered in
    blocks of fixed size, so a transcript of any length is spread: each of its
    stretches is first summed up as a small matrix, the matrices of one
    transcript give the states at the stretches' ends, and each stretch is then
    solved between them. That is the Viterbi path of the whole.
    """
    python_ready(lines.sparkSession)
    blocked = lines.withColumn("block", F.col("mid").bitwiseAND(-(1 << BLOCK_BITS)))

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mid, conv, symbols = (table.column(c).to_numpy() for c in ("mid", "conv_id", "symbol"))
        order = np.argsort(mid)
        return mid[order], conv[order], symbols[order]

    def edges(table: pa.Table) -> pa.Table:
        mid, conv, symbols = columns(table)
        cuts = stretches(conv)
        open_ = [cuts[0]] if len(cuts) == 1 else [cuts[0], cuts[-1]]
        return pa.table(
            {
                "conv_id": pa.array([conv[a] for a, _ in open_], pa.int64()),
                "block": pa.array([table.column("block")[0].as_py()] * len(open_), pa.int64()),
                "first": pa.array([mid[a] for a, _ in open_], pa.int64()),
                "matrix": pa.array([stretch_matrix(model, symbols[a:b]).ravel() for a, b in open_], pa.list_(pa.float64())),
            }
        )

    def chained(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("first").to_numpy())
        matrices = np.array(table.column("matrix").to_pylist()).reshape(-1, K, K)[order]
        score, back = model.start, []
        for m in matrices:
            entry = score[:, None] + m
            back.append([entry.argmax(axis=0)])
            exit_ = entry.max(axis=0)
            onward = exit_[:, None] + model.move
            back[-1].append(onward.argmax(axis=0))
            score = onward.max(axis=0)
        last, after, found = int(exit_.argmax()), -1, []
        for entry, onward in reversed(back):
            if after >= 0:
                last = int(onward[after])
            found.append((int(entry[last]), last, after))
            after = found[-1][0]
        entry, last, after = (list(reversed(x)) for x in zip(*found))
        plain = table.take(pa.array(order)).select(["conv_id", "block", "first"])
        for name, values in (("entry", entry), ("exit", last), ("after", after)):
            plain = plain.append_column(name, pa.array(values, pa.int32()))
        return plain

    def solved(table: pa.Table, ends: pa.Table) -> pa.Table:
        mid, conv, symbols = columns(table)
        known = {r["first"]: r for r in ends.to_pylist()}
        state, following = np.empty(len(mid), np.int32), np.empty(len(mid), np.int32)
        for a, b in stretches(conv):
            end = known.get(int(mid[a]))
            path = viterbi(model, symbols[a:b], only(end["entry"]) if end else model.start, end["exit"] if end else None)
            state[a:b] = path
            following[a:b] = np.append(path[1:], end["after"] if end else -1)
        return pa.table({"mid": mid, "state": state, "next_state": following})

    opened = blocked.groupBy("block").applyInArrow(edges, "conv_id long, block long, first long, matrix array<double>")
    ends = opened.groupBy("conv_id").applyInArrow(
        chained, "conv_id long, block long, first long, entry int, exit int, after int"
    )
    return blocked.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(solved, "mid long, state int, next_state int")


def format_transcripts(lines: DataFrame, model: Model) -> DataFrame:
    """Roles and canonical rendering of transcript lines ``(conv_id, pos, line)``.

    One row per line: ``conv_id, pos, role_pred, new_turn, rendered``. Rendered
    lines of a transcript, joined by line breaks in the order of ``pos``, read
    ``<|role|>``, the turn's lines without speaker markers, ``<|end|>`` for each
    turn. A null line counts as empty, lines without ``conv_id`` form one
    transcript; of lines at the same place the order is by text. An empty table
    gives an empty result; other columns are not read.

    Lines are range-partitioned and sorted by transcript and place, and never
    gathered beyond a block.
    """
    given = lines.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"),
    )
    order = ["conv_id", "pos", "line"]
    ranged = given.repartitionByRange("conv_id", "pos").sortWithinPartitions(*order)
    placed = ranged.withColumn("mid", F.monotonically_increasing_id())
    seen = placed.withColumn("symbol", symbol(F.col("line"), F.col("pos") == 0))
    seen = materialize(seen, "lines")
    numbers = seen.select("mid", F.coalesce("conv_id", F.lit(-(1 << 63))).alias("conv_id"), "symbol")
    states = recover_roles(numbers, model)
    roles = F.array(*(F.lit(role) for role, _ in STATES))
    role = F.element_at(roles, F.col("state") + 1)
    new_turn = F.col("state") % 2 == 0
    ends_turn = F.col("next_state") % 2 <= 0
    head = F.when(new_turn, F.format_string(TURN, role)).otherwise("")
    tail = F.when(ends_turn, END).otherwise("")
    text = F.when(new_turn, unmarked(F.col("line"))).otherwise(F.col("line"))
    return seen.join(states, "mid").select(
        "conv_id", "pos", role.alias("role_pred"), new_turn.alias("new_turn"), F.concat(head, text, tail).alias("rendered")
    )


# Styles of speaker markers in which turns are written out, and the share of turns, of four, that have one.
STYLES = ["%s: ", "### %s: ", "[%s]: ", "**%s:** ", "%s> "]


def transcripts(conversations: DataFrame) -> DataFrame:
    """Plain transcript lines ``(conv_id, turn, at, pos, role, line)`` written out from a table of turns.

    Every conversation has a marker style of its own, and one turn in four has
    no marker. ``role`` is kept for fitting and for comparison.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    lines = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)).alias("at", "body"),
    )
    name = F.initcap(F.coalesce("role", F.lit("user")))
    marked = F.lit(None).cast("string")
    for k, pattern in enumerate(STYLES):
        marked = F.when(style == k, F.format_string(pattern, name)).otherwise(marked)
    has_marker = (F.col("at") == 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0)
    line = F.when(has_marker, F.concat(marked, F.col("body"))).otherwise(F.col("body"))
    # Lines of a turn stand behind each other: a turn has fewer than 2^24 lines.
    pos = F.col("turn") * (1 << 24) + F.col("at")
    return lines.select("conv_id", "turn", "at", pos.alias("pos"), "role", line.alias("line"))
