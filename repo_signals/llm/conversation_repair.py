"""Repair of a conversation's turn structure by weighted interval parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals.llm.text import python_ready

WHITE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}

# Places in a conversation `(s?(ua)+)?`, named by what was read last, and what may follow. A conversation may end where
# nothing was read or after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
FOLLOWS = {
    START: {"s": SYSTEM, "u": ASKED},
    SYSTEM: {"u": ASKED},
    ASKED: {"a": ANSWERED},
    ANSWERED: {"u": ASKED},
}
ENDS = (START, ANSWERED)
# Row codes: the initial of the role, and a mark behind it.
WHOLE, TRUNCATED, LOST = "", "!", "-"

# Cells for stretches of so many rows are remembered, as short conversations look alike.
REMEMBERED = 8

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def best(found: Cells, span: tuple[int, int], cell: Cell) -> None:
    if span not in found or cell < found[span]:
        found[span] = cell


def joined(left: Cells, right: Cells) -> Cells:
    """The binary rules ``(p, q) -> (p, r) (r, q)``: the least cost, and of equal ones the least audit, for each ``(p, q)``.

    Of two audits of equal cost neither begins the other, as the further one
    could only go on with insertions, which cost something. So the least audit
    of a whole is made of the least audits of its parts.
    """
    found: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                best(found, (p, q), (cost + more, audit + rest))
    return found


def insertions() -> Cells:
    """The closure of the empty span: the cheapest rows put in to get from one place to another."""
    found: Cells = {(p, p): (0, "") for p in FOLLOWS}
    step = dict(found)
    for p, following in FOLLOWS.items():
        for label, q in following.items():
            if label in NAMES:
                best(step, (p, q), (INSERT_COST, INSERT))
    while (longer := joined(found, step)) != found:
        found = longer
    return found


NOTHING = insertions()


def of_row(code: str) -> Cells:
    """The unary rules for one row: deleted, kept or given another role, with what may be put in around it."""
    initial, mark = code[:1], code[1:]
    found: Cells = {(p, p): (DELETE_COST, DELETE) for p in FOLLOWS}
    if mark != LOST:
        extra = TRUNCATED_COST if mark == TRUNCATED else 0
        for p, following in FOLLOWS.items():
            for label, q in following.items():
                if label == initial:
                    best(found, (p, q), (extra, KEEP))
                if label in NAMES:
                    best(found, (p, q), (REROLE_COST + extra, REROLE))
    return joined(joined(NOTHING, found), NOTHING)


@lru_cache(1 << 12)
def leaf(code: str) -> Cells:
    return of_row(code)


@lru_cache(1 << 14)
def remembered(codes: tuple[str, ...]) -> Cells:
    return bottom_up([leaf(c) for c in codes])


def bottom_up(spans: list[Cells]) -> Cells:
    """Cells of neighbouring spans joined two by two, so that all spans of one length are done before any longer one."""
    while len(spans) > 1:
        spans = [joined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0]


def cheapest(codes: list[str]) -> Cell:
    """Cost and audit of the best repair of a conversation with these row codes.

    The grammar is in Chomsky normal form with one symbol ``(p, q)`` per pair of
    places: what leads from ``p`` to ``q``. As such a symbol derives a span
    however the span is split, one split per span is enough, and the chart needs
    spans of doubling length only: its size and time grow with the number of rows.
    """
    if not codes:
        return 0, ""
    blocks = [remembered(tuple(codes[k : k + REMEMBERED])) for k in range(0, len(codes), REMEMBERED)]
    cells = bottom_up(blocks)
    return min(cells[START, q] for q in ENDS if (START, q) in cells)


class Repair:
    """Follows an audit along the rows of its conversation; every call gives the role and text of what is written."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START

    def write(self, label: str) -> None:
        self.place = FOLLOWS[self.place][label]

    def label(self) -> str:
        return next(x for x in FOLLOWS[self.place] if x in NAMES)

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """What is put in before the next row, or after the last one."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            label = self.label()
            self.write(label)
            yield INSERT, NAMES[label], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return
        label = role[:1] if edit == KEEP else self.label()
        self.write(label)
        yield edit, role if edit == KEEP else NAMES[label], text


# --- rows ---------------------------------------------------------------------------------------

SPACE = " "
ROW_ORDER = ["conv_id", "turn", "role", "hash"]


def normal_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, hash``; a missing role or text is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(SPACE)).alias(c) for c in ("role", "text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return plain.withColumn("hash", F.xxhash64("text"))


def coded_rows(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    """``conv_id, turn, role, hash, n, initial, blank, cut, first``: the distinct rows without their texts, and how often they occur.

    ``every`` adds one row with ``n`` 0 for each of its conversations.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = normal_rows(rows).select(
        *ROW_ORDER,
        F.lit(1).alias("n"),
        (F.length(trimmed) == 0).alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    if every is not None:
        none = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        absent = {c: F.lit(None).cast(t) for c, t in marked.dtypes if c not in ("conv_id", "n")}
        marked = marked.unionByName(none.withColumns({**absent, "n": F.lit(0)}))
    distinct = marked.groupBy(*ROW_ORDER).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    earlier = W.partitionBy("conv_id", "role", "hash").orderBy(F.asc_nulls_first("turn"))
    return distinct.withColumn("first", F.row_number().over(earlier) == 1)


REPORT = {
    "conv_id": pa.int64(),
    "gaps": pa.int64(),
    "blank": pa.int64(),
    "duplicate": pa.int64(),
    "truncated": pa.int64(),
    "illegal": pa.int64(),
    "cost": pa.int64(),
    "audit": pa.string(),
}
REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = ("su", "ua", "au")


class Conversation:
    """What is known of a conversation while its rows come in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = self.initial = None

    def add(self, turn: int | None, role: str, n: int, blank: bool, cut: bool, first: bool) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        for k in range(n):
            if blank:
                self.blank, mark = self.blank + 1, LOST
            elif k or not first:
                self.duplicate, mark = self.duplicate + 1, LOST
            elif cut:
                self.truncated, mark = self.truncated + 1, TRUNCATED
            else:
                mark = WHOLE
            if self.codes:
                self.illegal += self.initial + initial not in LEGAL
            self.initial = initial
            # Only these initials matter to the grammar.
            self.codes.append((initial if initial in ("s", "u", "a") else "?") + mark)

    def report(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.codes))


def parsed(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    """One row per conversation: its faults, and cost and audit of its repair.

    A conversation's rows come in order without their texts; it holds a code per
    row, and its cells a letter per row, as the audit that is returned does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "first")]
            for conv_id, turn, role, n, *faults in zip(*lists):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        out.append(at.report())
                    at = Conversation(conv_id)
                if n:
                    at.add(turn, role, n, *faults)
            yield packed(out)
            out = []
        yield packed(out if at is None else [*out, at.report()])

    def packed(reports: list[tuple]) -> pa.RecordBatch:
        columns = zip(*reports) if reports else [[] for _ in REPORT]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, REPORT.values())], list(REPORT))

    ordered = coded_rows(rows, every).repartition("conv_id").sortWithinPartitions(*ROW_ORDER)
    return ordered.select("conv_id", "turn", "role", "n", "blank", "cut", "first").mapInArrow(run, REPORT_DDL)


def along_the_rows(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of every conversation in order, behind its report: ``head`` is 0 for reports and 1 for rows.

    Texts are shuffled once and met as they come; no conversation is held.
    """
    texts = normal_rows(rows)
    absent = {c: F.lit(None).cast(t) for c, t in texts.dtypes if c != "conv_id"}
    heads = reports.withColumns({"head": F.lit(0), **absent})
    both = heads.unionByName(texts.withColumn("head", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "hash")


def repair_report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The faults of every conversation and its cheapest repair, as figures and a digest.

    ``rows`` has ``conv_id, turn, role, text``; other columns are not read. A
    missing role or text is one space. Rows stand in order of ``turn`` (missing
    ones first), then role and a hash of the text. A row is blank without a
    character other than white space, else a duplicate if role and text came
    before, else truncated if its last such character is not one of ``.!?``.
    Keeping a row costs nothing, giving it the role user or assistant 1, deleting
    it 2 (blank rows and duplicates have to go), putting in an empty row 5, and a
    truncated row that stays 5 more. What remains has the initials
    ``(s?(ua)+)?``.

    Returns one row per ``conv_id`` of ``rows`` and of ``every``, a null one
    included: ``conv_id, gaps`` (turns left out between first and last),
    ``blank, duplicate, truncated, illegal`` (neighbours whose initials are not
    su, ua or au), ``cost, audit`` (initials of the edits, the least of equally
    cheap ones) and ``repaired_sha256`` of the lines ``role:text``. An empty
    table gives an empty result; a conversation without rows zeros, an empty
    audit and the digest of nothing. Equal texts are told by 64-bit hashes.
    """
    python_ready(rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, repair, sha, written, out = None, None, None, 0, []

        def put(lines: Iterator[tuple[str, str, str]]) -> None:
            nonlocal written
            for _, role, text in lines:
                sha.update(("\n" if written else "").encode() + f"{role}:{text}".encode())
                written += 1

        def end() -> None:
            if report is not None:
                put(repair.inserted())
                out.append((*report, sha.hexdigest()))

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("head", "role", "text")]
            for k, (head, role, text) in enumerate(zip(*lists)):
                if not head:
                    end()
                    report = tuple(batch.column(c)[k].as_py() for c in REPORT)
                    repair, sha, written = Repair(report[-1]), hashlib.sha256(), 0
                else:
                    put(repair.row(role, text))
            yield packed(out)
            out.clear()
        end()
        yield packed(out)

    def packed(reports: list[tuple]) -> pa.RecordBatch:
        columns = zip(*reports) if reports else [[] for _ in range(len(REPORT) + 1)]
        types = [*REPORT.values(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [*REPORT, "repaired_sha256"])

    ordered = along_the_rows(parsed(rows, every), rows)
    return ordered.mapInArrow(digest, f"{REPORT_DDL}, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The conversations after their cheapest repair: ``conv_id, turn`` (from 0), ``role, text, edit`` (K, R or I).

    Order, costs and missing values are those of ``repair_report``.
    """
    python_ready(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, repair, turn, out = None, None, 0, []

        def put(lines: Iterator[tuple[str, str, str]]) -> None:
            nonlocal turn
            for edit, role, text in lines:
                out.append((conv_id, turn, role, text, edit))
                turn += 1

        def packed() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in range(5)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "text", "edit"])

        for batch in batches:
            for conv, head, role, text, audit in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text", "audit"))
            ):
                if not head:
                    if repair is not None:
                        put(repair.inserted())
                    conv_id, repair, turn = conv, Repair(audit), 0
                else:
                    put(repair.row(role, text))
            yield packed()
        if repair is not None:
            put(repair.inserted())
        yield packed()

    ordered = along_the_rows(parsed(rows, None), rows)
    return ordered.mapInArrow(write, "conv_id long, turn long, role string, text string, edit string")


def damaged(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the hash of ``conv_id:turn``, for trying a repair.

    Of ``modulus`` remainders 0 drops a row, 1 empties its text, 2 takes the
    marks ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Missing values
    are one space, also in what is hashed.
    """

    def given(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(SPACE))

    case = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % modulus
    rows = conversations.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), case.alias("case"))
    kept = rows.where("case != 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))))
    text = (
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    )
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"))
