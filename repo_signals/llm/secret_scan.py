"""Secret scans with DataFrame functions alone: fixed patterns, and character Markov models for what they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repo_signals.functions.columns import scalar
from repo_signals.session import materialize

# Fixed patterns, in the order in which kinds are listed. For access keys and hex runs the shortest length is part of
# the pattern: their matches are whole runs, so a run that is too short has no longer match inside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE_CHARS = 12
KINDS = ["assign", "access", "hex", "markov"]

# Strings the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
CANDIDATE_CHARS = 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
# Ordinary identifiers are runs of the same characters that are too short to be judged.
ORDINARY_WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{5,19}(?![A-Za-z0-9+/_-])"
# How many observed transitions the overall shares of characters are worth.
PRIOR = 10.0
# Mean log-likelihood ratio per character, in nats, from which a string counts as random.
RANDOM_FROM = 0.75
# Documents the two models are fitted on: with matches of the patterns, and any.
FIT_RANDOM_DOCS = 4000
FIT_ORDINARY_DOCS = 1000

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def located(text: Column, pattern: str, matches: Column, values: Column, kind: str) -> Column:
    """The spans of a pattern's matches, in code points, with the string each stands for.

    The pattern also splits the text, so a match begins where the pieces and
    matches before it end. Nothing is folded for a text without a match.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"), values.alias("value"))

    def step(done: Column, x: Column) -> Column:
        low = done["at"] + F.length(x["piece"])
        high = low + F.length(x["match"])
        span = F.struct(
            low.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            high.alias("end"),
            F.lit(kind).alias("kind"),
            x["value"].alias("value"),
        )
        more = F.struct(high.alias("at"), F.concat(done["spans"], F.array(span).cast(f"array<{SPAN}>")).alias("spans"))
        return F.when(x["match"].isNull(), done).otherwise(more)

    return F.when(F.size(matches) > 0, F.aggregate(steps, start, step, lambda done: done["spans"])).otherwise(empty)


def parts_outside(c: Column, base: Column) -> Column:
    """The parts of a span that no base span covers; base spans come by start and may overlap."""

    def part(low: Column, high: Column) -> Column:
        span = F.struct(
            low.alias("start"),
            F.lit(KINDS.index("markov")).alias("rank"),
            high.alias("end"),
            F.lit("markov").alias("kind"),
            c["value"].substr(low - c["start"] + 1, high - low).alias("value"),
        )
        return F.array(span).cast(f"array<{SPAN}>")

    def upto(done: Column, end: Column) -> Column:
        return F.when(done["at"] < end, F.concat(done["parts"], part(done["at"], end))).otherwise(done["parts"])

    def step(done: Column, b: Column) -> Column:
        return F.struct(F.greatest(done["at"], b["end"]).alias("at"), upto(done, b["start"]).alias("parts"))

    start = F.struct(c["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    touching = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return F.aggregate(touching, start, step, lambda done: upto(done, c["end"]))


def base_spans(rows: DataFrame, *carried: str) -> DataFrame:
    """The ``carried`` columns, the pattern matches ``base`` of ``text``, the ``candidates`` outside them, and the ``rests``.

    Of a long run that pattern matches cut into, every part of ``CANDIDATE_CHARS``
    is a candidate of its own; its shorter parts, if together they are as long,
    are one rest: ``tried``, the string they make, and the ``parts``.
    """
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": CANDIDATE}
    found = rows.select(
        *carried, "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items())
    )
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))
    spans = {
        k: located(F.col("text"), p, F.col(k), values if k == "assign" else F.col(k), k) for k, p in patterns.items()
    }
    assigned = F.filter(spans["assign"], lambda s: F.length(s["value"]) >= ASSIGN_VALUE_CHARS)
    ordered = found.select(
        *carried,
        F.array_sort(F.concat(assigned, spans["access"], spans["hex"])).alias("base"),
        spans["markov"].alias("candidates"),
    )

    def cut(c: Column) -> Column:
        return F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    apart = F.filter("candidates", lambda c: ~cut(c)).alias("apart")
    pieces = F.transform(F.filter("candidates", cut), lambda c: parts_outside(c, F.col("base"))).alias("pieces")
    split = ordered.select(*carried, "base", apart, pieces)
    long = F.filter(F.flatten("pieces"), lambda p: F.length(p["value"]) >= CANDIDATE_CHARS)
    short = F.transform("pieces", lambda run: F.filter(run, lambda p: F.length(p["value"]) < CANDIDATE_CHARS))
    joined = F.transform(
        short, lambda run: F.struct(F.array_join(F.transform(run, lambda p: p["value"]), "").alias("tried"), run.alias("parts"))
    )
    rests = F.filter(joined, lambda r: F.length(r["tried"]) >= CANDIDATE_CHARS)
    return split.select(*carried, "base", F.concat("apart", long).alias("candidates"), rests.alias("rests"))


def with_text(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def pair_counts(strings: DataFrame, name: str) -> DataFrame:
    """How often each character of the alphabet follows each other one in weighted ``(value, n)``: at most 66 x 66 rows."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("at")
    pairs = strings.where(F.length("value") > 1).select("n", "value", at)
    first = F.call_function("instr", F.lit(ALPHABET), F.col("value").substr(F.col("at"), F.lit(1)))
    second = F.call_function("instr", F.lit(ALPHABET), F.col("value").substr(F.col("at") + 1, F.lit(1)))
    coded = pairs.select("n", first.alias("a"), second.alias("b")).where((F.col("a") > 0) & (F.col("b") > 0))
    return coded.groupBy(((F.col("a") - 1) * len(ALPHABET) + F.col("b") - 1).alias("pair")).agg(F.sum("n").alias(name))


def ratio_table(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: the log-likelihood ratio of every character transition, random strings against ordinary identifiers.

    Labelled samples of both come from the corpus: the strings that the fixed
    patterns find are random, the plain words of other documents ordinary. Of
    each at most a stated number of documents is used, those with the smallest
    hash of their identifier. A character's transitions are smoothed by the
    overall shares of the characters in the same sample, and those by one each, so
    without any sample both models are uniform and nothing counts as random.
    """
    hashed = F.xxhash64(F.col("doc_id"), F.lit(2))
    order = [hashed, F.col("doc_id")]
    random = (
        scanned.where(F.size("base") > 0).orderBy(*order).limit(FIT_RANDOM_DOCS).select(F.explode("base.value").alias("value"))
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = chosen.orderBy(*order).limit(FIT_ORDINARY_DOCS)
    # At most FIT_ORDINARY_DOCS identifiers; of repeated ones a single text is read.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    ordinary = texts.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY_WORD), F.lit(0))).alias("value"))
    counted = [
        pair_counts(x.groupBy("value").agg(F.count(F.lit(1)).alias("n")), name)
        for x, name in ((random, "random"), (ordinary, "ordinary"))
    ]
    size = len(ALPHABET)
    pairs = docs.sparkSession.range(size * size).withColumnRenamed("id", "pair")
    grid = pairs.join(F.broadcast(counted[0]), "pair", "left").join(F.broadcast(counted[1]), "pair", "left")
    grid = grid.fillna(0, ["random", "ordinary"])
    grid = grid.withColumns({"a": F.floor(F.col("pair") / size), "b": F.col("pair") % size})
    names = ("random", "ordinary")
    before = grid.groupBy("a").agg(*(F.sum(c).alias(f"{c}_before") for c in names))
    after = grid.groupBy("b").agg(*(F.sum(c).alias(f"{c}_after") for c in names))
    whole = grid.agg(*(F.sum(c).alias(f"{c}_whole") for c in names))

    def share(c: str) -> Column:
        overall = (F.col(f"{c}_after") + 1) / (scalar(whole)[f"{c}_whole"] + size)
        return F.log((F.col(c) + PRIOR * overall) / (F.col(f"{c}_before") + PRIOR))

    # One row for each character of the alphabet.
    known = grid.join(F.broadcast(before), "a").join(F.broadcast(after), "b")
    scored = known.select("pair", (share("random") - share("ordinary")).alias("ratio"))
    listed = F.array_sort(F.collect_list(F.struct("pair", "ratio")))
    return scored.agg(F.transform(listed, lambda x: x["ratio"]).alias("ratios"))


def mean_ratio(value: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of a string's transitions."""

    def code(at: Column) -> Column:
        return F.call_function("instr", F.lit(ALPHABET), value.substr(at, F.lit(1))) - 1

    def step(total: Column, at: Column) -> Column:
        return total + F.element_at(ratios, (code(at) * len(ALPHABET) + code(at + 1) + 1).cast("int"))

    places = F.sequence(F.lit(1), F.length(value) - 1)
    return F.aggregate(places, F.lit(0.0), step) / (F.length(value) - 1)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, random_from: float = RANDOM_FROM) -> DataFrame:
    """Spans of secrets in every whole text; starts and ends in code points, ends exclusive.

    ``assign`` spans cover key word to value, ``access`` and ``hex`` their run;
    matches of one kind do not overlap. ``markov`` spans are other long strings
    that the random model explains better than the ordinary one by
    ``random_from`` per character; they never overlap the pattern matches, which
    all stay. What a pattern match leaves of a longer string is judged too, unless
    it is under ``CANDIDATE_CHARS``, as any string too short to tell. Returns ``doc_id, base, added``: arrays of spans
    (start, rank, end, kind, value) by start, then kind. Null text counts as
    empty and has none. One row per input row, repeated ones included; only
    ``doc_id`` and ``text`` are read; an empty table gives an empty result.
    """
    scanned = materialize(scan_patterns(docs), "secrets")
    return judged(scanned, materialize(ratio_table(docs, scanned), "ratios"), random_from)


def scan_patterns(docs: DataFrame) -> DataFrame:
    return base_spans(with_text(docs, F.col("doc_id").cast("long").alias("doc_id")), "doc_id")


def judged(scanned: DataFrame, table: DataFrame, random_from: float) -> DataFrame:
    """The candidates and rests that the one-row table of ratios calls random, as ``added``; other columns stay."""
    # Read as a scalar, and only where a text has candidates.
    held = F.when(F.size("candidates") + F.size("rests") > 0, scalar(table)["ratios"])
    likely = F.filter("candidates", lambda c: mean_ratio(c["value"], F.col("ratios")) >= random_from)
    rests = F.filter("rests", lambda r: mean_ratio(r["tried"], F.col("ratios")) >= random_from)
    added = F.array_sort(F.concat(likely, F.flatten(F.transform(rests, lambda r: r["parts"]))))
    return scanned.withColumn("ratios", held).withColumn("added", added).drop("candidates", "rests", "ratios")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document, from ``find_secrets``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the value of every span replaced; spans come by start and may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        low = F.greatest(s["end"] - F.length(s["value"]), done["at"])
        fresh = F.concat(done["out"], text.substr(done["at"] + 1, low - done["at"]), F.lit(mask))
        # A span that begins inside the one before only makes the masked stretch longer.
        overlaps = (done["at"] > 0) & (s["end"] - F.length(s["value"]) < done["at"])
        more = F.struct(s["end"].alias("at"), F.when(overlaps, done["out"]).otherwise(fresh).alias("out"))
        return F.when(s["end"] <= done["at"], done).otherwise(more)

    rest = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def without_secrets(docs: DataFrame, random_from: float = RANDOM_FROM, mask: str = "[SECRET]") -> DataFrame:
    """The documents with the value of every secret masked; all columns stay as they are but ``text``.

    Of an assignment only the value goes, so the key word remains. Null, empty
    and clean texts pass unchanged. One row per input row.
    """
    table = materialize(ratio_table(docs, materialize(scan_patterns(docs), "secrets")), "ratios")
    rows = with_text(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("body"))
    spans = judged(base_spans(rows, "row", "body"), table, random_from)
    text = masked(F.col("body"), F.array_sort(F.concat("base", "added")), mask)
    changed = spans.select("row", F.when(F.col("body").isNull(), F.col("body")).otherwise(text).alias("body"))
    return changed.select(*(F.col("body").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
