"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The characters Python's str.strip() removes.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

REGEX_SPECIAL = set(r".^$*+?{}[]\|()")


def as_column(value: str | Column) -> Column:
    """A column by its exact name, which may contain dots, or the expression itself."""
    return F.col(f"`{value}`") if isinstance(value, str) else value


def utc(value: str | Column) -> Column:
    """Strict timestamp; malformed text raises under ANSI."""
    return as_column(value).cast("timestamp")


def utc_lenient(value: str | Column) -> Column:
    """Timestamp, or NULL where the text cannot be parsed."""
    return F.try_to_timestamp(as_column(value).cast("string"))


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed whole days, rounded towards minus infinity, in exact integer arithmetic."""
    delta = F.unix_micros(utc(later)) - F.unix_micros(utc(earlier))
    return F.call_function("div", delta - F.pmod(delta, F.lit(MICROS_PER_DAY)), F.lit(MICROS_PER_DAY))


def strip(value: str | Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def present(value: str | Column) -> Column:
    """The value with NaN turned into NULL."""
    c = as_column(value).cast("double")
    return F.when(~F.isnan(c), c)


def missing(df: DataFrame, name: str) -> Column:
    """Whether a value is NULL or, in a column of floating point, NaN."""
    c = as_column(name)
    return c.isNull() | F.isnan(c) if df.schema[name].dataType.typeName() in ("double", "float") else c.isNull()


def at_least(value: str | Column, floor: float) -> Column:
    """The value, but no less than the floor; NULL stays NULL, which ``greatest`` alone would skip."""
    c = as_column(value)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def clamp(value: str | Column, low: float, high: float) -> Column:
    c = as_column(value)
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ladder_above(value: Column, steps: Iterable[tuple[float, str]], floor: str) -> Column:
    """First label whose threshold the value exceeds; steps run from high to low."""
    out = None
    for threshold, label in steps:
        test = value > F.lit(threshold)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(floor))


def ladder_below(value: Column, steps: Iterable[tuple[float, str]], ceiling: str) -> Column:
    """First label whose threshold the value stays under; steps run from low to high."""
    out = None
    for threshold, label in steps:
        test = value < F.lit(threshold)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(ceiling))


def lookup(value: str | Column, table: Mapping[str, int], default: int) -> Column:
    """A literal map lookup; the map is a constant of the program, never data."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(value)), F.lit(default))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found. Patterns without special characters are searched as plain text, which is faster."""
    special = [p for p in patterns if any(c in REGEX_SPECIAL for c in p)]
    found = contains_any(text, [p for p in patterns if p not in special])
    # (?d): a dot matches anything but a line feed.
    return found | text.rlike("(?d)" + "|".join(special)) if special else found


def array_spread(values: Column) -> Column:
    """Population standard deviation of an array of doubles, in one running pass."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(
            n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2")
        )

    return F.aggregate(values, start, step, lambda acc: F.sqrt(F.try_divide(acc["m2"], acc["n"])))


def scalar(one_row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery.

    Spark runs it once and fails if it has a second row, so global figures reach
    every task without a join and without passing through user code on the driver.
    """
    return one_row.select(F.struct("*").alias("s")).scalar()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison across engines.

    Engines round decimal ties differently, so this is plain arithmetic that gives
    the same bits everywhere. ``floor`` gives a long, so numbers whose digits no
    longer fit a double's 53 bits, NaN and the infinities pass as they are.
    """
    scale = 10.0**digits
    limit = F.lit(2.0**53 / scale)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]

    def exact(c: Column) -> Column:
        cut = F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
        return F.when(F.abs(c) < limit, cut).otherwise(c)

    return df.withColumns({c: exact(as_column(c)) for c in doubles}) if doubles else df
