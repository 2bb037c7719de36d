"""The leakage audit: table profile, correlations with the target, dates, distributions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repo_signals import schema
from repo_signals.functions.columns import as_column, flag, ladder_above, missing, present, scalar, utc, utc_lenient
from repo_signals.operators.ordering import hash_sample
from repo_signals.operators.quantiles import count_values, quantiles_of
from repo_signals.session import materialize

HISTOGRAM_BINS = 100
KDE_GRID = 200


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def stacked(
    rows: DataFrame, fields: Sequence[tuple[str, dict[str, Column]]], name: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Turn each aggregate row into one row per listed item."""
    items = [F.struct(F.lit(item).alias(name), *[c.alias(k) for k, c in cols.items()]) for item, cols in fields]
    return rows.select(*keep, F.inline(F.array(*items)))


# --- table profile -----------------------------------------------------------------------------


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(", ".join(df.columns)).alias("columns")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with NULL or NaN, their count and percentage, most first, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(df, c)).alias(f"_null_{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        (c, {"null_count": F.col(f"_null_{i}"), "_rows": F.col("_rows")}) for i, c in enumerate(df.columns)
    ]
    percent = F.round(F.lit(100.0) * F.col("null_count") / F.col("_rows"), 2)
    found = stacked(counts, rows, "column").where(F.col("null_count") > 0)
    return found.select("column", "null_count", percent.alias("null_pct")).orderBy(F.desc("null_count"), "column")


def category_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Per text column the number of distinct values and the most frequent ones.

    All columns are counted in one shuffle of (column, value) partial counts. The
    rank filter keeps ``top`` rows per column in each task before values meet.
    """
    names = list(columns or text_columns(df))
    n_rows = scalar(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    cells = [F.struct(F.lit(c).alias("column"), as_column(c).alias("value")) for c in names]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Looking at n keeps the counts of this branch identical, so that their shuffle is done once for both.
    distinct = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
    frequent = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    shown = counts.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= top)
    return shown.join(F.broadcast(distinct), "column").select(
        "column", "n_unique", "rank", "value", "n", F.round(F.lit(100.0) * F.col("n") / n_rows, 2).alias("pct")
    )


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = [c for c in (columns or schema.DATE_COLUMNS) if c in df.columns]
    parsed = df.select([parsed_date(df, c).alias(c) for c in names])
    ends = parsed.agg(
        *[f(c).alias(f"{p}_{c}") for c in names for f, p in ((F.min, "min"), (F.max, "max"))]
    )
    rows = [(c, {"min_date": F.col(f"min_{c}"), "max_date": F.col(f"max_{c}")}) for c in names]
    return stacked(ends, rows, "column").where(F.col("min_date").isNotNull())


def parsed_date(df: DataFrame, name: str) -> Column:
    """Dates that are text are parsed leniently, as an audit must survive bad values."""
    return utc_lenient(name) if isinstance(df.schema[name].dataType, T.StringType) else utc(name)


def target_summary(df: DataFrame, column: str = schema.TARGET) -> DataFrame:
    """Count, mean, extremes, median and 99th percentile, all from the value counts of one pass."""
    counted = count_values(df, [column])
    value, times = F.col("value"), F.col("_w")
    basic = counted.agg(
        F.coalesce(F.sum(times), F.lit(0)).alias("n"),
        F.try_divide(F.sum(value * times), F.sum(times)).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quantiles = scalar(
        quantiles_of(counted, [0.5, 0.99]).agg(
            F.max(F.when(F.col("prob") == 0.5, value)).alias("median"),
            F.max(F.when(F.col("prob") == 0.99, value)).alias("q99"),
        )
    )
    return basic.withColumns({"median": quantiles["median"], "q99": quantiles["q99"]})


# --- correlations ------------------------------------------------------------------------------


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """One short row ``(*by, _pair, _x, _y)`` per table row and pair whose first column is known.

    They are summed in place, so the query stays the same size for any number of
    columns. One aggregation with all pairs side by side takes more than twice as
    long, as its code grows beyond what the JVM compiles.
    """
    cells = [
        F.struct(F.lit(i).alias("_pair"), present(a).alias("_x"), present(b).alias("_y"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.select(*by, F.inline(F.array(*cells))).where(F.col("_x").isNotNull())


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of column pairs, over the rows where both are known.

    Rows ``(*by, _pair, correlation, n_equal)``, ``_pair`` being the position in
    ``pairs``; a pair whose first column has no value at all is left out. A single
    set of moments per pair is shuffled. A constant column gives NULL: the built-in
    ``corr`` would divide by zero under ANSI.
    """
    x, y = F.col("_x"), F.col("_y")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(y)
    return (
        pair_cells(df, pairs, by)
        .groupBy(*by, "_pair")
        .agg(F.try_divide(F.covar_pop(x, y), spread).alias("correlation"), F.count_if(x == y).alias("n_equal"))
    )


def pair_moments(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Count, means and centred sums of products, ``(*by, _pair, n, mean_x, mean_y, xx, yy, xy)``, over rows where both are known."""
    x, y, n = F.col("_x"), F.col("_y"), F.count(F.lit(1))
    return (
        pair_cells(df, pairs, by)
        .where(y.isNotNull())
        .groupBy(*by, "_pair")
        .agg(
            n.alias("n"),
            F.avg(x).alias("mean_x"),
            F.avg(y).alias("mean_y"),
            (F.var_pop(x) * n).alias("xx"),
            (F.var_pop(y) * n).alias("yy"),
            (F.covar_pop(x, y) * n).alias("xy"),
        )
    )


def merged_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moments of several parts taken together, for each pair and ``by``."""
    keys = [*by, "_pair"]

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name) * F.col("n")), F.sum("n"))

    middle = parts.groupBy(*keys).agg(mean("mean_x").alias("_mx"), mean("mean_y").alias("_my"))
    dx, dy, n = F.col("mean_x") - F.col("_mx"), F.col("mean_y") - F.col("_my"), F.col("n")
    return (
        parts.join(middle, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("xx") + n * dx * dx).alias("xx"),
            F.sum(F.col("yy") + n * dy * dy).alias("yy"),
            F.sum(F.col("xy") + n * dx * dy).alias("xy"),
        )
    )


def moment_correlation() -> Column:
    """Pearson correlation from centred sums; NULL for a constant column."""
    return F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))


def pick(names: Sequence[str]) -> Column:
    """The name at the position of the pair."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.col("_pair"))


def correlations(df: DataFrame, target: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(feature, correlation, n_equal)`` of every column with a value against the target, in one pass."""
    found = pair_correlations(df, [(c, target) for c in columns], by)
    return found.select(*by, pick(columns).alias("feature"), "correlation", "n_equal")


def leakage_correlations(df: DataFrame, target: str = schema.TARGET, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each numeric column with the target, and its risk band, strongest first."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    size = F.abs("correlation")
    return (
        correlations(df, target, names)
        .drop("n_equal")
        .withColumn("abs_correlation", size)
        .withColumn("risk", ladder_above(F.col("abs_correlation"), schema.RISK_BANDS, schema.RISK_FLOOR))
        .orderBy(F.desc_nulls_last("abs_correlation"), "feature")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The lower triangle, one row per pair, from one pass over the table."""
    pairs = [(b, a) for a, b in combinations(columns or numeric_columns(df), 2)]
    return pair_correlations(df, pairs).select(
        pick([a for a, _ in pairs]).alias("feature_a"), pick([b for _, b in pairs]).alias("feature_b"), "correlation"
    )


def target_correlation(df: DataFrame, columns: Sequence[str], target: str = schema.LOG_TARGET) -> DataFrame:
    return correlations(df, target, columns).drop("n_equal").orderBy(F.desc_nulls_last("correlation"), "feature")


def mirror_check(df: DataFrame, column: str = "watchers_count", target: str = schema.TARGET) -> DataFrame:
    """Whether a column merely repeats the target."""
    x, y = as_column(column), as_column(target)
    gap = F.abs(x - y)
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return df.agg(
        F.try_divide(F.covar_pop(x, y), spread).alias("correlation"),
        (F.lit(100.0) * F.try_divide(F.count_if(x == y), F.count(F.lit(1)))).alias("exact_match_pct"),
        F.max(gap).cast("double").alias("max_difference"),
        F.avg(gap).alias("mean_difference"),
    ).withColumn(
        "leaks",
        flag((F.coalesce("correlation", F.lit(0.0)) > 0.99) | (F.coalesce("exact_match_pct", F.lit(0.0)) > 95)),
    )


def names_by_strength(threshold: float) -> Column:
    """Aggregate: the features whose |r| exceeds the threshold, strongest first, as text."""
    ranked = F.struct((-F.col("abs_correlation")).alias("s"), F.col("feature").alias("f"))
    strong = F.when(F.col("abs_correlation") > threshold, ranked)
    return F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(strong)), lambda e: e["f"]))


def risk_lists(ranked: DataFrame) -> DataFrame:
    """Names of the features above each of the two upper risk thresholds. One row per column is gathered."""
    bands = schema.RISK_BANDS[:2]
    row = ranked.agg(
        *[names_by_strength(t).alias(f"_names_{label}") for t, label in bands],
        *[F.count_if(F.col("abs_correlation") > t).alias(f"_n_{label}") for t, label in bands],
    )
    items = [(label, {"features": F.col(f"_names_{label}"), "n": F.col(f"_n_{label}")}) for _, label in bands]
    return stacked(row, items, "band").where(F.col("n") > 0)


# --- dates -------------------------------------------------------------------------------------


def future_dates(df: DataFrame, columns: Sequence[str] | None = None, reference: str = "ingested_at") -> DataFrame:
    """Per date column the rows that lie after the latest ingestion."""
    names = [c for c in (columns or schema.DATE_COLUMNS) if c in df.columns and c != reference]
    latest = scalar(df.agg(F.max(parsed_date(df, reference)).alias("t")))["t"]
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(parsed_date(df, c) > latest).alias(f"_late_{i}") for i, c in enumerate(names)],
        *[F.count(parsed_date(df, c)).alias(f"_known_{i}") for i, c in enumerate(names)],
    )
    rows = [
        (
            c,
            {
                "n_future": F.col(f"_late_{i}"),
                "future_pct": F.round(F.lit(100.0) * F.col(f"_late_{i}") / F.col("_rows"), 2),
                "_known": F.col(f"_known_{i}"),
            },
        )
        for i, c in enumerate(names)
    ]
    return stacked(row, rows, "column").where(F.col("_known") > 0).drop("_known")


# --- feature lists -----------------------------------------------------------------------------


def name_verdict(column: str, parts: Sequence[str] = schema.LEAK_NAME_PARTS) -> str:
    if column in schema.NOT_FEATURES:
        return "skipped"
    return "excluded" if any(p in column.lower() for p in parts) else "safe"


def safe_features(
    df: DataFrame,
    target: str = schema.TARGET,
    parts: Sequence[str] = schema.LEAK_NAME_PARTS,
) -> DataFrame:
    """One row per candidate column: the verdict by name next to what the data say."""
    names = [c for c in df.columns if name_verdict(c, parts) != "skipped"]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(df, c)).alias(f"_null_{i}") for i, c in enumerate(names)],
    )
    items = [
        (c, {"verdict": F.lit(name_verdict(c, parts)), "_nulls": F.col(f"_null_{i}"), "_rows": F.col("_rows")})
        for i, c in enumerate(names)
    ]
    strength = correlations(df, target, [c for c in numeric_columns(df) if c in names])
    percent = F.lit(100.0) / F.col("_rows")
    return (
        stacked(counts, items, "feature")
        .join(F.broadcast(strength), "feature", "left")
        .select(
            "feature",
            "verdict",
            F.round(percent * F.col("_nulls"), 2).alias("null_pct"),
            F.abs("correlation").alias("abs_correlation"),
            F.round(percent * F.col("n_equal"), 2).alias("match_pct"),
        )
    )


def leak_guard(df: DataFrame, features: Sequence[str], target: str = schema.TARGET) -> DataFrame:
    """One row per model feature: dropped if it is known to be computed from the target, or correlates like it."""
    have = [f for f in features if f in df.columns]
    judged = [c for c in numeric_columns(df) if c in have and c != target]
    named = F.array(*[F.lit(f) for f in schema.LEAKING_FEATURES])
    listed = df.sparkSession.createDataFrame([(c,) for c in judged], "feature string")
    # A column without any value has no correlation and still a verdict.
    verdicts = (
        F.broadcast(listed)
        .join(F.broadcast(correlations(df, target, judged)), "feature", "left")
        .withColumn("abs_correlation", F.abs("correlation"))
        .withColumn("named", flag(F.array_contains(named, F.col("feature"))))
        .withColumn("critical", flag(F.col("abs_correlation") > schema.RISK_BANDS[0][0]))
    )
    return verdicts.select(
        "feature", "abs_correlation", "named", "critical", (F.lit(1) - F.greatest("named", "critical")).alias("kept")
    )


def drop_leaks(df: DataFrame, features: Sequence[str], target: str = schema.TARGET) -> list[str]:
    """The features that survive the guard, text columns included. One row per column reaches the driver."""
    dropped = {r.feature for r in leak_guard(df, features, target).where("kept = 0").collect()}
    return [f for f in features if f in df.columns and f not in dropped and f != target]


# --- distributions -----------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, weight: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range, empty ones included; the top edge belongs to the last bin.

    A constant column gets a range one unit wide. ``weight`` counts a row several times.
    """
    x = present(column)
    half = F.when(F.col("a") == F.col("b"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    span = scalar(ends.select((F.col("a") - half).alias("lo"), (F.col("b") + half).alias("hi")))
    width = (span["hi"] - span["lo"]) / bins
    index = F.least(F.lit(bins - 1), F.floor((x - span["lo"]) / (span["hi"] - span["lo"]) * bins)).cast("int")
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    filled = df.where(x.isNotNull()).groupBy(index.alias("bin")).agg(times.alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(filled), "bin", "left").select(
        "bin",
        (span["lo"] + F.col("bin") * width).alias("low"),
        (span["lo"] + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def target_histogram(
    df: DataFrame,
    column: str = schema.TARGET,
    bins: int = HISTOGRAM_BINS,
    view: float = 0.99,
) -> DataFrame:
    """The histogram over the full range, with a mark on the bins that start within the viewed quantile."""
    counted = count_values(df, [column])
    edge = scalar(quantiles_of(counted, [view]).select("value"))["value"]
    return histogram(counted, "value", bins, "_w").withColumn("in_view", flag(F.col("low") <= edge))


def density_curve(df: DataFrame, column: str, grid: int = KDE_GRID) -> DataFrame:
    """Gaussian kernel density at ``grid`` points between the extremes, Scott's bandwidth.

    One pass counts equal values; every distinct value then adds its kernel to all
    grid points inside its own task, so only ``grid`` partial sums per task are
    shuffled and no value is approximated. A constant column has no density.
    """
    counted = count_values(df, [column])
    x, w = F.col("value"), F.col("_w")
    ends = scalar(
        counted.agg(
            F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(w).alias("n"), (F.sum(x * w) / F.sum(w)).alias("mean")
        )
    )
    n = ends["n"].cast("double")
    squares = scalar(counted.agg(F.sum(w * F.pow(x - ends["mean"], F.lit(2.0))).alias("sum")))["sum"]
    bandwidth = F.sqrt(F.try_divide(squares, n - 1)) * F.pow(n, F.lit(-0.2))
    step = (ends["hi"] - ends["lo"]) / (grid - 1)
    z = F.try_divide(F.col("grid_x") - x, F.col("h"))
    return (
        counted.select("value", "_w", bandwidth.alias("h"), ends["lo"].alias("lo"), step.alias("step"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
        .withColumn("grid_x", F.col("lo") + F.col("point") * F.col("step"))
        .groupBy("point")
        .agg(F.first("grid_x").alias("grid_x"), F.sum(F.try_divide(w * F.exp(-z * z / 2), F.col("h"))).alias("mass"))
        .select("point", "grid_x", (F.col("mass") / (n * F.sqrt(2 * F.pi()))).alias("density"))
    )


def binned_density(df: DataFrame, column: str, grid: int = KDE_GRID, tolerance: float = 1e-10) -> DataFrame:
    """``density_curve`` from weights in narrow bins: its work does not depend on the number of distinct values.

    Every value is shared out between the two bin edges around it in proportion
    to its distance. For bins of width d that changes a kernel of bandwidth h by
    no more than d^2/8 times its greatest curvature, which is its peak over h^2;
    the width is chosen so that this stays below ``tolerance`` times the peak.
    Kernels end at eight bandwidths, where they are 1e-14 of their peak.
    """
    x = present(column)
    first = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.stddev_samp(x).alias("s"))
    spread = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    ends = scalar(materialize(first.withColumn("h", F.when(spread > 0, spread)), "ends"))
    h, lo = ends["h"], ends["lo"]
    width = h * F.lit((8 * tolerance) ** 0.5)
    place = F.try_divide(x - lo, width)
    share = place - F.floor(place)
    edges = F.array(
        F.struct(F.floor(place).alias("bin"), (F.lit(1.0) - share).alias("w")),
        F.struct((F.floor(place) + 1).alias("bin"), share.alias("w")),
    )
    bins = df.where(place.isNotNull()).select(F.inline(edges)).groupBy("bin").agg(F.sum("w").alias("w")).where("w > 0")
    step = (ends["hi"] - lo) / (grid - 1)
    at = F.col("bin") * width
    reach = F.lit(8.0) * h
    low = F.greatest(F.lit(0), F.ceil((at - reach) / step))
    high = F.least(F.lit(grid - 1), F.floor((at + reach) / step))
    points = bins.select("w", at.alias("at"), F.explode(F.when(low <= high, F.sequence(low, high))).alias("point"))
    z = (F.col("point") * step - F.col("at")) / h
    mass = points.groupBy("point").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("mass"))
    curve = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point")).join(F.broadcast(mass), "point", "left")
    scale = ends["n"] * h * F.sqrt(2 * F.pi())
    return curve.select(
        "point", (lo + F.col("point") * step).alias("grid_x"), (F.coalesce("mass", F.lit(0.0)) / scale).alias("density")
    )


def scatter_sample(
    df: DataFrame,
    x: str = "watchers_count",
    y: str = schema.TARGET,
    key: str = "id",
    rows: int = 10000,
    seed: int = 42,
) -> DataFrame:
    """A sample of points and the end of the identity line through them."""
    sample = hash_sample(df.select(key, x, y), key, rows=rows, seed=seed)
    ends = scalar(sample.agg(F.greatest(F.max(x), F.max(y)).alias("end")))
    return sample.withColumn("line_end", ends["end"])


# --- the whole audit ---------------------------------------------------------------------------


def audit_report(df: DataFrame, target: str = schema.TARGET, mirror: str = "watchers_count") -> DataFrame:
    """Every section of the audit as ``(section, key, value)`` text.

    Two passes: one with counts and dates, one with the moments of every column.
    """
    dates = [c for c in schema.DATE_COLUMNS if c in df.columns]
    latest = parsed_date(df, "ingested_at") if "ingested_at" in dates else F.lit(None).cast("timestamp")
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(df, c)).alias(f"_null_{i}") for i, c in enumerate(df.columns)],
        F.max(latest).alias("_latest"),
    )
    mirrors = (F.col("feature") == mirror) & (F.col("correlation") > 0.99)
    leaks = scalar(
        leakage_correlations(df, target).agg(
            names_by_strength(schema.RISK_BANDS[0][0]).alias("critical"),
            names_by_strength(schema.RISK_BANDS[1][0]).alias("high"),
            F.when(F.count_if(mirrors) > 0, "True").otherwise("False").alias("mirror"),
        )
    )
    n_null = sum((flag(F.col(f"_null_{i}") > 0) for i in range(len(df.columns))), F.lit(0))
    verdicts = {v: [c for c in df.columns if name_verdict(c) == v] for v in ("safe", "excluded")}
    entries = [
        ("data_quality", "total_rows", F.col("_rows").cast("string")),
        ("data_quality", "total_cols", F.lit(str(len(df.columns)))),
        ("data_quality", "categorical_cols", F.lit(str(len(text_columns(df))))),
        ("data_quality", "null_columns", n_null.cast("string")),
        ("feature_leakage", "critical_features", leaks["critical"]),
        ("feature_leakage", "high_risk_features", leaks["high"]),
        ("feature_leakage", "watchers_leakage", leaks["mirror"] if mirror in df.columns else F.lit("None")),
        ("temporal_integrity", "date_columns", F.lit(", ".join(dates))),
        ("temporal_integrity", "ingestion_max", F.coalesce(F.date_format("_latest", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))),
        ("safe_features", "safe_features", F.lit(", ".join(verdicts["safe"]))),
        ("safe_features", "excluded_features", F.lit(", ".join(verdicts["excluded"]))),
    ]
    items = [
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.alias("value")) for s, k, v in entries
    ]
    return row.select(F.inline(F.array(*items)))


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines, ready for a text sink."""
    return report.select(F.format_string("[%s] %s: %s", "section", "key", "value").alias("value"))
