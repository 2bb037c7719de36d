"""Scores of predictions, fold summaries and importance tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import at_least, ladder_above, ladder_below
from repo_signals.operators.ordering import top_n


def squared_log_error(actual: str | Column, predicted: str | Column) -> Column:
    """Squared error of ``log1p``; a negative prediction counts as zero, a missing one has no error."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.pow(F.log1p(at_least(p, 0.0)) - F.log1p(a), F.lit(2.0))


def rmsle(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Error over the ``n`` rows that have a prediction and a target; ``n_missing`` rows lack one."""
    error = squared_log_error(actual, predicted)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.count_if(error.isNull()).alias("n_missing"),
        F.sqrt(F.avg(error)).alias("rmsle"),
    )


def mean_predictions(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """Test rows of every fold, predicted by the train mean of the log target."""
    means = stats.select("fold", "train_mean")
    return blocks.join(F.broadcast(means), F.col("block") == F.col("fold")).withColumn(
        "predicted", F.expm1("train_mean")
    )


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population spread of the fold scores, and the scores in fold order."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "rmsle")))
    listed = F.transform(ordered, lambda e: F.format_string("%.4f", e["rmsle"]))
    return scores.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("rmsle").alias("mean_rmsle"),
        F.stddev_pop("rmsle").alias("std_rmsle"),
        F.concat_ws(", ", listed).alias("scores"),
    )


def improvement(score: Column, baseline: float = schema.BASELINE_RMSLE) -> Column:
    return (F.lit(baseline) - score) / F.lit(baseline) * 100


def holdout_gap(score: Column, baseline: float = schema.BASELINE_RMSLE) -> Column:
    return (score - F.lit(baseline)) / F.lit(baseline) * 100


def gap_band(gap: Column) -> Column:
    return ladder_above(gap, [(20.0, "large"), (10.0, "moderate")], "excellent")


def run_assessment(scores: DataFrame, baseline: float = schema.BASELINE_RMSLE) -> DataFrame:
    """Bands of each scored run: gain over the baseline, target ranges, generalisation gap."""
    score = F.col("rmsle")
    gain, gap = improvement(score, baseline), holdout_gap(score, baseline)
    out = scores.withColumns(
        {
            "improvement_pct": gain,
            "improvement_band": ladder_below(gain, [(5.0, "modest"), (15.0, "good")], "excellent"),
            "target_band_all": ladder_below(score, [(0.58, "excellent"), (0.63, "on_target")], "above_target"),
            "target_band_clean": ladder_below(score, [(0.58, "excellent"), (0.65, "on_target")], "above_target"),
            "gap_pct": gap,
            "gap_band": gap_band(gap),
            "is_valid": F.when(gap > 20, F.lit(0)).otherwise(F.lit(1)),
        }
    )
    return out.withColumns({f"vs_{stage}": score - F.lit(v) for stage, v in schema.STAGE_RMSLE.items()})


def importance_mean(per_fold: DataFrame) -> DataFrame:
    """Mean importance of each feature over the folds."""
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))


def importance_top(importance: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important features with rank and share of the shown total."""
    shown = top_n(importance, [F.desc("importance"), F.asc("feature")], n)
    return ranked_share(shown, "feature", "importance")


def ranked_share(shown: DataFrame, item: str, weight: str) -> DataFrame:
    """Rank and percentage within a list that is already cut to its length."""
    entry = F.struct((-F.col(weight)).alias("s"), F.col(item).alias("i"))
    listed = shown.agg(F.array_sort(F.collect_list(entry)).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, e: a - e["s"])
    return listed.select(total.alias("t"), F.posexplode("l")).select(
        (F.col("pos") + 1).alias("rank"),
        F.col("col.i").alias(item),
        (-F.col("col.s")).alias(weight),
        F.round(F.lit(100.0) * F.try_divide(-F.col("col.s"), F.col("t")), 2).alias("pct"),
    )


def family_rules(feature: str | Column, clean: bool = True) -> Mapping[str, Column]:
    """Which features belong to which family. Families may overlap.

    In the clean variant logged owner columns belong to none; otherwise every
    logged column that is no embedding counts as velocity.
    """
    f = F.col(feature) if isinstance(feature, str) else feature
    if clean:
        name, rule = "Velocity (Clean)", f.contains("per_day") & ~f.contains("star")
    else:
        name = "Velocity"
        rule = f.contains("per_day") | f.contains("ratio") | (f.startswith("log_") & ~f.contains("emb"))
    return {
        "Metadata": f.isin(schema.METADATA_FEATURES),
        "Embeddings": f.startswith("readme_emb_"),
        "Owner": f.startswith("owner_"),
        "Topic": f.startswith("topic_"),
        name: rule,
    }


def family_share(importance: DataFrame, rules: Mapping[str, Column], top: int | None = None) -> DataFrame:
    """Importance per family, over the ``top`` features if given, with its share of all families and its member count."""
    shown = importance if top is None else top_n(importance, [F.desc("importance"), F.asc("feature")], top)
    hit = [(name, F.coalesce(rule, F.lit(False))) for name, rule in rules.items()]
    weight = F.col("importance")
    row = shown.agg(
        *[F.coalesce(F.sum(F.when(h, weight)), F.lit(0.0)).alias(f"_w_{i}") for i, (_, h) in enumerate(hit)],
        *[F.count_if(h).alias(f"_n_{i}") for i, (_, h) in enumerate(hit)],
    )
    total = sum((F.col(f"_w_{i}") for i in range(len(hit))), F.lit(0.0))
    items = [
        F.struct(
            F.lit(name).alias("family"),
            F.col(f"_w_{i}").alias("importance"),
            F.round(F.lit(100.0) * F.try_divide(F.col(f"_w_{i}"), total), 1).alias("pct"),
            F.col(f"_n_{i}").alias("n_features"),
        )
        for i, (name, _) in enumerate(hit)
    ]
    return row.select(F.inline(F.array(*items))).orderBy(F.desc("importance"), "family")
