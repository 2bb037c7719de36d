"""Owner reputation, for training (from the rows) and for serving (from owner profiles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repo_signals import schema
from repo_signals.functions.columns import array_spread, contains_any, flag, scalar, utc, whole_days
from repo_signals.operators.prep import impute_median
from repo_signals.operators.skew import left_join_spread
from repo_signals.session import materialize


def is_organisation(login: str, repo_count: str) -> Column:
    named = contains_any(F.lower(F.col(login)), schema.ORG_KEYWORDS)
    return flag(named | (F.col(repo_count) > schema.ORG_REPO_COUNT))


def owner_totals(df: DataFrame, owner: str = "owner_login") -> DataFrame:
    """One row per owner from a single grouped aggregation, rows without an owner included.

    Date figures need ``created_at``, the latest ingestion needs ``ingested_at``.
    """
    stars, forks = F.col(schema.TARGET), F.col("forks_count")
    measures = [
        F.avg(stars).alias("owner_mean_stars"),
        F.sum(stars).alias("owner_total_stars"),
        F.count(stars).alias("owner_repo_count"),
        F.stddev_samp(stars).alias("owner_std_stars"),
        F.avg(forks).alias("owner_mean_forks"),
        F.sum(forks).alias("owner_total_forks"),
        F.avg(F.when(stars > schema.SUCCESS_STARS, F.lit(1.0)).otherwise(F.lit(0.0))).alias("owner_success_rate"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if "created_at" in df.columns:
        created = utc("created_at")
        measures += [F.min(created).alias("owner_first_repo"), F.max(created).alias("owner_last_repo")]
    if "ingested_at" in df.columns:
        measures.append(F.max(utc("ingested_at")).alias("last_seen"))
    totals = df.groupBy(owner).agg(*measures).withColumn("owner_is_org", is_organisation(owner, "owner_repo_count"))
    if "created_at" in df.columns:
        totals = totals.withColumn("owner_active_days", whole_days("owner_last_repo", "owner_first_repo"))
    return totals


def owner_reputation(df: DataFrame, owner: str = "owner_login", as_of: str | None = None) -> DataFrame:
    """One row per owner, from one pass over the rows.

    Tenure counts to ``as_of``; by default to the latest ``ingested_at``, so the
    result does not depend on the day it is computed. The row being predicted is
    part of its owner's figures, which for owners of one repository leaks the target.

    The totals are written once as a small table: the latest ingestion, the heavy
    owners and the medians are all taken from it, not from the rows again.
    """
    totals = materialize(owner_totals(df, owner), "owners")
    known = totals.where(F.col(owner).isNotNull()).drop("last_seen")
    if "owner_first_repo" not in known.columns:
        return known
    until = F.lit(as_of).cast("timestamp") if as_of else scalar(totals.agg(F.max("last_seen").alias("t")))["t"]
    return known.withColumn("owner_tenure_days", whole_days(until, "owner_first_repo"))


def owner_features(
    df: DataFrame,
    owner: str = "owner_login",
    row_id: str = "id",
    as_of: str | None = None,
) -> DataFrame:
    """Reputation joined back to the rows, gaps filled with row medians, skewed columns logged.

    A table without an owner column is returned as it is.
    """
    if owner not in df.columns:
        return df
    reputation = owner_reputation(df, owner, as_of)
    measures = [c for c in schema.OWNER_MEASURES if c in reputation.columns]
    joined = left_join_spread(df, reputation, owner, "n_rows", row_id).drop("n_rows")
    # The median over rows equals the median over owners weighted by their row counts.
    filled = impute_median(joined, measures, reputation, "n_rows")
    return filled.withColumn("owner_is_org", F.coalesce("owner_is_org", F.lit(0))).withColumns(
        {f"log_{c}": F.log1p(c) for c in schema.OWNER_LOGGED if c in measures}
    )


def earlier_sums(created: Column) -> dict[str, Column]:
    """Sums over rows from which the figures of an owner follow, whatever part of the rows they are taken over."""
    stars, forks = F.col(schema.TARGET).cast("double"), F.col("forks_count").cast("double")
    return {
        "_n": F.count(stars),
        "_stars": F.sum(stars),
        "_squares": F.sum(stars * stars),
        "_n_forks": F.count(forks),
        "_forks": F.sum(forks),
        "_rows": F.count(F.lit(1)),
        "_successes": F.count_if(stars > schema.SUCCESS_STARS),
        "_first": F.min(created),
    }


def owner_history(df: DataFrame, owner: str = "owner_login", at: str = "created_at", row_id: str = "id") -> DataFrame:
    """Figures of each row's owner over its earlier rows only, so the row itself leaks nothing.

    Earlier is by time, and by ``row_id`` among rows of one time. Returns one row
    per row: ``row_id, owner``, count, total, mean and sample deviation of stars,
    mean of forks, share of successes, and days since the first; all but count
    and total are NULL where there is nothing earlier, which includes rows
    without an owner.

    Rows are range-partitioned by owner, time and id. A running sum inside every
    partition is added to the sums of the owner's partitions before it, so an
    owner of very many rows is spread over as many tasks as it fills.
    """
    created = utc(at)
    columns = [row_id, owner, created.alias("_at"), schema.TARGET, "forks_count"]
    laid = df.select(*columns).where(F.col(owner).isNotNull()).repartitionByRange(owner, "_at", row_id)
    laid = materialize(laid.withColumn("_part", F.spark_partition_id()), "laid")
    sums = earlier_sums(F.col("_at"))
    # One row per owner and partition.
    parts = laid.groupBy(owner, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    before = W.partitionBy(owner).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    merge = {n: F.min(n) if n == "_first" else F.sum(n) for n in sums}
    starts = parts.select(owner, "_part", *[c.over(before).alias(f"{n}_start") for n, c in merge.items()])
    inside = W.partitionBy(owner, "_part").orderBy("_at", row_id).rowsBetween(W.unboundedPreceding, -1)
    placed = laid.withColumns({n: c.over(inside) for n, c in sums.items()}).join(starts, [owner, "_part"])

    def both(name: str) -> Column:
        if name == "_first":
            return F.least(f"{name}_start", name)
        return F.coalesce(name, F.lit(0)) + F.coalesce(f"{name}_start", F.lit(0))

    earlier = placed.select(row_id, owner, "_at", *[both(n).alias(n) for n in sums])
    n = F.col("_n")
    spread = F.greatest(F.lit(0.0), F.col("_squares") - F.try_divide(F.col("_stars") * F.col("_stars"), n))
    known = earlier.select(
        row_id,
        owner,
        n.alias("owner_prior_count"),
        F.col("_stars").alias("owner_prior_total_stars"),
        F.try_divide("_stars", n).alias("owner_prior_mean_stars"),
        F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("owner_prior_std_stars"),
        F.try_divide("_forks", "_n_forks").alias("owner_prior_mean_forks"),
        F.try_divide("_successes", "_rows").alias("owner_prior_success_rate"),
        whole_days("_at", "_first").alias("owner_prior_days"),
    )
    nobody = df.where(F.col(owner).isNull()).select(row_id, owner)
    nothing = {"owner_prior_count": F.lit(0).cast("long"), "owner_prior_total_stars": F.lit(0.0)}
    return known.unionByName(nobody.withColumns(nothing), allowMissingColumns=True)


def owner_leave_one_out(df: DataFrame, owner: str = "owner_login", row_id: str = "id") -> DataFrame:
    """Figures of each row's owner over its other rows: the row's own value is taken out of its owner's sums.

    Returns one row per row: ``row_id, owner``, count, total and mean of stars,
    mean of forks, share of successes; means and shares are NULL where there is
    no other row, which includes rows without an owner. Heavy owners are split.
    """
    stars, forks = F.col(schema.TARGET).cast("double"), F.col("forks_count").cast("double")
    success = F.when(stars > schema.SUCCESS_STARS, F.lit(1.0)).otherwise(F.lit(0.0))
    totals = df.where(F.col(owner).isNotNull()).groupBy(owner).agg(
        F.count(stars).alias("_n"),
        F.sum(stars).alias("_stars"),
        F.count(forks).alias("_n_forks"),
        F.sum(forks).alias("_forks"),
        F.sum(success).alias("_successes"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    rows = df.select(row_id, owner, stars.alias("_own_stars"), forks.alias("_own_forks"), success.alias("_own_success"))
    joined = left_join_spread(rows, materialize(totals, "owners"), owner, "n_rows", row_id)

    def rest(total: str, own: str) -> Column:
        return F.coalesce(total, F.lit(0.0)) - F.when(F.col(owner).isNotNull(), F.coalesce(own, F.lit(0.0))).otherwise(0.0)

    def others(count: str, own: str) -> Column:
        return F.coalesce(count, F.lit(0)) - flag(F.col(owner).isNotNull() & F.col(own).isNotNull())

    n_rows = F.coalesce("n_rows", F.lit(1)) - 1
    return joined.select(
        row_id,
        owner,
        others("_n", "_own_stars").alias("owner_loo_count"),
        rest("_stars", "_own_stars").alias("owner_loo_total_stars"),
        F.try_divide(rest("_stars", "_own_stars"), others("_n", "_own_stars")).alias("owner_loo_mean_stars"),
        F.try_divide(rest("_forks", "_own_forks"), others("_n_forks", "_own_forks")).alias("owner_loo_mean_forks"),
        F.try_divide(rest("_successes", "_own_success"), n_rows).alias("owner_loo_success_rate"),
    )


def listed_stats(repos: Column) -> dict[str, Column]:
    """Figures over the array of an owner's listed repositories; an empty list counts as one default entry."""
    default = F.array(
        F.struct(
            F.lit(schema.EMPTY_LIST_STARS).cast("long").alias("stargazers_count"),
            F.lit(schema.EMPTY_LIST_FORKS).cast("long").alias("forks_count"),
        )
    )
    listed = F.when(F.size(repos) > 0, repos).otherwise(default)
    stars = F.transform(listed, lambda r: F.coalesce(r["stargazers_count"], F.lit(0)).cast("double"))
    forks = F.transform(listed, lambda r: F.coalesce(r["forks_count"], F.lit(0)).cast("double"))
    n = F.size(listed)
    zero = F.lit(0.0)
    total_stars = F.aggregate(stars, zero, lambda a, x: a + x)
    total_forks = F.aggregate(forks, zero, lambda a, x: a + x)
    return {
        "owner_total_stars": total_stars,
        "owner_mean_stars": total_stars / n,
        "owner_std_stars": array_spread(stars),
        "owner_total_forks": total_forks,
        "owner_mean_forks": total_forks / n,
        "owner_success_rate": F.size(F.filter(stars, lambda x: x > schema.SUCCESS_STARS)) / n,
    }


def serving_owner_stats(profiles: DataFrame, listed: DataFrame, as_of: Column) -> DataFrame:
    """Owner figures of the serving side, from profiles and the repositories they list.

    ``profiles(owner_login, owner_type, public_repos, owner_created_at)`` is joined
    to the aggregate of ``listed(owner_login, stargazers_count, forks_count)``; the
    spread is the population one, and owners without a list get the default entry.
    """
    stars = F.coalesce("stargazers_count", F.lit(0))
    forks = F.coalesce("forks_count", F.lit(0))
    per_owner = listed.groupBy("owner_login").agg(
        F.count(F.lit(1)).alias("_listed"),
        F.sum(stars).alias("_stars"),
        F.avg(stars).alias("_mean_stars"),
        F.stddev_pop(stars).alias("_std_stars"),
        F.sum(forks).alias("_forks"),
        F.avg(forks).alias("_mean_forks"),
        F.count_if(stars > schema.SUCCESS_STARS).alias("_successes"),
    )
    count = F.coalesce("public_repos", "_listed", F.lit(0))
    tenure = F.coalesce(whole_days(as_of, "owner_created_at"), F.lit(0))
    out = profiles.join(per_owner, "owner_login", "left").select(
        "owner_login",
        F.coalesce("_mean_stars", F.lit(float(schema.EMPTY_LIST_STARS))).alias("owner_mean_stars"),
        F.coalesce("_stars", F.lit(schema.EMPTY_LIST_STARS).cast("long")).alias("owner_total_stars"),
        F.when(count == 0, F.lit(1)).otherwise(count).cast("long").alias("owner_repo_count"),
        F.coalesce("_std_stars", F.lit(0.0)).alias("owner_std_stars"),
        F.coalesce("_mean_forks", F.lit(float(schema.EMPTY_LIST_FORKS))).alias("owner_mean_forks"),
        F.coalesce("_forks", F.lit(schema.EMPTY_LIST_FORKS).cast("long")).alias("owner_total_forks"),
        tenure.alias("owner_tenure_days"),
        tenure.alias("owner_active_days"),
        (F.coalesce("_successes", F.lit(0)) / F.coalesce("_listed", F.lit(1))).alias("owner_success_rate"),
        flag(F.col("owner_type") == "Organization").alias("owner_is_org"),
    )
    return with_owner_logs(out)


def with_owner_logs(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_owner_total_stars": F.log1p(F.col("owner_total_stars")),
            "log_owner_repo_count": F.log1p(F.col("owner_repo_count")),
        }
    )


def owner_stats_or_default(
    df: DataFrame,
    stats: DataFrame,
    owner: str = "owner_login",
    row_id: str = "id",
) -> DataFrame:
    """Known owner figures where there are any, else the default profile as a whole.

    ``stats`` has one row per owner. The rows to be scored are counted per owner,
    as one that is heavy here may be light, or unknown, in the statistics.
    """
    figures = [F.col(c).cast("double").alias(c) for c in schema.OWNER_DEFAULTS]
    wanted = stats.select(owner, *figures, F.lit(1).alias("_known"))
    joined = left_join_spread(df, wanted, owner, None, row_id)
    known = F.col("_known").isNotNull()
    return with_owner_logs(
        joined.withColumns(
            {c: F.when(known, F.col(c)).otherwise(F.lit(v)) for c, v in schema.OWNER_DEFAULTS.items()}
        ).drop("_known")
    )
