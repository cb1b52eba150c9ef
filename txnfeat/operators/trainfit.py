"""Statistics fitted on the training rows only: by group, as a small table that all splits are joined with.

Means and deviations are mergeable, and equal values are counted, so a group with most rows is combined in the tasks before the
shuffle. Quantiles are exact: the counts of a group's values are summed in their order by blocks, so no task holds all of them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flag
from ..session import shared_folder
from .blocks import running_sums

#: Groups up to so many are broadcast; more are joined in a shuffle.
BROADCAST_GROUPS = 250_000


def fit_groups(df: DataFrame, group: str, value: str, quantiles: dict[str, float], split: str = "split", train: str = "train") -> DataFrame:
    """group, n, mean, std and the named quantiles of `value` over the rows whose `split` is `train`.

    A null group is one of its own; null values don't count, and a group without any has n = 0 and nulls. The quantile q is the
    least value that at least a share q of the values don't exceed."""
    rows = df.where(F.col(split) == train)
    fitted = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"))
    if not quantiles:
        return fitted
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__key"), F.col(value).alias("__value")).agg(F.count("*").alias("times"))
    counts = _written(counts, "value-counts")
    run = with_groups(running_sums(counts, "__key", ("__value",), {"before": "times"}), counts.groupBy("__key").agg(F.sum("times").alias("n")), "__key")
    # Ranks are decimals: 0.99 * n in doubles may lie beyond a whole number.
    reached = lambda p: F.col("before") + F.col("times") >= F.ceil(F.col("fit_n").cast("decimal(19)") * F.lit(Decimal(repr(p))))
    found = run.groupBy("__key").agg(*(F.min(F.when(reached(p), F.col("__value"))).alias(k) for k, p in quantiles.items()))
    return _written(with_groups(fitted, found.withColumnRenamed("__key", group), group, ""), "fitted-groups")


def _written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table, where each use would compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_groups(df: DataFrame, fitted: DataFrame, group: str, prefix: str = "fit_") -> DataFrame:
    """`df` with the fitted columns of its group, null where the training rows have none. fitted: a row for each group."""
    other = fitted.select(F.col(group).alias("__group"), *(F.col(c).alias(prefix + c) for c in fitted.columns if c != group))
    few = other.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return df.join(F.broadcast(other) if few else other, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def add_amount_by_type(df: DataFrame, fitted: DataFrame | None = None, group: str = "type", amount: str = "amount") -> DataFrame:
    """amount_z_by_type and amount_pct_of_type_p99_flag: against the training rows of the same type.

    The z-score is null without a deviation above 0; the flag is 0 for a type that training hasn't seen. fitted: a table of
    fit_groups with p99 (as saved with a model), else it is fitted on the rows of `df` whose split is train."""
    fitted = fit_groups(df, group, amount, {"p99": 0.99}) if fitted is None else fitted
    out = with_groups(df, fitted, group, "__fit_")
    z = F.when(F.col("__fit_std") > 0, (F.col(amount) - F.col("__fit_mean")) / F.col("__fit_std"))
    return out.select(*df.columns, z.alias("amount_z_by_type"), flag(F.col(amount) > F.col("__fit_p99")).alias("amount_pct_of_type_p99_flag"))
