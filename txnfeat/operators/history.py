"""Strictly-prior history of an entity: cumulative and rolling aggregates that never see the row itself.

One operator serves both datasets. With a tie-break column the history has a total order, and a row sees earlier rows of
its own clock value; without one, rows of equal clock don't see each other. Rolling counts look at the clock alone: a row
exactly `width` old counts, one of the same clock value doesn't.

All frames share one partitioning and one sort: those ordered by (clock, tie-break) are declared before those ordered by
the clock, whose order they satisfy, so the plan has one exchange and one sort per entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag


@dataclass(frozen=True)
class History:
    """Names of the entity, clock, amount and (for a total order) tie-break columns, and of the outputs."""

    entity: str
    clock: str
    amount: str
    tie_break: str | None = None
    names: dict[str, str] = field(default_factory=dict)  # of count, first, sum, mean, std, max, since, zscore
    rolling_counts: dict[str, int] = field(default_factory=dict)  # name: width in clock units
    rolling_sums: dict[str, int] = field(default_factory=dict)
    shares: dict[str, Column] = field(default_factory=dict)  # name: predicate, as a share of prior rows


def add_history(df: DataFrame, h: History, min_count: int = 3, min_std: float = 1e-5) -> DataFrame:
    """The columns of `df` and the history's. Sum is 0.0 without prior rows; mean, std (of 2 and more), max, since and
    shares are null; the z-score needs `min_count` prior rows and a std over `min_std`. Null amounts count as rows only."""
    by = Window.partitionBy(h.entity)
    if h.tie_break:
        prior = by.orderBy(h.clock, h.tie_break).rowsBetween(Window.unboundedPreceding, -1)
        last = F.lag(h.clock, 1).over(by.orderBy(h.clock, h.tie_break))
    else:
        prior = by.orderBy(h.clock).rangeBetween(Window.unboundedPreceding, -1)
        last = F.max(h.clock).over(prior)
    n, mean, std = h.names["count"], h.names["mean"], h.names["std"]
    cumulative = {
        n: F.count(F.lit(1)).over(prior).cast("int"),
        h.names["sum"]: F.coalesce(F.sum(h.amount).over(prior), F.lit(0.0)),
        mean: F.avg(h.amount).over(prior),
        std: F.stddev(h.amount).over(prior),
        h.names["max"]: F.max(h.amount).over(prior),
        "__last": last,
        **{f"__{k}": F.sum(F.when(p, 1).otherwise(0)).over(prior) for k, p in h.shares.items()},
    }
    rolling = {}
    for name, width in {**h.rolling_counts, **h.rolling_sums}.items():
        frame = by.orderBy(h.clock).rangeBetween(-width, -1)
        rolling[name] = F.count(F.lit(1)).over(frame).cast("int") if name in h.rolling_counts else F.coalesce(F.sum(h.amount).over(frame), F.lit(0.0))
    out = df.select("*", *(c.alias(k) for k, c in cumulative.items())).select("*", *(c.alias(k) for k, c in rolling.items()))
    seen = F.col(n) > 0
    return out.select(
        *(c for c in out.columns if not c.startswith("__")),
        flag(F.col(n) == 0).alias(h.names["first"]),
        F.when(seen, F.col(h.clock) - F.col("__last")).cast("int").alias(h.names["since"]),
        F.when((F.col(n) >= min_count) & (F.col(std) > min_std), (F.col(h.amount) - F.col(mean)) / F.col(std)).alias(h.names["zscore"]),
        *(F.when(seen, F.col(f"__{k}") / F.col(n)).alias(k) for k in h.shares),
    )


LEDGER = History(
    "nameDest", "step", "amount",
    names={"count": "dest_prior_txn_count", "first": "dest_first_seen_flag", "sum": "dest_prior_amount_sum", "mean": "dest_prior_amount_mean", "std": "dest_prior_amount_std", "max": "dest_prior_amount_max", "since": "dest_steps_since_last_txn", "zscore": "dest_amount_zscore"},
    rolling_counts={"dest_txn_count_prev_24h": 24, "dest_txn_count_prev_168h": 168},
    rolling_sums={"dest_amount_sum_prev_24h": 24, "dest_amount_sum_prev_168h": 168},
)
CARD = History(
    "card_proxy_id", "TransactionDT", "TransactionAmt", tie_break="TransactionID",
    names={"count": "card_prior_txn_count", "first": "card_first_seen_flag", "sum": "card_prior_amt_sum", "mean": "card_prior_amt_mean", "std": "card_prior_amt_std", "max": "card_prior_amt_max", "since": "card_secs_since_last_txn", "zscore": "amt_zscore_vs_card"},
    rolling_counts={"card_txn_count_1h": 3600, "card_txn_count_24h": 86400, "card_txn_count_7d": 604800},
)


def add_ledger_history(df: DataFrame) -> DataFrame:
    from dataclasses import replace

    return add_history(df, replace(LEDGER, shares={"dest_prior_cashout_share": F.col("type") == "CASH_OUT"}))


def add_card_history(df: DataFrame) -> DataFrame:
    return add_history(df, CARD)
