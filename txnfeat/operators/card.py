"""Row-wise features of the card; families whose columns are absent are left out."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock_sin_cos, count_present, flag, log1p_floor, sha256_of
from ..specs import C_COLUMNS, D_COLUMNS, IDENTITY, INDICATORS, M_COLUMNS, NEAR_CONSTANT

#: The completeness of the identity block is a share of all its columns, present or not.
IDENTITY_SIZE = 40.0
NO_MIN, NO_MAX = 999999.0, -999999.0


def missingness_columns(columns: list[str]) -> dict[str, Column]:
    n = count_present([F.col(c) for c in IDENTITY if c in columns])
    return {
        "identity_nonnull_count": n,
        "has_identity_flag": flag(n > 0),
        "identity_completeness": n / F.lit(IDENTITY_SIZE),
        **{f"ind_{name}": flag(F.col(c).isNotNull()) for name, c in INDICATORS.items() if c in columns},
    }


def proxy_columns(columns: list[str]) -> dict[str, Column]:
    """Keys of a card and of a card at an address; null and absent parts are 'NA'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) if c in columns else F.lit("NA")
    card = sha256_of("_", *(part(f"card{i}") for i in range(1, 7)))
    return {"card_proxy_id": card, "card_addr_proxy_id": sha256_of("_", card, part("addr1"))}


def temporal_columns(train_max_day: float = 130.0) -> dict[str, Column]:
    t = F.col("TransactionDT")
    hour = (F.floor(t / 3600) % 24).cast("int")
    day = F.floor(t / 86400).cast("int")
    sin, cos = clock_sin_cos(hour)
    return {
        "hour_of_day": hour,
        "hour_sin": sin,
        "hour_cos": cos,
        "day_index": day,
        "day_of_week_rel": day % 7,
        "history_window_complete_flag": flag(day >= 7),
        "split": F.when(t <= train_max_day * 86400, "train").otherwise("valid"),
    }


def amount_columns() -> dict[str, Column]:
    a = F.col("TransactionAmt")
    return {
        "amt_log1p": log1p_floor(a),
        "amt_cents": F.round((a - F.floor(a)) * 100).cast("int"),
        "amt_decimals_gt2_flag": flag(F.abs(a * 100 - F.round(a * 100)) > 1e-4),
        "amt_is_whole_flag": flag(a == F.floor(a)),
    }


def masked_columns(columns: list[str]) -> dict[str, Column]:
    """Counts and extremes over the masked families M, C and D."""
    ms, cs, ds = ([c for c in family if c in columns] for family in (M_COLUMNS, C_COLUMNS, D_COLUMNS))
    out: dict[str, Column] = {}
    total = lambda xs: reduce(add, xs)
    if ms:
        out |= {f"m_{name}_cnt": total([F.when(test(F.col(c)), 1).otherwise(0) for c in ms]).cast("int") for name, test in (("true", lambda c: c == "T"), ("false", lambda c: c == "F"), ("null", lambda c: c.isNull()))}
    if cs:
        zeroed = [F.coalesce(F.col(c), F.lit(0.0)) for c in cs]
        out |= {"c_sum_log1p": log1p_floor(total(zeroed)), "c_nonzero_cnt": total([F.when(F.col(c) > 0, 1).otherwise(0) for c in cs]).cast("int"), "c_max": F.greatest(*zeroed) if len(cs) > 1 else zeroed[0]}
    if ds:
        several = len(ds) > 1
        out |= {"d_nonnull_cnt": count_present([F.col(c) for c in ds])}
        out |= {"d_min": F.least(*(F.coalesce(F.col(c), F.lit(NO_MIN)) for c in ds)) if several else F.col(ds[0]), "d_max": F.greatest(*(F.coalesce(F.col(c), F.lit(NO_MAX)) for c in ds)) if several else F.col(ds[0])}
    return out


def add_card_rowwise(df: DataFrame, train_max_day: float = 130.0) -> DataFrame:
    """All row-wise features in one projection, also where the frame has hundreds of columns."""
    return df.withColumns(missingness_columns(df.columns) | proxy_columns(df.columns) | temporal_columns(train_max_day) | amount_columns() | masked_columns(df.columns))


def prune_near_constant(df: DataFrame) -> DataFrame:
    """Without the near-constant columns; indicators must be derived before."""
    return df.drop(*NEAR_CONSTANT)
