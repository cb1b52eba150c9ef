"""Row-wise features of the ledger, each family in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock_sin_cos, flag, log1p_floor, safe_ratio, sha256_of
from ..specs import LEDGER_TYPES

COMPLETE_FROM_STEP = 169


def temporal_columns(columns: list[str]) -> dict[str, Column]:
    hour = F.col("step_hour").cast("int") if "step_hour" in columns else (F.col("step") % 24).cast("int")
    sin, cos = clock_sin_cos(hour)
    txn = F.col("txn_id") if "txn_id" in columns else sha256_of("|", *(F.col(c) for c in ("step", "type", "amount", "nameOrig", "nameDest")))
    return {
        "txn_id": txn,
        "step_hour": hour,
        "hour_sin": sin,
        "hour_cos": cos,
        "sim_day": F.floor((F.col("step") - 1) / 24).cast("int"),
        "history_window_complete_flag": flag(F.col("step") >= COMPLETE_FROM_STEP),
        **{f"type_{t.lower()}": flag(F.col("type") == t) for t in LEDGER_TYPES},
    }


def split_column(train_max: int = 500, valid_max: int = 600) -> Column:
    """train up to train_max, valid up to valid_max, else test; a null step is test."""
    return F.when(F.col("step") <= train_max, "train").when(F.col("step") <= valid_max, "valid").otherwise("test")


def amount_columns(include_tier_b: bool = True) -> dict[str, Column]:
    amount, orig, dest = F.col("amount"), F.col("oldbalanceOrg"), F.col("oldbalanceDest")
    out = {
        "amount_log1p": log1p_floor(amount),
        "amount_zero_flag": flag(amount == 0.0),
        "amt_to_oldbalOrg": safe_ratio(amount, orig + 1.0),
        "amt_to_oldbalDest": safe_ratio(amount, dest + 1.0),
        "orig_drain_flag": flag((orig > 0) & (F.abs(amount - orig) < 0.005)),
        "amount_exceeds_orig_balance_flag": flag(amount > orig),
        "orig_balance_zero_flag": flag(orig == 0.0),
        "dest_balance_zero_flag": flag((dest == 0.0) & (F.col("type") != "PAYMENT")),
    }
    if include_tier_b:
        out |= {
            "err_balance_orig": F.col("newbalanceOrig") + amount - orig,
            "err_balance_dest": dest + amount - F.col("newbalanceDest"),
            "orig_new_balance_zero_flag": flag(F.col("newbalanceOrig") == 0.0),
        }
    return out


def add_ledger_temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(temporal_columns(df.columns))


def add_ledger_amount_features(df: DataFrame, include_tier_b: bool = True) -> DataFrame:
    return df.withColumns(amount_columns(include_tier_b))


def add_ledger_rowwise(df: DataFrame, train_max: int = 500, valid_max: int = 600, include_tier_b: bool = True) -> DataFrame:
    """All row-wise features in one projection."""
    return df.withColumns(temporal_columns(df.columns) | {"split": split_column(train_max, valid_max)} | amount_columns(include_tier_b))
