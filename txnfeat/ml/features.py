"""The feature matrix: ordered feature columns and the label, checked."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import CARD_REQUIRED, CARD_STRINGS, LEDGER_REQUIRED, TIER_A, TIER_AB, card_features

LABEL = "isFraud"
KEYS = {"ledger": "txn_id", "card": "TransactionID"}
SPLITS = {"ledger": ("train", "valid", "test"), "card": ("train", "valid")}
CORE = {"ledger": [c for c in LEDGER_REQUIRED if not c.startswith("newbalance")], "card": list(CARD_REQUIRED)}


def feature_names(dataset: str, include_tier_b: bool = False) -> tuple[str, ...]:
    """Ordered features; balances after the transaction (tier B) exist for the ledger only."""
    if dataset.lower() not in KEYS:
        raise ValueError(f"unknown dataset {dataset}")
    if dataset.lower() == "card":
        return card_features()
    return TIER_AB if include_tier_b else TIER_A


def categorical(names) -> list[str]:
    return [n for n in names if n in CARD_STRINGS]


def select_features(df: DataFrame, dataset: str, include_tier_b: bool = False, names=None) -> DataFrame:
    """The features in order, and the label last where `df` has it. Missing values stay.

    Missing features and labels other than 0, 1 and null raise ValueError; keys and label are never features."""
    names = list(names or feature_names(dataset, include_tier_b))
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{len(missing)} features are missing: {missing[:5]}")
    if {LABEL, KEYS[dataset.lower()]} & set(names):
        raise ValueError("a key or the label is among the features")
    if LABEL not in df.columns:
        return df.select(*names)
    if not df.where(F.col(LABEL).isNotNull() & ~F.col(LABEL).isin(0, 1)).isEmpty():
        raise ValueError(f"{LABEL} has values other than 0 and 1")
    return df.select(*names, LABEL)


def validate_raw_schema(df: DataFrame, dataset: str) -> None:
    """Raises ValueError where core columns are missing or split has other values than the dataset's; null splits pass."""
    if missing := [c for c in (*CORE[dataset], "split") if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    # At most a few values; of a broken table ten are enough to tell.
    odd = df.where(F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS[dataset])).select("split").distinct().limit(10).collect()
    if odd:
        raise ValueError(f"unknown splits: {[r[0] for r in odd]}")


def load_split(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """The rows of one split; the filter is pushed to the files. Unknown splits, a missing table and no rows are errors."""
    if split not in SPLITS[dataset]:
        raise ValueError(f"{dataset} has no split {split}")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    validate_raw_schema(df, dataset)
    rows = df.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"split {split} is empty")
    return rows
