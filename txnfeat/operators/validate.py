"""Validation: schema contracts, data quality, leakage by name, and parity of two feature sets.

Reports are dicts; what they count comes from one aggregation each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import CARD_OUTPUT_REQUIRED, CARD_REQUIRED, LEDGER_OUTPUT_REQUIRED, LEDGER_REQUIRED, TIER_B

REQUIRED = {("ledger", "input"): LEDGER_REQUIRED, ("card", "input"): CARD_REQUIRED, ("ledger", "output"): LEDGER_OUTPUT_REQUIRED, ("card", "output"): CARD_OUTPUT_REQUIRED}
#: Columns whose absence is an error of its own.
ESSENTIAL = {"input": ("isFraud",), "output": ("split", "feature_version")}
#: Floating-point columns that are searched for NaN.
NAN_COLUMNS = 20

# Parts of names that give a label or the traffic away, and columns to review.
TARGET_PARTS = ("fraud_rate", "fraud_count", "is_fraud", "target_enc", "label_mean", "step_fraud")
VOLUME_PARTS = ("step_count", "step_volume", "global_velocity", "txns_per_hour")
LEDGER_REFERENCE = ("isFlaggedFraud", "nameOrig", "nameDest", "txn_id")
CARD_REFERENCE = ("TransactionID", "TransactionDT", "card_proxy_id", "card_addr_proxy_id")
CARD_ODD = ("D8", "D9", "id_02", "id_07", "id_08", "id_22", "id_26")


def validate_schema(df: DataFrame, dataset: str, side: str, raise_on_error: bool = False) -> dict[str, Any]:
    """Whether the required columns of the dataset's input or output are there. An unknown dataset raises ValueError."""
    if (dataset.lower(), side) not in REQUIRED:
        raise ValueError(f"unknown dataset {dataset}; there are ledger and card")
    missing = [c for c in REQUIRED[dataset.lower(), side] if c not in df.columns]
    errors = [f"missing columns: {missing}"] if missing else []
    errors += [f"column {c} is missing" for c in ESSENTIAL[side] if c not in df.columns]
    if errors and raise_on_error:
        raise ValueError(f"{side} schema of {dataset}: {errors}")
    return {"dataset": dataset, "validation_type": f"{side}_schema", "status": "FAIL" if errors else "PASS", "column_count": len(df.columns), "missing_columns": missing, "errors": errors, "warnings": []}


def validate_input_schema(df: DataFrame, dataset: str, raise_on_error: bool = False) -> dict[str, Any]:
    return validate_schema(df, dataset, "input", raise_on_error)


def validate_output_schema(df: DataFrame, dataset: str, raise_on_error: bool = False) -> dict[str, Any]:
    return validate_schema(df, dataset, "output", raise_on_error)


def quality_counts(df: DataFrame, id_column: str, critical: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct_ids (a null is one), and null, present and NaN counts by column; one pass over the data."""
    critical = [c for c in (critical or [id_column, "isFraud", "split"]) if c in df.columns]
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")][:NAN_COLUMNS]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.countDistinct(id_column) + F.coalesce(F.max(F.col(id_column).isNull().cast("int")), F.lit(0))).alias("distinct_ids"),
        *(F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in critical),
        *(F.count(c).alias(f"present:{c}") for c in df.columns),
        *(F.count_if(F.isnan(c)).alias(f"nan:{c}") for c in floats),
    )


def validate_feature_quality(df: DataFrame, id_column: str, critical: list[str] | None = None, raise_on_error: bool = False) -> dict[str, Any]:
    """Duplicates and nulls in critical columns are errors, wholly null columns and NaN are warnings; an empty frame fails."""
    row = quality_counts(df, id_column, critical).first().asDict()
    of = lambda kind: {k.partition(":")[2]: v for k, v in row.items() if k.startswith(kind + ":")}
    rows, distinct = row["rows"], row["distinct_ids"]
    if rows == 0:
        errors = ["the frame is empty"]
        if raise_on_error:
            raise ValueError(f"quality: {errors}")
        return {"status": "FAIL", "total_rows": 0, "errors": errors, "warnings": []}
    nulls, empty, nan = of("null"), [c for c, n in of("present").items() if n == 0], [c for c, n in of("nan").items() if n]
    errors = [f"{id_column} has {rows - distinct} duplicates in {rows} rows"] if distinct < rows else []
    errors += [f"critical column {c} has {n} nulls" for c, n in nulls.items() if n]
    warnings = ([f"wholly null columns: {empty}"] if empty else []) + ([f"NaN in columns: {nan}"] if nan else [])
    if errors and raise_on_error:
        raise ValueError(f"quality: {errors}")
    return {"status": "FAIL" if errors else "PASS", "total_rows": rows, "distinct_ids": distinct, "duplicate_ids": rows - distinct, "null_counts": nulls, "all_null_columns": empty, "nan_columns": nan, "errors": errors, "warnings": warnings}


def classify_leakage(column: str, dataset: str) -> tuple[str, str]:
    """(risk, review or safe; reason) of a feature's name."""
    low, dataset = column.lower(), dataset.lower()
    if column == "isFraud" or any(p in low for p in TARGET_PARTS):
        return "risk", "FATAL: depends on the label"
    if dataset == "ledger":
        if any(p in low for p in VOLUME_PARTS):
            return "risk", "global volume of a step"
        if column in TIER_B:
            return "risk", "balance after the transaction; for ablation only"
        if column in LEDGER_REFERENCE:
            return "review", "identifier or rule flag"
    if dataset == "card":
        if column in CARD_REFERENCE:
            return "review", "key or clock"
        if column in CARD_ODD:
            return "review", "unexplained link to identity, or nearly all null"
    return "safe", ""


def audit_feature_leakage(columns: list[str], dataset: str = "ledger") -> dict[str, Any]:
    """Columns by class; the audit fails only on those that depend on the label."""
    found = {c: classify_leakage(c, dataset) for c in columns}
    of = {k: [c for c in columns if found[c][0] == k] for k in ("safe", "review", "risk")}
    return {
        "dataset": dataset, "status": "FAIL" if any(r.startswith("FATAL") for _, r in found.values()) else "PASS",
        "safe_count": len(of["safe"]), "review_count": len(of["review"]), "leakage_risk_count": len(of["risk"]),
        "safe_features": of["safe"], "review_features": of["review"], "leakage_risk_features": of["risk"],
        "reasons": {c: r for c, (_, r) in found.items() if r},
    }


def validate_no_target_leakage(columns: list[str], target: str = "isFraud", raise_on_error: bool = True) -> bool:
    if target in columns and raise_on_error:
        raise ValueError(f"the label {target} is among the features")
    return target not in columns


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """compared, mismatches, column: of the keys in both frames, how many values differ: in being null, by more than the
    tolerance where numeric, at all otherwise. One join and one aggregation for all columns."""
    columns = columns or [c for c in a.columns if c in b.columns and c != key]
    numeric = {f.name for f in a.schema if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    both = a.select(F.col(key), F.struct(*columns).alias("a")).join(b.select(F.col(key), F.struct(*columns).alias("b")), key)

    def differs(c: str):
        x, y = F.col("a")[c], F.col("b")[c]
        return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance if c in numeric else x != y, F.lit(False))

    counts = both.agg(F.count(F.lit(1)).alias("compared"), *(F.count_if(differs(c)).alias(c) for c in columns))
    return counts.unpivot("compared", columns, "column", "mismatches")
