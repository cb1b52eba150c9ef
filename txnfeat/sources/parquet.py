"""Parquet scans with a contract, and sinks that check the grain."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..specs import CARD_REQUIRED, LEDGER_REQUIRED


def _load(spark: SparkSession, path: str, required) -> DataFrame:
    # Only a plain path is looked up here; any other scheme is Spark's to find.
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; the first that are there: {df.columns[:20]}")
    return df


def load_ledger(spark: SparkSession, path: str, required=LEDGER_REQUIRED) -> DataFrame:
    return _load(spark, path, required)


def load_card(spark: SparkSession, path: str, required=CARD_REQUIRED) -> DataFrame:
    return _load(spark, path, required)


def write_checked(df: DataFrame, path: str, rows: int | None = None, repartition: int | None = None, coalesce: int | None = None) -> int:
    """Overwrites `path`, reads the count back from the files, and raises ValueError if it isn't `rows`."""
    if repartition:
        df = df.repartition(repartition)
    elif coalesce:
        df = df.coalesce(coalesce)
    df.write.mode("overwrite").parquet(path)
    found = df.sparkSession.read.parquet(path).count()
    if rows is not None and found != rows:
        raise ValueError(f"{found} rows written, {rows} expected")
    return found


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
