"""Batch plans: scan, row-wise features, split, history, pruning, version; then a write that keeps the grain.

Row-wise features are one projection, and all history frames share one exchange and one sort. The grain is counted in the
footers of the input's and of the output's files, so the rows are read once."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import add_card_history, add_card_rowwise, add_ledger_history, add_ledger_rowwise, prune_near_constant
from ..operators.validate import audit_feature_leakage, validate_feature_quality, validate_input_schema, validate_output_schema
from ..sources import load_card, load_config, load_ledger, write_checked

DEFAULT_VERSION = "v1.0"


def ledger_features(df: DataFrame, train_max: int = 500, valid_max: int = 600, include_tier_b: bool = True, version: str = DEFAULT_VERSION) -> DataFrame:
    return add_ledger_history(add_ledger_rowwise(df, train_max, valid_max, include_tier_b)).withColumn("feature_version", F.lit(version))


def card_features(df: DataFrame, train_max_day: float = 130.0, version: str = DEFAULT_VERSION) -> DataFrame:
    return prune_near_constant(add_card_history(add_card_rowwise(df, train_max_day))).withColumn("feature_version", F.lit(version))


def _build(df: DataFrame, plan, out: str | None, **write) -> DataFrame:
    if out is None:
        return plan(df)
    write_checked(plan(df), out, rows=df.count(), **write)
    return df.sparkSession.read.parquet(out)


def build_ledger_features(spark: SparkSession, path: str, out: str | None = None, partitions: int | None = None, **options) -> DataFrame:
    """The ledger's features; with `out` as a table there, whose rows are those of the input.

    Its files are those of the history's exchange, which adaptive execution fits to the size of the data; `partitions` deals
    the rows anew to so many."""
    return _build(load_ledger(spark, path), lambda df: ledger_features(df, **options), out, repartition=partitions)


def build_card_features(spark: SparkSession, path: str, out: str | None = None, partitions: int | None = None, **options) -> DataFrame:
    return _build(load_card(spark, path), lambda df: card_features(df, **options), out, repartition=partitions)


def run_batch(spark: SparkSession, dataset: str, path: str, out: str, **options) -> dict:
    """Builds one dataset and validates what was written: schemas, quality and leakage."""
    build, id_ = (build_ledger_features, "txn_id") if dataset == "ledger" else (build_card_features, "TransactionID")
    before = validate_input_schema(spark.read.parquet(path), dataset, raise_on_error=True)
    done = build(spark, path, out, **options)
    return {"input": before, "output": validate_output_schema(done, dataset), "quality": validate_feature_quality(done, id_), "leakage": audit_feature_leakage([c for c in done.columns if c not in ("isFraud", "split", "feature_version")], dataset)}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Builds batch features.")
    p.add_argument("--config", required=True, help="YAML with a section per dataset: input, output and options of its builder")
    p.add_argument("--pipeline", choices=("all", "ledger", "card"), default="all")
    a = p.parse_args(args)
    from ..session import create_spark_session

    config, spark = load_config(a.config), create_spark_session()
    for dataset in ("ledger", "card") if a.pipeline == "all" else (a.pipeline,):
        section = dict(config[dataset])
        report = run_batch(spark, dataset, section.pop("input"), section.pop("output"), **section)
        print(dataset, {k: v["status"] for k, v in report.items()})


if __name__ == "__main__":
    main()
