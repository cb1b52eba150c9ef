"""Scans, sinks, replays and configuration."""

import json

import pytest

from txnfeat.sources import load_config, replay_card, replay_ledger, sanitise, write_checked, write_report


def test_config_and_reports(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("ledger:\n  input: a\n")
    assert load_config(str(tmp_path / "c.yaml")) == {"ledger": {"input": "a"}}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    write_report(df, str(tmp_path / "csv"))
    write_report(df, str(tmp_path / "json"), "json")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2


def test_checked_sinks(spark, tmp_path):
    df = spark.range(50).repartition(5)
    assert write_checked(df, str(tmp_path / "a"), rows=50, repartition=3) == 50 and len(list((tmp_path / "a").glob("*.parquet"))) == 3
    assert write_checked(df, str(tmp_path / "b"), coalesce=2) == 50 and len(list((tmp_path / "b").glob("*.parquet"))) == 2
    with pytest.raises(ValueError, match="expected"):
        write_checked(df, str(tmp_path / "c"), rows=49)


def test_sanitised_replays_in_order(spark):
    nan, inf = float("nan"), float("inf")
    ledger = spark.createDataFrame([(3, "DEBIT", nan), (1, "PAYMENT", 2.0), (1, "DEBIT", inf), (2, "DEBIT", -inf)], "step int, type string, amount double")
    assert [r["amount"] for r in sanitise(ledger).orderBy("step", "type").collect()] == [None, 2.0, None, None]
    records = [json.loads(r["value"]) for r in replay_ledger(ledger).collect()]
    assert [(r["step"], r["type"], r["amount"]) for r in records] == [(1, "DEBIT", None), (1, "PAYMENT", 2.0), (2, "DEBIT", None), (3, "DEBIT", None)]
    assert replay_ledger(ledger, limit=2).count() == 2
    card = spark.createDataFrame([(7, 20, 1, 5.0), (6, 20, 2, nan), (9, 10, 2, 1.0)], "TransactionID int, TransactionDT int, card1 int, TransactionAmt double")
    rows = replay_card(card).collect()
    assert [r["key"] for r in rows] == ["2", "2", "1"] and [json.loads(r["value"])["TransactionID"] for r in rows] == [9, 6, 7]
    assert [r["key"] for r in replay_card(card, 2, "TransactionID").collect()] == ["9", "6"]
