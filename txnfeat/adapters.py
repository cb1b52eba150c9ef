"""The provided tables in the shape of the ledger and of the card.

Amounts are whole cents (as doubles), so that sums are exact in any order. Nulls are put in by rules on keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .specs import CARD_STRINGS, INDICATORS

# The same text runs in Spark and, with other date functions, in DuckDB.
_LEDGER = """
select event_id, cast({hours} + 1 as int) as step,
       case event_type when 'purchase' then 'TRANSFER' when 'click' then 'CASH_OUT' when 'view' then 'PAYMENT' when 'signup' then 'CASH_IN' else 'DEBIT' end as type,
       cast(round(value * 100) as double) as amount, concat('C', cast(event_id as {text})) as nameOrig,
       cast(round(value * 100) * (event_id % 3) as double) as oldbalanceOrg,
       cast(round(value * 100) * greatest(event_id % 3 - 1, 0) as double) as newbalanceOrig,
       cast(user_id as {text}) as nameDest,
       cast(round(value * 100) * (event_id % 4) as double) as oldbalanceDest,
       cast(round(value * 100) * (event_id % 4 + 1) as double) as newbalanceDest,
       case when event_id % 97 = 0 then 1 else 0 end as isFraud, 0 as isFlaggedFraud
from events
"""
_CARD = """
select cast(o_orderkey as int) as TransactionID, case when o_orderkey % 29 = 0 then 1 else 0 end as isFraud,
       cast({days} * 86400 as int) as TransactionDT, cast(round(o_totalprice * 100) as double) as TransactionAmt,
       o_orderstatus as ProductCD, cast(o_custkey as int) as card1,
       case when o_custkey % 7 = 0 then null else cast(o_custkey % 500 as int) end as card2, 150 as card3,
       case when o_custkey % 11 = 0 then null when o_custkey % 2 = 0 then 'visa' else 'mastercard' end as card4,
       cast(o_custkey % 3 + 100 as int) as card5, case when o_custkey % 3 = 0 then 'credit' else 'debit' end as card6,
       case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 400 as int) end as addr1,
       case when o_orderkey % 2 = 0 then null else cast(o_orderkey % 37 as double) end as dist1,
       case when o_orderkey % 3 = 0 then null else 'mail.example' end as P_emaildomain,
       case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'T' else 'F' end as M1,
       case when o_orderkey % 6 = 0 then null when o_orderkey % 6 < 3 then 'T' else 'F' end as M2,
       case when o_orderkey % 8 = 0 then null else 'M2' end as M4,
       case when o_orderkey % 9 = 0 then null else cast(o_orderkey % 5 as double) end as C1,
       cast(o_orderkey % 2 as double) as C2,
       case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 13 as double) end as D1,
       case when o_orderkey % 4 < 2 then null else cast(o_orderkey % 17 - 8 as double) end as D2,
       case when o_orderkey % 5 < 4 then null else cast(o_orderkey % 19 as double) end as D15,
       case when o_orderkey % 20 < 17 then null else 'desktop' end as DeviceType,
       case when o_orderkey % 40 < 37 then null else 'Windows' end as DeviceInfo,
       case when o_orderkey % 4 <> 0 then null else cast(-(o_orderkey % 6) as double) end as id_01
from orders
"""
LEDGER_SQL = _LEDGER.format(hours="floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3600000000)", text="varchar")
CARD_SQL = _CARD.format(days="date_diff('day', date '1995-01-01', cast(o_orderdate as date))")
# The card with the source columns of all missingness indicators; each is null by a rule of its own.
_VALUE = {True: "concat(cast(TransactionID % 3 as {text}), '.mail')", False: "cast(TransactionID % 7 as double)"}
_MORE = ", ".join(f"case when TransactionID % {i + 2} = 0 then null else {_VALUE[c in CARD_STRINGS]} end as {c}" for i, c in enumerate(INDICATORS.values()) if not re.search(rf" as {c}\b", _CARD))
WIDE_SQL = f"select card.*, {_MORE.format(text='varchar')} from ({CARD_SQL}) card"


def _view(spark: SparkSession, sf_dir: str, name: str) -> None:
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "events")
    return spark.sql(_LEDGER.format(hours="timestampdiff(HOUR, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))", text="string"))


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "orders")
    return spark.sql(_CARD.format(days="datediff(cast(o_orderdate as date), date'1995-01-01')"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    card(spark, sf_dir).createOrReplaceTempView("card")
    return spark.sql(f"select card.*, {_MORE.format(text='string')} from card")
