"""History by blocks against the plain windows, where one entity has most rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnfeat.operators import History, add_history
from txnfeat.operators import blocks
from txnfeat.operators.validate import parity

NAMES = {k: f"h_{k}" for k in ("count", "first", "sum", "mean", "std", "max", "since", "zscore")}


def rows(n=900):
    rng = random.Random(2)
    out = []
    for i in range(n):
        entity = rng.choice(["hot"] * 6 + ["a", "b", None])
        # Half of the hot entity's rows have one clock value; amounts lie close together and far from 0.
        clock = 50 if entity == "hot" and rng.random() < 0.5 else rng.randrange(100)
        amount = None if rng.random() < 0.1 else float(10**7 + rng.randrange(40)) if entity == "hot" else float(rng.randrange(900))
        out.append((i, entity, clock, amount, rng.randrange(3), "m2"))
    return out


@pytest.mark.parametrize("tie", [None, "id"])
def test_blocks_against_windows(spark, tie):
    df = spark.createDataFrame(rows(), "id long, e string, t long, x double, kind int, M2 string").repartition(5)
    h = History("e", "t", "x", tie, NAMES, {"c5": 5, "c40": 40}, {"s5": 5}, {"share": F.col("kind") == 1})
    got = blocks.add_history_in_blocks(df, h, block_rows=40)
    assert set(got.columns) == set(add_history(df, h).columns)
    compared = parity(add_history(df, h), got, "id", tolerance=1e-6).collect()
    assert {r["compared"] for r in compared} == {900} and [r["column"] for r in compared if r["mismatches"]] == []


def test_blocks_of_an_entity_are_bounded(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("e"), F.col("id").alias("t"), F.lit(1).alias("one"))
    sizes = [r["count"] for r in blocks.placed(df, "e", ("t",), block_rows=1000).groupBy("e", "__block").count().where("e = 'hot'").collect()]
    assert len(sizes) >= 7 and max(sizes) <= 3000 and sum(sizes) == 10_000
    run = blocks.running_sums(df, "e", ("t",), {"before": "one"}, block_rows=1000)
    assert run.where("e = 'hot' and before <> t / 2").count() == 0 and run.where("e = 'e7'").agg(F.max("before")).first()[0] == 20_000 / 50 - 1
    # What is carried is at most a row for each block, so it may be broadcast; no window holds more than one block.
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "[e" in plan and "__block" in plan


def test_blocks_are_cut_in_order_from_few_ranges(spark, monkeypatch):
    """However many blocks there are, the driver samples few ranges; blocks follow the order and none is over its size."""
    monkeypatch.setattr(blocks, "RANGES", 4)
    df = spark.range(20_000).select((F.col("id") % 3).alias("e"), (F.col("id") * 7919 % 20_000).alias("t"), F.lit(1).alias("one"))
    made = blocks.placed(df, "e", ("t",), block_rows=10)
    assert made.select(F.input_file_name()).distinct().count() <= 4
    rows = [tuple(r) for r in made.select("e", "t", "__block").orderBy("e", "t").collect()]
    numbers = [b for *_, b in rows]
    assert len(rows) == 20_000 and numbers == sorted(numbers) and 2000 <= len(set(numbers)) <= 2004 and max(Counter(numbers).values()) == 10
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 50)
    assert blocks.placed(df, "e", ("t",), block_rows=10).select("__block").distinct().count() <= 54
    run = blocks.running_sums(df, "e", ("t",), {"before": "one"}, block_rows=10)
    by = Window.partitionBy("e").orderBy("t")
    assert run.withColumn("n", F.row_number().over(by)).where("before <> n - 1").count() == 0


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([], "id long, e string, t long, x double")
    for tie in (None, "id"):
        assert blocks.add_history_in_blocks(df, History("e", "t", "x", tie, NAMES, {"c5": 5})).count() == 0
