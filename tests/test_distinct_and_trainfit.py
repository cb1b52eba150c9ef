"""Prior distinct counts against sets, and statistics of the training rows."""

import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from txnfeat.operators.distinct import add_prior_distinct
from txnfeat.operators.trainfit import add_amount_by_type, fit_groups, with_groups


@pytest.mark.parametrize("tie", [None, "id"])
def test_prior_distinct_against_sets(spark, tie):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", None]), 7 if rng.random() < 0.3 else rng.randrange(40), rng.choice(["x", "y", "z", None, "v" + str(rng.randrange(60))]), rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, e string, t long, v string, w int").repartition(4)
    got = {r["id"]: (r["dv"], r["dw"], r["v"]) for r in add_prior_distinct(df, "e", "t", {"dv": "v", "dw": "w"}, tie, block_rows=30).collect()}
    for i, e, t, v, _ in rows:
        prior = [r for r in rows if r[1] == e and ((r[2], r[0]) < (t, i) if tie else r[2] < t)]
        assert got[i] == (len({r[3] for r in prior} - {None}), len({r[4] for r in prior} - {None}), v)
    assert add_prior_distinct(df.where("false"), "e", "t", {"dv": "v"}, tie).count() == 0


def test_statistics_see_training_rows_only(spark):
    train = [("A", float(x)) for x in range(1, 201)] + [("B", 5.0), (None, 1.0), (None, 3.0)]
    later = [("A", 10_000.0), ("A", None), ("C", 7.0), ("B", 6.0), (None, 2.0)]
    rows = [(k, x, "train") for k, x in train] + [(k, x, "test") for k, x in later]
    df = spark.createDataFrame(rows, "type string, amount double, split string")
    fitted = {r["type"]: r for r in fit_groups(df, "type", "amount", {"p99": 0.99, "half": 0.5}).collect()}
    assert set(fitted) == {"A", "B", None} and (fitted["A"]["n"], fitted["A"]["p99"], fitted["A"]["half"]) == (200, 198.0, 100.0)
    assert fitted["A"]["std"] == pytest.approx(statistics.stdev(range(1, 201)))
    out = {(r["type"], r["amount"]): (r["amount_z_by_type"], r["amount_pct_of_type_p99_flag"]) for r in add_amount_by_type(df).where("split = 'test'").collect()}
    assert out["A", 10_000.0][1] == 1 and out["A", 10_000.0][0] == pytest.approx((10_000 - 100.5) / statistics.stdev(range(1, 201)))
    assert out["A", None] == (None, 0) and out["C", 7.0] == (None, 0) and out["B", 6.0] == (None, 1) and out[None, 2.0][0] == pytest.approx(0.0)
    # A table fitted elsewhere is taken as it is, and joined in a shuffle where it is large.
    from txnfeat.operators import trainfit

    kept, trainfit.BROADCAST_GROUPS = trainfit.BROADCAST_GROUPS, 1
    try:
        assert with_groups(df, fit_groups(df, "type", "amount", {}), "type").where(F.col("type").isNull()).agg(F.sum("fit_n")).first()[0] == 6
    finally:
        trainfit.BROADCAST_GROUPS = kept


def test_quantiles_are_exact(spark):
    """As many values as a sketch rounds, in tasks that it merges, and ranks on whole numbers."""
    n = 600_000
    many = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("g"), F.col("id") % 350)).otherwise("hot").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("x"), F.lit("train").alias("split"))
    shares = {"p99": 0.99, "p7": 0.07, "least": 0.0, "most": 1.0}
    got = {r["k"]: tuple(r[q] for q in shares) for r in fit_groups(many, "k", "x", shares).collect()}
    values = {}
    for i in range(n):
        values.setdefault(f"g{i % 350}" if i % 50 == 0 else "hot", []).append(float(i * 7919 % n))
    nth = lambda v, q: sorted(v)[max(-(-len(v) * Fraction(str(q)) // 1), 1) - 1]
    assert got == {k: tuple(nth(v, q) for q in shares.values()) for k, v in values.items()}
    # 0.07 * 100 in doubles is over 7.
    few = spark.range(1, 101).select(F.lit(None).cast("string").alias("k"), "id", F.lit("train").alias("split"))
    assert fit_groups(few, "k", "id", {"p7": 0.07}).first()["p7"] == 7
