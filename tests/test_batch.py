import statistics

import pytest
from fixtures import BOUNDARY, LEDGER, LEDGER_COLUMNS, WINDOWS, boundary_rows, small_card_schema

from txnfeat.operators import add_card_history, add_card_rowwise, add_ledger_history, add_ledger_rowwise, select_subset
from txnfeat.operators.ledger import split_column
from txnfeat.operators.subset import rank_entities, rows_of
from txnfeat.operators.validate import parity
from txnfeat.plans import build_ledger_features, card_features, ledger_features


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(LEDGER, LEDGER_COLUMNS)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_ledger_rowwise(spark, ledger):
    got = by(add_ledger_rowwise(ledger, 7, 13), "nameOrig")
    for step, kind, amount, payer, before, after, _, dest, dest_after, _ in LEDGER:
        r = got[payer]
        assert len(r["txn_id"]) == 64 and r["split"] == ("train" if step <= 7 else "valid" if step <= 13 else "test")
        assert (r["step_hour"], r["sim_day"], r["amount_zero_flag"]) == (step % 24, (step - 1) // 24, int(amount == 0))
        assert r["orig_drain_flag"] == int(before > 0 and abs(amount - before) < 0.005)
        assert r["dest_balance_zero_flag"] == int(dest == 0 and kind != "PAYMENT")
        assert (r["err_balance_orig"], r["err_balance_dest"]) == (after + amount - before, dest + amount - dest_after)
        assert [r[f"type_{t.lower()}"] for t in ("TRANSFER", "DEBIT")] == [int(kind == "TRANSFER"), int(kind == "DEBIT")]
    assert {r["orig_drain_flag"] for r in got.values()} == {0, 1} and {r["amount_zero_flag"] for r in got.values()} == {0, 1}


def test_null_rules(spark):
    df = spark.createDataFrame([(None, None, None, None, -1.0, None, None, None, None, None)], LEDGER_COLUMNS)
    r = add_ledger_rowwise(df).select("*", split_column().alias("s")).first()
    assert r["amount_log1p"] == 0.0 and r["amount_zero_flag"] == 0 and r["s"] == "test" and r["amt_to_oldbalOrg"] is None


def test_ledger_history_ties(spark, ledger):
    got = by(add_ledger_history(ledger), "nameOrig")
    for step, _, amount, payer, _, _, dest, *_ in LEDGER:
        r, prior = got[payer], [x for x in LEDGER if x[6] == dest and x[0] < step]
        amounts = [x[2] for x in prior]
        assert (r["dest_prior_txn_count"], r["dest_prior_amount_sum"], r["dest_first_seen_flag"]) == (len(prior), sum(amounts), int(not prior))
        assert r["dest_steps_since_last_txn"] == (step - max(x[0] for x in prior) if prior else None)
        assert r["dest_prior_amount_max"] == max(amounts, default=None)
        std = statistics.stdev(amounts) if len(prior) > 1 else None
        assert r["dest_prior_amount_std"] == (None if std is None else pytest.approx(std))
        z = (amount - statistics.mean(amounts)) / std if len(prior) >= 3 and std > 1e-5 else None
        assert r["dest_amount_zscore"] == (None if z is None else pytest.approx(z))
        assert r["dest_prior_cashout_share"] == (pytest.approx(sum(x[1] == "CASH_OUT" for x in prior) / len(prior)) if prior else None)


def test_history_does_not_depend_on_row_order(spark, ledger):
    other = spark.createDataFrame(LEDGER[::-1], LEDGER_COLUMNS)
    assert all(r["mismatches"] == 0 for r in parity(add_ledger_history(ledger), add_ledger_history(other), "nameOrig", tolerance=1e-9).collect())


def test_card_boundaries(spark):
    got = by(add_card_history(add_card_rowwise(spark.createDataFrame(boundary_rows(), small_card_schema()))), "TransactionID")
    for n, (clock, i, _) in enumerate(BOUNDARY):
        assert got[i]["card_prior_txn_count"] == n and got[i]["card_prior_amt_sum"] == sum(a for *_, a in BOUNDARY[:n])
        for name, w in zip(("1h", "24h", "7d"), WINDOWS, strict=True):
            assert got[i][f"card_txn_count_{name}"] == sum(clock - w <= c < clock for c, _, _ in BOUNDARY)
        assert got[i]["card_secs_since_last_txn"] == (clock - BOUNDARY[n - 1][0] if n else None)


def test_card_rowwise_families(spark):
    rows = [(1, 0, 3600, 125.251, "C", 7, None, None, "visa", None, None, None, None, None, "T")]
    r = add_card_rowwise(spark.createDataFrame(rows, small_card_schema())).first()
    assert r["identity_nonnull_count"] == 0 and r["has_identity_flag"] == 0 and r["amt_decimals_gt2_flag"] == 1 and r["amt_cents"] == 25
    assert r["m_true_cnt"] == 1 and r["c_max"] == 0.0 and r["d_min"] is None and "ind_V1_11" not in r.asDict() and r["ind_M1_3"] == 1


@pytest.mark.parametrize("which", ["ledger", "card"])
def test_one_exchange_and_one_sort(spark, ledger, which):
    df = ledger_features(ledger) if which == "ledger" else card_features(spark.createDataFrame(boundary_rows(), small_card_schema()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_written_plan_keeps_the_grain(spark, ledger, tmp_path):
    ledger.write.parquet(str(tmp_path / "in"))
    out = build_ledger_features(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == len(LEDGER) and "feature_version" in out.columns
    with pytest.raises(FileNotFoundError):
        build_ledger_features(spark, str(tmp_path / "none"))
    ledger.drop("amount").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="amount"):
        build_ledger_features(spark, str(tmp_path / "bad"))


def test_subset_skips_what_does_not_fit(spark):
    # a has the largest velocity, c a tie, b the longest span; each entity is in the first list that takes it.
    rows = [("a", i, 9) for i in range(6)] + [("b", 100 * i, 1) for i in range(5)] + [("c", 1, 2), ("c", 1, 2), ("c", 2, 2)] + [("d", 200 * i, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    lists = {"top": 1, "min_span": 100, "min_rows": 2}
    assert [(r["k"], r["list"], r["place"]) for r in rank_entities(df, "k", "t", "v", **lists).orderBy("list", "place").collect()] == [("a", "A", 1), ("c", "B", 1), ("b", "C", 1), ("d", "C", 2)]
    assert select_subset(df, "k", "t", "v", 13, **lists) == ["a", "c", "d"] and select_subset(df, "k", "t", "v", 14, **lists) == ["a", "c", "b"]
    assert rows_of(df, "k", ["c"]).count() == 3


def test_batch_then_fit_then_score(spark, ledger, tmp_path):
    """The plan's write leaves nothing in the session that a model's closure can't be sent with."""
    from txnfeat.ml import fit

    ledger.write.parquet(str(tmp_path / "in"))
    done = build_ledger_features(spark, str(tmp_path / "in"), str(tmp_path / "out"), train_max=20, valid_max=30)
    m = fit(done, done, "ledger", names=["amount", "step_hour", "dest_prior_txn_count"])
    assert m.predict(done).count() == len(LEDGER)
