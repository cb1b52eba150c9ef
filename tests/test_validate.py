import math

import pytest
from pyspark.sql import functions as F

from txnfeat.operators import metrics, profile
from txnfeat.operators.validate import audit_feature_leakage, parity, validate_feature_quality, validate_input_schema, validate_no_target_leakage


def test_quality(spark):
    df = spark.createDataFrame([("1", 0, "train"), ("1", 1, "train"), ("2", 0, None)], "txn_id string, isFraud int, split string")
    r = validate_feature_quality(df, "txn_id")
    assert r["status"] == "FAIL" and r["duplicate_ids"] == 1 and r["null_counts"]["split"] == 1
    assert validate_feature_quality(df.limit(0), "txn_id")["status"] == "FAIL"
    with pytest.raises(ValueError):
        validate_feature_quality(df, "txn_id", raise_on_error=True)


def test_schema_and_leakage(spark):
    df = spark.createDataFrame([(1,)], "step int")
    assert validate_input_schema(df, "ledger")["status"] == "FAIL"
    with pytest.raises(ValueError):
        validate_input_schema(df, "other")
    r = audit_feature_leakage(["amount_log1p", "hour_sin", "isFraud", "dest_fraud_rate", "newbalanceOrig", "nameOrig"], "ledger")
    assert r["status"] == "FAIL" and r["safe_features"] == ["amount_log1p", "hour_sin"] and r["review_features"] == ["nameOrig"]
    assert audit_feature_leakage(["newbalanceOrig"], "ledger")["status"] == "PASS"
    with pytest.raises(ValueError):
        validate_no_target_leakage(["isFraud"])


def test_parity_sees_one_wrong_value(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, None, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-7, "x"), (2, 2.1, None), (3, 0.0, "y")], "k int, v double, s string")
    assert {r["column"]: r["mismatches"] for r in parity(a, b, "k").collect()} == {"v": 2, "s": 1}


def test_metrics_by_hand(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    m = metrics.evaluate(df, "y", "s", 0.5)
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 2)
    assert m["average_precision"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)
    assert m["roc_auc"] == pytest.approx((3 + 2.5 + 1) / 9)
    t, best = metrics.find_threshold(df, "y", "s")
    assert t == pytest.approx(0.109, abs=2e-3) and best["f1"] == pytest.approx(0.75)
    one = metrics.evaluate(df.where("y = 1"), "y", "s")
    assert math.isnan(one["roc_auc"])
    assert metrics.find_threshold(df.where("y = 0"), "y", "s")[0] == 0.5
    for bad in (df.limit(0), spark.createDataFrame([(2, 0.5)], "y int, s double"), spark.createDataFrame([(1, float("nan"))], "y int, s double")):
        with pytest.raises(ValueError):
            metrics.evaluate(bad, "y", "s")


def test_profiles(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1.0, None if i % 2 else "a", float(i), 2.0 * i) for i in range(10)], "id long, a double, b string, c double, d double")
    g = profile.null_mask_groups(df, "id").collect()
    assert (g[1]["columns"], g[1]["nulls"], g[1]["indicator_recommended"]) == ("a,b", 5, True) and g[0]["columns"] == "c,d"
    clusters = {r["column"]: (r["representative"], r["abs_r"]) for r in profile.correlation_clusters(df, [["a"], ["c", "d"]], fraction=1).collect()}
    assert clusters == {"a": ("CONSTANT_IN_SAMPLE", None), "c": ("c", 1.0), "d": ("c", pytest.approx(1.0))}
    assert profile.duplicate_columns(df.withColumn("e", F.col("c")), "id", ["a", "c", "d", "e"]) == [["c", "e"]]
    assert profile.compress_names(["V1", "V2", "V3", "D1"]) == "V1-V3,D1" and profile.family_of("V12") == "V"
    assert [profile.role_of(c) for c in ("id_30", "id_05", "V7", "odd")] == ["categorical-high-card", "numeric", "numeric (count/flag-like)", ""]
    assert profile.rank_auc(df.limit(0), "c", "id").first()[0] is None


def test_treatments(spark):
    # column, null_percent, rate_null, rate_present, top_share, minority, auc; and what follows
    cases = [
        (("TransactionID", 0.0, None, 3.0, 0.1, 9, 0.5), "EXCLUDE_IDENTIFIER"), (("D8", 50.0, 1.0, 9.0, 1.0, 9, 0.5), "5_NEEDS_INVESTIGATION"),
        (("V1", 0.0, None, 3.0, 99.9, 499, 0.5), "4_DROP_LOW_INFO"), (("V1", 0.0, None, 3.0, 99.0, 500, 0.5), "1_KEEP_IMPUTE"), (("M1", 99.5, 1.0, 3.0, 99.9, 1, None), "3_KEEP_CATEGORICAL"),
        (("V2", 0.9, 1.0, 9.0, 5.0, 9, 0.5), "1_KEEP_IMPUTE"), (("V2", 99.0, 1.0, 3.0, 5.0, 9, 0.44), "5_NEEDS_INVESTIGATION"), (("V2", 99.0, 1.0, 3.0, 5.0, 9, 0.52), "4_DROP_LOW_INFO"), (("V2", 99.0, 1.0, 3.0, None, 0, None), "4_DROP_LOW_INFO"),
        (("V2", 5.0, 1.0, 3.0, 5.0, 9, 0.5), "2_KEEP_MISSING_INDICATOR"), (("V2", 5.0, 1.0, 2.9, 5.0, 9, 0.5), "1_KEEP_IMPUTE"), (("V2", 4.9, 1.0, 9.0, 5.0, 9, 0.5), "1_KEEP_IMPUTE"),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(cases)], "i int, column string, null_percent double, rate_null double, rate_present double, top_share double, minority long, auc double")
    assert [r["t"] for r in df.select("i", profile.treatment().alias("t")).orderBy("i").collect()] == [t for _, t in cases]


def test_contracts(spark):
    from pyspark.sql.types import StructType

    from txnfeat.operators.contract import contract_drift, contract_table
    from txnfeat.specs import LEDGER_RAW

    text = "# Output\n\n" + contract_table(LEDGER_RAW)
    assert contract_drift(LEDGER_RAW, text) == {"missing": [], "extra": [], "retyped": [], "moved": []}
    other = StructType.fromDDL("type string, step int, amount float, more int")
    drift = contract_drift(other, text)
    assert drift["missing"] == [f.name for f in LEDGER_RAW][3:] and drift["extra"] == ["more"]
    assert drift["retyped"] == [("amount", "double", "float")] and drift["moved"] == ["step", "type"]
    with pytest.raises(ValueError):
        contract_drift(LEDGER_RAW, "no table")


def test_frequency_encoding_shuffles_beyond_the_bound(spark):
    from txnfeat.operators.encode import frequency_encode

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "z")], "id int, c string")
    for rows in (10, 0):
        got = {r["id"]: r["c_share"] for r in frequency_encode(df, df.where("id < 4"), "c", broadcast_rows=rows).collect()}
        assert got == {1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(1 / 3), 4: 0.0}
