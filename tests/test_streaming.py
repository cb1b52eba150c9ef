import json
import os
import random
import re
import sys
from collections import Counter
from unittest.mock import Mock

import numpy as np
import pandas as pd
import pytest
from fixtures import LEDGER, LEDGER_COLUMNS, boundary_rows, small_card_schema
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnfeat import operators
from txnfeat.operators.validate import parity
from txnfeat.plans import card_features, ledger_features
from txnfeat.sources import stream_source
from txnfeat.streaming import dlq, state
from txnfeat.streaming.pipelines import build_pipeline

GOOD = {"step": 1, "type": "TRANSFER", "amount": 5.0, "nameOrig": "o", "nameDest": "d", "isFraud": 0}
CARD = {"TransactionID": 1, "TransactionDT": 5, "TransactionAmt": 1.5, "ProductCD": "W", "isFraud": 0, "card1": 7}


def reasons(spark, texts, reason):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, value string")
    return [r["reason_code"] for r in dlq.classify(df, reason).orderBy(F.col("key").cast("int")).collect()]


def test_ledger_reasons(spark):
    cases = [(GOOD, None), ({**GOOD, "amount": 5}, None), ({k: v for k, v in GOOD.items() if k != "step"}, "MISSING_FIELD"), ({**GOOD, "nameDest": None}, "MISSING_FIELD"), ({**GOOD, "step": "ten"}, "BAD_STEP_TYPE"), ({**GOOD, "step": True}, "BAD_STEP_TYPE"), ({**GOOD, "step": 1.5}, "BAD_STEP_TYPE"), ({**GOOD, "type": "TELEPORT"}, "BAD_TYPE"), ({**GOOD, "amount": "x"}, "BAD_FIELD_TYPE"), ({**GOOD, "isFraud": True}, "BAD_FIELD_TYPE"), ({**GOOD, "amount": -50.0}, "NEGATIVE_AMOUNT"), ({**GOOD, "step": 0}, "INVALID_STEP"), ({**GOOD, "step": 800}, "INVALID_STEP"), ({**GOOD, "isFraud": 99}, "INVALID_LABEL")]
    assert reasons(spark, [json.dumps(c) for c, _ in cases], dlq.ledger_reason) == [r for _, r in cases]
    broken = ["{not json", None, "[1]", "5", "", json.dumps(GOOD) + " x", '{"step": NaN}', '{"step": 1']
    assert set(reasons(spark, broken, dlq.ledger_reason)) == {"MALFORMED_JSON"}


def test_card_reasons(spark):
    cases = [(CARD, None), ({**CARD, "TransactionDT": "3600"}, None), ({**CARD, "TransactionDT": 3600.5}, None), ({**CARD, "isFraud": True}, None), ({**CARD, "card1": None}, "MISSING_FIELD"), ({**CARD, "TransactionAmt": "x"}, "BAD_FIELD_TYPE"), ({**CARD, "TransactionID": "1.5"}, "BAD_FIELD_TYPE"), ({**CARD, "ProductCD": 4}, "BAD_FIELD_TYPE"), ({**CARD, "TransactionAmt": -1}, "NEGATIVE_AMOUNT"), ({**CARD, "isFraud": 2}, "INVALID_LABEL"), ({**CARD, "TransactionDT": 0}, "INVALID_TRANSACTIONDT")]
    assert reasons(spark, [json.dumps(c) for c, _ in cases], dlq.card_reason) == [r for _, r in cases]


@pytest.mark.parametrize(("reason", "fields", "name"), [(dlq.ledger_reason, dlq.ledger_fields, "amount"), (dlq.card_reason, dlq.card_fields, "TransactionAmt")])
def test_a_record_is_judged_once(spark, reason, fields, name):
    """However many rules, filters and columns use a field, it is read from the record once, and so is its kind."""
    records = spark.createDataFrame([("k", "{}")], "key string, value string")
    done = dlq.classify(records, reason, fields).where("reason_code is null").select("value", "judged.*")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"$.{name}, VariantType") == 1 and plan.count("parse_json") <= 1 and plan.count("MALFORMED_JSON") == 1


@pytest.mark.parametrize(("reason", "fields", "name"), [(dlq.ledger_reason, dlq.ledger_fields, "amount"), (dlq.card_reason, dlq.card_fields, "TransactionAmt")])
def test_a_record_is_parsed_and_converted_once(spark, reason, fields, name):
    """The record's hash, its parse, and its number are in the plan once."""
    records = spark.createDataFrame([("k", "{}")], "key string, value string")
    done = dlq.classify(records, reason, fields).where("reason_code is null").select("value", "judged.*")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("md5(") == 1 and len(re.findall(rf"\.{name}, \$, DoubleType", plan)) == 1


def test_state_makes_no_call_for_each_row():
    """Rows of an entity go through one loop: its Python calls don't grow with them."""
    rows = pd.DataFrame({"nameDest": "d", "step": np.arange(600), "amount": 1.5, "type_cash_out": 1, state._ENTITY: "d"})
    schema = T.StructType([T.StructField(c, k) for c, k in (("nameDest", T.StringType()), ("step", T.IntegerType()), ("amount", T.DoubleType()), ("type_cash_out", T.ByteType()))])
    calls = Counter()

    def run_it(n):
        p = state.HistoryProcessor(operators.LEDGER, schema, {"share": "type_cash_out"})
        p.histories = Mock(exists=lambda: False)
        sys.setprofile(lambda frame, event, arg: calls.update([n] if event == "call" and frame.f_code.co_filename == state.__file__ else []))
        try:
            return sum(len(f) for f in p.handleInputRows(None, iter([rows[:n]]), None))
        finally:
            sys.setprofile(None)

    assert (run_it(60), run_it(600)) == (60, 600) and calls[600] == calls[60]


def test_more_than_a_record_is_malformed(spark):
    more = [json.dumps(GOOD) + x for x in (', "y": 5', ", 5", "]", '], "x": [1', ',"",')]
    assert set(reasons(spark, more, dlq.ledger_reason)) == {"MALFORMED_JSON"}
    assert reasons(spark, ["\t\r\n " + json.dumps(GOOD) + "\n"], dlq.ledger_reason) == [None]


def test_no_record_makes_the_rules_fail(spark):
    """Records with any text in the place of any value: each gets a reason, or fields of which none is null."""
    rng = random.Random(11)
    values = ["0", "1", "5.0", "1e1", "1e30", "-1e30", "1e400", "-1e400", "9" * 25, "9" * 400, "0.1", "-0.0", "1" + "0" * 18, "true", "null", "[1]", "{}", '""', '" 7 "', '"1_000"', '"_1"', '"nan"', '"inf"', '"-Infinity"', '"1e400"', '"0x10"', '"٣"', '"7f"', '"1.5d"', "NaN", "01", "1.", "-", '"a\\u0000b"', '"\\ud800"', '"W"', '"TRANSFER"', "3000000000", "-2147483648", "2147483648", "1E-400", '"9' + "9" * 400 + '"']
    for good, reason, fields in ((GOOD, dlq.ledger_reason, dlq.ledger_fields), (CARD, dlq.card_reason, dlq.card_fields)):
        texts = []
        for _ in range(1500):
            r = {k: json.dumps(v) for k, v in good.items()}
            for k in rng.sample(list(r), rng.choice([1, 1, 1, 2, 6])):
                r[k] = rng.choice(values)
            t = "{" + ", ".join(f'"{k}": {v}' for k, v in r.items()) + "}"
            if rng.random() < 0.1:
                i = rng.randrange(len(t))
                t = t[:i] + rng.choice('{}[]",:x\\0') + t[i + 1 :]
            texts.append(t)
        rows = dlq.classify(spark.createDataFrame([(None, t) for t in texts], "key string, value string"), reason, fields).collect()
        assert len(rows) == len(texts) and any(r["reason_code"] is None for r in rows)
        for r in rows:
            assert (r["reason_code"] is None) == (r["judged"] is not None), r
            assert r["judged"] is None or None not in tuple(r["judged"]), r


def test_judged_fields_reach_the_rows(spark):
    """Numbers that the rules take as strings or with fractions aren't lost on the way to the features."""
    from txnfeat.streaming.pipelines import card_rows, ledger_rows

    schema = small_card_schema()
    records = [{**CARD, "TransactionDT": "86400", "isFraud": "1", "TransactionAmt": " 2.5 "}, {**CARD, "TransactionID": 2.9, "TransactionDT": 86400.7, "isFraud": 1.0, "card1": "9"}]
    rows = card_rows(spark.createDataFrame([(None, json.dumps(r)) for r in records], "key string, value string"), schema=schema).orderBy("TransactionID").collect()
    assert [(r["TransactionID"], r["TransactionDT"], r["TransactionAmt"], r["isFraud"], r["card1"]) for r in rows] == [(1, 86400, 2.5, 1, 7), (2, 86400, 1.5, 1, 9)]
    rows = ledger_rows(spark.createDataFrame([(None, json.dumps(r)) for r in (GOOD, {**GOOD, "step": 5.0}, {**GOOD, "isFraud": 1.0})], "key string, value string")).collect()
    assert [(r["step"], r["isFraud"], r["amount"]) for r in rows] == [(1, 0, 5.0)]


def put(folder, n, records):
    folder.mkdir(exist_ok=True)
    path = folder / f"{n:03d}.json"
    path.write_text("".join(json.dumps({"key": None, "value": json.dumps(r) if isinstance(r, dict) else r}) + "\n" for r in records))
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age


def run(spark, tmp_path, dataset, schema=None):
    source = stream_source(spark, "file", str(tmp_path / "in"), max_files=1)
    for q in build_pipeline(source, dataset, str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(tmp_path / "dead"), schema=schema):
        q.processAllAvailable()
        q.stop()


def test_ledger_parity_with_ties_over_batches(spark, tmp_path):
    names = LEDGER_COLUMNS.replace(" int", "").replace(" double", "").replace(" string", "").split(", ")
    records = [dict(zip(names, r, strict=True)) | {"isFlaggedFraud": 0} for r in sorted(LEDGER)]
    far = [{**records[0], "step": s, "amount": float(s), "nameOrig": f"f{s}"} for s in (150, 170, 180, 400)]
    records += far
    # The two rows of step 10 come in different files; the second restarts the queries.
    cut = next(i for i, r in enumerate(records) if r["step"] == 10) + 1
    put(tmp_path / "in", 0, records[:cut])
    run(spark, tmp_path, "ledger")
    put(tmp_path / "in", 1, [*records[cut:14], "{broken"])
    put(tmp_path / "in", 2, records[14:])
    run(spark, tmp_path, "ledger")
    batch = ledger_features(spark.createDataFrame([tuple(r[n] for n in names) for r in records], LEDGER_COLUMNS), include_tier_b=False)
    got = spark.read.schema("value string").json(str(tmp_path / "out/*")).select(F.from_json("value", batch.schema).alias("r")).select("r.*")
    assert got.count() == len(records)
    compared = parity(batch.drop("newbalanceOrig", "newbalanceDest"), got, "txn_id").collect()
    assert {r["compared"] for r in compared} == {len(records)} and [r["column"] for r in compared if r["mismatches"]] == []
    assert spark.read.json(str(tmp_path / "dead-invalid/*")).count() == 1


def test_ledger_late_rows(spark, tmp_path):
    for n, step in enumerate((3, 5, 4, 5, 6)):
        put(tmp_path / "in", n, [{**GOOD, "step": step, "nameOrig": f"o{n}"}])
    run(spark, tmp_path, "ledger")
    steps = sorted(json.loads(r["value"])["step"] for r in spark.read.json(str(tmp_path / "out/*")).collect())
    late = [json.loads(r["value"]) for r in spark.read.json(str(tmp_path / "dead/*")).collect()]
    assert steps == [3, 5, 5, 6] and [(x["reason_code"], json.loads(x["raw_value"])["step"]) for x in late] == [("LATE_EVENT", 4)]


@pytest.mark.parametrize("files", [1, 4])
def test_card_parity_and_late(spark, tmp_path, files):
    schema = small_card_schema()
    rows = [dict(zip(schema.names, r, strict=True)) for r in sorted(boundary_rows(), key=lambda r: (r[2], r[0]))]
    for n in range(files):
        put(tmp_path / "in", n, rows[n * len(rows) // files : (n + 1) * len(rows) // files])
    put(tmp_path / "in", files, [rows[-1]])
    run(spark, tmp_path, "card", schema)
    batch = card_features(spark.createDataFrame(boundary_rows(), schema))
    got = spark.read.schema("value string").json(str(tmp_path / "out/*")).select(F.from_json("value", batch.schema).alias("r")).select("r.*")
    assert got.count() == len(rows)
    assert [r["column"] for r in parity(batch, got, "TransactionID").collect() if r["mismatches"]] == []
    assert spark.read.json(str(tmp_path / "dead/*")).count() == 1
