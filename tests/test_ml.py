import json
import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnfeat.ml import class_weight, fit, load_model, score_records, score_status, score_stream, select_features, stream_counts, with_seen
from txnfeat.ml.boosting import Options, boost
from txnfeat.sources import stream_source

NAMES = ["amount", "oldbalanceOrg", "step_hour"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select((F.col("id") % 50).cast("double").alias("amount"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("oldbalanceOrg"), (F.col("id") % 24).cast("int").alias("step_hour"), ((F.col("id") % 50) > 40).cast("int").alias("isFraud"))


def test_weights():
    assert class_weight(900, 100) == 9 and class_weight(10**6, 1, "sqrt_damping") == 50 and class_weight(5, 0) == 1 and class_weight(9, 1, "unweighted") == 1


def test_select_features(spark, rows):
    assert select_features(rows, "ledger", names=NAMES).columns == [*NAMES, "isFraud"]
    assert select_features(rows.drop("isFraud"), "ledger", names=NAMES).columns == NAMES
    for bad in (lambda: select_features(rows, "ledger"), lambda: select_features(rows, "other"), lambda: select_features(rows.withColumn("isFraud", F.lit(3)), "ledger", names=NAMES), lambda: select_features(rows, "ledger", names=["isFraud"])):
        with pytest.raises(ValueError):
            bad()


def test_fit_save_score(spark, rows, tmp_path):
    m = fit(rows, rows, "ledger", names=NAMES)
    assert m.report["valid"]["f1"] > 0.9
    m.save(f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m")
    assert again.threshold == m.threshold and again.features == NAMES
    good = {"txn_id": "k1", "amount": 45.0, "oldbalanceOrg": None, "step_hour": "3"}
    texts = ["[1]", json.dumps({k: v for k, v in good.items() if k != "txn_id"}), json.dumps(good | {"txn_id": "  "}), json.dumps(good), json.dumps(good | {"amount": 46.0}), json.dumps({"txn_id": "k2", "amount": 1}), json.dumps(good | {"txn_id": "k3", "amount": "x"})]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")
    got = [r["status"] for r in score_status(df, "txn_id", NAMES, order="n").orderBy("n").collect()]
    assert got == ["MALFORMED", "MISSING_KEY", "MISSING_KEY", "SCORED", "DUPLICATE", "MISSING_FEATURES", "INVALID_NUMERIC_FEATURE"]
    scored = score_records(df.where("n = 3"), again, "txn_id").collect()
    assert [r["txn_id"] for r in scored] == ["k1"] and 0 <= scored[0]["fraud_score"] <= 1


def test_duplicates_over_micro_batches(spark, tmp_path):
    good = {"amount": 45.0, "oldbalanceOrg": None, "step_hour": "3"}
    files = [[{"txn_id": "k1", **good}, {"txn_id": "k2", "amount": 1}, "[1]", {"txn_id": " ", **good}], [{"txn_id": "k1", **good}, {"txn_id": "k2", **good}, {"txn_id": "k3", **good}, "[1]", {"txn_id": " ", **good}], [{"txn_id": "k3", **good}, {"txn_id": "k4", **good}, {"txn_id": "k4", **good, "amount": 50.0}]]
    (tmp_path / "in").mkdir()
    model = SimpleNamespace(features=NAMES, dataset="ledger", version="v", predict=lambda d: d.withColumn("probability", F.lit(0.5)))
    statuses, scores = [], []

    def keep(batch, n):
        statuses.append(sorted((r["key"] or "", r["status"]) for r in score_status(batch, "txn_id", NAMES, seen="seen").collect()))

    for n, records in enumerate(files):
        path = tmp_path / "in" / f"{n}.json"
        path.write_text("".join(json.dumps({"key": None, "value": r if isinstance(r, str) else json.dumps(r)}) + "\n" for r in records))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
        if n == 1:
            continue
        # The first file has a query of its own; the others come after a restart.
        source = stream_source(spark, "file", str(tmp_path / "in"), max_files=1)
        for w in (score_stream(source, model, "txn_id", str(tmp_path / "out"), str(tmp_path / "c1"), str(tmp_path / "rejects"), str(tmp_path / "counts")), with_seen(source, "txn_id").writeStream.option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(keep)):
            q = w.start()
            q.processAllAvailable()
            q.stop()
    bad = [("", "MALFORMED"), (" ", "MISSING_KEY")]
    assert statuses == [[*bad, ("k1", "SCORED"), ("k2", "MISSING_FEATURES")], [*bad, ("k1", "DUPLICATE"), ("k2", "DUPLICATE"), ("k3", "SCORED")], [("k3", "DUPLICATE"), ("k4", "DUPLICATE"), ("k4", "SCORED")]]
    for n in range(3):
        scores.append([json.loads(x)["txn_id"] for f in sorted((tmp_path / "out" / f"batch={n}").glob("*.json")) for x in f.read_text().splitlines()])
    assert scores == [["k1"], ["k3"], ["k4"]]
    assert stream_counts(spark, str(tmp_path / "counts")) == {"processed": 12, "scored": 3, "duplicates": 4, "errors": 5}
    rejected = spark.read.schema("key string, status string, value string").json(str(tmp_path / "rejects/*")).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in rejected} == {"MALFORMED": 2, "MISSING_KEY": 2, "DUPLICATE": 4, "MISSING_FEATURES": 1}


def _flags(spark, tmp_path, batches, **options):
    """Flags of records that come one micro-batch after another, and the rows of state after each."""
    (tmp_path / "in").mkdir()
    got, sizes = [], []

    def keep(batch, n):
        got.append([(json.loads(r["value"])["k"], r["seen"]) for r in batch.orderBy("key").collect()])

    for n, keys in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"key": f"{i:03d}", "value": json.dumps({"k": k})}) + "\n" for i, k in enumerate(keys)))
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    source = stream_source(spark, "file", str(tmp_path / "in"), max_files=1)
    q = with_seen(source, "k", **options).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    assert q.awaitTermination(300)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return got, sizes


def test_bounded_duplicates_against_a_cache(spark, tmp_path):
    rng = np.random.default_rng(4)
    batches = [[f"k{rng.integers(9)}"] for _ in range(4)] + [[f"k{i}"] for i in rng.integers(9, size=9)]
    got, sizes = _flags(spark, tmp_path, batches, capacity=4, groups=1)
    cache, expected = {}, []
    for (k,) in batches:
        expected.append([(k, k in cache)])
        cache.pop(k, None)
        cache[k] = True
        if len(cache) > 4:
            cache.pop(next(iter(cache)))
    assert got == expected and {x for b in got for _, x in b} == {True, False}
    # Two entries for each key and one for the group (each is counted twice), however many keys have come.
    assert max(sizes) == sizes[-1] == 2 * (2 * 4 + 1)


def test_state_of_many_keys_stays_within_the_capacity(spark, tmp_path):
    batches = [[f"k{100 * b + i}" for i in range(100)] + [f"k{100 * b}"] for b in range(4)]
    got, sizes = _flags(spark, tmp_path, batches, capacity=40, groups=4)
    assert all(sum(x for _, x in b) <= 1 for b in got) and max(sizes) == sizes[-1] <= 2 * (2 * 40 + 4)
    for bad in ({"capacity": 0}, {"capacity": -1}, {"capacity": 5, "ttl_ms": 5}):
        with pytest.raises(ValueError):
            with_seen(spark.createDataFrame([], "key string, value string"), "k", **bad)


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    got, _ = _flags(spark, tmp_path, [["a"], ["a"], ["b"]], ttl_ms=3_600_000)
    assert got == [[("a", False)], [("a", True)], [("b", False)]]
    (tmp_path / "short").mkdir()
    got, _ = _flags(spark, tmp_path / "short", [["a"], ["b"], ["a"]], ttl_ms=1)
    assert got == [[("a", False)], [("b", False)], [("a", False)]]


SMALL = Options(trees=6, rate=0.3, depth=3, least_rows=5)


def test_boosted_with_many_categories(spark):
    df = spark.range(1500).select(F.concat(F.lit("d"), F.col("id") % 700).alias("DeviceInfo"), (F.col("id") % 9).cast("double").alias("TransactionAmt"), ((F.col("id") % 9) > 6).cast("int").alias("isFraud"))
    m = fit(df, None, "card", kind="boosted", names=["DeviceInfo", "TransactionAmt"], options=SMALL)
    assert m.report["train"]["roc_auc"] > 0.95


def grown(rows, numeric, o):
    """The same trees by trying every split of the rows themselves: no bins, no sums by bin. rows: features, label, weight."""
    y, w = (np.array([r[i] for r in rows], float) for i in (-2, -1))
    columns = list(zip(*(r[:-2] for r in rows), strict=True))
    start = np.log((w @ y) / (w.sum() - w @ y))
    margin = np.full(len(y), start)
    for _ in range(o.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(x * 2**20).astype(int) for x in ((p - y) * w, p * (1 - p) * w))
        nodes = [np.arange(len(y))]
        for _level in range(o.depth):
            below = []
            for node in nodes:
                found = []
                total = (g[node].sum(), h[node].sum())
                score = lambda gs, hs: (gs / 2**20) ** 2 / (hs / 2**20 + o.ridge)
                for f, x in enumerate(columns):
                    values = {x[i] for i in node if x[i] is not None}
                    if f < numeric:
                        order = sorted(values)
                    else:
                        order = sorted(values, key=lambda v: (sum(g[i] for i in node if x[i] == v) / (sum(h[i] for i in node if x[i] == v) + o.smooth * 2**20), v))
                    for k in range(len(order)):
                        for nulls in (True, False):
                            side = {*order[: k + 1], *([None] if nulls else [])}
                            left = np.array([i for i in node if x[i] in side], int)
                            right = np.setdiff1d(node, left)
                            if min(len(left), len(right)) < o.least_rows or min(h[left].sum(), h[right].sum()) < o.least_hessian * 2**20:
                                continue
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(*total)
                            found.append((gain, -f, nulls, -len(left), left, right))
                if found and (top := max(found, key=lambda s: s[:4]))[0] > 0:
                    below += top[4:]
                else:
                    margin[node] += -o.rate * total[0] / (total[1] + o.ridge * 2**20) if len(node) < len(y) else 0
            nodes = below
        for node in nodes:
            margin[node] += -o.rate * g[node].sum() / (h[node].sum() + o.ridge * 2**20)
    return 1 / (1 + np.exp(-margin))


def mixed(spark, n=240):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        a, b, c = int(rng.integers(12)), int(rng.integers(5)), str(rng.choice(["x", "y", "z", "w"]))
        label = int(rng.random() < (0.7 if a > 7 or c == "z" else 0.15))
        rows.append((None if rng.random() < (0.5 if label else 0.1) else float(a), float(b), None if rng.random() < 0.2 else c, label, 1.0 + label))
    return rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c string, y int, w double").repartition(5)


def test_boosted_trees_against_every_split(spark):
    o = Options(trees=3, rate=0.3, depth=3, least_rows=8)
    rows, df = mixed(spark)
    model = boost(df, ["a", "b"], ["c"], "y", "w", o)
    assert len(model.trees) == 3
    got = {r[0]: r[1] for r in df.select("id", model.probability()).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], grown(rows, 2, o), atol=1e-9)
    # Another layout, and margins written anew after each tree: the same trees.
    from txnfeat.ml import boosting

    refresh, boosting.REFRESH = boosting.REFRESH, 1
    try:
        again = boost(df.repartition(2, "b"), ["a", "b"], ["c"], "y", "w", o)
    finally:
        boosting.REFRESH = refresh
    assert [t.left for t in again.trees] == [t.left for t in model.trees] and np.allclose([v for t in again.trees for v in t.value], [v for t in model.trees for v in t.value])


def test_boosted_nulls_take_the_learnt_side(spark):
    """Nulls are all of label 1 here, and both ends of the values of label 0: no imputed value tells that."""
    rows = [(None, 1)] * 60 + [(float(i % 9), 0) for i in range(300)] + [(float("nan"), 1)] * 20
    df = spark.createDataFrame(rows, "a double, y int").withColumn("w", F.lit(1.0))
    model = boost(df, ["a"], [], "y", "w", SMALL)
    p = {r[0]: r[1] for r in spark.createDataFrame([(None,), (4.0,), (99.0,)], "a double").select("a", model.probability()).collect()}
    assert p[None] > 0.6 > 0.2 > p[4.0] == p[99.0]


def test_boosted_edges(spark):
    df = spark.createDataFrame([(1.0, "u", 1, 1.0), (2.0, None, 1, 1.0), (3.0, "v", None, 1.0)], "a double, c string, y int, w double")
    assert boost(df, ["a"], ["c"], "y", "w", SMALL).trees == []
    none = boost(df.where("false"), ["a"], ["c"], "y", "w", SMALL)
    assert none.trees == [] and none.start == 0.0
    assert [r[0] for r in df.select(none.probability()).collect()] == [0.5] * 3


def test_boosted_save_and_load(spark, tmp_path):
    _, df = mixed(spark)
    df = df.select(F.col("a").alias("TransactionAmt"), F.col("c").alias("card4"), F.col("y").alias("isFraud"))
    m = fit(df, df, "card", kind="boosted", names=["TransactionAmt", "card4"], options=SMALL)
    m.save(f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m")
    one, two = ([r["probability"] for r in x.predict(df).orderBy("TransactionAmt", "card4").collect()] for x in (m, again))
    assert one == two and again.threshold == m.threshold and m.report["valid"]["roc_auc"] > 0.75
