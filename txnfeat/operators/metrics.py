"""Metrics of scores: confusion counts, threshold sweeps, average precision, ROC AUC. All are aggregations by score value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals
from .profile import rank_auc


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp at score >= threshold, and precision, recall, f1 (0 where undefined)."""
    return sweep(df, label, score, [threshold])


def sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, tn, fp, fn, tp, precision, recall, f1 for each threshold, in one aggregation of the rows.

    Rows are counted by how many thresholds they reach; the totals are sums over these few counts."""
    ts = sorted(thresholds)
    spark = df.sparkSession
    reached = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col(score)))
    counts = df.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    steps = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "step int, threshold double")
    # Two short tables: thresholds, and counts by reached thresholds.
    pairs = steps.join(F.broadcast(counts), F.lit(True), "left")
    above = F.col("reached") >= F.col("step")
    s = pairs.groupBy("threshold").agg(*(F.coalesce(F.sum(F.when(cond, F.col(v))), F.lit(0)).alias(k) for k, cond, v in (("tn", ~above, "q"), ("fp", above, "q"), ("fn", ~above, "p"), ("tp", above, "p"))))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("threshold", "tn", "fp", "fn", "tp", zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the sum over distinct scores of the recall gained times the precision there; null for a single class."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(by, "s", {"tp": "p", "k": "n"}, descending=True)
    s = cum.agg(F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("a"), F.sum("p").alias("p"), F.max("k").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("a") / F.col("p")).alias("average_precision"))


def evaluate(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> dict[str, float | int]:
    """All metrics as a dict. Empty input, null or non-finite scores, scores outside 0 to 1 and labels but 0 and 1 raise ValueError."""
    validate_scores(df, label, score)
    row = confusion(df, label, score, threshold).first().asDict()
    nan = float("nan")
    ap, roc = average_precision(df, label, score).first()[0], rank_auc(df, score, label).first()[0]
    single = row["tp"] + row["fn"] == 0 or row["tn"] + row["fp"] == 0
    return row | {"average_precision": nan if single else ap, "roc_auc": nan if single else 0.5 if roc is None else roc}


def validate_scores(df: DataFrame, label: str, score: str) -> None:
    s, y = F.col(score), F.col(label)
    n, bad_s, bad_y = df.agg(F.count(F.lit(1)), F.count_if(s.isNull() | F.isnan(s) | ~s.between(0, 1)), F.count_if(y.isNull() | ~y.isin(0, 1))).first()
    if not n or bad_s or bad_y:
        raise ValueError(f"{n} rows, {bad_s} bad scores, {bad_y} bad labels")


def find_threshold(df: DataFrame, label: str, score: str, criterion: str = "f1", beta: float = 1.0, points: int = 100) -> tuple[float, dict]:
    """(threshold, metrics there): the lowest of the best of `points` thresholds from 0.01 to 0.99; 0.5 without positives."""
    if criterion not in ("f1", "fbeta"):
        raise ValueError(f"unknown criterion {criterion}")
    validate_scores(df, label, score)
    rows = sweep(df, label, score, [0.01 + 0.98 * i / (points - 1) for i in range(points)]).orderBy("threshold").collect()  # `points` rows
    if not rows or rows[0]["tp"] + rows[0]["fn"] == 0:
        return 0.5, evaluate(df, label, score, 0.5)

    def value(r) -> float:
        if criterion == "f1":
            return r["f1"]
        p, q = r["precision"], r["recall"]
        return (1 + beta**2) * p * q / (beta**2 * p + q) if p + q > 0 else 0.0

    best = max(rows, key=lambda r: (value(r), -r["threshold"]))
    return best["threshold"], evaluate(df, label, score, best["threshold"])
