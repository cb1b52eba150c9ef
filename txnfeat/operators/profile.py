"""Column profiles: missing values, frequent values, moments, rank AUC, null-mask groups, correlation clusters, treatments.

Columns are profiled together: values are unpivoted to (column, value) and aggregated by column, so the number of jobs
doesn't grow with the number of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_totals

#: Parts of a column's distinct values that are ranked on their own.
PARTS = 64


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, distinct of each column; distinct leaves nulls out."""
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct("value").alias("distinct"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, max, mean, std (of the population), median, zero_share, negative_share, all_integer of numeric columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.5).alias("median"),
        (F.count_if(F.col("v") == 0) / F.count(F.lit(1))).alias("zero_share"), (F.count_if(F.col("v") < 0) / F.count(F.lit(1))).alias("negative_share"), F.bool_and(F.col("v") == F.floor("v")).alias("all_integer"),
    )


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, value, n, share (of the column's non-null rows), place of the k most frequent values; ties by value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # The best k of each of many parts of a column's values first, so that no task ranks all of them.
    place = lambda *by: F.row_number().over(Window.partitionBy("column", *by).orderBy(F.desc("n"), "value")).cast("int")
    few = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS))).withColumn("place", place("part")).where(F.col("place") <= k)
    totals = long.groupBy("column").agg(F.count(F.lit(1)).alias("total"))
    ranked = few.join(F.broadcast(totals), "column").withColumn("place", place()).where(F.col("place") <= k)  # a row per column
    return ranked.select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"), "place")


def rank_auc(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: auc of the column for the label over non-null rows, with ties at their mean rank; null for one class or one value.

    Ranks come from counts by value, so only distinct values are ordered."""
    by = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    ranked = running_totals(by, "v", {"below": "n"}, inclusive=False).select("n", "p", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
    s = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), F.count(F.lit(1)).alias("values"))
    return s.select(F.when((F.col("values") > 1) & (F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def rate_lift(df: DataFrame, column: str, label: str, base_percent: float) -> DataFrame:
    """n and label rate in percent where the column is null and where it isn't, and their ratios to a base rate."""
    null, y = F.col(column).isNull(), F.col(label)
    return df.agg(F.count_if(null).alias("n_null"), F.count_if(~null).alias("n_present"), (F.avg(F.when(null, y)) * 100).alias("rate_null"), (F.avg(F.when(~null, y)) * 100).alias("rate_present")).select("*", (F.col("rate_null") / base_percent).alias("lift_null"), (F.col("rate_present") / base_percent).alias("lift_present"))


def value_histogram(df: DataFrame, key: str) -> DataFrame:
    """n, keys: how many keys have n rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def _column_hashes(df: DataFrame, row_id: str, values: dict[str, Column]) -> dict[str, tuple]:
    """For each named flag or hash by row, two sums over the rows, whatever their order, in one aggregation."""
    hashed = lambda v, seed: F.xxhash64(F.col(f"`{row_id}`"), v, F.lit(seed)).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)), *(F.sum(hashed(v, seed)) for v in values.values() for seed in (1, 2))).first()
    return {c: (row[1 + 2 * i], row[2 + 2 * i]) for i, c in enumerate(values)}


def null_mask_groups(df: DataFrame, row_id: str, columns: list[str] | None = None, label: str | None = None) -> DataFrame:
    """group, columns (by name, runs of numbers as a range), n_columns, nulls, null_percent, indicator_recommended of the columns
    that are null in the same rows; with a label rate_null and rate_present too, its rate in percent where they are null and not.

    Each column's null mask is reduced to two sums of hashes of row ids and flags. Groups are named MG00, MG01, ... by rising
    null percent, then first name. Columns without nulls are a group. Its rates are null where there are no such rows."""
    columns = columns or [c for c in df.columns if c not in (row_id, label)]
    masks: dict[tuple, list[str]] = {}
    for c, h in _column_hashes(df, row_id, {c: F.col(f"`{c}`").isNull() for c in columns}).items():
        masks.setdefault(h, []).append(c)
    firsts = {min(v): sorted(v, key=_natural) for v in masks.values()}
    null = lambda c: F.col(f"`{c}`").isNull()
    y = F.col(label) if label else F.lit(None).cast("double")
    row = df.agg(F.count(F.lit(1)), *(x for c in firsts for x in (F.count_if(null(c)), F.avg(F.when(null(c), y)) * 100, F.avg(F.when(~null(c), y)) * 100))).first()
    stats = {c: (row[1 + 3 * n], row[2 + 3 * n], row[3 + 3 * n]) for n, c in enumerate(firsts)}
    percent = lambda n: 100.0 * n / row[0] if row[0] else 0.0
    order = sorted(firsts, key=lambda c: (stats[c][0], c))
    out = [(f"MG{n:02d}", compress_names(firsts[c]), len(firsts[c]), stats[c][0], p := percent(stats[c][0]), 5.0 <= p < 99.5, *stats[c][1:]) for n, c in enumerate(order)]
    done = df.sparkSession.createDataFrame(out, "group string, columns string, n_columns int, nulls long, null_percent double, indicator_recommended boolean, rate_null double, rate_present double")
    return done if label else done.drop("rate_null", "rate_present")


def duplicate_columns(df: DataFrame, row_id: str, columns: list[str]) -> list[list[str]]:
    """Groups of two or more columns that have the same values, as text, in all rows."""
    same: dict[tuple, list[str]] = {}
    for c, h in _column_hashes(df, row_id, {c: F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string")) for c in columns}).items():
        same.setdefault(h, []).append(c)
    return [v for v in same.values() if len(v) > 1]


def category_rates(df: DataFrame, columns: list[str], label: str, min_rows: int = 1000) -> DataFrame:
    """column, highest, lowest: the extremes of the label's rate in percent over its values with at least min_rows rows; null without one."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("y", "x.*")
    rate = F.when(F.col("n") >= min_rows, F.col("rate") * 100)
    by = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).withColumn("rate", F.when(F.col("value").isNotNull(), rate))
    return by.groupBy("column").agg(F.max("rate").alias("highest"), F.min("rate").alias("lowest"))


def _natural(name: str) -> tuple:
    return tuple(int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name))


def compress_names(names: list[str]) -> str:
    """V1,V2,V3,D1 as V1-V3,D1: runs of a prefix with successive numbers."""
    out: list[list] = []
    for name in names:
        m = re.fullmatch(r"(\D+)(\d+)", name)
        if m and out and out[-1][0] == m[1] and out[-1][2] == int(m[2]) - 1:
            out[-1][2:] = [int(m[2]), name]
        else:
            out.append([m[1] if m else name, name, int(m[2]) if m else -2, name])
    return ",".join(a if a == b else f"{a}-{b}" for _, a, _, b in out)


def correlation(a: str, b: str):
    """Pearson's r over rows where both columns are present; null where one is constant there (corr() fails then in ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_clusters(df: DataFrame, blocks: list[list[str]], threshold: float = 0.98, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """column, representative, abs_r: in each block of columns, a column joins the first representative with |r| >= threshold, else it is one.

    Blocks are columns that are null in the same rows (null_mask_groups). r is over the sampled rows where all of a block are
    present, from one correlation matrix for each block; columns that are constant there have the representative
    CONSTANT_IN_SAMPLE and no abs_r."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    sample = df.sample(fraction=fraction, seed=seed) if fraction < 1 else df
    out: list[tuple] = []
    for block in blocks:
        rows = sample.select(*(F.col(c).cast("double").alias(c) for c in block)).dropna()
        spread = rows.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(block)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(block))).first()
        varied = [c for i, c in enumerate(block) if spread[f"lo{i}"] is not None and spread[f"lo{i}"] < spread[f"hi{i}"]]
        r = Correlation.corr(VectorAssembler(inputCols=varied, outputCol="x").transform(rows).select("x"), "x").first()[0].toArray() if varied else None
        chosen: list[int] = []
        for i, c in enumerate(varied):
            k = next((k for k in chosen if abs(r[k][i]) >= threshold), i)
            if k == i:
                chosen.append(i)
            out.append((c, varied[k], 1.0 if k == i else float(abs(r[k][i]))))
        out += [(c, "CONSTANT_IN_SAMPLE", None) for c in block if c not in varied]
    return df.sparkSession.createDataFrame(out, "column string, representative string, abs_r double")


def family_of(column: str) -> str:
    """A card column's family by its name."""
    for pattern, family in ((r"C\d+", "C"), (r"D\d+", "D"), (r"M\d", "M"), (r"V\d+", "V"), (r"card\d", "card"), (r"addr\d", "addr"), (r"dist\d", "dist"), (r"[PR]_emaildomain", "email"), (r"id_\d\d", "id"), (r"Device(Type|Info)", "device"), (r"Transaction(ID|DT|Amt)|isFraud", "core")):
        if re.fullmatch(pattern, column):
            return family
    return "other"


# The card's categorical columns, and those that need a closer look.
CATEGORICAL = ("ProductCD", *(f"card{i}" for i in range(1, 7)), "addr1", "addr2", "P_emaildomain", "R_emaildomain", *(f"M{i}" for i in range(1, 10)), "DeviceType", "DeviceInfo", *(f"id_{i}" for i in range(12, 39)))
INVESTIGATE = ("id_02", "D8", "D9", "id_07", "id_08", "id_22", "id_26")
# Roles of the card's columns by name, then by family.
ROLES = {
    "TransactionID": "identifier",
    "isFraud": "target",
    "TransactionDT": "time",
    "TransactionAmt": "numeric-continuous; log1p; amount decimals",
    "ProductCD": "categorical-low-card",
    "card1": "categorical-high-card / entity proxy",
    "card2": "categorical-high-card",
    "card3": "categorical-mid-card",
    "card4": "categorical-low-card",
    "card5": "categorical-mid-card",
    "card6": "categorical-low-card",
    "addr1": "categorical-mid-card",
    "addr2": "categorical (dominant level)",
    "dist1": "numeric-continuous",
    "dist2": "numeric-continuous",
    "P_emaildomain": "categorical-high-card (domain / provider-group / TLD splits)",
    "R_emaildomain": "categorical-high-card",
    "DeviceType": "categorical-low-card",
    "DeviceInfo": "categorical-high-card (normalise: prefix/brand)",
}
FAMILY_ROLES = {"C": "numeric-count; heavy tail -> log1p", "D": "numeric-timedelta", "M": "categorical-binary (T/F) or M0/M1/M2", "V": "numeric (count/flag-like)"}
ID_FLAGS, ID_STRINGS, ID_NUMBERS = (12, 15, 16, 23, 27, 28, 29, 34, 35, 36, 37, 38), (30, 31, 33), (1, *range(3, 12))


def role_of(column: str) -> str:
    """A card column's role as a feature, by its name; empty for other names."""
    if column in ROLES:
        return ROLES[column]
    family = family_of(column)
    if family == "id":
        n = int(column[3:])
        return "categorical-low-card" if n in ID_FLAGS else "categorical-high-card" if n in ID_STRINGS else "numeric" if n in ID_NUMBERS else "categorical (numeric-coded)"
    return FAMILY_ROLES.get(family, "")


def with_roles(profile: DataFrame) -> DataFrame:
    """`profile` (column, ...) with family and role, by a lookup in a literal map of the card's columns."""
    from ..specs import card_columns

    names = card_columns()
    looked = lambda f: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for c in names for x in (c, f(c)))), F.col("column")), F.lit(""))
    return profile.withColumn("family", looked(family_of)).withColumn("role", looked(role_of))


def describe_columns(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, null_percent, rate_null, rate_present, top_share (percent of the non-null rows), minority (the other non-null rows), auc.

    Of `columns`, the numeric ones have an auc for the label over non-null rows."""
    kinds = dict(df.dtypes)
    y = F.col(label).cast("double")
    parts = [x for c in columns for x in (F.count_if(F.col(c).isNull()), F.avg(F.when(F.col(c).isNull(), y)) * 100, F.avg(F.when(F.col(c).isNotNull(), y)) * 100)]
    row = df.agg(F.count(F.lit(1)), *parts).first()
    most = {r["column"]: r for r in top_values(df, columns, 1).collect()}
    out = []
    for i, c in enumerate(columns):
        nulls, rate_null, rate_present = row[1 + 3 * i : 4 + 3 * i]
        present, top = row[0] - nulls, most.get(c)
        auc = None if kinds[c] == "string" else rank_auc(df, c, label).first()[0]
        out.append((c, 100.0 * nulls / row[0] if row[0] else 0.0, rate_null, rate_present, 100.0 * top["share"] if top else None, present - (top["n"] if top else 0), auc))
    return df.sparkSession.createDataFrame(out, "column string, null_percent double, rate_null double, rate_present double, top_share double, minority long, auc double")


def treatment() -> Column:
    """What to do with a card column, from its row of describe_columns; the first rule that holds decides."""
    c, null = F.col("column"), F.col("null_percent")
    near_constant = F.coalesce(F.col("top_share") >= 99.0, F.lit(False)) & ~c.isin(*CATEGORICAL)
    gap = F.coalesce(F.abs(F.col("rate_null") - F.col("rate_present")), F.lit(0.0))
    return (
        F.when(c == "TransactionID", "EXCLUDE_IDENTIFIER").when(c == "isFraud", "TARGET").when(c == "TransactionDT", "DERIVE_TIME_FEATURES")
        .when(c.isin(*INVESTIGATE), "5_NEEDS_INVESTIGATION")
        .when(near_constant & (F.col("minority") >= 500), "1_KEEP_IMPUTE").when(near_constant | (c == "id_27"), "4_DROP_LOW_INFO")
        .when(c.isin(*CATEGORICAL), "3_KEEP_CATEGORICAL")
        .when(null < 1, "1_KEEP_IMPUTE")
        .when((null >= 99) & (F.abs(F.col("auc") - 0.5) >= 0.05), "5_NEEDS_INVESTIGATION").when(null >= 99, "4_DROP_LOW_INFO")
        .when((null >= 5) & (gap >= 2), "2_KEEP_MISSING_INDICATOR")
        .otherwise("1_KEEP_IMPUTE")
    )
