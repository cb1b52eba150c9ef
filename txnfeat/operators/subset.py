"""A deterministic subset of entities for replays: large ones, ones with ties, and ones with long spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_entities(df: DataFrame, entity: str, clock: str, velocity: str, top: int = 10, ties: int = 30, spans: int = 30, min_span: int = 30 * 86400, min_rows: int = 200) -> DataFrame:
    """entity, rows, list, place: three lists, at most top, ties and spans long, without an entity of an earlier one.

    A: the highest value of the column `velocity` (a rolling count). B: the most ties of the clock. C: of those with a span of
    min_span and min_rows rows at least, the most rows. Equal ones stand in the order of the entity; nulls are left out."""
    df = df.where(F.col(entity).isNotNull())
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), (F.max(clock) - F.min(clock)).alias("span"), F.max(velocity).alias("peak"))
    tied = df.groupBy(entity, clock).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(entity).agg(F.count(F.lit(1)).alias("groups"))
    # orderBy and limit are a bounded top-k in each task, so no window sees all entities; the lists are short, so they are broadcast.
    listed = lambda rows, by, name, n: rows.orderBy(F.desc(by), entity).limit(n).select(entity, "rows", F.lit(name).alias("list"), F.col(by).cast("long").alias("by"))
    without = lambda rows, chosen: rows.join(F.broadcast(chosen.select(entity)), entity, "left_anti")
    a = listed(sizes, "peak", "A", top)
    b = listed(without(tied.join(sizes, entity), a), "groups", "B", ties)
    c = listed(without(without(sizes.where((F.col("span") >= min_span) & (F.col("rows") >= min_rows)), a), b), "rows", "C", spans)
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("by"), entity)).cast("int")
    return a.unionByName(b).unionByName(c).select(entity, "rows", "list", place.alias("place"))


def select_subset(df: DataFrame, entity: str, clock: str, velocity: str, max_rows: int, **lists) -> list:
    """Entities taken in turn from the three lists while their rows fit in max_rows; one that doesn't fit is skipped."""
    ranked = rank_entities(df, entity, clock, velocity, **lists).collect()  # as many as the lists are long
    queue = sorted(((r["place"], r["list"], r[entity], r["rows"]) for r in ranked))
    chosen, left = [], max_rows
    for _, _, key, rows in queue:
        if key not in chosen and rows <= left:
            chosen.append(key)
            left -= rows
    return chosen


def rows_of(df: DataFrame, entity: str, chosen: list) -> DataFrame:
    """The rows of the chosen entities, by a semi-join with the short list."""
    keys = df.sparkSession.createDataFrame([(k,) for k in chosen], f"`{entity}` {dict(df.dtypes)[entity]}")
    return df.join(F.broadcast(keys), entity, "left_semi")
