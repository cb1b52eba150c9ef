"""Prior distinct counts: how many different values an entity had before a row, exactly and with no set for each row.

A value counts from its first occurrence on. So the first occurrence of each (entity, value) is found in one aggregation for
all columns, and the count is a running sum of first occurrences, by blocks (operators.blocks): neither an entity nor a value
with most rows is a task's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, _joined, _with_ticks, running_sums
from .history import History


def add_prior_distinct(df: DataFrame, entity: str, clock: str, counts: dict[str, str], tie_break: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with the number of different values of columns ({output: column}) in strictly earlier rows of the entity.

    Earlier is by (clock, tie-break), or by the clock alone: rows of one clock value then don't see each other. Nulls don't
    count; values count by their text. A null entity is an entity of its own; clocks are not null; an empty table gives an
    empty one."""
    order = (clock, tie_break) if tie_break else (clock,)
    names = {k: f"__new_{i}" for i, k in enumerate(counts)}
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("__i"), F.col(c).cast("string").alias("__v")) for i, c in enumerate(counts.values()))))
    firsts = df.select(entity, *order, values.alias("__e")).where("__e.__v is not null").groupBy(entity, "__e.__i", "__e.__v").agg(F.min(F.struct(*order)).alias("__at"))
    new = firsts.groupBy(entity, *(F.col(f"__at.{c}").alias(c) for c in order)).agg(*(F.count(F.when(F.col("__i") == i, 1)).alias(c) for i, c in enumerate(names.values())))
    key = (entity, *order)
    zero = {c: F.coalesce(c, F.lit(0)) for c in names.values()}
    if tie_break:
        items = _joined(df.select(*key), new, key).withColumns(zero)
        run = running_sums(items, entity, order, {f"__before_{i}": c for i, c in enumerate(names.values())}, block_rows)
        done = _joined(df, run.drop(*names.values()), key)
    else:
        ticks = df.groupBy(*key).agg(F.count("*").alias("tick_rows"))
        run = running_sums(_joined(ticks, new, key).withColumns(zero), entity, order, {f"__before_{i}": c for i, c in enumerate(names.values())}, block_rows)
        done = _with_ticks(df, run.drop(*names.values()), History(entity, clock, ""), df.count())
    return done.select(*df.columns, *(F.col(f"__before_{i}").cast("int").alias(k) for i, k in enumerate(counts)))
