"""Running totals over a whole table in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def running_totals(df: DataFrame, by: str, totals: dict[str, str], descending: bool = False, inclusive: bool = True, ranges: int = RANGES) -> DataFrame:
    """`df` with, for each name: column of `totals`, the sum of the column over all rows up to this one in the order of `by`.

    `by` must be distinct, as after grouping by it. Rows are cut into ranges of `by` at approximate quantiles; sums of
    whole ranges before a row's own are few, and a window adds those within it."""
    grid = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    found = df.agg(F.expr(f"percentile_approx(cast({by} as double), array({grid}), 10000)")).first()[0] or []
    borders = sorted(set(found))
    part = F.size(F.filter(F.expr(f"array({', '.join(f'{b!r}D' for b in borders)})"), lambda b: b < F.col(by).cast("double"))) if borders else F.lit(0)
    d = df.withColumn("__part", part)
    order = F.desc if descending else F.asc
    before = Window.orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)  # over at most `ranges` rows
    sums = d.groupBy("__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in totals.items()))
    offsets = sums.select("__part", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals))
    within = Window.partitionBy("__part").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = d.join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, *((F.col(f"__{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in totals.items()))
