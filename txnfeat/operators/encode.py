"""Encodings whose tables are fitted on the training rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fitted tables up to this many rows (under 100 MB) are broadcast; larger ones are joined in a shuffle.
BROADCAST_ROWS = 1_000_000


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """The column's values with their share of the training rows; nulls are a value."""
    n = train.count()
    return train.groupBy(F.col(column).alias("value")).agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("share"))


def frequency_encode(df: DataFrame, train: DataFrame, column: str, out: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with the share of the training rows that have the row's value; 0 for values that training hasn't seen."""
    table = frequency_table(train, column)
    small = table.count() <= broadcast_rows
    joined = df.join(F.broadcast(table) if small else table, df[column].eqNullSafe(table["value"]), "left")
    return joined.select(*(df[c] for c in df.columns), F.coalesce("share", F.lit(0.0)).alias(out or f"{column}_share"))
