"""Null-aware scalar building blocks; all stay in whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(predicate: Column) -> Column:
    """1 where the predicate holds, else 0, also where it is null; tinyint."""
    return F.when(predicate, 1).otherwise(0).cast("tinyint")


def log1p_floor(amount: Column) -> Column:
    """log(1 + x) of the amount, negative and null amounts counting as 0."""
    return F.log1p(F.greatest(F.lit(0.0), amount))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (also in ANSI mode)."""
    return F.try_divide(a, b)


def clock_sin_cos(hour: Column) -> tuple[Column, Column]:
    angle = hour * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def sha256_of(separator: str, *columns: Column) -> Column:
    """SHA-256 in hex of the columns as strings, joined; nulls are skipped."""
    return F.sha2(F.concat_ws(separator, *columns), 256)


def count_present(columns: list[Column]) -> Column:
    """How many of the columns aren't null; 0 if there are none."""
    return reduce(add, (F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0)).cast("int")
