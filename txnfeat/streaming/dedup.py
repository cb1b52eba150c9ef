"""Duplicates in a stream of scored or feature records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_repeated(stream: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first record of each key. watermark: (timestamp column, delay) bounds the state: a key is forgotten after the
    delay. Unlike a bounded cache in one process, the state is by key and lives through a restart."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])
