"""Streams of JSON records: Kafka where its connector is installed, else directories of JSON lines (key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..specs import LEDGER_RAW

RECORD = "key string, value string"


def stream_source(spark: SparkSession, kind: str, where: str, servers: str | None = None, starting: str = "earliest", max_offsets: int | None = None, fail_on_data_loss: bool = True, max_files: int | None = None) -> DataFrame:
    """key and value as strings. kind: 'kafka' (where: topic) or 'file' (where: a directory of JSON lines)."""
    if kind == "kafka":
        r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", where).option("startingOffsets", starting).option("failOnDataLoss", str(fail_on_data_loss).lower())
        if max_offsets:
            r = r.option("maxOffsetsPerTrigger", max_offsets)
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    r = spark.readStream.schema(RECORD)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(where)


def as_records(df: DataFrame, key: Column | None, columns: list[str] | None = None) -> DataFrame:
    """key and value: the columns as JSON, nulls included."""
    value = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.select((key.cast("string") if key is not None else F.lit(None).cast("string")).alias("key"), value.alias("value"))


def stream_sink(records: DataFrame, kind: str, where: str, checkpoint: str, servers: str | None = None, mode: str = "append") -> DataStreamWriter:
    """A writer of key and value. A file sink writes each micro-batch to a folder of its own number, so a replay overwrites it."""
    w = records.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if kind == "kafka":
        return w.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", where)
    return w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").json(f"{where}/batch={n}"))


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls in all floating-point columns."""
    out = {f.name: F.when(~(F.isnan(f.name) | F.col(f.name).isin(float("inf"), float("-inf"))), F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    return df.withColumns(out) if out else df


def replay_ledger(df: DataFrame, limit: int = 0) -> DataFrame:
    """The ledger's raw columns as records without a key, by step (ties: by the other columns); limit 0: all."""
    columns = [c for c in LEDGER_RAW.names if c in df.columns]
    ordered = sanitise(df.select(*columns)).orderBy("step", *(c for c in columns if c != "step"))
    return as_records(ordered.limit(limit) if limit else ordered, None, columns)


def replay_card(df: DataFrame, limit: int = 0, key: str = "card1") -> DataFrame:
    """All columns as records by (TransactionDT, TransactionID), keyed by card1 or TransactionID."""
    ordered = sanitise(df).orderBy("TransactionDT", "TransactionID")
    return as_records(ordered.limit(limit) if limit else ordered, F.col(key), df.columns)
