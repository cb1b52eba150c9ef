"""Scoring of JSON records: a status for each, and a score for the valid ones.

A record's key counts as seen whatever else is wrong with it, so a corrected copy of a rejected record is a duplicate.
In a stream the keys of earlier micro-batches are in keyed state, so a key that comes again in a later one is too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..streaming.dlq import record_of
from .train import Model

def _known(v: Column, key: Column) -> Column:
    """Whether the record has a key that counts."""
    return F.coalesce(v.isNotNull() & (F.trim(key) != ""), F.lit(False))


class SeenProcessor(StatefulProcessor):
    """Adds `seen`: whether the group's key came in an earlier micro-batch. Groups without a key have no state."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.came = handle.getValueState("came", T.StructType([T.StructField("came", T.BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, seen = bool(key[0]), False
        if known:
            seen = self.came.exists()
            if not seen:
                self.came.update((True,))
        for batch in rows:
            yield batch.drop(columns=["known_", "group_"]).assign(seen=seen)

    def close(self) -> None:
        pass


class BoundedSeenProcessor(StatefulProcessor):
    """Adds `seen`, from a cache of at most `capacity` keys for each group: a key that comes is its newest, and the one that
    hasn't come for longest goes out. Each key has a place in the order of coming; places are never used again, and the
    oldest that is taken is found by going on from where the last one was, so a row costs a few entries of state."""

    def __init__(self, key: str, capacity: int):
        self.key, self.capacity = key, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, number = T.StructType([T.StructField("key", T.StringType())]), T.StructType([T.StructField("n", T.LongType())])
        self.places = handle.getMapState("places", text, number)
        self.order = handle.getMapState("order", number, text)
        self.about = handle.getValueState("about", T.StructType([T.StructField(c, T.LongType()) for c in ("next", "oldest", "keys")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = bool(key[0])
        if not known:
            for batch in rows:
                yield batch.drop(columns=["known_", "group_", "key_"]).assign(seen=False)
            return
        after, oldest, keys = self.about.get() if self.about.exists() else (0, 0, 0)
        for batch in rows:
            seen = []
            for k in batch["key_"]:
                found = self.places.containsKey((k,))
                if found:
                    self.order.removeKey(self.places.getValue((k,)))
                else:
                    keys += 1
                seen.append(found)
                self.places.updateValue((k,), (after,))
                self.order.updateValue((after,), (k,))
                after += 1
                while keys > self.capacity:
                    if self.order.containsKey((oldest,)):
                        self.places.removeKey(self.order.getValue((oldest,)))
                        self.order.removeKey((oldest,))
                        keys -= 1
                    oldest += 1
            yield batch.drop(columns=["known_", "group_", "key_"]).assign(seen=seen)
        self.about.update((after, oldest, keys))

    def close(self) -> None:
        pass


def with_seen(records: DataFrame, key: str, ttl_ms: int | None = None, capacity: int | None = None, groups: int = 64) -> DataFrame:
    """`records` (a stream with value: JSON) with seen: whether the record's key came in an earlier micro-batch.

    The state lives through a restart, and a replayed micro-batch gets the same flags. It has every key; with `ttl_ms` those
    that came within so many milliseconds of processing time; with `capacity` about so many keys, those that came last:
    keys are dealt to `groups`, each with its part of the capacity (1 group: exactly the last `capacity` keys, in one task).
    A time to live makes Spark run micro-batches without data for ever, so it turns those off in the session. With a
    capacity keys of one micro-batch count in the order in which they are read, so a key that repeats in it is seen too."""
    if capacity is not None and capacity <= 0:
        raise ValueError(f"the capacity must be positive, not {capacity}")
    if capacity is not None and ttl_ms is not None:
        raise ValueError("a cache has a capacity or a time to live")
    ship(records.sparkSession)
    kept = records.drop("seen")
    v = record_of(F.col("value"))
    own = F.try_variant_get(v, f"$.{key}", "string")
    out = T.StructType([*kept.schema, T.StructField("seen", T.BooleanType())])
    d = kept.withColumn("known_", _known(v, own))
    lone = F.xxhash64("value").cast("string")
    if capacity is not None:
        d = d.withColumn("key_", own).withColumn("group_", F.when(F.col("known_"), F.pmod(F.xxhash64("key_"), F.lit(groups)).cast("string")).otherwise(lone))
        return d.groupBy("known_", "group_").transformWithStateInPandas(BoundedSeenProcessor(key, -(-capacity // groups)), out, outputMode="Append", timeMode="None")
    d = d.withColumn("group_", F.when(F.col("known_"), own).otherwise(lone))
    if ttl_ms:
        records.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return d.groupBy("known_", "group_").transformWithStateInPandas(SeenProcessor(ttl_ms), out, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def score_status(records: DataFrame, key: str, features: list[str], numeric: bool = True, order: str | None = None, seen: str | None = None) -> DataFrame:
    """`records` (value: JSON) with key and status: MALFORMED, MISSING_KEY, DUPLICATE, MISSING_FEATURES, INVALID_NUMERIC_FEATURE or SCORED.

    Of records with one key the first by `order` (else by value) isn't a duplicate, unless its column `seen` is true. numeric: features must be numbers or
    strings of numbers; null counts as missing value, an absent name as missing feature."""
    v = record_of(F.col("value"))
    d = records.withColumn("__v", v).withColumn("key", F.try_variant_get("__v", f"$.{key}", "string"))
    known = _known(F.col("__v"), F.col("key"))
    first = F.row_number().over(Window.partitionBy("key", F.when(known, 0).otherwise(F.xxhash64("value"))).orderBy(F.col(order or "value"), "value"))
    kinds = {f: F.schema_of_variant(F.try_variant_get("__v", f"$.{f}", "variant")) for f in features}
    absent, odd = F.lit(False), F.lit(False)
    for f, kind in kinds.items():
        absent = absent | kind.isNull()
        text = F.trim(F.try_variant_get("__v", f"$.{f}", "string"))
        odd = odd | kind.startswith("OBJECT") | kind.startswith("ARRAY") | ((kind == "STRING") & text.try_cast("double").isNull())
    status = (
        F.when(F.col("__v").isNull(), "MALFORMED").when(F.coalesce(F.trim("key") == "", F.lit(True)), "MISSING_KEY").when((F.col("__n") > 1) | (F.col(seen) if seen else F.lit(False)), "DUPLICATE")
        .when(absent, "MISSING_FEATURES").when(F.coalesce(odd, F.lit(False)) if numeric else F.lit(False), "INVALID_NUMERIC_FEATURE").otherwise("SCORED")
    )
    return d.withColumn("__n", first).withColumn("status", status).drop("__n", "__v")


def score_records(records: DataFrame, model: Model, key: str, seen: str | None = None) -> DataFrame:
    """key, fraud_score (four digits), model_version and scored_at (ISO-8601, UTC) of the records whose status is SCORED."""
    from .features import categorical

    strings = categorical(model.features)
    done = score_status(records, key, model.features, numeric=model.dataset == "ledger", seen=seen).where("status = 'SCORED'")
    v = record_of(F.col("value"))
    rows = done.select("key", *(F.try_variant_get(v, f"$.{f}", "string" if f in strings else "double").alias(f) for f in model.features))
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return model.predict(rows).select(F.col("key").alias(key), F.round("probability", 4).alias("fraud_score"), F.lit(model.version).alias("model_version"), at.alias("scored_at"))


def score_stream(records: DataFrame, model: Model, key: str, out: str, checkpoint: str, rejects: str | None = None, counts: str | None = None, ttl_ms: int | None = None, capacity: int | None = None) -> DataStreamWriter:
    """A writer of the scores of a stream of records; with `rejects` also of the records that aren't scored, with key, status and
    value, and with `counts` of a row for each micro-batch: processed, scored, duplicates, errors.

    Keys count as duplicates by with_seen: of all time, or within a time to live or a capacity. Each micro-batch has a folder of its own number in each of them, so a replay overwrites it and nothing counts twice."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        score_records(batch, model, key, seen="seen").write.mode("overwrite").json(f"{out}/batch={n}")
        judged = score_status(batch, key, model.features, numeric=model.dataset == "ledger", seen="seen")
        if rejects:
            judged.where("status <> 'SCORED'").select("key", "status", "value").write.mode("overwrite").json(f"{rejects}/batch={n}")
        if counts:
            of = lambda status: F.count_if(F.col("status") == status)
            errors = F.count_if(~F.col("status").isin("SCORED", "DUPLICATE"))
            judged.agg(F.count(F.lit(1)).alias("processed"), of("SCORED").alias("scored"), of("DUPLICATE").alias("duplicates"), errors.alias("errors")).write.mode("overwrite").json(f"{counts}/batch={n}")
        batch.unpersist()

    return with_seen(records, key, ttl_ms, capacity).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def stream_counts(spark: SparkSession, counts: str) -> dict[str, int]:
    """The sums over all micro-batches of processed, scored, duplicates and errors."""
    names = ("processed", "scored", "duplicates", "errors")
    row = spark.read.schema(", ".join(f"{c} long" for c in names)).json(f"{counts}/*").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    return row.asDict()
