"""Streaming pipelines: records in, features and dead letters out.

Invalid records are a query of their own. Late rows come out of the state as data, so one micro-batch decides features and
late dead letters together, and a replay writes the same ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import CARD, LEDGER, History, add_card_rowwise, add_ledger_rowwise, prune_near_constant
from ..sources.streams import as_records, stream_sink
from ..specs import LEDGER_RAW, card_raw_schema
from . import dlq
from .state import with_state

VERSION = "v1.0"
_RECORD, _PARSED, _JUDGED = "history_record", "history_parsed", "judged"


def _rows(records: DataFrame, schema, rowwise, *keep: str) -> DataFrame:
    """The columns to keep of the records (value among them), and the features of each row alone.

    Fields that were judged come from there, in the contract's types; of others from_json makes null what it can't read."""
    parsed = records.select(*keep, _JUDGED, F.from_json("value", schema).alias(_PARSED))
    judged = records.schema[_JUDGED].dataType.names
    raw = [F.col(f"{_JUDGED if c in judged else _PARSED}.{c}").alias(c) for c in schema.names]
    return rowwise(parsed.select(*(F.col(c).alias(_RECORD if c == "value" else c) for c in keep), *raw))


def _ledger_rowwise(rows: DataFrame) -> DataFrame:
    return add_ledger_rowwise(rows, include_tier_b=False).drop("newbalanceOrig", "newbalanceDest", "isFlaggedFraud")


def _card_rowwise(train_max_day: float):
    return lambda rows: prune_near_constant(add_card_rowwise(rows, train_max_day))


def _valid(records: DataFrame, reason, fields) -> DataFrame:
    """value and judged of the valid records."""
    return dlq.classify(records, reason, fields).where("reason_code is null").select("value", _JUDGED)


def ledger_rows(records: DataFrame) -> DataFrame:
    """Valid records with the row-wise features known at authorisation time."""
    return _rows(_valid(records, dlq.ledger_reason, dlq.ledger_fields), LEDGER_RAW, _ledger_rowwise)


def card_rows(records: DataFrame, train_max_day: float = 130.0, schema=None) -> DataFrame:
    return _rows(_valid(records, dlq.card_reason, dlq.card_fields), schema or card_raw_schema(), _card_rowwise(train_max_day))


def _stream(valid: DataFrame, schema, rowwise, h: History, share_flags: dict[str, str] | None = None) -> DataFrame:
    """Rows with their history. Only what the state reads and what was judged goes to Python, with the record; the row is
    made again from that afterwards, where no columns but those in use are parsed."""
    judged = [c for c in valid.schema[_JUDGED].dataType.names if c in schema.names]
    reads = list(dict.fromkeys((h.entity, h.clock, h.amount, *([h.tie_break] if h.tie_break else []), *(share_flags or {}).values(), *judged)))
    seen = with_state(_rows(valid, schema, rowwise, "value").select(F.col(_RECORD), *reads), h, share_flags)
    seen = seen.withColumn(_JUDGED, F.struct(*judged)).drop(*reads).withColumnRenamed(_RECORD, "value")
    made = [c for c in seen.columns if c not in ("value", _JUDGED)]
    rows = _rows(seen, schema, rowwise, *made)
    return rows.select(*(c for c in rows.columns if c not in made), *made).withColumn("feature_version", F.lit(VERSION))


def ledger_stream(records: DataFrame) -> DataFrame:
    return _stream(_valid(records, dlq.ledger_reason, dlq.ledger_fields), LEDGER_RAW, _ledger_rowwise, LEDGER, {"dest_prior_cashout_share": "type_cash_out"})


def card_stream(records: DataFrame, train_max_day: float = 130.0, schema=None) -> DataFrame:
    return _stream(_valid(records, dlq.card_reason, dlq.card_fields), schema or card_raw_schema(), _card_rowwise(train_max_day), CARD)


def late_letters(rows: DataFrame, key: str) -> DataFrame:
    """Dead-letter records of the rows with a reason; the raw value is the enriched row as JSON."""
    columns = [c for c in rows.columns if c != "reason_code"]
    raw = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    late = rows.where("reason_code is not null").select(F.col(key).cast("string").alias("key"), raw.alias("value"), "reason_code")
    return dlq.dead_letters(late)


def start_features(rows: DataFrame, key: str, where: str, late_where: str, checkpoint: str, kind: str = "file", servers: str | None = None) -> StreamingQuery:
    """Writes features to one sink and late rows to another, micro-batch by micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        features = as_records(batch.where("reason_code is null").drop("reason_code"), F.col(key))
        for records, to in ((features, where), (late_letters(batch, key), late_where)):
            if kind == "kafka":
                records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", to).save()
            else:
                records.write.mode("overwrite").json(f"{to}/batch={n}")
        batch.unpersist()

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def start_dead_letters(records: DataFrame, reason, where: str, checkpoint: str, kind: str = "file", servers: str | None = None) -> StreamingQuery:
    return stream_sink(dlq.dead_letters(dlq.classify(records, reason)), kind, where, checkpoint, servers).start()


def build_pipeline(records: DataFrame, dataset: str, out: str | None = None, checkpoint: str | None = None, dead: str | None = None, kind: str = "file", servers: str | None = None, stateless: bool = False, schema=None):
    """The stream of rows, or with `out` and `checkpoint` the running queries. dead: the dead-letter sink."""
    if dataset not in ("ledger", "card"):
        raise ValueError(f"unknown dataset {dataset}")
    key, reason = ("txn_id", dlq.ledger_reason) if dataset == "ledger" else ("TransactionID", dlq.card_reason)
    if stateless:
        rows = ledger_rows(records) if dataset == "ledger" else card_rows(records, schema=schema)
        rows = rows.withColumn("reason_code", F.lit(None).cast("string"))
    else:
        rows = ledger_stream(records) if dataset == "ledger" else card_stream(records, schema=schema)
    if not (out and checkpoint):
        return rows
    queries = [start_features(rows, key, out, dead or f"{out}-late", f"{checkpoint}/features", kind, servers)]
    if dead:
        queries.append(start_dead_letters(records, reason, f"{dead}-invalid", f"{checkpoint}/dlq", kind, servers))
    return queries
