"""Runs a streaming pipeline: python -m txnfeat.streaming.cli --dataset ledger --source DIR --out DIR --checkpoint DIR."""

from __future__ import annotations

import argparse

from ..session import create_streaming_session
from ..sources.streams import stream_source
from .pipelines import build_pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Streams records to features and dead letters.")
    p.add_argument("--dataset", choices=("ledger", "card"), required=True)
    p.add_argument("--kind", choices=("file", "kafka"), default="file")
    p.add_argument("--servers", help="Kafka bootstrap servers")
    p.add_argument("--source", required=True, help="directory or topic")
    p.add_argument("--out", required=True)
    p.add_argument("--dead", help="dead-letter directory or topic")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--starting", default="earliest")
    p.add_argument("--max-offsets", type=int)
    p.add_argument("--stateless-only", action="store_true")
    p.add_argument("--once", action="store_true", help="stop when what is there has been read")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = create_streaming_session()
    records = stream_source(spark, a.kind, a.source, a.servers, a.starting, a.max_offsets, fail_on_data_loss=a.dataset == "ledger")
    running = build_pipeline(records, a.dataset, a.out, a.checkpoint, a.dead, a.kind, a.servers, a.stateless_only)
    for q in running:
        if a.once:
            q.processAllAvailable()
            q.stop()
        else:
            q.awaitTermination()


if __name__ == "__main__":
    main()
