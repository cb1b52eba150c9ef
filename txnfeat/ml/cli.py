"""Trains, evaluates, ablates or scores: python -m txnfeat.ml.cli --mode train --dataset ledger --data DIR --model DIR."""

from __future__ import annotations

import argparse
import json

from ..session import STREAMING, create_spark_session
from ..sources.streams import stream_source
from .features import load_split
from .score import score_stream
from .train import ablate, fit, load_model


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Models on feature tables.")
    p.add_argument("--mode", choices=("train", "evaluate", "ablate", "consume"), required=True)
    p.add_argument("--dataset", choices=("ledger", "card"), default="ledger")
    p.add_argument("--data", help="feature table")
    p.add_argument("--model", help="folder of the model")
    p.add_argument("--kind", choices=("logistic", "boosted"), default="logistic")
    p.add_argument("--weighting", choices=("ratio", "sqrt_damping", "unweighted"), default="ratio")
    p.add_argument("--split", default="valid")
    p.add_argument("--threshold", type=float)
    p.add_argument("--source", help="records to score: a directory")
    p.add_argument("--out", help="scores: a directory")
    p.add_argument("--rejects", help="records that aren't scored: a directory")
    p.add_argument("--counts", help="counts by micro-batch: a directory")
    p.add_argument("--checkpoint")
    a = p.parse_args(args)
    spark = create_spark_session(config=STREAMING if a.mode == "consume" else None)
    if a.mode in ("train", "ablate"):
        train, valid = (load_split(spark, a.data, a.dataset, s) for s in ("train", "valid"))
        if a.mode == "ablate":
            print(json.dumps(ablate(train, valid, kind=a.kind, weighting=a.weighting)))
            return
        m = fit(train, valid, a.dataset, a.kind, a.weighting)
        m.save(a.model)
        print(json.dumps(m.report))
    elif a.mode == "evaluate":
        print(json.dumps(load_model(spark, a.model).evaluate(load_split(spark, a.data, a.dataset, a.split), a.threshold)))
    else:
        m, key = load_model(spark, a.model), "txn_id" if a.dataset == "ledger" else "TransactionID"
        score_stream(stream_source(spark, "file", a.source), m, key, a.out, a.checkpoint, a.rejects, a.counts).start().awaitTermination()


if __name__ == "__main__":
    main()
