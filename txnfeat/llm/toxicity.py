"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the buckets of its words, its pairs of neighbours, and its pairs with one or two words between them,
each present or not; a bucket's value is its inverse document frequency in the sample, and those in hardly any toxic row are left out. FTRL keeps two numbers for each
bucket, z and n: the sum of squared gradients n sets the bucket's own learning rate, and a bucket whose z stays within L1
has weight 0, so that a few thousand weights are left to broadcast.

Learning is on a bounded sample of labelled rows, in shards of SHARD_ROWS, each one row of a table: in each round every shard
goes on from the same state, text by text in its own task, and the states are averaged. An eighth of the sample isn't learnt from but calibrates
the score. Scoring reads every whole text once, where it lies, with no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fields_of, session_of, table, trimmed, with_bytes, written
from .decontaminate import LETTERS, hashes
from .quality import held_out, regression

#: The most labelled rows that are learnt from; rows of a shard.
SAMPLE_ROWS, SHARD_ROWS = 16_384, 4096
BITS, GAPS = 21, (1, 2, 3)
#: A bucket is known if so many toxic rows of the sample have it. Tasks that count these rows.
LEAST_DOCS, COUNTERS = 5, 4
#: FTRL: learning rate, its offset, L1 for each row of a shard (at least 1 in all), times over the sample.
ALPHA, BETA, L1, ROUNDS = 1.0, 1.0, 0.00625, 5
#: The sample's part that calibrates, and the most that a toxic row counts for in place of one.
CALIBRATES, MOST_WEIGHT = 8, 20.0
THRESHOLD = 0.5
#: Bytes of a text whose words are held at once.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets(text: bytes, known: WordHashes) -> Iterator[np.ndarray]:
    """The buckets of a text's features, stretch by stretch of its words; they may repeat."""
    plain, at, before = text.translate(LETTERS), 0, np.empty(0, np.uint64)
    while at < len(plain):
        # A stretch ends between two words.
        end = plain.find(b" ", at + CHUNK_BYTES)
        end = len(plain) if end < 0 else end
        h = np.r_[before, hashes(plain[at:end].split(), known)]
        out = [h[len(before) :]]
        for gap in GAPS:
            x = h[:-gap] * _M1 + np.uint64(gap)
            x ^= x >> np.uint64(31)
            x = (x + h[gap:]) * _M2
            out.append(x ^ (x >> np.uint64(32)))
        yield (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32)
        at, before = end, h[-max(GAPS) :]


def features(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct buckets of the whole text."""
    parts = [np.unique(b) for b in buckets(text, known)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def pack(places: np.ndarray) -> bytes:
    """Sorted places as their compressed differences, a third of their size."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(places, prepend=0).astype("<i4").tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4"), dtype=np.int32)


@dataclass
class State:
    """Of FTRL. The last place is the constant's, to which neither L1 nor a value applies."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at, l1: float) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float, l1: float) -> None:
        """One row: places (the constant's last), values, label, and what it counts for."""
        w = self.weights(at, l1)
        w[-1] = self.weights(at[-1:], 0.0)[0]
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * weight * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    """Buckets with a weight, those weights, and the constant; of the log-odds."""

    places: np.ndarray
    weights: np.ndarray
    constant: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def score(self, text: bytes, table: np.ndarray, known: WordHashes) -> float:
        found = [np.unique(b[table[b] != 0]) for b in buckets(text, known)]
        z = self.constant + (float(table[np.unique(np.concatenate(found))].astype(float).sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic, place (its order in learning) and the features of the rows to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.withColumn("place", F.xxhash64(F.col("doc_id"), F.lit(12))).orderBy("place", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "place", "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = pa.array([pack(features(t.as_py(), known)) for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], names=["doc_id", "toxic", "place", "features"])

    session_of(docs)
    rows = with_bytes(texts).drop("text").mapInArrow(trimmed(f), "doc_id long, toxic int, place long, features binary")
    return written(rows.groupBy("doc_id", "toxic", "place").agg(F.min("features").alias("features")), "toxicity-sample")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's rows, and of its toxic ones, have each bucket."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        for toxic, x in zip(b.column(0).to_pylist(), b.column(1)):
            at = unpack(x.as_py())
            n[0, at] += 1
            n[1, at] += toxic
    at = np.flatnonzero(n[0])
    yield pa.RecordBatch.from_arrays([pa.array([pack(at.astype(np.int32))]), *(pa.array([x[at].tobytes()]) for x in n)], names=["at", "n", "bad"])


def _known(places: np.ndarray):
    """The features of each row as their places among `places`; those that aren't there are left out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.full(1 << BITS, -1, np.int32)
        to[places] = np.arange(len(places))
        for b in batches:
            at = [to[unpack(x.as_py())] for x in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack(x[x >= 0]) for x in at], pa.binary())], names=["shard", "place", "doc_id", "toxic", "at"])

    return trimmed(f)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    """A model from at most `rows` labelled rows that aren't held out, those with the least hashes of doc_id.

    docs: doc_id, text; labels: doc_id, toxic. Null labels are left out, a doc_id with several labels counts as the highest,
    one with several texts as one of them; rows that repeat count once. Without rows of both classes all texts score alike."""
    sample = _sample(docs, labels, rows)
    calibrates = F.pmod("place", F.lit(CALIBRATES)) == 0
    counted = {(r[0], r[1]): r[2] for r in sample.groupBy(calibrates, "toxic").count().collect()}
    bad, good = counted.get((False, 1), 0), counted.get((False, 0), 0)
    if not bad or not good:
        both = sum(n for (_, toxic), n in counted.items() if toxic), sum(counted.values())
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), float(np.log((both[0] + 1) / (both[1] - both[0] + 1))))
    spark, learns = sample.sparkSession, sample.where(~calibrates)
    # A vector of 2^BITS counts from each of COUNTERS tasks.
    df, bad_df = np.zeros((2, 1 << BITS), np.int64)
    for r in learns.select("toxic", "features").coalesce(COUNTERS).mapInArrow(trimmed(_documents), "at binary, n binary, bad binary").toLocalIterator():
        at = unpack(bytes(r["at"]))
        df[at] += np.frombuffer(r["n"], np.int32)
        bad_df[at] += np.frombuffer(r["bad"], np.int32)
    places = np.flatnonzero(bad_df >= LEAST_DOCS).astype(np.int32)
    values = np.log((bad + good + 1) / (df[places] + 1)) / np.log(bad + good + 1)
    places, values = places[values > 0], np.append(values[values > 0], 1.0)
    shards = -(-(bad + good) // shard_rows)
    l1, weight = max(1.0, L1 * (bad + good) / shards), float(np.clip(good / bad, 1.0, MOST_WEIGHT))
    last = len(places)
    state = State(np.zeros(last + 1), np.zeros(last + 1))
    # By other bits of the place than those that choose what calibrates; a quotient of doubles would lose them.
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard")
    dealt = learns.select(shard, "place", "doc_id", "toxic", "features").mapInArrow(_known(places), "shard int, place long, doc_id long, toxic int, at binary")
    # A row for each shard, with its rows in the order of learning.
    dealt = dealt.repartition(shards, "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "toxic", "at"))).alias("rows"))
    dealt = written(dealt.select("rows.toxic", "rows.at"), "toxicity-shards")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((values, state))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, start = sent.value
            for b in batches:
                for labels, rows in zip(b.column(0), b.column(1)):
                    own = State(start.z.copy(), start.n.copy())
                    for toxic, at in zip(labels.as_py(), rows.values):
                        at = np.append(unpack(at.as_py()), last)
                        own.learn(at, values[at], toxic, weight if toxic else 1.0, l1)
                    moved = np.flatnonzero(own.n != start.n)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (moved.astype(np.int32), own.z[moved], own.n[moved])], names=["places", "z", "n"])

        z, n = np.zeros_like(state.z), np.zeros_like(state.n)
        found = sorted(dealt.mapInArrow(trimmed(learn), "places binary, z binary, n binary").collect())
        for r in found:
            at = np.frombuffer(r["places"], np.int32)
            z[at] += np.frombuffer(r["z"]) - state.z[at]
            n[at] += np.frombuffer(r["n"]) - state.n[at]
        state = State(state.z + z / len(found), state.n + n / len(found))
        sent.unpersist()
    w = state.weights(np.arange(last), l1) * values[:-1]
    model = Model(places[w != 0], w[w != 0].astype(np.float32), float(state.weights(np.array([last]), 0.0)[0]))
    return _calibrated(model, sample.where(calibrates))


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with its log-odds stretched and moved to fit rows that it hasn't learnt from; as it is, where these have one class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value.table().astype(float)
        for b in batches:
            raw = [float(t[unpack(x.as_py())].sum()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.float64())], names=["toxic", "raw"])

    found = sorted(rows.select("toxic", "features").mapInArrow(trimmed(f), "toxic int, raw double").collect())
    y, x = np.array([r[0] for r in found], float), np.array([[r[1]] for r in found]).reshape(-1, 1)
    if len(set(y.tolist())) < 2 or x.std() == 0:
        return model
    mean, scale, (a, b) = regression(x, y)
    return Model(model.places, (model.weights * (a / scale[0])).astype(np.float32), float(b - a * mean[0] / scale[0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs` with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold, else 0).

    Null texts score as empty ones, by the constant alone; equal texts score alike; a text of any length is read whole,
    stretch by stretch. Columns of `docs` named score or predicted are replaced; an empty table gives an empty one."""
    sent = session_of(docs).sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, WordHashes()
        weights = model.table()
        for b in batches:
            s = np.array([model.score(t.as_py(), weights, known) for t in b.columns[-1]], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    return with_bytes(kept).mapInArrow(trimmed(f), f"{fields_of(kept)}score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
