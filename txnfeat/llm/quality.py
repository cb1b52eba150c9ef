"""Quality classifier by compression.

Two zstandard dictionaries hold good and bad labelled texts. A text is compressed block by block with each and with
none; the difference of the sizes, normalised by the text's length and by the sizes themselves, and the plain ratios are
calibrated to a score by logistic regression on other labelled texts than those in the dictionaries. A compressed size
has a share that doesn't grow with the text (frame headers, the first literals of each block), so the same difference
means less for a short text; log(n) and n^-0.5 let the calibration correct that. Alone they tell nothing (README).
Scoring reads every whole text once, where it lies, with no shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields_of, session_of, table, trimmed, with_bytes, written

#: The most labelled rows of each class that the dictionaries, and that the calibration, learn from.
DICTIONARY_ROWS, CALIBRATION_ROWS = 600, 2000
#: The most bytes of a dictionary, all of which its tables hold; texts are cut to one length, at most EXCERPT_BYTES, that makes
#: them fit. Of a longer text it has that many bytes in a row, from a place chosen by a hash.
DICTIONARY_BYTES, EXCERPT_BYTES = 4_000_000, 1 << 16
#: Bytes of a block that is compressed at once; a block's difference is told against so many bytes at least.
BLOCK_BYTES, LEAST_BYTES, LEVEL = 2048, 200, 5
THRESHOLD = 0.3
FEATURES = 8


def sizes(good, bad, plain, text: bytes) -> list[float]:
    """The features of a text: normalised differences and ratios of compressed sizes. An empty text is one empty block."""
    n, g, b, p, most = max(len(text), 1), 0, 0, 0, -1.0
    for i in range(0, n, BLOCK_BYTES):
        block = text[i : i + BLOCK_BYTES]
        x, y = len(good.compress(block)), len(bad.compress(block))
        g, b, p = g + x, b + y, p + len(plain.compress(block))
        most = max(most, (x - y) / max(len(block), LEAST_BYTES))
    return [(g - b) / (g + b), g / n, b / n, p / n, np.log(n) / 10, (g - b) / n, most, n**-0.5]


def excerpt(doc_id: int, text: bytes, length: int = EXCERPT_BYTES) -> bytes:
    """The whole text, or `length` bytes of a longer one from a place that a hash of doc_id chooses."""
    places = max(1, len(text) - length + 1)
    at = zlib.crc32(b"%d" % doc_id) % places if places > 1 else 0
    return text[at : at + length]


def dictionary(texts: list[tuple[int, bytes]]) -> bytes:
    """The texts, each by its doc_id, as one: whole if they have up to DICTIONARY_BYTES, else cut to the greatest length that fits."""
    left, length = DICTIONARY_BYTES - len(texts), EXCERPT_BYTES
    for i, n in enumerate(sorted(len(t) for _, t in texts)):
        if n * (len(texts) - i) > left:
            length = min(length, left // (len(texts) - i))
            break
        left -= n
    return b"\n".join(excerpt(i, t, length) for i, t in texts)


def _parameters() -> zstandard.ZstdCompressionParameters:
    """With tables that have a place for each byte of a dictionary; those of the level hold only the end of a large one."""
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=23, hash_log=22, chain_log=22, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        """With the good, with the bad, and with no dictionary."""
        plain, out = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), []
        for body in (self.good, self.bad):
            if len(body) < 8:
                out.append(plain)
                continue
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_parameters())
            out.append(zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=d))
        return (*out, plain)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge logistic regression; with one class or none, weights that give its share or 0.5."""
    if not len(y) or len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def held_out(doc_id: str = "doc_id"):
    """Rows whose CRC-32 of doc_id as text is a multiple of 5 (a null counts as empty text); nothing is learnt from them."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality and the features of the whole text of a sample of rows."""
    sent = session_of(docs).sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = sent.value.compressors()
        for b in batches:
            rows = [sizes(*with_, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    return with_bytes(docs).drop("text").mapInArrow(trimmed(f), "doc_id long, quality int, features array<double>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS) labelled rows that aren't held out, chosen by a hash of doc_id.

    docs: doc_id, text; labels: doc_id, quality. Null labels are left out, a doc_id with several labels counts as the
    lowest, one with several texts as its least text; rows that repeat are learnt once; without rows of both classes all
    texts score alike."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.withColumn("place", F.xxhash64(F.col("doc_id"), F.lit(7)))
    learnt = []
    for q in (0, 1):
        own = [(r[0], q) for r in known.where(F.col("quality") == q).orderBy("place", "doc_id").limit(DICTIONARY_ROWS + CALIBRATION_ROWS).select("doc_id").collect()]
        # Half of a small sample goes to the dictionaries, the rest calibrates.
        n = min(DICTIONARY_ROWS, (len(own) + 1) // 2)
        learnt += [(*r, i < n, i) for i, r in enumerate(own)]
    # At most 5,200 identifiers, whatever the input.
    ids = docs.sparkSession.createDataFrame(learnt, "doc_id long, quality int, worded boolean, place int")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "worded", "place").agg(F.min("text").alias("text"))
    sample = written(texts, "quality-sample")
    # Of a text the driver gets EXCERPT_BYTES at most.
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    start = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.greatest(F.lit(1), F.octet_length("text") - EXCERPT_BYTES + 1)
    cut = F.when(F.octet_length("text") > EXCERPT_BYTES, F.substring(data, F.col("start") + 1, F.lit(EXCERPT_BYTES))).otherwise(data)
    worded = sample.where("worded").withColumn("start", start.cast("int")).select("place", "quality", "doc_id", cut.alias("body"))
    bodies: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for _, q, doc, body in sorted(map(tuple, worded.toLocalIterator())):
        bodies[q].append((doc, bytes(body)))
    blank = Model(dictionary(bodies[1]), dictionary(bodies[0]), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    found = sorted((r[0], r[1], tuple(r[2])) for r in _features(sample.where("not worded").select("doc_id", "quality", "text"), blank).collect())
    x = np.array([f for _, _, f in found]).reshape(-1, FEATURES)
    blank.mean, blank.scale, blank.weights = regression(x, np.array([q for _, q, _ in found], float))
    return blank


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs` with score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0).

    Null texts score as empty ones; equal texts score alike; a text of any length is compressed block by block. Columns of
    `docs` named score or predicted are replaced; an empty table gives an empty one."""
    sent = session_of(docs).sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = sent.value.compressors()
        for b in batches:
            x = np.array([sizes(*with_, t.as_py()) for t in b.columns[-1]], float).reshape(-1, FEATURES)
            s = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    return with_bytes(kept).mapInArrow(trimmed(f), f"{fields_of(kept)}score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
