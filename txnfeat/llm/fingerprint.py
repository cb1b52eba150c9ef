"""Document fingerprints: I-Match with randomised lexicon subsets.

Terms within a band of inverse document frequency form the lexicon; the frequency is over distinct texts, so copies of
one text don't take its terms out of the band. Each of SUBSETS random subsets takes a term with the density of its group:
of any term in the groups of ALL_GROUPS, of a term of the lexicon in those of BAND_GROUPS. A text's distinct terms in the
subset, sorted, are hashed to one part of the fingerprint.
Dense subsets tell near-identical texts apart from others, sparse ones still agree where half of the terms differ; a
text without a term in a subset has no part there. The likeness of two fingerprints is the share of equal parts among
those that either has.

The band's lower end is a share of all documents, so the lexicon has at most (distinct terms of a text, on average) /
RAREST terms of 8 bytes, however many texts there are; all of them go to every task, and the band alone decides. Which terms a part is hashed over doesn't depend on the text, so a text with
few terms of the band shares parts with an edited copy that has many. Texts without terms use their bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields_of, ranges, session_of, table, trimmed, with_bytes, written
from .decontaminate import LETTERS

#: Document frequency of the band's rarest and most frequent terms, as shares of all documents.
RAREST, COMMONEST = 0.0005, 0.2
#: Texts that several documents have, up to this many, are broadcast with their count; beyond, texts are shuffled.
BROADCAST_TEXTS = 300_000
#: Groups of disjoint subsets: (one in so many terms is in a subset, subsets in the group). A term is in one subset of a
#: group at most, so it is hashed once for each group, not once for each subset. A term is always in a subset of (8, 8).
ALL_GROUPS = ((8, 8), (32, 12), (128, 12))
BAND_GROUPS = ((8, 8), (8, 8), (32, 12), (128, 12), (512, 24))
GROUPS = ALL_GROUPS + BAND_GROUPS
SUBSETS = sum(n for _, n in GROUPS)
#: Hex digits of a part; a missing part is so many dashes.
DIGITS = 6
#: Bytes of text in a range of identifiers.
RANGE_BYTES = 16 << 20

_SEEDS = np.random.default_rng(20240102).integers(1, 1 << 63, (len(GROUPS), 1), dtype=np.uint64)
_SLOTS = np.array([[n - 1] for n, _ in GROUPS], np.uint64)
_SIZES = np.array([[n] for _, n in GROUPS], np.uint64)
_BASES = np.cumsum(_SIZES, axis=0) - _SIZES
_NONE = "-" * DIGITS


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _POWERS[0], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def terms(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct terms: runs of letters and digits, A-Z lower-cased. No term is handled by itself."""
    chars = np.frombuffer(text.translate(LETTERS), np.uint8)
    inside = chars != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    h = np.add.reduceat((chars[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place], starts)
    return np.unique(_mix(h + lengths.astype(np.uint64)))


def fingerprint(text: bytes, lexicon: np.ndarray) -> str:
    own = terms(text)
    if not len(own):
        return _hex(xxhash.xxh64_intdigest(text)) * SUBSETS
    band = own[lexicon[np.searchsorted(lexicon, own).clip(max=len(lexicon) - 1)] == own] if len(lexicon) else own[:0]
    subsets, values = [], []
    for some, groups in ((own, slice(len(ALL_GROUPS))), (band, slice(len(ALL_GROUPS), None))):
        x = _mix(some[None, :] ^ _SEEDS[groups])
        slot = x & _SLOTS[groups]
        inside = slot < _SIZES[groups]
        subsets.append((slot + _BASES[groups])[inside].astype(np.int64))
        values.append(x[inside])
    subset = np.concatenate(subsets)
    # A subset's hash is that of its sorted terms: a sum of mixed values, which is the same in any order.
    sums = np.zeros(SUBSETS, np.uint64)
    np.add.at(sums, subset, np.concatenate(values))
    some = np.bincount(subset, minlength=SUBSETS).tolist()
    return "".join([_hex(p) if n else _NONE for p, n in zip(_mix(sums).tolist(), some, strict=True)])


def _hex(n: int) -> str:
    return f"{n & (1 << 4 * DIGITS) - 1:0{DIGITS}x}"


def likeness(a: str, b: str) -> float:
    """The share of equal parts among those that either fingerprint has, from 0 to 1."""
    if a == b:
        return 1.0
    parts = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    same, neither = sum(x == y for x, y in parts), sum(x == y == _NONE for x, y in parts)
    return (same - neither) / (len(parts) - neither) if neither < len(parts) else 1.0


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, broadcast_texts: int = BROADCAST_TEXTS) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency over the distinct texts of `docs` is in the band.

    Null and empty texts have no terms, and count as one text; terms at the band's ends are in it; an empty table has none."""
    session_of(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            # A text of `copies` documents counts as one: each adds an equal share.
            for (t, copies), times in Counter(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).items():
                own = terms(t).tolist()
                if times == copies:
                    seen.update(own)
                else:
                    for term in own:
                        seen[term] += times / copies
            if len(seen) > 1_000_000:
                yield _counts(seen)
                seen.clear()
        if seen:
            yield _counts(seen)

    def _counts(seen):
        return pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen.keys(), np.uint64, len(seen)).view(np.int64)), pa.array(np.fromiter(seen.values(), np.float64, len(seen)))], names=["term", "n"])

    texts = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"))
    distinct = written(texts.groupBy("h", "h2").agg(F.count("*").alias("copies")), "imatch-texts")
    n = distinct.count()
    repeated = distinct.where("copies > 1")
    if repeated.count() <= broadcast_texts:
        texts = texts.join(F.broadcast(repeated), ["h", "h2"], "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    else:
        texts = texts.dropDuplicates(["h", "h2"]).select("text", F.lit(1).cast("long").alias("copies"))
    # The shares of a text add up to one but for rounding errors far below a half.
    freq = texts.mapInArrow(trimmed(count), "term long, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n")).where((F.col("n") >= max(1, math.ceil(rarest * n))) & (F.col("n") <= commonest * n))
    return np.sort(freq.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text of each row of `docs`: the text of the next row by (doc_id, text); after the last, the first.

    Null identifiers come first, null texts are empty. One shuffle of the texts, by ranges of the identifier; the first
    row of each range is also sent to the range before, so no task needs more than its own range."""
    session_of(docs)
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    n, part = ranges(d, "k", RANGE_BYTES)
    d = d.withColumn("part", part)
    # One short row per range: the range before each one that has rows gets a copy of its first key's rows.
    firsts = sorted(tuple(r) for r in d.groupBy("part").agg(F.min("k")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(before, "k long, to int"))
    own, also = F.struct("part", F.lit(0).alias("copy")), F.struct(F.col("to").alias("part"), F.lit(1).alias("copy"))
    places = F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also)))
    d = d.join(copies, "k", "left").withColumn("at", places).select("doc_id", "k", "text", "at.part", "at.copy")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = []
            for doc, text, p, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "copy")), strict=True):
                if held is not None and held[2] == p:
                    rows.append((held[0], held[1], text))
                held = None if copy else (doc, text, p)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "text", "next_text"])

    parted = d.repartitionById(n, "part").sortWithinPartitions("part", "copy", "k", "text")
    return parted.select("doc_id", "text", "part", "copy").mapInArrow(trimmed(pair), "doc_id long, text binary, next_text binary")


def edited(text: str, other: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of another text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of `docs` (doc_id, text).

    A text's edited form takes its second half from the next row by (doc_id, text). Null texts are empty; an empty text's
    edited form is empty; null identifiers come first; repeated rows follow each other, so one is the next of another; a single
    row is its own next; an empty table gives an empty one. A text of any length is fingerprinted whole."""
    import hashlib

    sent = session_of(docs).sparkContext.broadcast(lexicon(docs))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows = []
            for doc, text, other in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                a = last[1] if last and last[0] == text else fingerprint(text, sent.value)
                last = other, fingerprint(other, sent.value)
                own = text.decode()
                e = edited(own, other.decode()).encode()
                y = fingerprint(e, sent.value)
                rows.append((doc, len(own), hashlib.sha256(e).hexdigest(), a, y, likeness(a, y), likeness(a, last[1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(trimmed(f), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with the fingerprint of the whole text, in place of a column of that name; equal texts have equal
    fingerprints, null texts that of an empty one."""
    sent = session_of(docs).sparkContext.broadcast(lexicon(docs))
    kept = docs.drop("fingerprint")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [fingerprint(t.as_py(), sent.value) for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.string())], names=[*b.schema.names[:-1], "fingerprint"])

    return with_bytes(kept).mapInArrow(trimmed(f), f"{fields_of(kept)}fingerprint string")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
