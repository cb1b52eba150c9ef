"""Benchmark decontamination by winnowing.

Of the hashes of all k-grams of words, the least in each run of w consecutive k-grams is kept as a fingerprint, with
k + w - 1 = the window length, so two texts that share a window share a fingerprint. Documents whose fingerprints meet
a benchmark item's are aligned with that item, and the hit is extended over the whole run of equal words.

A benchmark of up to `broadcast_bytes` is sent to every task, and documents are judged where they are read, in one
pass. A larger one is joined on fingerprints in a shuffle; then each text meets the items that it may hold."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fields_of, fresh, session_of, table, trimmed, with_bytes, written

#: Words of a window; words of a k-gram.
WINDOW, GRAM = 13, 5
#: A document is contaminated where at least one in so many of its words is hit.
SHARE = 20
#: The most bytes of benchmark text that go to every task.
BROADCAST_BYTES = 16 << 20

#: For translate(): letters and digits lower-cased, other ASCII as spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all bytes above 127."""
    return text.translate(LETTERS).split()


def hashes(ws: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The least hash of each w consecutive ones, without repetitions in a row."""
    if len(g) < w:
        return g[:0]
    m, span = g, 1
    while span * 2 <= w:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    return m[np.concatenate(([True], m[1:] != m[:-1]))]


def shape(n_words: int, window: int = WINDOW, gram: int = GRAM) -> tuple[int, int, int]:
    """(window, k, w) for an item of so many words: a shorter one is one window and one k-gram."""
    return (window, gram, window - gram + 1) if n_words >= window else (n_words, n_words, 1)


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted keys."""
    return keys[np.searchsorted(keys, x).clip(max=len(keys) - 1)] == x


class Index:
    """Fingerprints of items, and their words, to find and extend hits."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, gram: int = GRAM, known: WordHashes | None = None):
        self.ids, self.words, known = [], [], WordHashes() if known is None else known
        groups: dict[tuple, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            h = hashes(words(text), known)
            if not len(h):
                continue
            j, s = len(self.ids), shape(len(h), window, gram)
            self.ids.append(item)
            self.words.append(h)
            g = grams(h, s[1])
            kept = set(winnow(g, s[2]).tolist())
            for q, x in enumerate(g.tolist()):
                if x in kept:
                    groups[s][x].append((j, q))
        self.groups = [(s, at, np.array(sorted(at), np.uint64)) for s, at in groups.items()]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray | None, set[str]]:
        """Which words of a text lie in a window of an item (None: no word), and the items whose windows occur."""
        mask, found = None, set()
        for (n, k, w), at, keys in self.groups:
            g = grams(h, k)
            if len(g) < w:
                continue
            if not _in(winnow(g, w), keys).any():
                continue
            done = set()
            for p in np.flatnonzero(_in(g, keys)).tolist():
                for j, q in at[int(g[p])]:
                    if (j, p - q) in done:
                        continue
                    done.add((j, p - q))
                    item, d = self.words[j], p - q
                    lo, hi = max(0, d), min(len(h), d + len(item))
                    same = np.concatenate(([0], (h[lo:hi] == item[lo - d : hi - d]).view(np.int8), [0]))
                    edges = np.flatnonzero(np.diff(same))
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        if b - a >= n:
                            mask = np.zeros(len(h), bool) if mask is None else mask
                            mask[lo + a : lo + b] = True
                            found.add(self.ids[j])
        return mask, found


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judge(n: int, n_hit: int, items: set[str]) -> tuple:
    return n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of `docs` (doc_id, text and any others, all of which it keeps) with n_words, n_hit, n_items, items_sha256, contaminated.

    benchmark: item_id, text. Null and empty texts have no words, so they hit nothing and are clean; an item without
    words never occurs; an item_id that is null counts as the string 'null'; items that repeat an id count once.
    Columns of `docs` that have one of the new names are replaced."""
    session_of(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    new = [x.split()[0] for x in OUT.split(", ")]
    docs = docs.drop(*new)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        return _by_broadcast(docs, items, window, gram)
    return _by_shuffle(docs, items, window, gram)


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in items.collect()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        index = Index(sent.value, window, gram, known)
        for b in batches:
            rows = []
            for text in b.columns[-1]:
                h = hashes(words(text.as_py()), known)
                mask, found = index.hits(h)
                rows.append(_judge(len(h), 0 if mask is None else int(mask.sum()), found))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=[*b.schema.names[:-1], *(x.split()[0] for x in OUT.split(", "))])

    return with_bytes(docs).mapInArrow(trimmed(judge), f"{fields_of(docs)}{OUT}")


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """Texts and items meet by fingerprint; equal texts are judged once. A passage in very many texts is one key of these
    joins, whose large partitions adaptive execution splits on the side of the texts."""
    own = fresh(docs, "key")
    items = written(items.distinct().withColumn("item_key", F.sha2("text", 256)), "decontaminate-items")
    texts = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).select(F.sha2("text", 256).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts, "decontaminate-texts")

    def marks(shapes, key):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for b in batches:
                for k, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                    h = hashes(words(text), known)
                    found = [(s[0], winnow(grams(h, s[1]), s[2])) for s in (shapes or ([shape(len(h), window, gram)] if len(h) else []))]
                    ns = np.concatenate([np.full(len(m), n, np.int32) for n, m in found]) if found else np.zeros(0, np.int32)
                    ms = np.concatenate([m for _, m in found]).view(np.int64) if found else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_pydict({key: pa.array([k] * len(ns), pa.string()), "n": ns, "mark": ms})

        return f

    item_marks = written(items.select("item_key", "text").distinct().mapInArrow(marks(None, "item_key"), "item_key string, n int, mark long").distinct(), "decontaminate-marks")
    shapes = [shape(r[0], window, gram) for r in item_marks.select("n").distinct().collect()]  # at most `window` of them
    pairs = texts.mapInArrow(marks(shapes, "key"), "key string, n int, mark long").distinct().join(item_marks, ["n", "mark"]).select("key", "item_key").distinct()
    asked = pairs.join(items, "item_key").select("key", F.lit(1).alias("kind"), "item_id", "text")
    both = texts.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("item_id"), "text").union(asked)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = h = mask = found = None
        known = WordHashes()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if key is not None:
                        rows.append((key, *_judge(len(h), int(mask.sum()), found)))
                    key, h, found = r["key"], hashes(words(r["text"]), known), set()
                    mask = np.zeros(len(h), bool)
                else:
                    m, f = Index([(r["item_id"], r["text"])], window, gram, known).hits(h)
                    found |= f
                    if m is not None:
                        mask |= m
            if rows:
                yield _batch(rows)
        if key is not None:
            yield _batch([(key, *_judge(len(h), int(mask.sum()), found))])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=[own, *(x.split()[0] for x in OUT.split(", "))])

    judged = both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(trimmed(judge), f"`{own}` string, {OUT}")
    keyed = docs.withColumn(own, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    return keyed.join(judged, own).drop(own)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)
), lengths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)
), found as (
  select doc_id, item_id, i, n from doc_windows join item_windows using (n, s)
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from found) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""
