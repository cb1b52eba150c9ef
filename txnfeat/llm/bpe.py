"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are split into pre-tokens (words) once, and kept as positions into the distinct words of a chunk of documents. The
positions are written to a file in the shared folder, one for each task; the distinct words are shuffled by a hash bucket. A
bucket encodes each of its words once, however many chunks and positions hold it, and answers each chunk with the ids. The
answers are shuffled by chunk, meet the chunk's positions, and each document's ids are put together by position. Exploding
every pre-token as a row of its own would shuffle over ten times the input; as packed word lists only about 0.4 times the
input is shuffled, and the positions take 0.8 times the input on disk.

A chunk's key is a hash of its documents and words with its place, so a task that is run again, whose rows come in the same
order (those of a table do), gives the same chunks. A chunk whose words have no answer raises ValueError instead of losing rows."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session_of, shared_folder, storage, table, trimmed

#: Code points of text in a chunk: what a task holds at a time, besides one document.
CHUNK_CHARS = 4 << 20
#: Bytes of text for each word bucket, buckets at least and at most: with more, a chunk's list for a bucket would have a few words
#: only. Beyond 256 GB buckets grow, but a task streams its lists and holds only a bucket's distinct words.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 32, 1 << 14

_SPACED = re.compile(r"(?:^|\s) ")


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def units(text: str) -> list[str]:
    """The text cut before each space that follows something else than white space; no pre-token crosses such a cut."""
    out, open_ = [], True
    for i, piece in enumerate(text.split(" ")):
        if i == 0:
            out.append(piece)
        elif open_:
            out[-1] += " " + piece
        else:
            out.append(" " + piece)
        open_ = not piece or piece[-1].isspace()
    return out


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers below 2**32, as compressed byte planes."""
    planes = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_bytes(xs: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, xs), np.uint32, len(xs)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(xs), 3)


def unpack_bytes(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends, body = np.cumsum(unpack(data[4 : 4 + n]), dtype=np.int64).tolist(), zstandard.decompress(data[4 + n :])
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Chunk:
    """Documents as positions into distinct words."""

    def __init__(self):
        self.docs, self.streams, self.spaced, self.raw, self.chars = [], [], _Numbers(), _Numbers(), 0

    def add(self, doc, text: str) -> None:
        if _SPACED.search(text):
            own = np.fromiter((-1 - self.raw[u] for u in units(text)), np.int32)
        else:
            pieces = text.split(" ")
            own = np.fromiter(map(self.spaced.__getitem__, pieces), np.int32, len(pieces))
            own[0] = -1 - self.raw[pieces[0]]
        self.docs.append(doc)
        self.streams.append(own)
        self.chars += len(text)

    def close(self, pattern: str, n_buckets: int) -> tuple[bytes, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(identity, pre-tokens of each document, positions into the words, the words by bucket and falling frequency, the buckets' ends)."""
        find, number = regex.compile(pattern).findall, _Numbers()
        split = [[number[w] for w in find(u)] for u in (*(" " + u for u in self.spaced), *self.raw)]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((w for s in split for w in s), np.int64, int(counts.sum()))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        stream = np.concatenate(self.streams).astype(np.int64)
        stream = np.where(stream < 0, len(self.spaced) - 1 - stream, stream)
        each = counts[stream]
        ends = np.cumsum(each)
        at = np.repeat(starts[stream] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)
        positions = flat[at]
        lengths = np.fromiter(map(len, self.streams), np.int64, len(self.streams))
        per_doc = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))])
        words = [w.encode() for w in number]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
        order = np.lexsort((-np.bincount(positions, minlength=len(words)), bucket))
        inverse = np.empty(len(words), np.uint32)
        inverse[order] = np.arange(len(words))
        positions, words = inverse[positions], [words[i] for i in order.tolist()]
        key = hashlib.blake2b(repr(self.docs).encode() + b"\0".join(words) + positions.tobytes() + per_doc.tobytes(), digest_size=16).digest()
        return key, per_doc, positions, words, np.searchsorted(bucket[order], np.arange(n_buckets), side="right")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            chunk.add(doc, text or "")
            if chunk.chars >= CHUNK_CHARS:
                yield chunk
                chunk = Chunk()
    if chunk.docs:
        yield chunk


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file as {token bytes: id}."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODED = "doc_id long, ids binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, then=None, fields_then: str = _ENCODED) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every row of `docs` (doc_id, text; other columns are left out).

    The ids are what tiktoken gives for the whole text, special tokens being ordinary text; a null or empty text has none.
    Repeated rows and doc_ids are encoded each for itself. ranks go to every task: a vocabulary of fixed size. `then`, a
    function for mapInArrow, is applied to the rows where they are made; the result has its fields."""
    spark = session_of(docs)
    texts = docs.select("doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, total // BUCKET_BYTES))
    sent = spark.sparkContext.broadcast(ranks)
    fields = "chunk binary, bucket int, path string, at long, size long, body binary"
    schema = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])
    folder = shared_folder(spark, "bpe-positions")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        uri = f"{folder}/part-{task:06d}-{uuid.uuid4().hex[:12]}.bin"
        fs, path = storage(uri)
        out, at = None, 0
        for n_chunk, c in enumerate(_chunks(batches)):
            key, per_doc, places, words, ends = c.close(pattern, n_buckets)
            # Equal rows may make equal chunks.
            key += task.to_bytes(4, "big") + n_chunk.to_bytes(4, "big")
            sizes = np.diff(np.concatenate(([0], ends)))
            used = np.flatnonzero(sizes)
            ids = pa.RecordBatch.from_arrays([pa.array(c.docs, pa.int64())], names=["doc_id"]).serialize().to_pybytes()
            parts = [pack(per_doc), pack(places), pack(used), pack(sizes[used]), ids]
            data = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
            if out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            out.write(data)
            lists = [(k, pack_bytes(words[e - n : e])) for k, n, e in zip(used.tolist(), sizes[used].tolist(), ends[used].tolist(), strict=True)]
            # A chunk without words has a row, too.
            for k, body in lists or [(0, pack_bytes([]))]:
                yield pa.RecordBatch.from_pydict({"chunk": [key], "bucket": [k], "path": [uri], "at": [at], "size": [len(data)], "body": [body]}, schema=schema)
            at += len(data)
        if out is not None:
            out.close()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        bucket, known = None, {}
        for b in batches:
            for key, k, uri, at, size, body in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                words = unpack_bytes(body)
                for w in words:
                    if w not in known:
                        known[w] = np.array(coder.encode_ordinary(w.decode()), "<u4").tobytes()
                ids = [known[w] for w in words]
                counts, flat = pack(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), pack(np.frombuffer(b"".join(ids), "<u4"))
                yield pa.RecordBatch.from_pydict({"chunk": [key], "bucket": [k], "path": [uri], "at": [at], "size": [size], "body": [len(counts).to_bytes(8, "little") + counts + flat]}, schema=schema)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, place = None, {}, None
        for b in batches:
            for key, k, uri, at, size, body in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if key != now:
                    if now is not None:
                        yield from documents(answers, *place)
                    now, answers, place = key, {}, (uri, at, size)
                answers[k] = body
        if now is not None:
            yield from documents(answers, *place)

    def documents(answers: dict[int, bytes], uri: str, at: int, size: int) -> Iterator[pa.RecordBatch]:
        """The rows of a chunk, from the answers of its buckets and its positions in the file."""
        fs, path = storage(uri)
        with fs.open_input_file(path) as f:
            f.seek(at)
            data = f.read(size)
        parts = []
        while data:
            n = int.from_bytes(data[:8], "little")
            parts.append(data[8 : 8 + n])
            data = data[8 + n :]
        per_doc, places, used, sizes = (unpack(p) for p in parts[:4])
        doc_ids = pa.ipc.read_record_batch(pa.BufferReader(parts[4]), pa.schema([("doc_id", pa.int64())])).column(0).to_pylist()
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for j, n_words in zip(used.tolist(), sizes.tolist(), strict=True):
            body = answers.pop(j, None)
            n = 0 if body is None else int.from_bytes(body[:8], "little")
            counts.append(np.zeros(0, np.int64) if body is None else unpack(body[8 : 8 + n]).astype(np.int64))
            if len(counts[-1]) != n_words:
                raise ValueError("a chunk's words have no answer; write the input as a table first")
            flat.append(unpack(body[8 + n :]))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        starts = np.cumsum(counts) - counts
        rows, size, p = [], 0, 0
        for doc, n in zip(doc_ids, per_doc.tolist(), strict=True):
            w = places[p : p + n]
            p += n
            each = counts[w]
            ends = np.cumsum(each)
            ids = flat[np.repeat(starts[w] - ends + each, each) + np.arange(int(ends[-1]) if n else 0)]
            rows.append((doc, ids.tobytes()))
            size += len(ids)
            if size > 1 << 20:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    words = texts.mapInArrow(trimmed(split), fields)
    answers = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(answer), fields)
    last = trimmed((lambda batches: then(together(batches))) if then else together)
    return answers.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(last, fields_then)


def _decoded(spark: SparkSession, ranks: dict[bytes, int]):
    """Joins the ids of each batch with the token-byte table, whose size is fixed: a lookup of places and lengths in it."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ids must be 0, 1, 2 ... without gaps")
    sent = spark.sparkContext.broadcast(sorted(ranks, key=ranks.__getitem__))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, sent.value), np.int64, len(sent.value))
        places, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(sent.value), np.uint8)
        for b in batches:
            texts = []
            for x in b.column(1):
                ids = np.frombuffer(x.as_py() or b"", "<u4")
                if len(ids) and int(ids.max()) >= len(lengths):
                    raise KeyError(int(ids.max()))
                each = lengths[ids]
                ends = np.cumsum(each)
                texts.append(flat[np.repeat(places[ids] - ends + each, each) + np.arange(int(each.sum()))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "bytes"])

    return f


_DECODED = "doc_id long, ids binary, bytes binary"


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids, bytes of every row of `encoded`: its ids joined with the token-byte table. An id that isn't in it raises KeyError.

    Null ids are none; repeated rows are decoded each for itself; an empty table gives an empty one."""
    return encoded.select("doc_id", "ids").mapInArrow(trimmed(_decoded(session_of(encoded), ranks)), _DECODED)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`; decoded where the ids are put together."""
    return encode(docs, ranks, pattern, _decoded(session_of(docs), ranks), _DECODED).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the multilingual vocabulary of the public tokenizers."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
