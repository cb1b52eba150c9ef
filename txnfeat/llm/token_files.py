"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier:
  blocks   entries (shared prefix length, rest length, value length as varints; rest of the key; value), where every
           RESTART-th entry has its whole key; zstandard-compressed, and a CRC-32
  index    for each block: first key, offset, length, documents and ids before it in the shard
  filter   Bloom filter over the keys
  footer   fixed length: places of index and filter, numbers of documents and ids, end mark
A key is the identifier as 8 bytes in the order of signed numbers; a null identifier is the empty key and comes first.
A value is the document's ids, little-endian, 2 bytes each if the vocabulary has at most 65,536 entries, else 4."""

from __future__ import annotations

import bisect
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, session_of, shared_folder, storage, table, trimmed, written

BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 18, 16, 10, 7
#: Bytes of text that one shard's documents have, about.
SHARD_BYTES = 32 << 20
#: Distinct words whose ids a task keeps, of about 200 bytes each.
CACHE = 500_000
FOOTER, MARK = struct.Struct("<6QBx6s"), b"SSTTOK"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries that come in ascending order of their keys."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.n, self.last, self.size = [], 0, b"", 0
        self.index, self.keys, self.docs, self.ids = [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not fall")
        if not self.n:
            self.index.append([key, self.at, 0, self.docs, self.ids])
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.n, self.last, self.size = self.n + 1, key, self.size + len(entry)
        self.keys.append(key)
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            body = self.zip.compress(b"".join(self.block))
            body += struct.pack("<I", zlib.crc32(body))
            self.index[-1][2] = len(body)
            self.out.write(body)
            self.at += len(body)
            self.block, self.n, self.size = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<4Q", *rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, self.width, MARK))


class ShardReader:
    """Reads an open shard: all of it in order, or single keys by filter and binary search over the block index."""

    def __init__(self, f):
        self.f = f
        f.seek(f.size() - FOOTER.size)
        at, n, bloom_at, self.bits, self.docs, self.ids, self.width, mark = FOOTER.unpack(f.read(FOOTER.size))
        if mark != MARK:
            raise ValueError("not a token shard")
        f.seek(at)
        data, i, self.blocks = f.read(n), 0, []
        while i < len(data):
            k, i = _read_varint(data, i)
            self.blocks.append((data[i : i + k], *struct.unpack_from("<4Q", data, i + k)))
            i += k + 32
        f.seek(bloom_at)
        self.bloom = f.read((self.bits + 7) // 8)

    def block(self, b: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, _, _ = self.blocks[b]
        self.f.seek(at)
        body = self.f.read(n)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a block is damaged")
        data, i, key = zstandard.decompress(body[:-4]), 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + n]
            i += n

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the shard, value) in order."""
        for b, (_, _, _, _, start) in enumerate(self.blocks):
            for key, value in self.block(b):
                yield id_of(key), start, value
                start += len(value) // self.width

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an identifier: none if it is absent, several if it repeats."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        firsts = [b[0] for b in self.blocks]
        found, b = [], max(0, bisect.bisect_left(firsts, key) - 1)
        while b < len(firsts) and firsts[b] <= key:
            found += [v for k, v in self.block(b) if k == key]
            b += 1
        return found


# Texts of these characters only are their own NFC form, and their lower-casing goes letter by letter.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
# The tokenizer's own pattern for its words, over those characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


#: How a byte-level model writes the bytes of the letters from À to ÿ: each printable byte as the character of its number,
#: the others, in order, as those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
_LETTERS = {c: "".join(chr(b) if b in _PRINTABLE else chr(256 + _HIDDEN.index(b)) for b in chr(c).encode()) for c in range(192, 256)}


def _plain_words(text: str) -> list[str]:
    """Words that the tokenizer encodes each by itself; pieces with other characters stay whole."""
    if _PLAIN.fullmatch(text):
        return _WORD.findall(text.lower())
    out = []
    for piece in re.split(r"[ \t-\r]+", text):
        out += _WORD.findall(piece.lower()) if _PLAIN.fullmatch(piece) else [piece]
    return out


class _WordIds(dict):
    """The stored ids of words, each encoded when it is first asked for; emptied at CACHE entries."""

    def __init__(self, t, kind: np.dtype):
        super().__init__()
        self.t, self.model, self.code = t, t.model.tokenize, {2: "H", 4: "I"}[kind.itemsize]

    def __missing__(self, word: str) -> bytes:
        # The model itself takes a plain word; any other goes through the tokenizer's normalisation and splitting.
        if _PLAIN.fullmatch(word):
            ids = [x.id for x in self.model(word if word.isascii() else word.translate(_LETTERS))]
        else:
            ids = self.t.encode(word, add_special_tokens=False).ids
        if len(self) >= CACHE:
            self.clear()
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        stored = self[word] = out.tobytes()
        return stored


def id_width(tokenizer_json: str) -> int:
    """Bytes of an id: 2 if the vocabulary, with its added tokens, has at most 65,536 entries, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 else 4


def encode_words(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids, width (bytes of an id) of every row of `docs` (doc_id, text), `end_id` appended.

    The ids are those that the tokenizer gives for the whole text with add_special_tokens=False; null texts are empty, equal
    rows are encoded each for itself, an empty table gives an empty one. The tokenizer (a tokenizers file, sent to every
    task: its vocabulary has a fixed size) must be a lower-casing BPE with word ends that drops white space, as CLIP's: then
    its words are encoded each by itself, and each distinct one once as long as a task remembers it. A text that holds the
    string of an added token is given to the tokenizer as a whole. A long text is held by one task, with its ids."""
    sent, width = session_of(docs).sparkContext.broadcast(tokenizer_json), id_width(tokenizer_json)
    kind = np.dtype(f"<u{width}")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        known, end = _WordIds(t, kind).__getitem__, np.array([end_id], kind).tobytes()

        def stored(text: str) -> bytes:
            if any(a in text for a in added):
                return np.array(t.encode(text, add_special_tokens=False).ids, kind).tobytes() + end
            return b"".join(map(known, _plain_words(text))) + end

        for b in batches:
            values = [stored(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) // width for v in values], pa.int64()), pa.array(values, pa.binary()), pa.array([width] * len(values), pa.int32())], names=["doc_id", "n_tokens", "ids", "width"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(f), "doc_id long, n_tokens long, ids binary, width int")


def write_shards(docs: DataFrame, encoded: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes `encoded` (doc_id, ids, width), the rows of `docs`, as shards; returns shard, path, docs, ids, as a written table.

    Shards hold ranges of doc_id, whose borders come from the distribution of `docs`, so nothing is encoded twice; each is
    written by one task. Equal identifiers stay in one shard, ordered by their ids; null identifiers come first; an empty
    table has no shard."""
    session_of(encoded)
    n, shard = ranges(docs, "doc_id", shard_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = out = w = uri = None
        rows = []
        for b in batches:
            for s, doc, ids, width in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids", "width")), strict=True):
                if s != now:
                    if w is not None:
                        w.close()
                        out.close()
                        rows.append((now, uri, w.docs, w.ids))
                    now, uri = s, f"{folder}/shard-{s:06d}-{uuid.uuid4().hex[:12]}.sst"
                    fs, path = storage(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                    w = ShardWriter(out, width)
                w.add(key_of(doc), ids)
        if w is not None:
            w.close()
            out.close()
            rows.append((now, uri, w.docs, w.ids))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "path", "docs", "ids"])

    parted = encoded.select(shard.alias("shard"), "doc_id", "ids", "width").repartitionById(n, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return written(parted.mapInArrow(trimmed(write), "shard int, path string, docs long, ids long"), "shards")


def _placed(shards: DataFrame) -> DataFrame:
    """path and start of each listed shard, each in a task of its own. The driver gets a short row per shard."""
    listed = sorted(tuple(r) for r in shards.select("shard", "path", "ids").collect())
    starts = np.cumsum([0, *(r[2] for r in listed)]).tolist()
    plan = shards.sparkSession.createDataFrame([(i, r[1], s) for i, (r, s) in enumerate(zip(listed, starts, strict=False))], "i int, path string, start long")
    return plan.repartitionById(max(1, len(listed)), "i").select("path", "start")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (doc_id, start, stored ids, width), of some megabytes each, from the shards that are listed."""
    for uri, before in ((u, s) for b in batches for u, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
        fs, path = storage(uri)
        with fs.open_input_file(path) as f:
            r, rows, size = ShardReader(f), [], 0
            for doc, start, value in r:
                rows.append((doc, before + start, value, r.width))
                size += len(value)
                if size > 1 << 22:
                    yield rows
                    rows, size = [], 0
            if rows:
                yield rows


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (as stored) and width of each document of the listed shards."""
    session_of(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _documents(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["doc_id", "start", "ids", "width"])

    return _placed(shards).mapInArrow(trimmed(read), "doc_id long, start long, ids binary, width int")


def look_up(shards: Iterable[str], doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document, from the shards' paths: by Bloom filter, block index and one block."""
    found = []
    for uri in shards:
        fs, path = storage(uri)
        with fs.open_input_file(path) as f:
            r = ShardReader(f)
            found += [np.frombuffer(v, f"<u{r.width}") for v in r.get(doc_id)]
    return found


def checksums(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit integers, of each document of the listed shards."""
    session_of(shards)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _documents(batches):
            out = [(doc, start, len(v) // w, zlib.crc32(np.frombuffer(v, f"<u{w}").astype("<u4").tobytes())) for doc, start, v, w in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(shards).mapInArrow(trimmed(f), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encoded = encode_words(docs, f.read(), end_id=1)
    return checksums(write_shards(docs, encoded, shared_folder(spark, "tokens")))
