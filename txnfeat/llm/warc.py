"""WARC archives: records with revisits, segments and chunked transfer framing; and their reassembly.

Writing: every page is one record; a block longer than `segment_bytes` is split into a first segment and continuation
records, which go to a second archive of the same task. Reading: segments are grouped by origin identifier, ordered by
segment number, checked against the stated total length, and the chunked framing is decoded while they stream by, so a
task holds one segment at a time, however long a record is. Revisits are resolved by the identifier of the record that
they refer to, and have its length and digest. What is broken becomes a row that tells the problem, not an error."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session_of, shared_folder, storage, table, trimmed, written

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
#: Revisits up to this many rows (each under 200 bytes) are broadcast to the payloads; beyond, shuffled.
BROADCAST_REVISITS = 100_000
#: Any day will do; equal runs write equal records.
DATE = "2024-01-01T00:00:00Z"

RECORDS = "origin string, segment int, page_id long, record_type string, refers string, digest string, total long, block binary, problem string"


def record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to, copy of each page.

    A null html is an empty payload. Of equal payloads of at least `least_bytes`, the rows with the smallest page_id
    are responses (all of them, if that page is repeated), the others revisit it; null page_ids are never smallest, and
    pages without one that share a payload are responses if no other page has it. copy numbers rows that repeat both
    page_id and payload from 0. Types are found on digests and page_ids alone, and meet the payloads by both, so a payload
    that very many pages share is no hot key; only rows that repeat both are sorted with their payloads."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.select("*", F.sha2("payload", 256).alias("payload_digest"))
    long = F.octet_length("payload") >= least_bytes
    each = written(p.groupBy("payload_digest", "page_id", long.alias("long")).agg(F.count("*").alias("n")), "warc-digests")
    firsts = written(each.where("long").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 and first is not null").select("payload_digest", "first"), "warc-firsts")
    again = each.join(F.broadcast(firsts) if firsts.count() <= broadcast_revisits else firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    marked = again.select(F.col("payload_digest").alias("digest_"), F.col("page_id").alias("page_"), "first")
    repeated = written(each.where("n > 1").select(F.col("payload_digest").alias("digest_"), F.col("page_id").alias("page_"), F.lit(True).alias("repeats")), "warc-repeated")
    marked = written(marked.join(repeated, (marked["digest_"] == repeated["digest_"]) & marked["page_"].eqNullSafe(repeated["page_"]), "full").select(F.coalesce(marked["digest_"], repeated["digest_"]).alias("digest_"), F.coalesce(marked["page_"], repeated["page_"]).alias("page_"), "first", "repeats"), "warc-marked")
    n = marked.count()
    done = p.join(F.broadcast(marked) if n <= broadcast_revisits else marked, (F.col("payload_digest") == F.col("digest_")) & F.col("page_id").eqNullSafe(F.col("page_")), "left")
    columns = ["page_id", "url", "payload", "payload_digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to")]
    if repeated.isEmpty():
        return done.select(*columns, F.lit(0).alias("copy"))
    copy = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy("url")) - 1
    return done.where("repeats is null").select(*columns, F.lit(0).alias("copy")).union(done.where("repeats").select(*columns, copy.alias("copy")))


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """The identifier of the record of a page with that payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}/{copy}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), CHUNK_BYTES) for c in [payload[i : i + CHUNK_BYTES]]) + b"0\r\n\r\n"


def write_archives(records: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes `records` (of record_types) as .warc.gz archives below `folder`; returns their paths, as a written table.

    Each attempt of a task writes files of its own name, and only those of the attempt that succeeded are listed."""
    session_of(records)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        fs, path = storage(stem)
        out: dict[str, pa.NativeFile] = {}

        def put(kind: str, data: bytes) -> None:
            if kind not in out:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out[kind] = fs.open_output_stream(f"{path}-{kind}.warc.gz", compression=None)
            out[kind].write(data)

        for b in batches:
            for page, url, payload, digest, kind, refers, copy in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "copy")), strict=True):
                origin = record_id(page, digest, copy)
                first = [("WARC-Type", kind), ("WARC-Record-ID", origin), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if kind == "revisit":
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    put("main", _record([*first, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest))], block))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
                if len(block) <= segment_bytes:
                    put("main", _record(first, block))
                    continue
                put("main", _record([*first, ("WARC-Segment-Number", 1)], block[:segment_bytes]))
                starts = range(segment_bytes, len(block), segment_bytes)
                for k, at in enumerate(starts, 2):
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}/{k}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if at == starts[-1] else None)]
                    put("more", _record(more, block[at : at + segment_bytes]))
        for f in out.values():
            f.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{stem}-{k}.warc.gz" for k in out], pa.string())})

    return written(records.mapInArrow(trimmed(write), "path string"), "warc-list")


def parse_archive(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an open .warc.gz file, record by record; raises ValueError where it is broken."""
    rest, z, data = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not rest:
            rest = f.read(1 << 16)
            if not rest:
                if data:
                    raise ValueError("the archive ends within a record")
                return
        try:
            data += z.decompress(rest)
        except zlib.error as e:
            raise ValueError(f"the archive is damaged: {e}") from e
        rest = z.unused_data
        if z.eof:
            head, _, body = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode(errors="replace").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            n = fields.get("Content-Length", "")
            if not lines[0].startswith("WARC/") or "WARC-Type" not in fields or "WARC-Record-ID" not in fields or not n.isdigit() or len(body) != int(n) + 4:
                raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
            yield fields, body[: int(n)]
            z, data = zlib.decompressobj(31), bytearray()
        else:
            rest = b""


class Payload:
    """Decodes an HTTP response block that comes in pieces; keeps only its length and SHA-256, unless `keep`."""

    def __init__(self, keep: bool = False):
        self.buffer, self.head, self.left, self.done, self.read = b"", None, None, False, 0
        self.sha, self.n, self.kept = hashlib.sha256(), 0, [] if keep else None

    def feed(self, piece: bytes) -> None:
        self.read += len(piece)
        self.buffer += piece
        if self.head is None:
            head, found, rest = self.buffer.partition(b"\r\n\r\n")
            if not found:
                return
            self.head, self.buffer = head, rest
        if b"Transfer-Encoding: chunked" not in self.head:
            self._take(self.buffer)
            self.buffer = b""
            return
        at = 0
        while not self.done:
            if self.left is None:
                end = self.buffer.find(b"\r\n", at)
                if end < 0:
                    break
                self.left, at = int(self.buffer[at:end].split(b";")[0], 16), end + 2
                self.last = self.left == 0
            take = self.buffer[at : at + self.left]
            if take:
                self._take(take)
                at, self.left = at + len(take), self.left - len(take)
            if self.left or len(self.buffer) < at + 2:
                break
            if self.buffer[at : at + 2] != b"\r\n":
                raise ValueError("broken chunk")
            at, self.left, self.done = at + 2, None, self.last
        self.buffer = self.buffer[at:]

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def close(self, digest: str) -> tuple[int, str]:
        if self.head is None or b"Transfer-Encoding: chunked" in self.head and not self.done or self.buffer:
            raise ValueError("the response is cut short")
        if self.sha.hexdigest() != digest:
            raise ValueError("the payload doesn't have the stated digest")
        return self.n, digest


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def read_archives(paths: DataFrame) -> DataFrame:
    """One row per record or segment of the archives listed in `paths`, undecoded.

    An archive that is damaged gives its records up to there and a row of the type broken, with the path as origin and the
    problem. No paths give no rows; a path that is listed twice gives its records twice."""
    spark = session_of(paths)
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("problem", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for uri in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = storage(uri)
            with fs.open_input_stream(path, compression=None) as f:
                try:
                    for h, block in parse_archive(f):
                        rows.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), _number(h.get("WARC-Segment-Number")) or 0, _number(h.get("X-Page-ID")), h["WARC-Type"], h.get("WARC-Refers-To"), h.get("WARC-Payload-Digest", "sha256:")[7:], _number(h.get("WARC-Segment-Total-Length")), block, None))
                        size += len(block)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append((uri, 0, None, "broken", None, None, None, b"", str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, min(paths.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return paths.repartition(n, "path").mapInArrow(trimmed(read), RECORDS)


def reassemble(records: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of each record; with payloads, the payload too (a revisit has none).

    A response's segments are joined in order, checked and decoded. All segments of one origin meet in one task in order; a
    task holds one segment (all of a payload, if payloads are asked for). A revisit has the page, length and digest of the
    response whose identifier it names. Of a record with a missing or repeated segment, another total length or digest, or
    of a revisit without its response, problem tells what is wrong, and length and digest are null; else problem is null."""
    session_of(records)
    extra = [("payload", pa.binary())] if payloads else []
    schema = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("problem", pa.string()), *extra])

    class Record:
        def __init__(self, origin: str):
            self.origin, self.last, self.first, self.total, self.payload, self.problem = origin, None, {}, None, Payload(payloads), None

        def add(self, r: dict) -> None:
            segment = r.pop("segment")
            block = r.pop("block")
            self.problem = self.problem or r["problem"]
            if segment != (0 if self.last is None and segment == 0 else (self.last or 0) + 1):
                self.problem = self.problem or f"segment {segment} after {self.last}"
            self.last = segment
            if r["record_type"] != "continuation":
                self.first = r
            self.total = r["total"] if r["total"] is not None else self.total
            if not self.problem and r["record_type"] != "revisit":
                try:
                    self.payload.feed(block)
                except ValueError as e:
                    self.problem = str(e)

        def row(self) -> tuple:
            n = digest = None
            if not self.problem and (not self.first or self.last > 1 and self.total != self.payload.read):
                self.problem = "segments are missing or have another total length"
            kind = self.first.get("record_type")
            if kind == "revisit":
                digest = self.first["digest"]
            elif not self.problem:
                try:
                    n, digest = self.payload.close(self.first["digest"])
                except ValueError as e:
                    self.problem = str(e)
            whole = [b"".join(self.payload.kept) if n is not None else None] if payloads else []
            return (self.origin, self.first.get("page_id"), n, None if self.problem else digest, kind, self.first.get("refers"), self.problem, *whole)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if now is None or r["origin"] != now.origin:
                    if now is not None:
                        rows.append(now.row())
                    now = Record(r["origin"])
                now.add(r)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(now.row(), schema, strict=True)], schema=schema)

    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string, problem string"
    done = records.repartition(n, "origin").sortWithinPartitions("origin", "segment").mapInArrow(trimmed(join), fields + ", payload binary" * payloads)
    done = written(done, "warc-records")
    # A response with a problem, or under an identifier that repeats, isn't there for revisits.
    answers = done.where("record_type = 'response' and problem is null").groupBy("origin").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("n"), F.first("payload_digest").alias("d"))
    asked = done.where("record_type = 'revisit' and problem is null").join(answers.withColumnRenamed("origin", "refers"), "refers", "left")
    fits = F.col("d") == F.col("payload_digest")
    resolved = asked.select("page_id", F.when(fits, F.col("n")).alias("payload_bytes"), F.when(fits, F.col("d")).alias("payload_digest"), "record_type", F.when(fits, F.col("refers_to")).alias("refers_to"), F.when(fits, F.lit(None)).otherwise("the response that it revisits is missing or has another digest").alias("problem"), *(["payload"] if payloads else []))
    others = done.where("record_type is null or record_type <> 'revisit' or problem is not null")
    return others.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem", *(["payload"] if payloads else [])).unionByName(resolved)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(record_types(table(spark, sf_dir, "pages")), shared_folder(spark, "warc"))
    return reassemble(read_archives(paths))


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages
), firsts as (
  select digest, min(page_id) as first from p where n >= 100 group by digest
)
select p.page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
       case when first is null or p.page_id = first then 'response' else 'revisit' end as record_type,
       case when p.page_id <> first then first end as refers_to, cast(null as varchar) as problem
from p left join firsts f on p.digest = f.digest
"""
