"""Helpers shared by the operators: tables, the cluster's shared folder, storage and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Rows, and bytes beyond the last of them, that go to Python at once; a row holds a whole text.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, with small Arrow batches, since a row may hold a very long text."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the frame as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_bytes(docs: DataFrame) -> DataFrame:
    """`docs` and, as its last column, the text in UTF-8 (null: empty)."""
    return docs.withColumn(fresh(docs, "text_bytes"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def fields_of(df: DataFrame) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema)


#: Steps of the distribution of identifiers from which the borders of ranges are taken.
STEPS = 8192


def ranges(docs: DataFrame, key: str, range_bytes: int) -> tuple[int, Column]:
    """(n, the range, from 0 to n - 1, of a row by its `key`, a long), where larger keys are never in a lower range.

    A range has about `range_bytes` of the column text. Up to STEPS borders are quantiles, found in a row by binary search;
    where more ranges are needed, each stretch between quantiles is divided into as many equal parts of its keys. A null
    key is in the first range. One pass over keys and lengths of texts; the driver gets STEPS numbers."""
    quantiles = F.percentile_approx(key, literals(i / STEPS for i in range(1, STEPS)), 4 * STEPS)
    total, low, high, found = docs.agg(F.sum(F.octet_length("text")), F.min(key), F.max(key), quantiles).first()
    n = (total or 0) // range_bytes + 1
    if n == 1 or found is None:
        return 1, F.lit(0)
    rough = min(n, STEPS)
    borders = sorted({found[STEPS * i // rough - 1] for i in range(1, rough)})
    xs, k = literals(borders, "L"), F.col(key)
    # Which is the number of borders below the key: halve what is left of them until one place remains.
    rounds = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(xs, middle(s)) < k, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    at = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), step, lambda s: s["lo"])
    parts = -(-n // rough)
    if parts > 1:
        ends = literals([low, *borders, high], "L")
        a, b = F.get(ends, at).cast("double"), F.get(ends, at + 1).cast("double")
        inside = F.floor((k.cast("double") - a) * parts / F.greatest(b - a, F.lit(1.0)))
        at = at * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))
    return (len(borders) + 1) * parts, F.coalesce(at.cast("int"), F.lit(0))


def literals(xs, suffix: str = "D"):
    """A literal array column of numbers, parsed at once; one lit() each takes a millisecond."""
    return F.expr(f"array({', '.join(f'{x!r}{suffix}' for x in xs)})")


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; works in executors, for each scheme that pyarrow knows."""
    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function for mapInArrow, at whose end the worker, which lives on, gives its free memory back."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return g


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


class WordHashes(dict):
    """64-bit hashes of words (bytes), the same in every process; emptied at `limit` entries. One for each task."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
