"""Near-duplicate groups: MinHash bands retrieve candidates, odd sketches screen them, full shingle sets confirm them.

1. One pass over the texts gives each row its set size, a 128-bit identity of its set, BANDS band keys and an odd
   sketch: the parity of how many of the MinHash samples fall on each bit. Equal sets are one node, numbered by itself
   and not by a doc_id, so thousands of copies cost as much as one and a doc_id with several texts is several nodes.
2. The members of a band's bucket form a star around its hub, its smallest node. All buckets of a hub are one cluster, so
   a family that shares many buckets is looked at once. Members are compared with their hub.
3. In a cluster that then still holds several components, those outside the hub's component (strays) are compared with
   all members of other components. This happens in cells: a block of strays against a block of members, both of bounded
   size, in one task. A cell gives links, at most one fewer than it has components, and never a row for each pair.
4. Wherever two sets are compared, their odd sketches come first: a pair whose XOR has too many ones (an estimate far
   below the threshold) ends there, the others are confirmed on full sets. Components of the links come from alternating
   large and small stars, as tables.

At J = 0.8, 32 bands of 4 rows miss a pair with probability (1 - 0.8^4)^32 = 5e-8. The screen lets up to 81 of 256 bits differ, over
five standard deviations more than expected, and ends a pair with probability 8e-8 (for independent MinHashes: those that
differ are binomial, each flips two random bits). A link is lost only if no other path joins the two."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, session_of, table, trimmed, written

BANDS, ROWS, SKETCH_BITS = 32, 4, 256
#: Rows of nodes up to this many (about 100 MB in an executor's hash table) are broadcast; more are joined in a shuffle.
BROADCAST_ROWS = 250_000
#: Estimates this far below the threshold are screened out.
SLACK = 0.3
#: A block has about so many shingles; each of its sets counts for EACH more, so it has at most about 1,000 sets.
BLOCK, EACH = 400_000, 400

_RANDOM = np.random.default_rng(20240101)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, k: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence, if it has fewer words; none without words."""
    ws = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    h = np.fromiter(map((WordHashes() if hashes is None else hashes).__getitem__, ws), np.uint64, len(ws))
    if not len(h):
        return h
    m = min(k, len(h))
    n = len(h) - m + 1
    out = np.full(n, m, np.uint64)
    for i in range(m):
        out = (out + h[i : i + n]) * _M1
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out))


def minhashes(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least values of the set under as many hash functions."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        x = np.multiply.outer(_A, s[i : i + 256])
        x += _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return least


def signature(s: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """(identity of the set, band keys, odd sketch)."""
    least = _mix(minhashes(s) + np.arange(BANDS * ROWS, dtype=np.uint64) * _M2)
    bits = np.bincount((least >> np.uint64(11)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
    keys = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = _mix(keys + least.reshape(BANDS, ROWS)[:, r])
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys.view(np.int64).tolist(), sketch.tolist()


def most_ones(similarity: float) -> int:
    """The expected XOR population count of two odd sketches at that similarity."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - similarity) / SKETCH_BITS)))


def estimate(a: list[int], b: list[int]) -> float:
    """Similarity from two odd sketches."""
    ones = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * math.log(max(1 - 2 * ones / SKETCH_BITS, 1e-9))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _ones(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, sid, bands, sketch of each row; sid, bands and sketch are null for an empty set."""
    session_of(docs)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                s = shingles(text.as_py(), k, hashes)
                rows.append((doc.as_py(), len(s), *(signature(s) if len(s) else (None, None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_shingles", "sid", "bands", "sketch"])

    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(trimmed(sign), "doc_id long, n_shingles long, sid binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, k: int, broadcast_rows: int) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the wanted nodes (sid, node, id), from the text of one of each node's rows."""
    session_of(docs)
    nodes = written(nodes, "near-dups-wanted")
    # Rows with the doc_id of a wanted node's first row; which of them has the node's set is seen from the set itself.
    ids = written(nodes.select("id").distinct(), "near-dups-ids")
    texts = docs.select(F.col("doc_id").alias("own"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    texts = texts.join(_small(ids, broadcast_rows), F.col("own").eqNullSafe(F.col("id")), "left_semi").select("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [s for t in b.column(0) if len(s := shingles(t.as_py(), k, hashes))]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "set"])

    of = nodes.select("sid", "node")
    found = written(texts.mapInArrow(trimmed(f), "sid binary, set binary").join(_small(of, broadcast_rows), "sid").select("node", "set"), "near-dups-sets")
    # More rows than nodes only where a doc_id repeats or is null; then one of the equal sets is kept.
    return found if found.count() == nodes.count() else written(found.groupBy("node").agg(F.first("set").alias("set")), "near-dups-sets")


class _Cell:
    """Two blocks of sets whose pairs are compared; left sets also with each other, if `within`."""

    def __init__(self, percent: int):
        self.percent, self.most = percent, most_ones(percent / 100 - SLACK)
        self.sides: tuple[list, list] = ([], [])
        self.within = False

    def links(self) -> list[tuple[int, int]]:
        """Pairs (a, b) of nodes that join the components as all links do."""
        left, right = self.sides
        if self.within:
            right = right + left
        if not left or not right:
            return []
        sizes = np.array([len(r[2]) for r in right], np.int64)
        values = np.concatenate([r[2] for r in right])
        rows = np.repeat(np.arange(len(right), dtype=np.int32), sizes)
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        sketches = np.array([r[3] for r in right], np.int64).view(np.uint64)
        nodes, labels = np.array([r[0] for r in right]), np.array([r[1] for r in right])
        own, found = np.array([r[1] for r in left]), []
        for i, (node, _, s, sketch) in enumerate(left):
            ones = np.bitwise_count(sketches ^ np.array(sketch, np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = (labels != own[i]) & (ones <= self.most) & (np.minimum(sizes, len(s)) * 100 >= np.maximum(sizes, len(s)) * self.percent)
            if not near.any():
                continue
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            each = hi - lo
            ends = np.cumsum(each)
            at = np.repeat(lo - ends + each, each) + np.arange(int(ends[-1]))
            common = np.bincount(rows[at], minlength=len(right))
            for j in np.flatnonzero(near & (common * 100 >= (sizes + len(s) - common) * self.percent)).tolist():
                if labels[j] != own[i]:
                    found.append((node, int(nodes[j])))
                    gone = labels[j]
                    labels[labels == gone] = own[i]
                    own[own == gone] = own[i]
        return found


def _compared(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within cells (hub, i, r, side, node, c, sketch, set): sets of side 0 and 1 whose components c differ."""
    session_of(cells)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell(percent)
        for b in batches:
            keys = list(zip(*(b.column(x).to_pylist() for x in ("hub", "i", "r")), strict=True))
            for key, side, node, c, sketch, s in zip(keys, *(b.column(x).to_pylist() for x in ("side", "node", "c", "sketch")), b.column("set"), strict=True):
                if key != now:
                    if found := cell.links():
                        yield _batch(found)
                    now, cell = key, _Cell(percent)
                    cell.within = key[2] == 0
                cell.sides[side].append((node, c, np.frombuffer(s.as_py(), np.uint64), sketch))
        if found := cell.links():
            yield _batch(found)

    def _batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    placed = cells.repartition("hub", "i", "r").sortWithinPartitions("hub", "i", "r", "side", "node")
    return placed.select("hub", "i", "r", "side", "node", "c", "sketch", "set").mapInArrow(trimmed(f), "a long, b long")


def _block(blocks: Column) -> Column:
    """The block of a node, one of so many."""
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in the edges (a, b), by alternating large and small stars."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        last, seen = seen, print_of(now)
        if last == seen:
            break
    return written(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text; other columns are left out).

    Texts are linked where 100 * intersection >= percent * union of their sets of k-word shingles; component_id is the
    smallest doc_id of a row whose text is reachable. Null texts and texts without words have an empty set and are linked
    with nothing. Rows that repeat a doc_id with one text are told alike; those with one doc_id and different texts are
    different texts, each in its own component. A null doc_id is never smallest: component_id is null where all rows of a
    component have none. kept is doc_id = component_id, with null equal to null. An empty table gives an empty one."""
    signed = written(signatures(docs, k), "near-dups-signed")
    # Equal sets have equal bands and sketches.
    classes = signed.where("sid is not null").groupBy("sid", "n_shingles").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    reps = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-dups-reps")
    nodes = reps.select("node", "sketch", F.col("n_shingles").alias("n"))

    # Stars: each member of a bucket and its hub.
    placed = reps.select("node", F.explode("bands").alias("key"))
    shared = written(placed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub"), "near-dups-buckets")
    stars = written(placed.join(_small(shared, broadcast_rows), "key").where("node <> hub").select("hub", "node").distinct(), "near-dups-stars")
    members = written(stars.select("node").union(stars.select("hub")).distinct(), "near-dups-members")
    known = written(nodes.join(_small(members, broadcast_rows), "node"), "near-dups-known")
    ends = _small(known, broadcast_rows // 5)
    x, y = (ends.select(F.col("node").alias(a), F.col("sketch").alias(b), F.col("n").alias(c)) for a, b, c in (("hub", "x", "m"), ("node", "y", "n")))
    enough = (F.least("m", "n") * 100 >= F.greatest("m", "n") * percent) & (_ones("x", "y") <= most_ones(percent / 100 - SLACK))
    screened = written(stars.join(x, "hub").join(y, "node").where(enough).select("hub", "node", "n"), "near-dups-screened")
    blocks = screened.groupBy("hub").agg(F.ceil(F.sum(F.col("n") + EACH) / block).cast("int").alias("p"))
    at = lambda i, r, side, c: [F.col("hub"), i.cast("int").alias("i"), r.cast("int").alias("r"), F.lit(side).alias("side"), F.col("node"), c.alias("c")]
    # Cells of the stars: the hub against a block of members. Left sets are compared with each other where r is 0, and here a hub is alone.
    cells = blocks.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("k")).select(*at(F.col("k"), F.lit(1), 0, F.col("node")))
    cells = cells.union(screened.join(blocks, "hub").select(*at(_block(F.col("p")), F.lit(1), 1, F.col("node"))))

    def compared(cells: DataFrame, sets: DataFrame) -> DataFrame:
        return written(_compared(cells.join(sets, "node").join(ends.select("node", "sketch"), "node"), percent), "near-dups-links")

    wanted = lambda df: reps.select("sid", "node", "id").join(_small(written(df.distinct(), "near-dups-asked"), broadcast_rows), "node")
    links = compared(cells, _sets(docs, wanted(screened.select("node").union(screened.select("hub"))), k, broadcast_rows))
    found = components(links)

    # Clusters that still hold several components: strays, outside the hub's component, against all others.
    label = written(ends.select("node", "n").join(found.withColumnRenamed("id", "node"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("c")), "near-dups-labels")
    some = _small(label, broadcast_rows // 2)
    cluster = stars.join(some, "node").join(some.select(F.col("node").alias("hub"), F.col("c").alias("hub_c")), "hub")
    mixed = cluster.groupBy("hub").agg(F.max(F.col("c") != F.col("hub_c")).alias("mixed")).where("mixed").select("hub")
    cluster = cluster.join(_small(written(mixed, "near-dups-mixed"), broadcast_rows), "hub")
    cluster = written(cluster.union(cluster.select("hub", F.col("hub").alias("node"), "hub_c").distinct().join(some, "node").select("hub", "node", "n", "c", "hub_c")), "near-dups-clusters")
    if not cluster.isEmpty():
        stray, weight = F.col("c") != F.col("hub_c"), F.col("n") + EACH
        several = lambda x: F.greatest(F.lit(1), F.ceil(F.sum(F.when(x, weight).otherwise(0)) / block)).cast("int")
        sized = cluster.groupBy("hub").agg(several(stray).alias("ps"), several(~stray).alias("pg"))
        of = cluster.join(_small(written(sized, "near-dups-blocks"), broadcast_rows), "hub")
        of = of.withColumn("k", F.when(stray, _block(F.col("ps"))).otherwise(_block(F.col("pg"))))
        # The cells (i, r) of a set: a stray of block k is left in (k, each block of the hub's component and each later block of
        # strays), right in (each earlier block of strays, its own); one of the hub's component is right in (each block of strays, k).
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        as_left = F.transform(F.concat(span(F.lit(0), F.col("pg") - 1), span(F.col("pg") + F.col("k") + 1, F.col("pg") + F.col("ps") - 1)), lambda r: F.struct(F.col("k").alias("i"), r.alias("r"), F.lit(0).alias("side")))
        as_right = F.transform(span(F.lit(0), F.when(stray, F.col("k") - 1).otherwise(F.col("ps") - 1)), lambda i: F.struct(i.alias("i"), F.when(stray, F.col("pg") + F.col("k")).otherwise(F.col("k")).alias("r"), F.lit(1).alias("side")))
        cells = of.withColumn("cell", F.explode(F.when(stray, F.concat(as_left, as_right)).otherwise(as_right))).select("hub", "cell.i", "cell.r", "cell.side", "node", "c")
        more = compared(cells, _sets(docs, wanted(cluster.select("node")), k, broadcast_rows))
        if not more.isEmpty():
            found = components(links.union(more))

    # Rows of texts with copies or links; all other rows are their own component.
    of = reps.select("sid", "node", "id", "copies").join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    special = written(of.where("copies > 1 or component is not null").select("sid", "id", F.coalesce("component", "node").alias("component")), "near-dups-special")
    least = special.groupBy("component").agg(F.min("id").alias("component_id"))
    named = written(special.join(_small(written(least, "near-dups-least"), broadcast_rows), "component").select("sid", F.lit(True).alias("named"), "component_id"), "near-dups-named")
    out = signed.select("doc_id", "n_shingles", "sid").join(_small(named, broadcast_rows), "sid", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach as (
  select doc_id, doc_id as other from n
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
), smallest as (select doc_id, min(other) as component_id from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id,
       coalesce(component_id, w.doc_id) = w.doc_id as kept
from words w left join n using (doc_id) left join smallest using (doc_id)
"""
