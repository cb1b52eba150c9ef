"""Source divergence audit: how far the term shares of each two sources of a language lie apart, and each source's own terms.

Terms are counted by (language, source), in each task before the shuffle. Each kept term then is one row, a vector of its counts
in all sources of its language; higher-order functions turn it into shares, and the differences of each two of them into
contributions, which are summed where they are made before they are shuffled. All arithmetic is on integers.

A share is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the group's occurrences of the V kept terms; two shares
p and q contribute floor((p - q)^2 / (p + q)). Work and rows grow with kept terms times pairs of sources; the result has a
row for each pair of sources, so their number is taken as one that such a result can be made for."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import session_of, table, trimmed, with_bytes, written

LEAST_DOCS, BEST = 10, 10
#: Entries that a task counts before it passes them on; bytes of a text whose terms are held at once.
ENTRIES, CHUNK_BYTES = 400_000, 1 << 20
#: So many contributions are a task's work: few terms of many sources are spread like many terms of few.
TASK_PAIRS = 4_000_000


#: For translate(): A-Z lower-cased, other ASCII than letters as spaces.
LETTERS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def share(count: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(10^9 * (count + 2) / (total + 2 * kept)); beyond 64 bits in decimals."""
    least = f"1000000000L * ({count} + 2) div ({total} + 2 * {kept})"
    most = f"cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {kept} as decimal(20,0))"
    return f"1 + case when {count} < 9000000000L then {least} else {most} end"


def _difference(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch of it at a time."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, docs, size = defaultdict(Counter), defaultdict(Counter), 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in found.items():
            held = docs[lang, source]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        found.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            terms, distinct = found[lang, source], set()
            before = len(terms)
            for words in stretches(text.as_py()):
                terms.update(words)
                distinct.update(words)
            docs[lang, source].update(distinct)
            size += len(terms) - before
            if size >= ENTRIES:
                yield from told()
                size = 0
    yield from told()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) of all terms."""
    session_of(docs)
    texts = with_bytes(docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))).drop("text")
    each = texts.mapInArrow(trimmed(_count), "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """lang, source, part, item, value, rank.

    docs: text, lang, source; a null counts as an empty text, other columns are left out. Part 'pair' has a row for each
    ordered pair of sources of a language, part 'term' the `best` terms whose share in the source is above that in the
    language. Values are in descending order, ties in ascending order of the item's UTF-8. A term is kept where at least
    `least_docs` rows of its language hold it (rows that repeat count each); without kept terms all pairs have value 0
    and there are no terms. A group without terms has the share of a count of 0 for each. A text of any length is read
    whole, stretch by stretch; an empty table gives an empty one."""
    kept = counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("own")).where(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "divergence-terms")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.select("lang", F.explode("own").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    each = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("s"))
    langs = each.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s"), F.sum("s.total").alias("all_total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    # A row for each language, as long as its number of sources.
    langs = written(langs.select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), "all_total", F.coalesce("v", F.lit(0)).alias("v")), "divergence-groups")

    work = langs.agg(F.sum(F.col("v") * F.size("sources") * F.size("sources") / 2)).first()[0] or 0
    wide = kept.join(langs, "lang").repartition(int(work // TASK_PAIRS) + 1, "lang", "term")
    wide = wide.withColumn("counts", F.expr("transform(sources, s -> coalesce(own[s], 0L))"))
    wide = wide.withColumn("shares", F.expr(f"transform(counts, (n, i) -> {share('n', 'totals[i]', 'v')})"))

    one = wide.select("lang", "shares", F.posexplode("shares").alias("i", "p"))
    two = one.select("lang", "i", F.explode(F.expr(f"transform(slice(shares, i + 2, size(shares)), (q, k) -> struct(i + 1 + k as j, {_difference('p', 'q')} as f))")).alias("c"))
    sums = two.groupBy("lang", "i", F.col("c.j").alias("j")).agg(F.sum("c.f").alias("f"))
    pairs = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    pairs = pairs.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(sums, ["lang", "i", "j"], "left")
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(in_order))

    q = wide.withColumn("q", F.expr(share("n", "all_total", "v")))
    own = q.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "counts", "shares")).alias("c")).where("c.counts > 0 and c.shares > q")
    own = own.select("lang", F.col("c.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_difference("c.shares", "q")).alias("value"))
    # The filter on the rank is applied before the shuffle too: a task sends the best of each group.
    return pairs.union(own.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= best))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), groups as (select distinct lang, source from docs),
terms as (select row, lang, source, unnest(w) as term from docs),
kept as (select lang, term from terms group by all having count(distinct row) >= 10),
sizes as (select lang, count(*)::hugeint as v from kept group by lang),
counts as (select lang, source, term, count(*)::hugeint as n from terms join kept using (lang, term) group by all),
totals as (select lang, source, sum(n)::hugeint as total from counts group by all),
all_counts as (select lang, term, sum(n)::hugeint as n from counts group by all),
all_totals as (select lang, sum(n)::hugeint as total from all_counts group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * v) as p
  from groups g join kept k on g.lang = k.lang join sizes s on s.lang = g.lang
  left join totals t on t.lang = g.lang and t.source = g.source
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), lang_shares as (
  select lang, term, 1 + 1000000000 * (n + 2) // (total + 2 * v) as q from all_counts join all_totals using (lang) join sizes using (lang)
), own as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value
  from shares join lang_shares using (lang, term) where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from own)
)
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 10
"""
