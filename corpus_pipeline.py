"""From documents to token ids: four stages, each written as Parquet and read again as the next one's input.

Stages work on the columns of documents (doc_id, text, lang, source, n_chars); others are left out. Null and empty texts
pass through each stage by the rules of its operator. Each stage judges all that its predecessor kept, and needs nothing
on the driver but bounded samples and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnfeat.llm import bpe, decontaminate, near_dups, quality
from txnfeat.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Identifiers up to this many (8 MB) are broadcast to drop their rows; more are shuffled.
BROADCAST_IDS = 1_000_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts are scored like any other, equal texts alike, so rows that repeat stay or go together; texts of any
    length are scored whole. Without labels all texts score alike. An empty table gives an empty one."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """`docs` with key_, and whether it's a key of its own: of doc_id and text where a doc_id is null or has several texts, else doc_id."""
    text = (F.col("text").isNull(), "text")
    odd = docs.select("doc_id", F.xxhash64(*text).alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("doc_id is null or lo <> hi")
    own = not odd.isEmpty()
    return docs.withColumn("key_", F.xxhash64(F.col("doc_id").isNull(), "doc_id", *text) if own else F.col("doc_id")), own


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates (five-word shingles, Jaccard 0.8).

    Rows are told apart by doc_id and text: those with one doc_id and different texts are different documents, rows equal
    in both are one. A null doc_id comes after all others; rows with a null doc_id and no words all stay, as null and empty
    texts are linked with nothing. Texts of any length are compared whole; an empty table gives an empty one."""
    docs, own = _keyed(docs.select(*COLUMNS))
    judged = written(near_dups.near_duplicates(docs.select(F.col("key_").alias("doc_id"), "text"), k=5, percent=80).withColumnRenamed("doc_id", "key_"), "pipeline-groups")
    if own:
        ids = judged.join(docs.select("key_", "doc_id").distinct(), "key_")
        groups = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).getField("key_").alias("first"), F.countDistinct("key_").alias("n"))
        groups = written(groups.where("n > 1").select("component_id", "first"), "pipeline-firsts")
        gone = judged.join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS // 2 else groups, "component_id").where("key_ <> first")
    else:
        gone = judged.where("not kept")
    gone = written(gone.select("key_").distinct(), "pipeline-gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "key_", "left_anti")
    repeated = judged.join(gone, "key_", "left_anti").groupBy("key_").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words")).where("n > 1").select("key_", "words")
    n = repeated.count()
    if not n:
        return left.select(*COLUMNS)
    repeated = F.broadcast(repeated) if n <= BROADCAST_IDS // 2 else repeated
    marked = left.join(repeated, "key_", "left")
    folds = F.col("words").isNotNull() & (F.col("doc_id").isNotNull() | (F.col("words") > 0))
    return marked.where(~folds).select(*COLUMNS).union(marked.where(folds).dropDuplicates(["key_"]).select(*COLUMNS))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are contaminated by benchmark items.

    Null and empty texts have no words, so they stay, as all do where the benchmark is empty; rows that repeat are judged
    alike; texts of any length are searched whole. An empty table gives an empty one."""
    judged = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left.

    Null and empty texts have no tokens; rows that repeat have a row each; a long text is put together by one task. An empty
    table gives an empty one."""
    return bpe.digests(docs.select("doc_id", "text"), *bpe.vocabulary())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("tokens", tokens),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
