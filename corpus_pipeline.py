"""The corpus pipeline: documents in, packed sequences out, in five stages.

Each stage works on all rows its predecessor kept; all but the last return the columns of
documents. Rejected documents leave at the first two stages; the third keeps one document of each
group of near-duplicates; the fourth repeats documents to meet the mixture's targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import language, quality
from feedloom.llm.mixing import mixed_documents
from feedloom.llm.common import BROADCAST_IDS, cut, discard, join_by_key, small, written
from feedloom.llm.near_dedup import grouped, with_check
from feedloom.llm.packing import pack
from feedloom.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.5), learned from their labels.

    Null, empty or wordless text: scored by the bias alone. Null doc_id and repeated rows: each is scored. Empty table: no rows.
    """
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, weights).where("predicted = 1").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is near to a learned one; the others, and texts that are null or hold no letter, go.

    Null doc_id, null lang and repeated rows: each is read by its text. Without any known language all go. Empty table: no rows.
    """
    return language.identify(docs, language.train(docs)).where("not rejected").select(*docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over five-word shingles: that of the smallest doc_id.

    Of several rows of a group with that doc_id, or of a group without any doc_id, the first by text
    stays. Rows of different groups stay, also if they share a null or repeated doc_id; so do
    different texts without a word. Rows of a doc_id that occurs once are known by it, the others by
    doc_id and set of shingles. Empty table: no rows.
    """
    groups = written(grouped(docs.select("doc_id", "text"), n=5, percent=80))
    ids = groups.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    sized = lambda df: F.broadcast(df) if small(df, BROADCAST_IDS) else df
    ids = cut(ids.where("not kept or n > 1"))
    gone = ids.where("not kept").select("doc_id", F.lit(True).alias("_gone"))
    left = join_by_key(docs, gone, "doc_id", "text", "left", BROADCAST_IDS).where("_gone is null").drop("_gone")
    twice = ids.where("kept and n > 1").select(F.col("doc_id").alias("_t"))
    if twice.isEmpty():
        return left
    twice, same = sized(twice), F.col("doc_id").eqNullSafe(F.col("_t"))
    kept = groups.where("kept and check is not null").join(twice, same, "left_semi").select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), F.col("grp").alias("_grp")).distinct()
    again = with_check(left.join(twice, same, "left_semi").select(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("r"), "doc_id", "text"), 5)
    placed = again.where("check is not null").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check")))
    one = F.min("r").alias("r")
    first = placed.groupBy("doc_id", "_grp").agg(one).select("doc_id", "r").unionByName(again.where("check is null").groupBy("doc_id", "text").agg(one).select("doc_id", "r"))
    return left.join(twice, same, "left_anti").unionByName(first.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in docs.columns if c != "doc_id"]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The 3:1:2 mixture of one and a half times the words left; a document stands there as often as it is taken.

    Null or wordless text: never taken. Null source: a source of its own. Rows of one doc_id share its place in the order. Empty table: no rows.
    """
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mixture in sequences of 4096 tokens.

    Null or empty text: its end token. Null doc_id and repeated rows: packed like any others. Empty table: no rows.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("language identification", known_language),
    ("MinHash near-dedup", near_deduplicated),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: Classifiers and hashes are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again, and removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
